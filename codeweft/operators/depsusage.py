"""Which packages a file uses, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import package_hint
from ..functions.tables import LANGUAGES
from . import parse


def hinted(rows: DataFrame) -> DataFrame:
    """Evidence rows with the hint of their package."""
    hint = F.lit("")
    for code in LANGUAGES:
        hint = F.when(F.col("language") == code, package_hint(F.col("module_name"), code)).otherwise(hint)
    return rows.withColumn("package_hint", hint)


def usage_evidence(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """Evidence rows with the hint of their package."""
    return hinted(parse.evidence(files, mode))


def identifier_map(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """(path, language, identifier, module_name, module_item, module_alias): what each identifier that an import binds stands for; the last import wins."""

    def rows(path: str, language: str, content: str):
        return ((k, *x) for k, x in parse._bound(parse.File(path, language, content)).items())

    return parse.per_file(files, rows, "identifier string, module_name string, module_item string, module_alias string", mode)


def usage_by_package(files: DataFrame) -> DataFrame:
    """(package_hint, files, uses) over all files."""
    return usage_evidence(files).groupBy("package_hint").agg(F.count_distinct("path").alias("files"), F.count("*").alias("uses"))


def unused_imports(files: DataFrame) -> DataFrame:
    """Bindings that no identifier of their file uses."""

    def rows(path: str, language: str, content: str):
        f = parse.File(path, language, content)
        used = {t for t, _ in parse.facts.identifiers(f.root, language)}
        for i, x in enumerate(f.imports):
            module, item, alias = parse._normal(x, language)
            if not x[3] and (alias or item or module) not in used:
                yield i, module, item, alias, x[4]

    return parse.per_file(files, rows, "ord int, module_name string, module_item string, module_alias string, line int")
