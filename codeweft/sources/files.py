"""Source files as rows: path, rel_path, language, is_import, root, content.

Files come from directories (``source_files``) or from any DataFrame of paths and
contents (``from_dataframe``).  Filters on path, language and is_import are
plain predicates, so Spark drops files before it reads or parses them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import LANGUAGES

SCHEMA = "path string, rel_path string, language string, is_import boolean, root int, content string"


def languages(spark: SparkSession) -> DataFrame:
    """The registry of languages: code, name, object_oriented, extensions."""
    rows = [(code, name, oo, list(exts)) for code, (name, oo, exts) in LANGUAGES.items()]
    return spark.createDataFrame(rows, "code string, name string, object_oriented boolean, extensions array<string>")


def language(code: str) -> tuple[str, bool, tuple[str, ...]]:
    """(name, object-oriented, extensions) of a language."""
    if code not in LANGUAGES:
        raise ValueError(f"unknown language: {code}")
    return LANGUAGES[code]


def extension(path: Column) -> Column:
    """The last extension of a path's last part, with its dot; empty if there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def language_of(path: Column) -> Column:
    """The language of a path by its extension, case-sensitive; null if unknown."""
    out = F.lit(None).cast("string")
    for code, (_, _, exts) in LANGUAGES.items():
        out = F.when(extension(path).isin(*exts), code).otherwise(out)
    return out


def excluded(files: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Without the files whose path any pattern matches anywhere."""
    for p in patterns:
        files = files.filter(~F.col("path").rlike(p))
    return files


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def from_dataframe(df: DataFrame, path: str = "path", content: str = "content", is_import: bool = False, root: int = 0, rel_path: str | None = None) -> DataFrame:
    """Files of a DataFrame with a path and a content column (string or binary); rel_path is a column's, else the path's last part."""
    text = F.col(content)
    if dict(df.dtypes)[content] == "binary":
        text = F.decode(text, "UTF-8")
    p = F.col(path)
    rel = basename(p) if rel_path is None else F.col(rel_path)
    return df.select(p.alias("path"), rel.alias("rel_path"), language_of(p).alias("language"), F.lit(is_import).alias("is_import"), F.lit(root).alias("root"), text.alias("content"))


def bare(path: Column) -> Column:
    """A path without scheme and host: file:/a, file:///a, hdfs://host:1/a and s3a://bucket/a are all /a."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", ""), "^/+", ""))


def relative(path: Column, root: str) -> Column:
    """A path below a root, on any file system; of a root that is the file itself, its name."""
    base = F.concat(F.regexp_replace(bare(F.lit(root)), "/+$", ""), F.lit("/"))
    p = bare(path)
    return F.when(F.startswith(p, base), F.substring(p, F.length(base) + 1, F.length(p))).otherwise(basename(p))


def source_files(spark: SparkSession, app_dirs: Iterable[str], import_dirs: Iterable[str] = (), exclude: Iterable[str] = (), include_imports: bool = False, codes: Iterable[str] = tuple(LANGUAGES)) -> DataFrame:
    """Files under directories of any file system, of the languages asked for; imports only if asked for.

    path is the file's own, rel_path the one below its root.  Only names with a
    fitting extension are listed; the content is read for the rows and queries that
    need it. Spark's reader gives no row for an empty file.
    """
    wanted = [e for c in codes for e in language(c)[2]]
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = None
    groups = [(False, d, i) for i, d in enumerate(app_dirs)] + ([(True, d, i) for i, d in enumerate(import_dirs)] if include_imports else [])
    for is_import, d, i in groups:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(wanted) + "}").load(d)
        # A root without a scheme, or relative, as the file system knows it.
        place = system(d)
        whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
        path = F.regexp_replace("path", "^file:/*", "/")
        part = read.select(path.alias("path"), relative(F.col("path"), whole).alias("rel_path"), language_of(path).alias("language"), F.lit(is_import).alias("is_import"), F.lit(i).alias("root"), F.decode("content", "UTF-8").alias("content"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    return excluded(out, exclude)


def ordered(files: DataFrame) -> DataFrame:
    """App files before imports, root by root, by path."""
    return files.orderBy("is_import", "root", "path")


def find_file(files: DataFrame, name: str) -> DataFrame:
    """The first file of this name relative to its root: app roots in order, then import roots."""
    return files.filter(F.col("rel_path") == name).orderBy("is_import", "root", "path").limit(1)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__last", F.row_number().over(w)).filter("__last = 1").drop("__last")
