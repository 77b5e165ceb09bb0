"""A fluent front: files in, tables out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .functions.tables import LANGUAGES
from .operators import depsusage, parse, signatures
from .operators.inheritance import InheritanceFrame
from .plans import plugins
from .sources import files


class CodeFrame:
    """Source files with the analyses that start from them."""

    def __init__(self, rows: DataFrame):
        self.files = rows
        self._held: dict[str, DataFrame] = {}

    @classmethod
    def scan(cls, spark: SparkSession, app_dirs: Iterable[str], import_dirs: Iterable[str] = (), exclude: Iterable[str] = (), include_imports: bool = False, languages: Iterable[str] = tuple(LANGUAGES)) -> CodeFrame:
        return cls(files.source_files(spark, app_dirs, import_dirs, exclude, include_imports, languages))

    @classmethod
    def from_dataframe(cls, df: DataFrame, **names) -> CodeFrame:
        return cls(files.from_dataframe(df, **names))

    def prepared(self, *kinds: str, mode: str = "failfast") -> CodeFrame:
        """The same files with the tables of some kinds (``parse.KINDS``) read off one parse; the methods below then use them."""
        out = CodeFrame(self.files)
        out._held = {**self._held, **parse.together(self.files, kinds, mode)}
        return out

    def table(self, kind: str) -> DataFrame:
        held = self._held.get(kind)
        return held if held is not None else parse.table(self.files, kind)

    def cst(self) -> DataFrame:
        return self.table("cst")

    def query(self, *patterns: str) -> DataFrame:
        return parse.query(self.files, patterns)

    def walk(self, visitor: parse.Visitor) -> DataFrame:
        return parse.walk(self.files, visitor)

    def imports(self) -> DataFrame:
        return self.table("imports")

    def functions(self) -> DataFrame:
        return self.table("functions")

    def classes(self) -> DataFrame:
        return self.table("classes")

    def inheritance(self) -> InheritanceFrame:
        return InheritanceFrame(self.table("inheritance").withColumnRenamed("path", "file"))

    def usage(self) -> DataFrame:
        return depsusage.hinted(self.table("evidence"))

    def strip_comments(self) -> DataFrame:
        held = self._held.get("strip_comments")
        return held if held is not None else parse.strip_comments(self.files)

    def call_graph(self) -> DataFrame:
        return self.table("call_edges")

    def assignments(self) -> DataFrame:
        return self.table("assign_edges")

    def truncated(self) -> DataFrame:
        """Files whose call graph or traversal was cut off."""
        return self.table("limits").filter("calls_truncated OR items_truncated")

    def errors(self, *kinds: str) -> DataFrame:
        return parse.errors(self.files, kinds or tuple(parse.KINDS))

    def dfs(self) -> DataFrame:
        return parse.dfs_items(self.files, places=True)

    def evidence(self, sigs: list[dict]) -> DataFrame:
        """Matched steps with the places of identifier, caller and callee."""
        return signatures.evidence(self.dfs(), signatures.conditions(self.files.sparkSession, sigs))

    def match(self, sigs: list[dict]) -> DataFrame:
        return signatures.matches(self.evidence(sigs))

    def run(self, chosen: Iterable[plugins.Plugin]) -> dict[str, DataFrame]:
        return plugins.run(self.files, chosen)
