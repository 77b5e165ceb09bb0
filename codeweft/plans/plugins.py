"""Plugins: named analyses of the files of certain languages, run together.

A plugin either names a kind of table (``parse.KINDS``) and what to make of its
rows, or takes the files itself.  Those that name kinds share one parse of each
file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import depsusage, parse

Analysis = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Plugin:
    """analyse takes the files, or the rows of ``kind`` where that is given."""

    name: str
    languages: tuple[str, ...]
    analyse: Analysis
    kind: str = ""


def _as_is(rows: DataFrame) -> DataFrame:
    return rows


DEPENDENCY_USAGE = Plugin("dependency_usage", ("python", "javascript", "java", "go"), depsusage.hinted, "evidence")
STRIP_COMMENTS = Plugin("strip_comments", ("python", "javascript"), _as_is, "strip_comments")
CALL_GRAPH = Plugin("call_graph", ("python", "java", "go", "javascript"), _as_is, "call_edges")


def run(files: DataFrame, plugins: Iterable[Plugin], mode: str = "failfast") -> dict[str, DataFrame]:
    """Each plugin's rows over the files of its languages, in the plugins' order."""
    chosen = list(plugins)
    kinds = [p.kind for p in chosen if p.kind]
    tables = parse.together(files, kinds, mode) if kinds else {}
    return {p.name: p.analyse((tables[p.kind] if p.kind else files).filter(F.col("language").isin(*p.languages))) for p in chosen}


def each(rows: DataFrame, callback: Callable) -> None:
    """Calls back with each row on the driver; an error ends the run. For results that a person reads: see ``each_part``."""
    for row in rows.toLocalIterator():
        callback(row)


def each_part(rows: DataFrame, callback: Callable) -> None:
    """Calls back with an iterator of the rows of each part, where the part is; an error ends the run."""
    rows.foreachPartition(callback)
