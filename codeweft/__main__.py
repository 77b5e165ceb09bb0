"""Analyses from the command line.

    python -m codeweft files DIR...            the source files found
    python -m codeweft imports DIR...          and functions, classes, inheritance, usage, calls, assignments, graphs
    python -m codeweft strip DIR...            sources without comments
    python -m codeweft query DIR... --pattern '(call function: (identifier) @f)'
    python -m codeweft match DIR... --signatures FILE.yaml
    python -m codeweft ast DIR... --out DIR    syntax nodes as Parquet

Results go to the screen, or with --out to Parquet.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .api import CodeFrame
from .operators import parse, signatures

TABLES = {
    "files": lambda f: f.files.drop("content"),
    "imports": CodeFrame.imports,
    "functions": lambda f: f.functions().drop("body"),
    "classes": lambda f: parse.shown_classes(f.files.filter("language IN ('python', 'java')")),
    "inheritance": lambda f: CodeFrame(f.files.filter("language IN ('python', 'java')")).inheritance().shown(),
    "usage": CodeFrame.usage,
    "strip": CodeFrame.strip_comments,
    "calls": CodeFrame.call_graph,
    "assignments": CodeFrame.assignments,
    "graphs": lambda f: parse.shown_graphs(f.files),
    "ast": CodeFrame.cst,
}


def options(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser("codeweft", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("what", choices=[*TABLES, "query", "match"])
    p.add_argument("dirs", nargs="+")
    p.add_argument("--imports", action="append", default=[], metavar="DIR", help="a root of imports")
    p.add_argument("--exclude", action="append", default=[], metavar="PATTERN")
    p.add_argument("--language", action="append", default=[])
    p.add_argument("--pattern", action="append", default=[])
    p.add_argument("--signatures", metavar="FILE")
    p.add_argument("--out", metavar="DIR")
    p.add_argument("--rows", type=int, default=1000, help="rows shown on the screen")
    return p.parse_args(args)


def result(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    how = {"languages": o.language} if o.language else {}
    frame = CodeFrame.scan(spark, o.dirs, o.imports, o.exclude, bool(o.imports), **how)
    if o.what == "query":
        return frame.query(*o.pattern)
    if o.what == "match":
        return signatures.evidence(frame.dfs(), signatures.load_yaml(spark, o.signatures))
    return TABLES[o.what](frame)


def main(args: list[str] | None = None) -> int:
    o = options(args)
    if o.what == "query" and not o.pattern or o.what == "match" and not o.signatures:
        print(f"{o.what} needs --{'pattern' if o.what == 'query' else 'signatures'}", file=sys.stderr)
        return 2
    found = result(SparkSession.builder.getOrCreate(), o)
    if o.out:
        found.write.parquet(o.out)
        return 0
    for row in found.limit(o.rows).toLocalIterator():
        print("\t".join(str(x) for x in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
