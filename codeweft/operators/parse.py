"""Tables read off source files, one file at a time.

Each function takes files (path, language, content) and returns rows keyed by
path.  A file is parsed in one place and its rows leave together, so none of
these shuffles; columns that aren't asked for aren't read.  ``mode``: a file that
can't be handled raises (``failfast``) or is left out (``permissive``); ``errors``
tells which are left out and why.  ``together`` reads several tables off one parse of
each file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import callgraph, facts, patterns
from ..functions.tables import BUILTINS, LANGUAGES
from ..sources.shared import written
from ..syntax import parse

IMPORTS = "ord int, module_name string, module_item string, module_alias string, is_wildcard boolean, line int"
FUNCTIONS = "name string, parameters array<string>, return_type string, function_type string, access string, parent_class string, decorators array<string>, is_abstract boolean, is_static boolean, is_async boolean, body string, start_byte bigint, line int"
CLASSES = "name string, base_classes array<string>, methods array<string>, fields array<string>, constructor string, decorators array<string>, is_abstract boolean, access string"
INHERITANCE = "ord int, child string, parent string, relationship string, line int"
EVIDENCE = "ord int, module_name string, module_item string, module_alias string, is_wildcard boolean, identifier string, line int"
AT = "struct<start_byte:bigint,end_byte:bigint,start_row:int,start_col:int,end_row:int,end_col:int>"
CST = "node_id int, parent_id int, type string, start_byte bigint, end_byte bigint, start_row int, start_col int, end_row int, end_col int, text string"
ARGUMENTS = "array<array<struct<ns:string,is_literal:boolean>>>"
CALLS = f"seq int, caller string, callee string, identifier_text string, identifier_line int, args {ARGUMENTS}, truncated boolean"
ASSIGNMENTS = "seq int, src string, dst string, dst_is_literal boolean"
LEAVES = "src string, ord int, leaf string"
ITEMS = f"seq int, namespace string, caller string, identifier_text string, identifier_line int, args {ARGUMENTS}, depth int, terminal boolean, truncated boolean"
PLACES = f"identifier_at {AT}, caller_at {AT}, callee_at {AT}"
MATCHES = f"query int, match int, pattern int, capture string, type string, text string, at {AT}"
LIMITS = "calls_truncated boolean, items_truncated boolean, nodes int, assignments int, items int"
BATCH_ROWS = 4096


class File:
    """One file; what is derived from it is made once."""

    def __init__(self, path: str, language: str, content: str):
        self.path, self.language, self.content = path, language, content

    @cached_property
    def root(self):
        return parse(self.content, self.language)

    @cached_property
    def imports(self) -> list[tuple]:
        return list(facts.imports(self.root, self.language))

    @cached_property
    def graph(self) -> callgraph.Graph:
        return callgraph.build(self.path, self.root, self.language, self.imports)

    @cached_property
    def byte(self):
        """From positions in the text to bytes in its UTF-8."""
        return _byte_offsets(self.content)

    def at(self, n) -> dict | None:
        """Where a node is; null without one."""
        if n is None:
            return None
        a, b = n.source.point(n.start), n.source.point(n.end)
        return {"start_byte": self.byte(n.start), "end_byte": self.byte(n.end), "start_row": a[0], "start_col": a[1], "end_row": b[0], "end_col": b[1]}


def per_file(files: DataFrame, fn: Callable[[str, str, str], Iterable[tuple]], schema: str, mode: str = "failfast") -> DataFrame:
    """Rows of fn(path, language, content), with the path before them."""
    if mode not in ("failfast", "permissive"):
        raise ValueError(f"no such mode: {mode}")
    struct = T.StructType.fromDDL("path string, language string, " + schema)

    def run(batches):
        arrow = to_arrow_schema(struct)
        held: list[tuple] = []
        for batch in batches:
            for path, language, content in zip(*[c.to_pylist() for c in batch.columns]):
                try:
                    held += [(path, language, *row) for row in fn(path, language, content or "")]
                except Exception:
                    if mode == "failfast":
                        raise
                if len(held) >= BATCH_ROWS:
                    yield _batch(held, arrow)
                    held = []
        if held:
            yield _batch(held, arrow)

    known = files.filter("language IS NOT NULL").select("path", "language", F.col("content").cast("string").alias("content"))
    return known.mapInArrow(run, struct)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _byte_offsets(text: str):
    if text.isascii():
        return int
    sums = [0]
    for c in text:
        sums.append(sums[-1] + len(c.encode("utf-8", "surrogatepass")))
    return sums.__getitem__


# -- rows of one file ------------------------------------------------------------------
def _cst(f: File):
    ids = {}
    for i, n in enumerate(f.root.walk()):
        ids[id(n)] = i
        a, b = n.source.point(n.start), n.source.point(n.end)
        yield i, ids.get(id(n.parent), -1), n.type, f.byte(n.start), f.byte(n.end), a[0], a[1], b[0], b[1], None if n.kids else n.text


def _numbered(rows: Iterable[tuple]) -> Iterable[tuple]:
    return ((i, *x) for i, x in enumerate(rows))


def _normal(x: tuple, language: str) -> tuple[str, str, str]:
    module, item, alias = x[:3]
    if language == "go":
        module, item, alias = module.strip('"'), item.strip('"'), alias.strip('"').split("/")[-1]
    return module, item, alias


def _bound(f: File) -> dict[str, tuple[str, str, str]]:
    """What each identifier that an import binds stands for; the last import wins."""
    out = {}
    for x in f.imports:
        module, item, alias = _normal(x, f.language)
        if not x[3]:
            out[alias or item or module] = module, item, alias
    return out


def _evidence(f: File):
    n = 0
    for x in f.imports:
        if x[3]:
            yield n, *_normal(x, f.language), True, "", x[4]
            n += 1
    keys = _bound(f)
    for text, line in facts.identifiers(f.root, f.language):
        if text in keys:
            yield n, *keys[text], False, text, line
            n += 1


def _args(args: list) -> list:
    return [[{"ns": ns, "is_literal": literal} for ns, literal in a] for a in args]


def _calls(f: File):
    for i, c in enumerate(f.graph.calls):
        n = c.identifier
        yield i, c.caller, c.callee, n.text if n else "", n.row if n else -1, _args(c.args), f.graph.truncated


def _assignments(f: File):
    i = 0
    for src, targets in f.graph.targets.items():
        for dst in targets:
            yield i, src, dst, f.graph.literal(dst)
            i += 1


def _leaves(f: File):
    for src, targets in f.graph.targets.items():
        if targets:
            for i, leaf in enumerate(f.graph.resolve(src)):
                yield src, i, leaf


def _reach(f: File):
    calls: dict[str, list[str]] = {}
    for c in f.graph.calls:
        calls.setdefault(c.caller, []).append(c.callee)
    seen: set[str] = set()
    todo = list(calls.get(f.path, []))
    while todo:
        ns = todo.pop()
        if ns not in seen:
            seen.add(ns)
            todo += calls.get(ns, [])
    return ((x,) for x in sorted(seen))


def _items(f: File, limit: int = callgraph.MAX_ITEMS, places: bool = False):
    items, cut = callgraph.traverse(f.graph, limit)
    cut = cut or f.graph.truncated
    for i, x in enumerate(items):
        row = i, x.namespace, x.caller, x.identifier.text if x.identifier else "", x.identifier.row if x.identifier else -1, _args(x.args), x.depth, x.terminal, cut
        yield (*row, f.at(x.identifier), f.at(f.graph.nodes.get(x.caller)), f.at(f.graph.nodes.get(x.namespace))) if places else row


def _limits(f: File):
    items, cut = callgraph.traverse(f.graph)
    yield f.graph.truncated, cut, len(f.graph.nodes), len(f.graph.targets), len(items)


def _shown_graphs(f: File):
    """Lines of both graphs; built-in names that lead nowhere are left out."""
    g, known, i = f.graph, set(BUILTINS[f.language]), 0
    calls: dict[str, list[str]] = {}
    for c in g.calls:
        calls.setdefault(c.caller, []).append(c.callee)
    by: dict[str, int] = {}
    for targets in g.targets.values():
        for t in targets:
            by[t] = by.get(t, 0) + 1
    for ns, targets in g.targets.items():
        if targets or ns not in known:
            yield i, "assignments", f"{ns} (->{by.get(ns, 0)}) => [{' '.join(targets)}]"
            i += 1
    for ns in g.nodes:
        if ns in calls or ns not in known:
            yield i, "calls", f"{ns} (calls)=> [{' '.join(calls.get(ns, []))}]"
            i += 1


def _shown_classes(f: File):
    for x in facts.classes(f.root, f.language):
        yield x[0], facts.shown_class(x)


@dataclass(frozen=True)
class Kind:
    """A table read off files: its columns, the rows of one file, the languages that have it."""

    schema: str
    rows: Callable[[File], Iterable[tuple]]
    languages: tuple[str, ...] = tuple(LANGUAGES)


OBJECT_ORIENTED = ("python", "java")
KINDS = {
    "cst": Kind(CST, _cst),
    "imports": Kind(IMPORTS, lambda f: _numbered(f.imports)),
    "functions": Kind(FUNCTIONS, lambda f: facts.functions(f.root, f.language)),
    "classes": Kind(CLASSES, lambda f: facts.classes(f.root, f.language), OBJECT_ORIENTED),
    "shown_classes": Kind("name string, shown string", _shown_classes, OBJECT_ORIENTED),
    "inheritance": Kind(INHERITANCE, lambda f: _numbered(facts.inheritance(f.root, f.language)), OBJECT_ORIENTED),
    "strip_comments": Kind("stripped string", lambda f: [(facts.stripped(f.content, f.language),)], ("python", "javascript")),
    "evidence": Kind(EVIDENCE, _evidence),
    "call_edges": Kind(CALLS, _calls),
    "assign_edges": Kind(ASSIGNMENTS, _assignments),
    "resolved": Kind(LEAVES, _leaves),
    "reachable": Kind("callee string", _reach),
    "dfs_items": Kind(ITEMS, _items),
    "limits": Kind(LIMITS, _limits),
    "shown_graphs": Kind("ord int, graph string, line string", _shown_graphs),
}


def table(files: DataFrame, kind: str, mode: str = "failfast") -> DataFrame:
    """The rows of one kind."""
    rows = KINDS[kind].rows
    return per_file(files, lambda p, lang, c: rows(File(p, lang, c)), KINDS[kind].schema, mode)


def errors(files: DataFrame, kinds: Iterable[str] = tuple(KINDS), beyond: bool = False) -> DataFrame:
    """(path, language, kind, error): what permissive mode leaves out, of the kinds that the language has (beyond: of all)."""
    asked = list(kinds)

    def rows(path: str, language: str, content: str):
        f = File(path, language, content)
        for k in asked:
            if beyond or language in KINDS[k].languages:
                try:
                    for _ in KINDS[k].rows(f):
                        pass
                except Exception as e:
                    yield k, f"{type(e).__name__}: {e}"

    return per_file(files, rows, "kind string, error string")


def together(files: DataFrame, kinds: Iterable[str], mode: str = "failfast") -> dict[str, DataFrame]:
    """Tables of several kinds off one parse of each file; a kind holds the files of its languages.

    The rows are written to the shared folder once, parted by kind.
    """
    asked = list(dict.fromkeys(kinds))
    schema = ", ".join(["kind string", *[f"`{k}` struct<{_as_struct(KINDS[k].schema)}>" for k in asked]])
    names = {k: T.StructType.fromDDL(KINDS[k].schema).names for k in asked}

    def rows(path: str, language: str, content: str):
        f = File(path, language, content)
        out = []
        for i, k in enumerate(asked):
            if language in KINDS[k].languages:
                out += [(k, *[dict(zip(names[k], row)) if j == i else None for j in range(len(asked))]) for row in KINDS[k].rows(f)]
        return out

    held = written(per_file(files, rows, schema, mode), "facts", by="kind")
    return {k: held.filter(F.col("kind") == k).select("path", "language", f"{k}.*") for k in asked}


def _as_struct(ddl: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields)


# -- tables ---------------------------------------------------------------------------------
def cst(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """Syntax nodes, parents before children; leaves with their text."""
    return table(files, "cst", mode)


def imports(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """Bindings by import, one row each, numbered in order of emission."""
    return table(files, "imports", mode)


def functions(files: DataFrame, mode: str = "failfast") -> DataFrame:
    return table(files, "functions", mode)


def classes(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """Classes of Python and Java files; files of other languages raise, or are left out in permissive mode."""
    return table(files, "classes", mode)


def shown_classes(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """(path, language, name, shown): classes in one line each."""
    return table(files, "shown_classes", mode)


def inheritance(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """Edges from classes to their bases."""
    return table(files, "inheritance", mode)


def strip_comments(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """(path, language, stripped) of Python and JavaScript files."""
    return table(files.filter(F.col("language").isin("python", "javascript")), "strip_comments", mode)


def evidence(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """Uses of imported names: wildcards first, then each identifier that an import binds."""
    return table(files, "evidence", mode)


def call_edges(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """Calls of each file in order: a row for each call and callee. truncated: the file's graph was cut off."""
    return table(files, "call_edges", mode)


def assign_edges(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """What each name may stand for, directly."""
    return table(files, "assign_edges", mode)


def resolved(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """(path, language, src, ord, leaf): what each name stands for in the end. Assignments never leave a file, so neither does this."""
    return table(files, "resolved", mode)


def reachable(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """(path, language, callee): everything that a file, as its own first caller, leads to; within the file as well."""
    return table(files, "reachable", mode)


def dfs_items(files: DataFrame, limit: int = callgraph.MAX_ITEMS, mode: str = "failfast", places: bool = False) -> DataFrame:
    """Steps of the traversal of each file's call graph. truncated: the graph or the traversal was cut off.

    places: with the places of the identifier and of caller and callee where the file declares them.
    """
    return per_file(files, lambda p, lang, c: _items(File(p, lang, c), limit, places), f"{ITEMS}, {PLACES}" if places else ITEMS, mode)


def limits(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """One row for each file: whether its call graph or its traversal was cut off, and their sizes."""
    return table(files, "limits", mode)


def shown_graphs(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """Both graphs of each file in lines."""
    return table(files, "shown_graphs", mode)


def query(files: DataFrame, queries: Iterable[str], mode: str = "failfast") -> DataFrame:
    """Captures of patterns (``functions.patterns``): of each file query by query, match by match, a row for each capture."""
    asked = [patterns.read(q) for q in queries]

    def rows(path: str, language: str, content: str):
        f = File(path, language, content)
        for q, ps in enumerate(asked):
            for m, (p, found) in enumerate(patterns.matches(ps, f.root)):
                for name, n in found:
                    yield q, m, p, name, n.type, n.text, f.at(n)

    return per_file(files, rows, MATCHES, mode)


@dataclass(frozen=True)
class Visitor:
    """Hooks over files: rows of ``schema`` from a file's text, then from each of its nodes, parents first."""

    schema: str
    languages: tuple[str, ...] = tuple(LANGUAGES)
    on_file: Callable[[str, str, str], Iterable[tuple]] | None = None
    on_node: Callable[[str, str, object], Iterable[tuple]] | None = None


def walk(files: DataFrame, visitor: Visitor, mode: str = "failfast") -> DataFrame:
    """What a visitor gives for the files of its languages; an error of a hook ends the walk unless permissive."""

    def rows(path: str, language: str, content: str):
        if visitor.on_file is not None:
            yield from visitor.on_file(path, language, content)
        if visitor.on_node is not None:
            for n in parse(content, language).walk():
                yield from visitor.on_node(path, language, n)

    return per_file(files.filter(F.col("language").isin(*visitor.languages)), rows, visitor.schema, mode)
