"""Inheritance graphs of any size over a table of edges (child, parent, …).

Ancestors and descendants are closures by rounds: the pairs found last are joined
with the edges, pairs known already are dropped, until no new ones come.  The
number of rounds is the depth of the deepest hierarchy; cycles end by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


#: Rounds after which the pairs found are written as one table, so that plans stay small.
COMPACT = 8


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): every name reached from src, itself only through a cycle, by the shortest way."""
    direct = written(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    found = last = written(direct.withColumn("depth", F.lit(1)), "reach")
    for depth in count(2):
        new = last.alias("a").join(direct.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").distinct()
        new = written(new.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if new.isEmpty():
            return found
        found, last = found.unionByName(new), new
        if depth % COMPACT == 0:
            found = written(found, "reach")


def linearised(bases: dict[str, list[str]], name: str) -> list[str]:
    """The method resolution order of a class, as far as it is consistent.

    The orders of the bases and the list of bases are merged; a class met again
    on the way to itself ends the order there and is not in its own order twice.  No
    hierarchy is too deep or wide.
    """
    done: dict[str, list[str]] = {}
    #: The way to the class at hand: a class, its bases still to do, the orders of those done.
    way = [(name, iter(bases.get(name, [])), [])]
    above = {name}
    while way:
        here, left, orders = way[-1]
        base = next(left, None)
        if base is not None and (base in done or base in above):
            orders.append(done.get(base, [base]))
        elif base is not None:
            way.append((base, iter(bases.get(base, [])), []))
            above.add(base)
        else:
            done[here] = [here, *[x for x in merged([*orders, bases.get(here, [])]) if x != here]]
            way.pop()
            above.discard(here)
            if way:
                way[-1][2].append(done[here])
    return done[name]


def merged(lists: list[list[str]]) -> list[str]:
    """Heads of the lists, one by one, that stand in no list's rest; as far as there is one."""
    at = [0] * len(lists)
    #: In how many lists a name stands behind the head.
    behind: dict[str, int] = {}
    for q in lists:
        for x in q[1:]:
            behind[x] = behind.get(x, 0) + 1
    out = []
    while True:
        good = next((q[i] for q, i in zip(lists, at) if i < len(q) and not behind.get(q[i])), None)
        if good is None:
            return out
        out.append(good)
        for k, q in enumerate(lists):
            if at[k] < len(q) and q[at[k]] == good:
                at[k] += 1
                if at[k] < len(q):
                    behind[q[at[k]]] -= 1


def by_breadth(bases: dict[str, list[str]], name: str) -> list[str]:
    """All classes above one, nearest first, in the order of the bases; never the class itself."""
    seen, out = {name}, [name]
    for c in out:
        for p in bases.get(c, []):
            if p not in seen:
                seen.add(p)
                out.append(p)
    return out[1:]


def cycles_of(bases: dict[str, list[str]]) -> Iterator[list[str]]:
    """A cycle for each edge that leads back onto the path, from its smallest name on."""
    seen: set[str] = set()
    for start in sorted(bases):
        if start in seen:
            continue
        path, steps = [start], [iter(bases.get(start, []))]
        seen.add(start)
        while steps:
            step = next(steps[-1], None)
            if step is None:
                path.pop()
                steps.pop()
            elif step in path:
                ring = path[path.index(step) :]
                least = ring.index(min(ring))
                yield ring[least:] + ring[:least]
            elif step not in seen:
                seen.add(step)
                path.append(step)
                steps.append(iter(bases.get(step, [])))


class InheritanceFrame:
    """Edges (child, parent, relationship, file, line, ord) with questions about them."""

    COLUMNS = ("child", "parent", "relationship", "file", "line", "ord")

    def __init__(self, edges: DataFrame, classes: DataFrame | None = None):
        for name, value in (("relationship", F.lit("inherits")), ("file", F.lit("")), ("line", F.lit(0)), ("ord", F.lit(0))):
            if name not in edges.columns:
                edges = edges.withColumn(name, value)
        # Written once: what is asked of the graph reads the edges many times.
        self.edges = written(edges.select(*self.COLUMNS), "inheritance")
        ends = self.edges.select(F.explode(F.array("child", "parent")).alias("class"))
        self.classes = (ends if classes is None else ends.unionByName(classes.select("class"))).distinct()
        self._up: DataFrame | None = None

    @classmethod
    def from_classes(cls, classes: DataFrame, file: str = "path") -> InheritanceFrame:
        """From a table of classes: an edge for each base; classes without bases are kept as such."""
        named = classes.filter("name <> ''")
        edges = named.select(F.col("name").alias("child"), F.posexplode("base_classes").alias("ord", "parent"), F.col(file).alias("file")).filter("parent <> ''")
        return cls(edges.withColumn("line", F.lit(1)), named.select(F.col("name").alias("class")))

    def union(self, other: InheritanceFrame) -> InheritanceFrame:
        """Both graphs' edges; classes without edges don't come over."""
        return InheritanceFrame(self.edges.unionByName(other.edges), self.classes)

    def parents(self, name: str) -> DataFrame:
        return self.edges.filter(F.col("child") == name).orderBy("file", "ord").select("parent", "relationship", "file", "line")

    def children(self, name: str) -> DataFrame:
        return self.edges.filter(F.col("parent") == name).orderBy("file", "ord").select("child", "relationship", "file", "line")

    @property
    def up(self) -> DataFrame:
        """(src, dst, depth): classes and what they inherit from."""
        if self._up is None:
            self._up = written(closure(self.edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"))), "ancestors")
        return self._up

    def ancestors(self) -> DataFrame:
        """(class, ancestor, depth); never a class itself. For their order see ``ancestry``."""
        return self.up.filter("src <> dst").select(F.col("src").alias("class"), F.col("dst").alias("ancestor"), "depth")

    def descendants(self) -> DataFrame:
        return self.up.filter("src <> dst").select(F.col("dst").alias("class"), F.col("src").alias("descendant"), "depth")

    def related(self, pairs: DataFrame) -> DataFrame:
        """pairs (class, other) with is_ancestor (other is one of class) and depth (0 for itself, -1 if unrelated)."""
        up = self.up.select(F.col("src").alias("class"), F.col("dst").alias("other"), F.col("depth").alias("d"))
        both = pairs.join(up, ["class", "other"], "left")
        return both.select("class", "other", (F.col("d").isNotNull() & (F.col("class") != F.col("other"))).alias("is_ancestor"), F.when(F.col("class") == F.col("other"), 0).otherwise(F.coalesce("d", F.lit(-1))).alias("depth"))

    def roots(self) -> DataFrame:
        return self.classes.join(self.edges.select(F.col("child").alias("class")), "class", "left_anti")

    def leaves(self) -> DataFrame:
        return self.classes.join(self.edges.select(F.col("parent").alias("class")), "class", "left_anti")

    def _each(self, members: DataFrame, fn, schema: str) -> DataFrame:
        """fn(group, bases) over the edges of each group, many groups to a batch; members: (group, class)."""
        edges = self.edges.select(F.col("child").alias("class"), "parent", "file", "ord")
        rows = members.join(edges, "class", "left").groupBy("group").agg(F.collect_list(F.struct("class", "file", "ord", "parent")).alias("rows"))

        def run(frames):
            for pdf in frames:
                out = []
                for group, held in zip(pdf["group"], pdf["rows"]):
                    bases: dict[str, list[str]] = {}
                    for r in sorted(held, key=lambda r: (r["class"], r["file"] or "", r["ord"] or 0, r["parent"] or "")):
                        mine = bases.setdefault(r["class"], [])
                        if r["parent"] is not None and r["parent"] not in mine:
                            mine.append(r["parent"])
                    out += fn(group, bases)
                yield pd.DataFrame(out, columns=names)

        names = [part.split()[0] for part in schema.split(", ")]
        return rows.mapInPandas(run, schema)

    def mro(self) -> DataFrame:
        """(class, mro array): method resolution orders. A group is a class with its ancestors."""
        members = self.classes.select(F.col("class").alias("group"), "class").unionByName(self.ancestors().select(F.col("class").alias("group"), F.col("ancestor").alias("class")))
        return self._each(members, lambda g, bases: [(g, linearised(bases, g))], "class string, mro array<string>")

    def ancestry(self) -> DataFrame:
        """(class, ancestors array): nearest first, those of one distance in the order of the bases. A group is a class with its ancestors."""
        members = self.classes.select(F.col("class").alias("group"), "class").unionByName(self.ancestors().select(F.col("class").alias("group"), F.col("ancestor").alias("class")))
        return self._each(members, lambda g, bases: [(g, by_breadth(bases, g))], "class string, ancestors array<string>")

    def cycles(self) -> DataFrame:
        """(cycle array): one for each edge that closes a cycle, its smallest name first. A group is a set of classes that reach each other."""
        back = self.up.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        mutual = self.up.select("src", "dst").join(back, ["src", "dst"], "left_semi")
        members = mutual.groupBy("src").agg(F.min("dst").alias("group")).select("group", F.col("src").alias("class"))

        def run(g: str, bases: dict[str, list[str]]) -> list[tuple]:
            inside = {c: [p for p in ps if p in bases] for c, ps in bases.items()}
            return [(c,) for c in cycles_of(inside)]

        return self._each(members, run, "cycle array<string>")

    def statistics(self) -> DataFrame:
        """One row: classes, relationships, roots, leaves, cycles, and the most ancestors of a class."""
        most = self.ancestors().groupBy("class").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n"))
        parts = [("total_classes", self.classes), ("total_relationships", self.edges), ("root_classes", self.roots()), ("leaf_classes", self.leaves()), ("circular_inheritance", self.cycles())]
        counts = most.select(F.lit("max_inheritance_depth").alias("what"), "n")
        for name, df in parts:
            counts = counts.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n"))
        names = [*[n for n, _ in parts], "max_inheritance_depth"]
        return counts.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in names])

    def shown(self) -> DataFrame:
        """Each edge in one line. The format is a fixed value."""
        at = F.when(F.col("file") == "", "").otherwise(F.format_string(" at %s:%d", "file", "line"))
        return self.edges.select(F.concat_ws(" ", "child", "relationship", F.concat("parent", at)).alias("shown"))

    def described(self) -> DataFrame:
        """The graph in one line. The format is a fixed value."""
        n = F.col("circular_inheritance")
        line = F.format_string("InheritanceGraph{classes: %d, relationships: %d}", "total_classes", "total_relationships")
        return self.statistics().select(F.concat(line, F.when(n > 0, F.format_string(", WARNING: %d circular inheritance detected", n)).otherwise("")).alias("shown"))
