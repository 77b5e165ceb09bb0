"""Orders, cycles and closures over synthetic edges."""

from codeweft.operators.inheritance import InheritanceFrame, cycles_of, linearised


def test_linearisation():
    assert linearised({"D": ["B", "C"], "B": ["A"], "C": ["A"]}, "D") == ["D", "B", "C", "A"]
    assert linearised({}, "X") == ["X"]
    # Inconsistent: what can be merged is returned.
    assert linearised({"Z": ["X", "Y"], "X": ["A", "B"], "Y": ["B", "A"]}, "Z")[:3] == ["Z", "X", "Y"]
    assert linearised({"a": ["b"], "b": ["a"]}, "a")[0] == "a"


def test_cycles():
    assert list(cycles_of({"c": ["a"], "a": ["b"], "b": ["c"]})) == [["a", "b", "c"]]
    assert list(cycles_of({"a": ["b"], "b": []})) == []
    assert list(cycles_of({"a": ["a"]})) == [["a"]]


def test_frame(spark):
    edges = spark.createDataFrame([("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0), ("x", "y", 0), ("y", "x", 0)], "child string, parent string, ord int")
    g = InheritanceFrame(edges)
    assert {(r["class"], r.ancestor, r.depth) for r in g.ancestors().collect()} == {("D", "B", 1), ("D", "C", 1), ("D", "A", 2), ("B", "A", 1), ("C", "A", 1), ("x", "y", 1), ("y", "x", 1)}
    assert {r["class"] for r in g.roots().collect()} == {"A"} and {r["class"] for r in g.leaves().collect()} == {"D"}
    assert {r["class"]: r.mro for r in g.mro().collect()}["D"] == ["D", "B", "C", "A"]
    assert [r.cycle for r in g.cycles().collect()] == [["x", "y"]]
    pairs = spark.createDataFrame([("D", "A"), ("A", "D"), ("A", "A")], "class string, other string")
    assert {(r["class"], r.other): (r.is_ancestor, r.depth) for r in g.related(pairs).collect()} == {("D", "A"): (True, 2), ("A", "D"): (False, -1), ("A", "A"): (False, 0)}
    s = g.statistics().collect()[0]
    assert (s.total_classes, s.total_relationships, s.root_classes, s.leaf_classes, s.circular_inheritance, s.max_inheritance_depth) == (6, 6, 1, 1, 1, 3)
