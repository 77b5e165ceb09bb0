"""Deep hierarchies, shared folders, one parse for many tables, the command line."""

import types

import pytest
from pyspark.sql import functions as F

from codeweft import __main__ as cli
from codeweft.api import CodeFrame
from codeweft.operators import parse
from codeweft.operators.inheritance import InheritanceFrame, by_breadth, linearised
from codeweft.plans import plugins
from codeweft.sources import files as S
from codeweft.sources import shared


def test_orders_of_deep_and_wide_hierarchies():
    deep = {f"c{i}": [f"c{i + 1}"] for i in range(5000)}
    assert linearised(deep, "c0") == [f"c{i}" for i in range(5001)] and len(by_breadth(deep, "c0")) == 5000
    wide = {"x": [f"b{i}" for i in range(2000)]} | {f"b{i}": ["o"] for i in range(2000)}
    assert linearised(wide, "x") == ["x", *[f"b{i}" for i in range(2000)], "o"]
    assert linearised({"a": ["b"], "b": ["a"]}, "a") == ["a", "b"] and by_breadth({"a": ["b"], "b": ["a"]}, "a") == ["b"]
    # No consistent order: as far as it goes.
    assert linearised({"z": ["x", "y"], "x": ["a", "b"], "y": ["b", "a"]}, "z") == ["z", "x", "y"]


@pytest.mark.parametrize("path,root,want", [("hdfs://nn:8020/src/pkg/a.py", "hdfs://nn:8020/src", "pkg/a.py"), ("s3a://bucket/src/a.py", "s3a://bucket/src/", "a.py"), ("file:/tmp/x/a.py", "file:///tmp/x", "a.py"), ("file:///tmp/x/a.py", "/tmp/x", "a.py"), ("/tmp/src/src/a.py", "/tmp/src", "src/a.py"), ("hdfs://nn/one/a.py", "hdfs://nn/one/a.py", "a.py")])
def test_paths_below_roots(spark, path, root, want):
    assert spark.range(1).select(S.relative(F.lit(path), root).alias("r")).collect()[0].r == want


def test_a_cluster_without_a_shared_folder_raises():
    conf = types.SimpleNamespace(get=lambda key, other: other)
    with pytest.raises(RuntimeError):
        shared.shared_dir(types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077")))


def frame(spark):
    rows = [("p/x.py", "import os\nos.run('MD5')\nclass A(B): pass\n"), ("p/z.js", "// c\nf();"), ("p/J.java", "class J extends K { int x; }")]
    return CodeFrame.from_dataframe(spark.createDataFrame(rows, "path string, content string"))


def test_tables_of_one_parse(spark):
    f = frame(spark)
    ready = f.prepared("imports", "evidence", "call_edges", "inheritance", "strip_comments", "limits")
    for kind in ("imports", "evidence", "call_edges"):
        assert sorted(map(str, ready.table(kind).collect())) == sorted(map(str, f.table(kind).collect()))
    assert ready.imports().schema == f.imports().schema
    assert ready.usage().count() == 1 and ready.strip_comments().count() == 2 and ready.truncated().count() == 0
    assert {(r.child, r.parent) for r in ready.inheritance().edges.collect()} == {("A", "B"), ("J", "K")}
    # Plugins share the parse too: one scan of the files, of kinds after that.
    found = plugins.run(f.files, [plugins.DEPENDENCY_USAGE, plugins.CALL_GRAPH])
    assert all("MapInArrow" not in x._jdf.queryExecution().toString() for x in found.values())


def test_errors_are_told(spark):
    f = frame(spark)
    assert f.errors().count() == 0
    told = parse.errors(f.files, ["classes"], beyond=True).collect()
    assert [(r.path, r.language, r.kind) for r in told] == [("p/z.js", "javascript", "classes")] and "NotImplementedError" in told[0].error


def test_evidence_says_where(spark):
    sig = {"id": "s", "vendor": "v", "product": "q", "languages": {"python": {"match": "any", "conditions": [{"type": "call", "value": "os.run"}]}}}
    row = frame(spark).evidence([sig]).collect()[0]
    assert (row.vendor, row.product, row.identifier_text) == ("v", "q", "os.run")
    assert (row.identifier_at.start_row, row.identifier_at.start_col, row.identifier_at.end_col) == (1, 0, 6)
    assert row.caller_at.start_byte == 0 and row.callee_at is None and not row.truncated


def test_edges_are_written_once(spark):
    g = frame(spark).prepared("inheritance").inheritance()
    assert "MapInArrow" not in g.statistics()._jdf.queryExecution().toString()
    line = InheritanceFrame(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")).described().collect()[0].shown
    assert line == "InheritanceGraph{classes: 2, relationships: 2}, WARNING: 1 circular inheritance detected"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("import os\nos.run('x')\nclass A(B): pass\n")
    (tmp_path / "s.yaml").write_text("- id: s\n  languages:\n    python:\n      match: any\n      conditions:\n        - {type: call, value: os.run}\n")
    for what, more, want in (("imports", [], "os"), ("usage", [], "os"), ("calls", [], "run"), ("classes", [], "A(B)"), ("inheritance", [], "A inherits B"), ("query", ["--pattern", "(call) @c"], "os.run('x')"), ("match", ["--signatures", str(tmp_path / "s.yaml")], "os//run"), ("graphs", [], "(calls)=>")):
        assert cli.main([what, str(tmp_path), *more]) == 0
        assert want in capsys.readouterr().out
    assert cli.main(["ast", str(tmp_path), "--out", str(tmp_path / "ast")]) == 0
    assert spark.read.parquet(str(tmp_path / "ast")).count() > 5
    assert cli.main(["query", str(tmp_path)]) == 2
