"""Files, columns, signatures and the front, with Spark."""

import pytest
from pyspark.sql import functions as F

from codeweft.api import CodeFrame
from codeweft.functions import columns as C
from codeweft.operators import parse, signatures
from codeweft.plans import plugins
from codeweft.sources import files as S

PY = "import os\nfrom a.b import c\nos.run('MD5')  # x\n"


def frame(spark):
    return CodeFrame.from_dataframe(spark.createDataFrame([("p/x.py", PY), ("p/y.txt", "no"), ("p/z.js", "// c\nf();")], "path string, content string"))


def test_scan_directories(spark, tmp_path):
    for name, text in (("app/m.py", PY), ("app/sub/n.js", "x();"), ("app/skip/o.py", "pass"), ("lib/k.py", "pass"), ("app/r.txt", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    app, lib = str(tmp_path / "app"), str(tmp_path / "lib")
    rows = S.ordered(S.source_files(spark, [app], [lib], exclude=["/skip/"], include_imports=True)).collect()
    assert [(r.rel_path, r.language, r.is_import) for r in rows] == [("m.py", "python", False), ("sub/n.js", "javascript", False), ("k.py", "python", True)]
    assert rows[0].content == PY
    assert S.source_files(spark, [app], [lib], codes=["python"]).count() == 2
    assert S.find_file(S.source_files(spark, [app], [lib], include_imports=True), "k.py").count() == 1
    with pytest.raises(ValueError):
        S.language("cobol")


def test_usage_plugins_and_errors(spark):
    f = frame(spark)
    assert [(r.package_hint, r.identifier, r.line) for r in f.usage().collect()] == [("os", "os", 3)]
    found = f.run([plugins.DEPENDENCY_USAGE, plugins.STRIP_COMMENTS])
    assert found["strip_comments"].count() == 2
    seen = []
    plugins.each(found["dependency_usage"], seen.append)
    assert len(seen) == 1
    with pytest.raises(Exception):
        f.classes().collect()
    assert parse.classes(f.files, mode="permissive").count() == 0
    assert f.cst().filter("type IN ('call', 'call_expression')").count() == 2


def test_tokens_and_comments_in_the_jvm(spark):
    texts = [PY, "a = '''x\ny''' \\\n + b", "// c\nlet r = /a\\/\"/g; /* d */ f(`t${1}`) // e\n", 'func f() { s := `raw "` }', "é ’ \x00 \U0001f600", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for code in ("python", "javascript", "java", "go"):
        assert all(r.same for r in rows.select((F.array_join(C.tokens(F.col("t"), code), "") == F.col("t")).alias("same")).collect())
    js = rows.filter(F.col("t").startswith("//")).select(C.without_comments(F.col("t"), "javascript").alias("s")).collect()[0].s
    assert js == '\nlet r = /a\\/"/g;  f(`t${1}`) '


def test_prefixes_and_scopes(spark):
    r = spark.range(1).select(C.prefixes(F.lit("a//b//c")).alias("p"), C.prefixes(F.lit("a")).alias("q"), C.scopes(F.lit("f//g"), F.lit("x")).alias("s")).collect()[0]
    assert (r.p, r.q, r.s) == (["a", "a//b"], [], ["f//g//x", "f//x", "x"])


def test_signatures(spark):
    sig = lambda match, *conds: {"id": match + str(len(conds)), "languages": {"python": {"match": match, "conditions": list(conds)}}}
    run = {"type": "call", "value": "os.run", "args": [{"index": 0, "values": ["'MD5'"]}]}
    wild, other, late = {"type": "call", "value": "os.*"}, {"type": "call", "value": "no.where"}, {"type": "call", "value": "os.run", "args": [{"index": 1, "values": ["1"]}]}
    found = frame(spark).match([sig("any", run), sig("all", wild, run), sig("all", wild, run, other), sig("any", late, other)])
    assert {r.signature_id for r in found.collect()} == {"any1", "all2"}
    for bad in (None, {"id": ""}, {"id": "x", "languages": {"cobol": {"match": "any"}}}, {"id": "x", "languages": {"go": {"match": "some"}}}):
        with pytest.raises(ValueError):
            signatures.validate([bad])
    conds = signatures.conditions(spark, [{"id": "j", "languages": {"javascript": {"match": "any", "conditions": [{"type": "call", "value": "pkg.*"}, {"type": "call", "value": "pkg/*"}]}}}])
    assert [r.value for r in signatures.unmatchable(conds).collect()] == ["pkg.*"]
