import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeweft.llm import mixing


def weights_of(spark, tokens, **how):
    totals = spark.createDataFrame([(s, t, 1) for s, t in tokens.items()], "source string, tokens bigint, docs bigint")
    return {r.source: r for r in mixing.source_weights(totals, **how).collect()}


def slow_exponent(tokens, ok, top):
    lo, hi = 0.0, top
    if ok(0.0):
        return 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def test_target_entropy(spark):
    tokens = {"a": 6000, "b": 2000, "c": 500, None: 70}
    total = sum(tokens.values())

    def entropy(x):
        q = [(t / total) ** x for t in tokens.values()]
        return -sum(v / sum(q) * math.log(v / sum(q)) for v in q)

    for target in (1.2, 0.9, 0.3):
        found = weights_of(spark, tokens, entropy=target, budget=10_000)
        want = slow_exponent(tokens, lambda x: entropy(x) <= target, mixing.HIGHEST)
        assert all(abs(r.exponent - want) < 1e-9 for r in found.values())
        assert abs(-sum(r.weight * math.log(r.weight) for r in found.values()) - target) < 1e-6
        assert abs(sum(r.weight for r in found.values()) - 1) < 1e-12


def test_repetition_limit_and_least_budget(spark):
    tokens = {"a": 8000, "b": 1000, "c": 100, "none": 0}
    found = weights_of(spark, tokens, max_repeats=3.0)
    repeats = {s: found[s].quota / tokens[s] for s in "abc"}
    assert repeats["a"] == 1 and abs(repeats["c"] - 3) < 0.02 and 1 < repeats["b"] < 3 and found["none"].quota == 0
    assert {r.exponent for r in weights_of(spark, tokens, max_repeats=1e6).values()} == {0.0}


def test_copies_fit_the_quotas(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 7)
    monkeypatch.setattr(mixing, "GROUP_BLOCKS", 3)
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 40), "en", rng.choice(["hot"] * 6 + ["b", None, "c"]), 1) for i in range(300)]
    rows += [(500, "", "en", "b", 0), (501, None, None, None, None), (502, "x", "en", "empty", 1), (3, rows[3][1], "en", rows[3][3], 1)]
    frame = docs(rows).withColumn("mix_copy", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    for how in ({"max_repeats": 2.5}, {"entropy": 0.9, "budget": 2000}):
        found = mixing.mix(frame, mixing.words(F.col("text")), block_tokens=500, **how).collect()
        again = mixing.mix(frame.repartition(5), mixing.words(F.col("text")), block_tokens=500, **how).collect()
        assert sorted(map(str, found)) == sorted(map(str, again))
        size = lambda t: len((t or "").split())
        tokens, taken = defaultdict(int), defaultdict(int)
        for _, t, _, s, _ in rows:
            tokens[s] += size(t)
        for r in found:
            taken[r.source] += size(r.text)
        quotas = weights_of(spark, dict(tokens), **how)
        for s in tokens:
            most = max((size(t) for _, t, _, x, _ in rows if x == s), default=0)
            assert quotas[s].quota - most < taken[s] <= quotas[s].quota or tokens[s] == 0, (s, how)
        copies = Counter((r.doc_id, r.source) for r in found)
        for (i, s), n in copies.items():
            if i not in (3, 500, 501):
                assert n - quotas[s].quota // tokens[s] in (0, 1)
        if "max_repeats" in how:
            assert {r.doc_id for r in found} == {r[0] for r in rows}
        assert copies[500, "b"] == 1 and copies[501, None] == 1
        assert {c for c in found[0].asDict()} == {*frame.columns, "mix_block", "mix_order"}


def test_errors_and_empty(docs, spark):
    with pytest.raises(ValueError):
        weights_of(spark, {"a": 1})
    assert mixing.mix(docs([]), mixing.words(F.col("text")), max_repeats=2.0).collect() == []


def test_rows_that_tie_do_not_depend_on_partitioning(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    rows = [(1, f"w{i} x", None, s, 1) for s in ("a", "a", "b", "c") for i in range(40)] + [(None, "a b c", None, None, None)] * 30 + [(None, f"n{i}", "en", None, None) for i in range(30)]
    frame = docs(rows)
    results = []
    for way in (frame.repartition(1), frame.repartition(4, "text"), frame.orderBy(F.desc("text"))):
        results.append(sorted(map(str, mixing.mix(way, F.lit(2), max_repeats=1.5).collect())))
        results.append(sorted(map(str, mixing.mix(way, F.lit(2), entropy=1.0, budget=150).collect())))
    assert results[0] == results[2] == results[4] and results[1] == results[3] == results[5] and results[0] != results[1]


def test_a_target_out_of_reach_is_told(spark):
    assert {r.met for r in weights_of(spark, {"a": 100, "b": 100}, entropy=0.1, budget=10).values()} == {False}
    assert {r.met for r in weights_of(spark, {"a": 100, "b": 10}, entropy=0.1, budget=10).values()} == {True}
