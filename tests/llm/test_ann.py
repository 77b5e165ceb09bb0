import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from codeweft.llm import ann


def slow(ids, m, queries, k=5):
    out = {}
    for q in queries:
        a = m[ids.index(q)]
        scored = [(-(m[j] * a).sum() / (np.sqrt((a * a).sum()) * np.sqrt((m[j] * m[j]).sum())), i) for j, i in enumerate(ids) if i != q]
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_SIZE", 32)
    rng = np.random.default_rng(15)
    m = rng.normal(size=(1500, 16)).astype(np.float32).astype(float)
    m[200:900] = m[200]
    m[901] = m[900] * 2
    ids = list(range(1500))
    bad = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] + [1.0] * 15), (5200, [1.0] * 3), (None, [1.0] * 16), (5250, []), (0, m[0].tolist())]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m)] + bad, "vec_id bigint, embedding array<float>").withColumn("list", F.lit("clash"))
    found = ann.search(frame, F.col("vec_id") % 50 == 0).collect()
    want = slow(ids, m, ids[::50])
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        a, b = m[r.query_id], m[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.9
    assert [i for i, _ in got[250]] == [200, 201, 202, 203, 204]


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(16)
    graph = ann.Graph(ann.unit(rng.normal(size=(800, 16))), 0.3)
    hits = 0
    for q in ann.unit(rng.normal(size=(50, 16))):
        at, distance = graph.search(q)
        assert list(distance) == sorted(distance)
        hits += len(set(at[:16].tolist()) & set(np.argsort(-(graph.centre @ q))[:16].tolist()))
    assert hits / 800 > 0.9


def test_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    found = {(r.query_id, r.rank): r.vec_id for r in ann.search(frame, F.col("vec_id") % 50 == 0).collect()}
    assert found == {(0, 1): 1, (0, 2): 50, (50, 1): 1, (50, 2): 0}
    assert ann.search(frame.limit(0), F.col("vec_id") == 0).collect() == []
    assert ann.search(frame.filter("vec_id = 0"), F.col("vec_id") == 0).collect() == []


def test_all_lists_within_the_ratio_are_found():
    rng = np.random.default_rng(18)
    graph = ann.Graph(ann.unit(rng.normal(size=(1500, 32))), 0.3)
    most = 0
    for q in ann.unit(rng.normal(size=(20, 32))):
        far = np.sort(np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (graph.centre @ q))))
        most = max(most, ann.lists_of(far, graph.ratio))
        assert ann.lists_of(graph.within(q)[1], graph.ratio) >= 0.95 * ann.lists_of(far, graph.ratio)
    assert most > 2 * ann.BREADTH


def test_recall_where_lists_are_pruned():
    # Vectors without clusters: the hardest case. The sample is a third of them.
    rng = np.random.default_rng(19)
    m = ann.unit(rng.normal(size=(24_000, 24)))
    graph = ann.built(m[:8000], len(m), 5)
    lists = [[] for _ in graph.centre]
    for i in range(0, len(m), 2048):
        for r, c in zip(*ann.lists_near(m[i : i + 2048], graph.centre)):
            lists[c].append(r + i)
    hits = visited = 0
    for i in range(0, len(m), 240):
        at, distance = graph.within(m[i])
        at = at[: ann.lists_of(distance, graph.ratio)]
        visited += len(at)
        cos = m @ m[i]
        cos[i] = -2
        held = {x for c in at for x in lists[c]}
        hits += sum(x in held for x in np.argsort(-cos)[:5].tolist())
    assert hits / 500 >= 0.9 and visited / 100 < 0.5 * len(graph.centre)


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(20)
    m = rng.normal(size=(60, 8))
    size = np.array([1e300, 1e-300, 1.0])[np.arange(60) % 3]
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(m, size))]
    found = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    want = slow(list(range(60)), m, [0, 50])
    assert {(r.query_id, r.rank): r.vec_id for r in found} == {(q, k + 1): i for q, x in want.items() for k, (i, _) in enumerate(x)}
    assert all(abs(r.score - dict(want[r.query_id])[r.vec_id]) < 1e-9 for r in found)


def test_a_part_meets_its_queries_in_batches():
    met = []

    def nearest(lists, asks):
        met.append((lists["vec_id"].tolist(), len(asks)))
        return asks

    def frame(rows):
        return pd.DataFrame(rows, columns=["list", "part", "asks", "vec_id", "v"])

    first = [(0, 0, False, i, [1.0]) for i in range(3)] + [(0, 0, True, i, [1.0]) for i in range(700)]
    second = [(0, 0, True, i, [1.0]) for i in range(100)] + [(0, 1, True, 5, [1.0])] + [(1, 0, False, 9, [1.0])]
    third = [(1, 0, False, 10, [1.0]), (1, 0, True, 1, [1.0])]
    got = list(ann.streamed([frame(first), frame(second), frame(third)], nearest))
    assert met == [([0, 1, 2], 512), ([0, 1, 2], 188), ([0, 1, 2], 100), ([9, 10], 1)]
    assert sum(map(len, got)) == 801
