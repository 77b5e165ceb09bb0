import math
import random
import re
from collections import Counter

from codeweft.llm import toxicity as tx

BAD = ["vile", "rotten", "foul"]


def text(rng, bad):
    out = [rng.choice(["the", "sun", "sea", "tree", "walks", "green", "house", "over", "under"]) for _ in range(rng.randrange(5, 40))]
    for _ in range(bad):
        out.insert(rng.randrange(len(out)), rng.choice(BAD))
    return " ".join(out)


def data(spark, n=900):
    rng = random.Random(12)
    rows = [(i, text(rng, rng.choice([1, 2, 3]) if i % 5 == 0 else 0), int(i % 5 == 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 7] + [(None, 1), (3, None), (5, 0), (5, 1)], "doc_id bigint, toxic int")
    return rows, docs, labels


def test_held_out(spark):
    rows, docs, labels = data(spark)
    index = tx.fit(tx.learning_rows(docs), tx.learning_rows(labels))
    assert set(BAD) <= set(index.words)
    more = spark.createDataFrame([(9001, None, ""), (9002, "", ""), (9003, "foul " * 20000, ""), (None, "foul rotten", "")], docs.schema)
    found = {r.doc_id: r for r in tx.score(docs.unionByName(more), index).collect()}
    assert all((found[i].score >= 0.7) == bool(y) for i, _, y in rows)
    assert found[9001].score == found[9002].score < 0.1 and found[9003].score >= 0.7 and found[None].score >= 0.7
    assert found[9003].terms == ["foul"] and found[9003].evidence
    assert all(0 <= r.score <= 1 for r in found.values())


def test_block_max_search_is_exact():
    rng = random.Random(13)
    words = {f"w{i}": rng.uniform(0.1, 3) for i in range(30)}
    examples = [(i, float(rng.random() < 0.3), rng.choice([1.0, 2.5]), {rng.randrange(30): rng.randint(1, 4) for _ in range(rng.randrange(6))}) for i in range(900)]
    index = tx.Index(words, examples)
    keys = list(index.own)
    number = {k: index.own[k][0] for k in keys}
    for _ in range(60):
        key = tuple(sorted({rng.randrange(30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}.items()))
        slow = []
        q = dict(zip(*[x.tolist() for x in index.vector(key)]))
        for k in keys:
            v = dict(zip(*[x.tolist() for x in index.vector(k)])) if k else {}
            cos = sum(w * v.get(t, 0) for t, w in q.items())
            if cos > 0:
                slow.append((cos, number[k]))
        slow.sort(key=lambda x: (-x[0], x[1]))
        least = slow[min(24, len(slow) - 1)][0]
        want = [x for x in slow if x[0] >= least - 1e-9]
        got = index.nearest(key, 25)
        assert {i for _, i in got} == {i for _, i in want}
        assert all(abs(dict((i, c) for c, i in want)[i] - c) < 1e-9 for c, i in got)


def test_isotonic_steps_rise():
    rng = random.Random(14)
    examples = [(i, float(rng.random() < (0.9 if i % 3 else 0.1)), 1.0, {i % 3: 1, 3 + rng.randrange(8): 1}) for i in range(600)]
    index = tx.Index({f"w{i}": 1.0 for i in range(11)}, examples)
    index.calibrate()
    x, y = index.steps
    assert list(x) == sorted(x) and list(y) == sorted(y) and 0 <= y[0] and y[-1] <= 1
    assert not math.isnan(index.score("w0")[0])


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "the sea")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert tx.score(docs, tx.fit(docs, none)).collect()[0].score == 0.0
    assert tx.score(docs.limit(0), tx.fit(docs.limit(0), none)).collect() == []


def test_rare_words_and_small_tables_count(spark):
    # Each bad word is in fewer than 20 examples; the languages share none.
    rng = random.Random(17)
    plain = {"en": ["sun", "sea", "tree", "walks", "green"], "de": ["baum", "haus", "geht", "meer", "rot"]}
    bad = {"en": ["vile", "rotten"], "de": ["mies", "faul"]}
    rows = []
    for i in range(160):
        lang = "de" if i % 4 == 0 else "en"
        out = [rng.choice(plain[lang]) for _ in range(rng.randrange(10, 30))]
        rows.append((i, " ".join(out + [rng.choice(bad[lang])] * (i // 4 % 5 == 0)), int(i // 4 % 5 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    index = tx.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i < 120], "doc_id bigint, toxic int"))
    assert set(index.words) == {w for i, t, _ in rows if i < 120 for w in t.split()}
    found = {r.doc_id: r for r in tx.score(docs, index).collect()}
    assert all((found[i].score >= 0.5) == bool(y) for i, _, y in rows)
    assert found[100].terms[0] in bad["de"]


def brute(rows, labels, text_of):
    """Scores of all rows by plain loops: weights, cosines, votes, pools of equal or falling votes."""
    words = {i: Counter(re.findall(r"[^\W\d_]+", (text_of[i] or "").lower())) for i in text_of}
    learn = [i for i in labels if i in text_of]
    n1 = sum(labels[i] for i in learn)
    n0 = len(learn) - n1
    weight = {}
    for w in sorted({w for i in learn for w in words[i]}):
        c1 = sum(labels[i] for i in learn if w in words[i])
        c0 = sum(1 - labels[i] for i in learn if w in words[i])
        phi2 = (c1 * n0 - c0 * n1) ** 2 / ((c0 + c1) * (n0 + n1 - c0 - c1 + 0.5) * n0 * n1)
        weight[w] = (math.log((1 + n0 + n1) / (1 + c0 + c1)) + 1e-3) * (phi2 + tx.LEAST_WEIGHT)

    def vector(i):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in words[i].items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    entries = {}
    for i in learn:
        entries.setdefault(tuple(sorted((w, c) for w, c in words[i].items() if w in weight)), []).append(i)
    vectors = {k: vector(v[0]) for k, v in entries.items()}

    def vote(i, left_out=None):
        mine = vector(i)
        near = sorted(((sum(x * v.get(w, 0.0) for w, x in mine.items()), k) for k, v in vectors.items()), key=lambda x: -x[0])
        near = [x for x in near if x[0] > 0] if mine else [(1.0, k) for k in vectors if not k]
        if len(near) > tx.NEAREST:
            near = [x for x in near if x[0] >= near[tx.NEAREST - 1][0] - 1e-9]
        up = down = 0.0
        for cos, k in near:
            some = [labels[j] for j in entries[k]]
            if left_out is not None and left_out in entries[k]:
                some.remove(labels[left_out])
            up += sum(some) / (tx.GAP + max(0.0, 1 - cos))
            down += len(some) / (tx.GAP + max(0.0, 1 - cos))
        return up / down if down else None

    pools = []
    for v, y in sorted((vote(i, i), labels[i]) for i in learn if vote(i, i) is not None):
        pools.append([v, v, y, 1])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][0] - 1e-12 or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]):
            b = pools.pop()
            pools[-1] = [pools[-1][0], b[1], pools[-1][2] + b[2], pools[-1][3] + b[3]]

    def step(v):
        for k, (a, b, y, n) in enumerate(pools):
            if v <= b or k + 1 == len(pools):
                if v >= a or k == 0:
                    return y / n
                _, low, y0, m = pools[k - 1]
                return y0 / m + (y / n - y0 / m) * (v - low) / (a - low)

    return {i: 0.0 if vote(i) is None else step(vote(i)) for i in rows}


def test_fit_and_scores_against_brute_force(spark):
    rng = random.Random(23)
    rows = [(i, text(rng, rng.choice([0, 1, 2]) if i % 4 == 0 else 0)) for i in range(150)] + [(150, ""), (151, None), (152, "zzz")]
    labels = {i: int(i % 4 == 0) for i in range(0, 151) if i % 3}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = tx.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic int"))
    want = brute([i for i, _ in rows], labels, dict(rows))
    found = {r.doc_id: r.score for r in tx.score(docs, index).collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[i] - want[i]) < 1e-6 for i in want), [(i, found[i], want[i]) for i in want if abs(found[i] - want[i]) >= 1e-6]
    assert len({round(x, 6) for x in want.values()}) > 3
