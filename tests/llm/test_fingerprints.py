import hashlib
import random
import re

from pyspark.sql import functions as F

from codeweft.llm import fingerprints as fp


def paragraphs(text):
    return set(re.findall(r"[^\n]+?[.!?](?=[ \t\x0b\f\r]+[A-D])|[^\n]+", text))


def slow(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]

        def near(x, y):
            a, b = paragraphs(x), paragraphs(y)
            return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))

        out.setdefault((i, t), []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), near(t, e), near(t, nxt)))
    return out


def sample(rng, n):
    sentences = ["Alpha beta gamma.", "Été à la mer!", "No end", "x", "日本語。", "\U0001f600 yes?", "Of Of Of Of"]
    out = []
    for i in range(n):
        parts = [rng.choice(sentences) + str(rng.randrange(40)) + rng.choice([". ", "\n", "! ", " ", "\n\n"]) for _ in range(rng.choice([0, 1, 3, 20, 150]))]
        out.append((i * 7, "".join(parts)))
    return out


def test_agrees_with_sets_of_paragraphs(spark, docs, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_DOCS", 2)
    monkeypatch.setattr(fp, "QUANTILES", 4)
    rng = random.Random(9)
    rows = sample(rng, 40) + [(3, None), (3, "Same id. Twice."), (10**15, "far"), (-(10**15), "near"), (7, rng.choice(sample(rng, 40))[1])]
    found = fp.fingerprints(docs([(i, t, None, None, None) for i, t in rows])).collect()
    want = slow(rows)
    assert len(found) == len(rows)
    for r in found:
        mine = [w for (i, _), ws in want.items() if i == r.doc_id for w in ws]
        assert any(r.n_chars == n and r.edited_sha256 == sha and abs(r.near_edited - a) < 1e-9 and abs(r.near_next - b) < 1e-9 for n, sha, a, b in mine), r
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", set()).update(r.fingerprint for r in found if r.doc_id == i and r.n_chars == len(t or ""))
    assert len({r.fingerprint for r in found}) > 20


def test_single_null_and_empty(docs):
    one = fp.fingerprints(docs([(1, "A b. C d.", None, None, None)])).collect()
    assert one[0].near_next == 1.0
    both = {r.doc_id: r for r in fp.fingerprints(docs([(None, "z", None, None, None), (2, "", None, None, None)])).collect()}
    assert both[2].near_next == 0.0 and both[None].near_next == 0.0 and both[2].fingerprint != both[None].fingerprint
    assert fp.fingerprints(docs([])).collect() == []


def told(fingerprint):
    """The digests that a printed fingerprint holds, by peeling each of its segments."""
    n, at, out = int(fingerprint[:8], 16), 8, set()
    while at < len(fingerprint):
        third, size = int(fingerprint[at : at + 2], 16), int(fingerprint[at + 2 : at + 6], 16)
        at += 6
        cells = [[int(fingerprint[i : i + 4], 16), int(fingerprint[i + 4 : i + 12], 16), int(fingerprint[i + 12 : i + 28], 16)] for i in range(at, at + 28 * size, 28)]
        at += 28 * size
        if third == 0:
            assert all(c == 1 for c, _, _ in cells)
            out |= {k for _, _, k in cells}
            continue
        assert size == 3 * third
        todo = True
        while todo:
            todo = False
            for j, (c, x, k) in enumerate(cells):
                signed = k - 2**64 if k >= 2**63 else k
                spots = [(signed >> 21 * i) % third + third * i for i in range(3)]
                if c == 1 and j in spots:
                    todo = True
                    out.add(k)
                    for p in spots:
                        cells[p][0] -= 1
                        cells[p][1] ^= x
                        cells[p][2] ^= k
        assert all(z == [0, 0, 0] for z in cells)
    assert len(out) == n
    return out


def test_likeness_comes_from_the_printed_fingerprints(docs):
    rng = random.Random(31)
    rows = [(i, t) for i, t in sample(rng, 60)]
    rows += [(10_000 + i, t + " And More. " + t[: len(t) // 3]) for i, t in sample(rng, 8)]
    found = fp.fingerprints(docs([(i, t, None, None, None) for i, t in rows])).orderBy("doc_id", ascending=False).collect()
    sets = [told(r.fingerprint) for r in found]
    for k, r in enumerate(found):
        for near, other in ((r.near_edited, told(r.edited_fingerprint)), (r.near_next, sets[(k + 1) % len(found)])):
            held = len(sets[k]) + len(other)
            assert abs(near - (1 - len(sets[k] ^ other) / held if held else 1.0)) < 1e-9
    assert max(map(len, sets)) > 64


def test_rows_without_an_id_follow_by_text(docs, monkeypatch):
    monkeypatch.setattr(fp, "QUANTILES", 4)
    monkeypatch.setattr(fp, "BUCKET_DOCS", 1)
    monkeypatch.setattr(fp, "CHAIN", 2)
    texts = ["e", "a", "longer text", "longer texts", "É", "c", "", "b", "d", "longer"]
    rows = [(None, t) for t in texts] + [(5, "five"), (9, "nine")]
    found = fp.fingerprints(docs([(i, t, None, None, None) for i, t in rows])).collect()
    want = slow(rows)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted((str(i), n, sha) for (i, _), ws in want.items() for n, sha, _, _ in ws)


def test_segments_that_fail_are_tried_larger(spark):
    rows = spark.createDataFrame([([i * 2**42 for i in range(1, 9)],), ([5, 5 + 2**63 - 2**42],), ([],)], "ds array<bigint>")
    s = rows.select(fp.sketch(F.array_sort("ds")).alias("s"), "ds").select("s", "ds", fp.printed(F.col("s")).alias("p")).collect()
    assert [told(r.p) for r in s] == [{x % 2**64 for x in r.ds} for r in s]
    assert {x.third for x in s[0].s.segments} != {fp.THIRDS[0]}


def test_differences_carry_their_side(spark):
    a, b = list(range(0, 9000, 7)), list(range(70, 9100, 7))
    row = spark.createDataFrame([(a, b), (a, b[:3]), (a[:10], b)], "a array<bigint>, b array<bigint>")
    made = row.select("a", "b", fp.sketch(F.col("a")).alias("x"), fp.sketch(F.col("b")).alias("y"))
    for r in made.select("a", "b", fp.differences(F.col("x"), F.col("y")).alias("d")).collect():
        assert set(r.d.a) == set(r.a) - set(r.b) and set(r.d.b) == set(r.b) - set(r.a)


def test_clashing_columns_are_ignored(docs):
    rows = [(i, t, "x", "y", 1) for i, t in sample(random.Random(33), 12)]
    plain = fp.fingerprints(docs(rows))
    other = docs(rows).withColumnsRenamed({"lang": "bucket", "source": "fingerprint"}).withColumn("a", F.lit(1)).withColumn("m", F.lit("m")).withColumn("head", F.lit(None)).withColumn("next_text", F.lit("no"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, fp.fingerprints(other).collect()))
