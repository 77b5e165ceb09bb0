import random

from codeweft.llm import gear, substring_dedup as sd


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def slow_rolling(raw):
    out = []
    for i in range(len(raw)):
        out.append(sum(int(gear.G[raw[i - k]]) << k for k in range(min(16, i + 1))) % 65536)
    return out


def slow_spans(rows, least):
    """Chunks of the texts, first places, and runs, in plain loops."""
    seen, spans = {}, {}
    for i, text in sorted({(sd.LAST if i is None else i, t) for i, t in rows if t}, key=lambda r: (r[0], key(r[1]))):
        last, runs = 0, []
        raw = text.encode()
        for end in sd.chunk_ends(raw).tolist():
            a, b = len(raw[:last].decode()), len(raw[:end].decode())
            if seen.setdefault(raw[last:end], (i, text, a)) != (i, text, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            last = end
        if runs := [tuple(r) for r in runs if r[1] - r[0] >= least]:
            spans[i, text] = runs
    return spans


def key(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def test_rolling_hash_and_cuts():
    rng = random.Random(7)
    for n in (0, 1, 5, 40, 500):
        raw = words(rng, n).encode()
        import numpy as np

        assert gear.rolling(np.frombuffer(raw, np.uint8)).tolist() == slow_rolling(raw)
        ends = sd.chunk_ends(raw).tolist()
        assert ends == sorted(set(ends)) and (not raw or ends[-1] == len(raw))
        for a, b in zip([0, *ends], ends):
            raw[a:b].decode()


def test_spans_agree_with_brute_force(spark, docs):
    rng = random.Random(8)
    passage, line = words(rng, 70), words(rng, 12)
    texts = [words(rng, rng.randrange(200)) for _ in range(40)]
    for i in range(0, 30, 3):
        texts[i] = texts[i][:50] + "\n" + passage + " " + texts[i][50:]
    texts = [line + "\n" + t for t in texts] + ["x" * 5000, "x" * 5000, "ab " * 900, "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (100, texts[0]), (None, texts[1]), (1000, texts[1])]
    frame = docs([(i, t, "en", "s", 1) for i, t in rows])
    found = {(r.id, r.t): [(x.s, x.e) for x in r.spans] for r in sd.repeats(frame).collect()}
    want = slow_spans(rows, sd.LEAST_CHARS)
    assert found == {(i, key(t)): runs for (i, t), runs in want.items()}
    # The passage goes in all places but the first; the short common line stays.
    held = [i for i in range(0, 30, 3)]
    for i in held[1:]:
        assert sum(e - s for s, e in found[i, key(texts[i])]) > 0.6 * len(passage)
    assert (held[0], key(texts[0])) not in found and (1, key(texts[1])) not in found
    cut = sd.without(frame, sd.repeats(frame)).collect()
    assert len(cut) == len(rows)
    left = {}
    for r in cut:
        left.setdefault(r.doc_id, set()).add(r.text)
    for i, t in rows:
        runs = want.get((sd.LAST if i is None else i, t), [])
        out, at = "", 0
        for s, e in runs:
            out, at = out + t[at:s], e
        assert (None if t is None else out + t[at:]) in left[i]


def test_empty_table(docs):
    assert sd.repeats(docs([])).collect() == []
    assert sd.without(docs([]), sd.repeats(docs([]))).collect() == []
