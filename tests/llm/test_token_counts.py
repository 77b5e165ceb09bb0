import random

from codeweft.llm import queries, token_counts


def slow(enc, fields, by_line, rule):
    """Sections' counts by walking the bytes."""
    owner, n, where = [], 0, []
    for k, f in enumerate(fields):
        f = f or ""
        parts = f.split("\n") if by_line else [f]
        lines = [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
        if k + 1 < len(fields):
            lines[-1] += "\n"
        for x in lines:
            owner += [n] * len(x.encode())
            where.append(k)
            n += 1
    counts, at = [0] * n, 0
    for t in enc.encode_ordinary("\n".join(f or "" for f in fields)):
        size = len(enc.decode_single_token_bytes(t))
        held = owner[at : at + size]
        best = held[0] if rule == "start" else max(sorted(set(held)), key=held.count)
        counts[best] += 1
        at += size
    return counts, where


def test_counts_agree_with_a_walk(spark):
    enc, _ = token_counts.encoding(queries.BYTE_BPE, queries.BYTE_PATTERN)
    rng = random.Random(5)
    texts = [None, "", "one", "one\ntwo", "one\n\n\n  two\n", "\n", "é\n日本\n\U0001f600x"] + ["".join(rng.choice(["a ", "\n", "\n\n", "été ", "of the", "  ", "x"]) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, rng.choice(texts)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, title string")
    for fields, by_line, rule in ((["text"], True, "start"), (["text"], True, "most"), (["title", "text"], False, "start"), (["title", "text"], True, "most")):
        found = token_counts.section_counts(docs, queries.BYTE_BPE, queries.BYTE_PATTERN, fields, by_line, rule).collect()
        for i, text, title in rows:
            mine = sorted((r for r in found if r.doc_id == i), key=lambda r: r.section)
            values = [text] if fields == ["text"] else [title, text]
            counts, where = slow(enc, values, by_line, rule)
            assert [r.n_tokens for r in mine] == counts, (i, values, fields, by_line, rule)
            assert [r.field for r in mine] == where
            whole = "\n".join(v or "" for v in values)
            assert [r.char_start for r in mine[1:]] == [r.char_end for r in mine[:-1]] and mine[0].char_start == 0 and mine[-1].char_end == len(whole)
            assert sum(counts) == len(enc.encode_ordinary(whole))


def test_empty_table(docs):
    assert token_counts.section_counts(docs([]), queries.BYTE_BPE, queries.BYTE_PATTERN).collect() == []
