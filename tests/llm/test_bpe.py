import hashlib
import random
import struct

import pytest
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from codeweft.llm import bpe, queries

ODD = ["", " ", "\n\n", "It's  we'LL \t don't", "a" * 3000, "naïve café ÉÀ", "é ́x á̧", "<|endoftext|>", "foo<|startoftext|>bar <|endoftext|>", "日本語 テキスト", "\U0001f600\U0001f468‍\U0001f469", "x y z\u0085w", "ΣΑΣ Σ", "İstanbul ﬁ", "1234 5,6", "\x00\x01", "a\r\nb\x0bc"]


def library():
    tok = Tokenizer.from_file(queries.WORD_BPE)
    tok.no_truncation()
    tok.no_padding()
    return tok


def check(texts, encoder, tok):
    found = encoder.batch(texts)
    for text, ids, decoded in zip(texts, found, encoder.decoded(found).to_pylist()):
        want = tok.encode(text or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text
        assert decoded == tok.decode(want, skip_special_tokens=False), text


def test_equal_to_the_library():
    rng = random.Random(4)
    tok, encoder = library(), bpe.Encoder(queries.WORD_BPE)
    check([None, *ODD], encoder, tok)
    texts = []
    passage = " ".join(rng.choice(ODD) for _ in range(60))
    for _ in range(60):
        words = [rng.choice([*ODD, "the", "of", "tion", ".", ",", "Ending"]) for _ in range(rng.randrange(200))]
        texts.append(rng.choice([" ", "\n", "", "  "]).join(words) + rng.choice(["", passage]))
    check(texts + texts[:20], encoder, tok)


def test_small_tables_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "SEEN", 2)
    monkeypatch.setattr(bpe, "CHUNK_BITS", 4)
    monkeypatch.setattr(bpe, "CHUNK_LEAST", 8)
    encoder = bpe.Encoder(queries.WORD_BPE)
    for _ in range(3):
        check(["one two three four five six seven eight nine ten eleven twelve " * 9] * 2, encoder, library())


def test_shared_passages_are_encoded_once():
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000))
    encoder = bpe.Encoder(queries.WORD_BPE)
    asked = []
    raw = encoder.raw
    encoder.raw = lambda texts: asked.append(sum(map(len, texts))) or raw(texts)
    check(["first " + passage], encoder, library())
    check(["then " + passage], encoder, library())
    asked.clear()
    check(["another start, " + passage + " and end"], encoder, library())
    assert sum(asked) < len(passage) / 5 and encoder.mended == 0


def test_joins_that_disagree_are_mended(tmp_path, monkeypatch):
    # This normaliser reaches over white space.
    monkeypatch.setattr(bpe, "CHUNK_BITS", 3)
    monkeypatch.setattr(bpe, "CHUNK_LEAST", 6)
    tok = Tokenizer(models.BPE(vocab={x: i for i, x in enumerate("abcx")} | {"ab": 4}, merges=[("a", "b")]))
    tok.normalizer = normalizers.Replace(Regex(r"a\s+b"), "x")
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tok.save(str(tmp_path / "odd.json"))
    encoder, rng = bpe.Encoder(str(tmp_path / "odd.json")), random.Random(6)
    texts = ["".join(rng.choice("aabbc  ") for _ in range(rng.randrange(400))) for _ in range(200)]
    want = [b"".join(i.to_bytes(4, "little") for i in tok.encode(t).ids) for t in texts]
    assert encoder.batch(texts) == want and 0 < encoder.mended < 200


def test_ids_for_white_space_are_refused(tmp_path):
    Tokenizer(models.BPE(vocab={"a": 0, " ": 1}, merges=[])).save(str(tmp_path / "odd.json"))
    with pytest.raises(ValueError):
        bpe.Encoder(str(tmp_path / "odd.json"))


def test_query_columns(spark, docs):
    rows = [(1, "Hello world", "x", "y", 1), (1, "Hello world", None, None, 1), (None, None, None, None, None)]
    # Columns that clash with the result's are left alone.
    table = docs(rows).withColumnsRenamed({"lang": "ids", "source": "n_tokens"})
    found = bpe.encode(table, queries.WORD_BPE, digests=True).collect()
    assert len(found) == 3
    ids = library().encode("Hello world", add_special_tokens=False).ids
    one = [r for r in found if r.doc_id == 1]
    assert {r.ids_sha256 for r in one} == {hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()} and one[0].n_tokens == len(ids)
    assert [r.n_tokens for r in found if r.doc_id is None] == [0]
    assert bpe.encode(docs([]), queries.WORD_BPE).collect() == []
