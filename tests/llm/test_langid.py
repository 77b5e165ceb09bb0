import math
import random
from collections import Counter

import numpy as np

from codeweft.llm import langid

WORDS = {
    "en": "the of and to in that with from this which house water little people great".split(),
    "de": "der die und das nicht ein für mit schön größe wasser häuser kleine leute".split(),
    "fr": "le la les des est être après où élève maison petite eau grande ça".split(),
}


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 60))), lang))
    return rows


class Slow:
    """Interpolated Kneser-Ney by its formulas, from the texts."""

    def __init__(self, texts, alphabet):
        self.alphabet = alphabet
        self.tables = {}
        counts = Counter(s[i : i + 4] for s in texts for i in range(len(s) - 3))
        for n in (4, 3, 2, 1):
            few = Counter(counts.values())
            d = few[1] / (few[1] + 2 * few[2]) if few[1] else 0.5
            self.tables[n] = counts, min(max(d, 0.05), 0.95)
            counts = Counter(g[1:] for g in counts)

    def p(self, gram):
        if not gram:
            return 1 / (self.alphabet + 1)
        counts, d = self.tables[len(gram)]
        after = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        if not after:
            return self.p(gram[1:])
        total = sum(after.values())
        return max(after.get(gram, 0) - d, 0) / total + d * len(after) / total * self.p(gram[1:])


def shown(text):
    return langid.characters(text).astype("<u4").tobytes().decode("utf-32-le")


def test_normalised_characters():
    assert shown("Ab--c\n1É") == "   ab c é "
    assert shown("  x") == "   x " and shown("1 2 !") == "" and shown(None) == ""


def test_entropies_agree_with_the_formulas():
    rng = random.Random(10)
    rows = corpus(rng, 60)
    texts = {x: [shown(t) for _, t, lang in rows if lang == x] for x in WORDS}
    counts = {x: dict(Counter(s[i : i + 4] for s in texts[x] for i in range(len(s) - 3))) for x in WORDS}
    model = langid.Model(counts)
    alphabet = len({c for x in texts.values() for s in x for c in s})
    slow = [Slow(texts[x], alphabet) for x in model.languages]
    tests = ["the house", "größe où", "zzz qqq 日本", "", None, "!!", "der die das und nicht", "x"]
    size, ce = model.entropies(tests)
    for t, n, row in zip(tests, size, ce):
        s = shown(t)
        assert n == max(0, len(s) - 3)
        for k, m in enumerate(slow):
            want = -sum(math.log(m.p(s[i : i + 4])) for i in range(len(s) - 3)) / n if n else 0
            assert abs(row[k] - want) < 1e-4
    # Probabilities after a context sum to 1 with the unseen character.
    letters = {c for x in texts.values() for s in x for c in s}
    for m in slow[:1]:
        assert abs(sum(m.p("the"[:3] + c) for c in letters) + m.p("the￿") - 1) < 1e-9


def test_held_out_accuracy_and_rejection(spark):
    rng = random.Random(11)
    rows = [(i, t, lang, "clash") for i, t, lang in corpus(rng, 400)]
    odd = [(1000, None, "en", "x"), (1001, "12 !?", None, "x"), (1002, "щщщ жжж ххх ццц ююю " * 20, None, "x"), (1003, "", "de", "x"), (None, "the house of the people and the water", None, "x"), (5, rows[5][1], rows[5][2], "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, score string")
    model = langid.fit(langid.learning_rows(docs))
    found = langid.identify(docs, model).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r.doc_id: r for r in found}
    right = [by[i].lang_pred == lang for i, _, lang, _ in rows]
    assert np.mean(right) > 0.97
    assert np.mean([by[i].rejected for i, *_ in rows]) < 0.02
    for i in (1000, 1001, 1003):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected
    assert by[1002].rejected and by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in found)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the house", None)], "doc_id bigint, text string, lang string")
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert [(r.lang_pred, r.rejected) for r in found] == [("und", True)]
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).collect() == []


def test_small_languages_keep_their_grams(spark, monkeypatch):
    # No cut over all languages together: the small one's counts are all small.
    monkeypatch.setattr(langid, "MAX_GRAMS", 100, raising=False)
    rng = random.Random(19)
    rows = [(i, " ".join(rng.choice(WORDS["en"]) for _ in range(60)), "en") for i in range(200)]
    rows += [(1000 + i, " ".join(rng.sample(WORDS["de"], 3)), "de") for i in range(12)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["de", "en"]
    assert model.predict(["schön und klein das wasser"])[0] == ["de"]


def test_a_language_of_any_size_is_learned(spark):
    from codeweft.llm.common import uniform

    share = langid.share_of(10**13, 3000)
    assert 0 < share < 1e-9 and langid.share_of(10, 3000) == 1.0
    found = spark.range(200_000).select(uniform("id").alias("u")).agg({"u": "max"}).collect()[0][0]
    assert 0.9999 < found < 1
