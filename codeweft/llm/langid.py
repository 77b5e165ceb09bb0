"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 for each language, over lower-cased letters with every run
of anything else as one space.  Highest-order counts are of n-grams, lower-order
counts of the distinct n-grams that continue, each with its own absolute
discount.  All languages' models share sorted arrays of 64-bit n-gram hashes: a
row holds each language's log probability of the n-gram (already interpolated),
a row of a context holds each language's log weight of the next lower order.
Scoring is a binary search for each position of a text and the sum of the rows
found, so a language costs no search of its own.

The language with the lowest cross-entropy, in nats for each character, is
predicted.  Labelled documents kept from the counts calibrate two things: the
score (a softmax over total cross-entropies, its temperature fit by likelihood)
and the rejection: a text whose cross-entropy exceeds its language's mean by more
than REJECT_MARGIN times the REJECT_QUANTILE of the calibration documents,
allowing for its length, is rejected; so is a text without a letter.

The models are fit on labelled documents up to SAMPLE_DOCS a language in
expectation, chosen by a hash of doc_id, their whole texts; all their n-grams are
counted, so the sample alone bounds what the driver holds and broadcasts: 4 bytes
for each language and each n-gram of any of them, so that with hundreds of languages
``sample_docs`` is to be chosen smaller.

Defined results: null, empty and letterless texts are ``und`` with score 0 and
rejected; without any labelled document all are; equal rows get equal results;
ties between languages go to the first in order of name.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, uniform

ORDER = 4
SAMPLE_DOCS = 3000
CALIBRATION = 5
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 3.0
#: Characters over which a text's cross-entropy settles.
SETTLE = 200
BASE = np.uint64(0x9E3779B97F4A7C15)

_LETTERS = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def characters(text: str | None) -> np.ndarray:
    """Code points of the normalised text: ORDER - 1 spaces, words, a space. Empty without letters."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[x]
    if not letter.any():
        return np.zeros(0, np.uint32)
    x = np.where(letter, x, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = letter[0]
    x = x[keep]
    return np.concatenate((np.full(ORDER - 1, 32, np.uint32), x, np.full(int(x[-1] != 32), 32, np.uint32)))


def hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position from n - 1 on."""
    h = np.full(len(x) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h + x[i : len(x) - n + 1 + i]) * BASE
        h ^= h >> np.uint64(29)
    return h


def _hash(gram: str) -> int:
    return int(hashes(np.array([ord(c) for c in gram], np.uint64), len(gram))[0])


class KneserNey:
    """Interpolated probabilities of one language, from its counts of n-grams of order ORDER."""

    def __init__(self, counts: dict[str, int], alphabet: int):
        self.levels: list[tuple[dict, dict, dict, float]] = []
        for n in range(ORDER, 0, -1):
            sums: Counter = Counter()
            kinds: Counter = Counter()
            for g, c in counts.items():
                sums[g[:-1]] += c
                kinds[g[:-1]] += 1
            few = Counter(min(c, 3) for c in counts.values())
            discount = few[1] / (few[1] + 2 * few[2]) if few[1] else 0.5
            self.levels.append((counts, sums, kinds, min(max(discount, 0.05), 0.95)))
            counts = Counter(g[1:] for g in counts)
        self.uniform = 1.0 / (alphabet + 1)

    def weight(self, context: str) -> float:
        """Share of the next lower order after a context; 1 if the context was never seen."""
        _, sums, kinds, d = self.levels[ORDER - 1 - len(context)]
        return d * kinds[context] / sums[context] if context in sums else 1.0

    def probability(self, gram: str) -> float:
        p = self.uniform
        for n in range(1, len(gram) + 1):
            part = gram[len(gram) - n :]
            counts, sums, _, d = self.levels[ORDER - n]
            held = sums.get(part[:-1], 0)
            p = self.weight(part[:-1]) * p + (max(counts.get(part, 0) - d, 0.0) / held if held else 0.0)
        return p


class Model:
    """All languages' models in sorted hash arrays."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        alphabet = len({c for grams in counts.values() for g in grams for c in g})
        models = [KneserNey(counts[x], alphabet) for x in self.languages]
        self.grams, self.contexts = {}, {}
        for n in range(1, ORDER + 1):
            seen = sorted({g for m in models for g in m.levels[ORDER - n][0]})
            self.grams[n] = self._table(seen, lambda g: [m.probability(g) for m in models])
            heads = sorted({g for m in models for g in m.levels[ORDER - n][1]})
            self.contexts[n - 1] = self._table(heads, lambda h: [m.weight(h) for m in models]) if n > 1 else np.log([m.weight("") for m in models])
        self.unseen = self.contexts[0] + np.log([m.uniform for m in models])
        self.kappa, self.mean, self.limit = 1.0, np.zeros(len(models)), np.full(len(models), np.inf)

    def _table(self, keys: list[str], row) -> tuple[np.ndarray, np.ndarray]:
        h = np.array([_hash(k) for k in keys], np.uint64)
        values = np.log(np.array([row(k) for k in keys], np.float64).reshape(len(keys), len(self.languages)))
        order = np.argsort(h)
        return h[order], values[order].astype(np.float32)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each hash and whether it is there."""
        keys = table[0]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(characters scored, nats for each character by language) of each text."""
        xs = [characters(t) for t in texts]
        sizes = np.array([max(0, len(x) - ORDER + 1) for x in xs], np.int64)
        out = np.zeros((len(xs), len(self.languages)))
        full = np.flatnonzero(sizes)
        if not len(full) or not self.languages:
            return sizes, out
        x = np.concatenate([xs[i] for i in full]).astype(np.uint64)
        # Positions whose n-gram lies within one text.
        last = np.cumsum([len(xs[i]) for i in full])
        inside = np.ones(len(x), bool)
        for k in range(ORDER - 1):
            inside[np.concatenate(([0], last[:-1])) + k] = False
        at = np.flatnonzero(inside)
        table = self.grams[ORDER]
        found, there = self._find(table, hashes(x, ORDER)[at - ORDER + 1])
        values = table[1][found]
        miss = np.flatnonzero(~there)
        if len(miss):
            values[miss] = self._lower(x, at[miss], ORDER)
        sums = np.add.reduceat(values.astype(np.float64), np.concatenate(([0], np.cumsum(sizes[full])[:-1])), axis=0)
        out[full] = -sums / sizes[full][:, None]
        return sizes, out

    def _lower(self, x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities where no language has seen the n-gram that ends at ``at``."""
        if n == 1:
            return np.repeat(self.unseen[None, :], len(at), axis=0)
        near = np.stack([x[at - n + 1 + i] for i in range(n)])

        def spots(rows: np.ndarray) -> np.ndarray:
            h = np.full(rows.shape[1], len(rows), np.uint64)
            for r in rows:
                h = (h + r) * BASE
                h ^= h >> np.uint64(29)
            return h

        found, there = self._find(self.contexts[n - 1], spots(near[:-1]))
        values = np.where(there[:, None], self.contexts[n - 1][1][found] if len(self.contexts[n - 1][0]) else 0.0, 0.0)
        found, there = self._find(self.grams[n - 1], spots(near[1:]))
        lower = self.grams[n - 1][1][found].astype(np.float64)
        if not there.all():
            lower[~there] = self._lower(x, at[~there], n - 1)
        return values + lower

    def calibrate(self, rows: list[tuple[str, int, list[float]]]) -> None:
        """rows: (language, characters, nats by language) of labelled documents."""
        rows = [r for r in rows if r[1] and r[0] in self.languages]
        if not rows:
            return
        true = np.array([self.languages.index(r[0]) for r in rows])
        size, ce = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
        gaps = (ce - ce.min(1, keepdims=True)) * np.minimum(size, SETTLE)[:, None]
        best = -np.inf
        for kappa in np.geomspace(0.01, 10, 31):
            p = np.exp(-kappa * gaps)
            fit = np.log(np.maximum(p[np.arange(len(true)), true] / p.sum(1), 1e-12)).mean()
            if fit > best + 1e-9:
                best, self.kappa = fit, float(kappa)
        right = ce.argmin(1) == true
        for k in range(len(self.languages)):
            mine = right & (true == k)
            if mine.any():
                self.mean[k] = np.average(ce[mine, k], weights=np.minimum(size[mine], SETTLE))
                off = (ce[mine, k] - self.mean[k]) / np.sqrt(1 / size[mine] + 1 / SETTLE)
                self.limit[k] = max(REJECT_MARGIN * np.quantile(off, REJECT_QUANTILE), 1.0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected, nats for each character) of each text."""
        size, ce = self.entropies(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
        best = ce.argmin(1)
        least = ce[np.arange(len(best)), best]
        some = size > 0
        p = 1.0 / np.exp(-self.kappa * (ce - least[:, None]) * np.minimum(size, SETTLE)[:, None]).sum(1)
        off = (least - self.mean[best]) / np.sqrt(1 / np.maximum(size, 1) + 1 / SETTLE)
        return [self.languages[b] if s else "und" for b, s in zip(best, some)], np.where(some, p, 0.0), ~some | (off > self.limit[best]), np.where(some, least, 0.0)


def _slices(texts: list, most: int = 1_000_000):
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def share_of(count: int, sample_docs: int) -> float:
    """Share of a language's documents that teach: above 0 whatever their number."""
    return min(1.0, sample_docs / count)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the languages of ``docs`` (doc_id, text, lang); rows without lang or letters teach nothing."""
    rows = docs.filter("lang IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy("lang").count().collect()  # a row for each language
    shares = {r["lang"]: share_of(r["count"], sample_docs) for r in sizes}
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(x)) for lang, x in shares.items()]) if sizes else F.lit(0.0)
    sample = rows.filter(uniform(F.col("id"), F.length("t")) < share).select("lang", "t", (F.pmod(F.xxhash64(F.lit(3), "id", F.length("t")), F.lit(CALIBRATION)) == 0).alias("kept"))

    def count(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = characters(text)
                s = x.astype("<u4").tobytes().decode("utf-32-le")
                held.setdefault(lang, Counter()).update([s[i : i + ORDER] for i in range(len(s) - ORDER + 1)])
            if sum(map(len, held.values())) > 500_000:
                yield from _counts(held)
                held = {}
        yield from _counts(held)

    grams = sample.filter("NOT kept").select("lang", "t").mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in grams.orderBy("lang", "gram").collect():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    model = Model(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                size, ce = shared.value.entropies(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(langs[a:b], pa.string()), pa.array(size), pa.array(ce.tolist(), pa.list_(pa.float64()))], ["lang", "size", "ce"])

    if counts:
        model.calibrate([(r[0], r[1], list(r[2])) for r in sample.filter("kept").select("lang", "t").mapInArrow(score, "lang string, size bigint, ce array<double>").collect()])
    shared.destroy()
    return model


def _counts(held: dict[str, Counter]):
    for lang, grams in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred, score, rejected and nats, for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(text_col).cast("string").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:]) + ", lang_pred string, score double, rejected boolean, nats double"

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _slices(texts):
                langs, score, rejected, nats = shared.value.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[1:]], pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected), pa.array(nats, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score", "rejected", "nats"])

    return slim.mapInArrow(run, schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows that may teach: crc32(doc_id as text) modulo 4 is not 2."""
    return docs.filter(fold(F.col("doc_id"), 4) != 2)
