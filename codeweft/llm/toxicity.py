"""Toxicity by nearest labelled examples: exact TF-IDF cosine, block-max indexes.

Labelled examples are drawn from the labelled rows up to MAX_EXAMPLES of either
label in expectation, by a hash of doc_id; the draw is weighted back in the
votes.  Every lower-cased word of the examples is a term.  A vector holds
(1 + ln count) * weight of its terms; a term's weight is its idf times its
dependence on the label (chi-square over the number of examples, so that it does
not change with their number), which keeps the many words that tell nothing from
drowning the few that do.

Examples with equal vectors are one entry of the index with their labels summed.
Entries are numbered by their heaviest term, so that alike ones are near each
other; a term's postings fall into blocks of BLOCK entries, each with the term's
largest weight in it.  A query adds up postings by falling bound of its terms.
Once the terms left can't bring many entries among the nearest - by the sum of
their largest weights in each block - the entries that still could be are scored
whole.  The result is the exact nearest neighbours.

The NEAREST nearest entries vote, those that tie with the last included, with
weight 1 / (GAP + 1 - cosine).  Votes become probabilities by isotonic
regression on the examples' own leave-one-out votes.  The evidence is the
nearest examples and the terms shared with them.

Defined results: a text without a known term (null and empty too) has as
neighbours the examples that have none either, and so their share of label 1;
without any label 1 the score is 0; equal texts get equal scores; of several
labels of one doc_id the largest counts; null labels and null doc_ids teach
nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, uniform, written

MAX_EXAMPLES = 1500
#: Added to a term's dependence on the label, so that no term vanishes.
LEAST_WEIGHT = 1e-6
BLOCK, NEAREST, GAP = 64, 12, 0.05
#: Terms added up first; then four times as many, then all.
FIRST = 12
#: Entries that are scored whole at once, at most, unless all terms are added up.
MANY = 64
WORD = re.compile(r"[^\W\d_]+")


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for sizes[0] numbers, then those of first[1], and so on."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def terms_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Index:
    """Entries (term weights, label sums, an example) with block-max postings."""

    def __init__(self, terms: dict[str, float], examples: Iterable[tuple[int, float, float, dict[int, int]]]):
        """terms: word -> weight. examples: (doc_id, label, weight, counts by term number)."""
        self.number = {w: i for i, w in enumerate(terms)}
        self.words = list(terms)
        self.idf = np.array(list(terms.values()))
        held: dict[bytes, list] = {}
        for doc, label, weight, counts in examples:
            entry = held.setdefault(np.array(sorted(counts.items()), np.int32).tobytes(), [0.0, 0.0, []])
            entry[0] += weight
            entry[1] += weight * label
            entry[2].append((doc, label, weight))
        keys = {k: np.frombuffer(k, np.int32).reshape(-1, 2) for k in held}
        vectors = {k: self._unit(x[:, 0].astype(np.int64), x[:, 1]) for k, x in keys.items()}
        order = sorted(held, key=lambda k: (vectors[k][0][np.argmax(vectors[k][1])] if k else -1, k))
        self.all = [held[k][0] for k in order]
        self.toxic = [held[k][1] for k in order]
        self.examples = [sorted(held[k][2])[:3] for k in order]
        #: Of each entry: its (term, count) rows and its examples.
        self.sources = [(keys[k], held[k][2]) for k in order]
        self.blank = next((i for i, k in enumerate(order) if not k), None)
        sizes = np.array([len(keys[k]) for k in order], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        self.term = np.concatenate([vectors[k][0] for k in order] or [np.zeros(0)]).astype(np.int32)
        self.weight = np.concatenate([vectors[k][1] for k in order] or [np.zeros(0)])
        #: Postings by term: entries and weights; blocks with the largest weight in each.
        by = np.argsort(self.term, kind="stable")
        self.entry, self.posted = np.repeat(np.arange(len(order), dtype=np.int32), sizes)[by], self.weight[by]
        term = self.term[by]
        self.post = np.searchsorted(term, np.arange(len(terms) + 1))
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(self.entry // BLOCK, prepend=-1) != 0))
        self.block, self.top = self.entry[first] // BLOCK, np.maximum.reduceat(self.posted, first) if len(first) else self.posted
        self.blocks = np.searchsorted(term[first], np.arange(len(terms) + 1))
        self.most = np.zeros(len(terms))
        np.maximum.at(self.most, term, self.posted)
        self.cache: dict[bytes, tuple] = {}
        #: A query's weights by term number, zero between queries.
        self.scratch: np.ndarray | None = None
        self.steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def __getstate__(self) -> dict:
        """What scoring needs: not the entries' sources."""
        return {k: v for k, v in self.__dict__.items() if k != "sources"} | {"cache": {}, "scratch": None}

    @property
    def own(self) -> dict[tuple, tuple]:
        """Key -> (entry, examples)."""
        return {tuple(map(tuple, x.tolist())): (i, e) for i, (x, e) in enumerate(self.sources)}

    def _unit(self, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[t]
        return t, w / math.sqrt(float(w @ w)) if len(t) else w

    def vector(self, key: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights, of length 1."""
        x = np.array(key, np.int64).reshape(-1, 2)
        return self._unit(x[:, 0], x[:, 1])

    def key(self, words: list[str]) -> tuple:
        number = self.number
        return tuple(sorted(Counter([number[w] for w in words if w in number]).items()))

    def _added(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of the postings of some terms, by entry."""
        first = self.post[terms]
        sizes = self.post[terms + 1] - first
        at = _ranges(first, sizes)
        return np.bincount(self.entry[at], self.posted[at] * np.repeat(weights, sizes), len(self.all))

    def _bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Most that some terms can add to an entry, by block."""
        first = self.blocks[terms]
        sizes = self.blocks[terms + 1] - first
        at = _ranges(first, sizes)
        return np.bincount(self.block[at], self.top[at] * np.repeat(weights, sizes), len(self.all) // BLOCK + 1)

    def nearest(self, key: tuple, k: int) -> list[tuple[float, int]]:
        """(cosine, entry) of the k nearest entries by falling cosine, ties with the last included; only those above 0."""
        terms, weights = self.vector(key)
        bound = weights * self.most[terms]
        by = np.argsort(-bound, kind="stable")
        terms, weights, bound = terms[by], weights[by], bound[by]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)
        sums = np.zeros(len(self.all))
        at, step = 0, FIRST
        while True:
            sums += self._added(terms[at : at + step], weights[at : at + step])
            at = min(at + step, len(terms))
            # Sums only grow: the k-th largest now is a lower bound of the k-th cosine.
            least = float(np.partition(sums, -k)[-k]) if len(sums) > k else 0.0
            if at == len(terms):
                near = np.flatnonzero((sums > 0) & (sums >= least - 1e-9))
                break
            if rest[at] < least:
                near = np.flatnonzero(sums >= least - rest[at] - 1e-9)
                if len(near) > MANY:
                    more = self._bounds(terms[at:], weights[at:])
                    near = near[sums[near] + more[near // BLOCK] >= least - 1e-9]
                if len(near) <= MANY:
                    break
            step = len(terms) if step > FIRST else FIRST * 4
        if self.scratch is None:
            self.scratch = np.zeros(len(self.idf))
        # Each by itself, in one order of terms, so that equal texts get equal cosines.
        q = self.scratch
        q[terms] = weights
        sizes = self.begin[near + 1] - self.begin[near]
        place = _ranges(self.begin[near], sizes)
        cosines = np.add.reduceat(self.weight[place] * q[self.term[place]], np.cumsum(sizes) - sizes) if len(near) else np.zeros(0)
        q[terms] = 0.0
        found = sorted(zip(cosines.tolist(), near.tolist()), key=lambda x: (-x[0], x[1]))
        least = found[k - 1][0] if len(found) >= k else 0.0
        return [x for x in found if x[0] >= least - 1e-9]

    def vote(self, near: list[tuple[float, int]], without: tuple[int, float, float] | None = None) -> float:
        """Weighted share of label 1. without: an entry with a weight and a label sum to be left out."""
        up = down = 0.0
        for cos, i in near:
            w = 1.0 / (GAP + max(0.0, 1.0 - cos))
            total, toxic = self.all[i], self.toxic[i]
            if without and without[0] == i:
                total, toxic = total - without[1], toxic - without[2]
            up += w * toxic
            down += w * total
        return up / down if down > 1e-12 else math.nan

    def neighbours(self, key: tuple) -> list[tuple[float, int]]:
        near = self.nearest(key, NEAREST) if key else []
        return near or ([(1.0, self.blank)] if self.blank is not None else [])

    def calibrate(self) -> None:
        """Isotonic regression of the labels on the leave-one-out votes."""
        points = []
        for i, (counts, examples) in enumerate(self.sources):
            near = self.neighbours(tuple(map(tuple, counts.tolist())))
            for label in (0.0, 1.0):
                mine = [w for _, y, w in examples if y == label]
                if mine:
                    w = mine[0]
                    v = self.vote(near, (i, w, w * label))
                    if not math.isnan(v):
                        points.append((v, label, sum(mine)))
        points.sort()
        pools: list[list[float]] = []
        for v, y, w in points:
            pools.append([v, v, y * w, w])
            while len(pools) > 1 and (pools[-2][1] >= pools[-1][0] or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]):
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        if pools:
            x = [e for p in pools for e in (p[0], p[1])]
            y = [p[2] / p[3] for p in pools for _ in (0, 1)]
            self.steps = np.array(x), np.array(y)

    def score(self, text: str | None) -> tuple[float, list[int], list[str]]:
        """(score, nearest examples, terms) of one text."""
        text = text or ""
        known = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
        if known not in self.cache:
            if len(self.cache) > 50_000:
                self.cache.clear()
            key = self.key(terms_of(text))
            near = self.neighbours(key)
            v = self.vote(near)
            score = 0.0 if math.isnan(v) else float(np.clip(np.interp(v, *self.steps), 0.0, 1.0))
            docs = [e[0] for _, i in near[:3] for e in self.examples[i]][:3]
            terms, weights = self.vector(key)
            self.cache[known] = score, docs, [self.words[t] for t in terms[np.argsort(-weights, kind="stable")[:20]]]
        return self.cache[known]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """An index of labelled texts. docs: (doc_id, text); labels: (doc_id, toxic), only rows that may teach."""
    known = written(labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxicity-labels")
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {y: min(1.0, max_examples / size[y]) if y in size else 1.0 for y in (0, 1)}
    drawn = known.filter(uniform(F.col("doc_id")) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # At most about 2 * max_examples rows of two numbers.
    examples = written(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("t")).join(F.broadcast(drawn), "doc_id"), "toxicity-examples")

    def present(batches):
        held: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[y].update(set(terms_of(text)))
            if len(held[0]) + len(held[1]) > 300_000:
                yield _sums(held)
                held = [Counter(), Counter()]
        yield _sums(held)

    counts = examples.select("toxic", "t").mapInArrow(present, "w string, c0 bigint, c1 bigint").groupBy("w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    sums = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    n0, n1 = sums.get(0, 0), sums.get(1, 0)
    if not n0 or not n1:
        index = Index({}, [(0, 0.0 if n0 or not n1 else 1.0, 1.0, {})])
        index.calibrate()
        return index
    total = float(n0 + n1)
    both = F.col("c0") + F.col("c1")
    apart = F.col("c1") * F.lit(float(n0)) - F.col("c0") * F.lit(float(n1))
    # Chi-square over the number of examples: 0 to about 1, whatever their number.
    phi2 = apart * apart / (both * (F.lit(total) - both + 0.5) * float(n0) * float(n1))
    # idf over the examples weighted back to all labelled rows.
    whole = n0 / share[0] + n1 / share[1]
    idf = F.log((1 + whole) / (1 + F.col("c0") / share[0] + F.col("c1") / share[1])) + 1e-3
    # The words of about 2 * MAX_EXAMPLES texts at most.
    chosen = counts.select("w", (idf * (phi2 + LEAST_WEIGHT)).alias("x")).toArrow().sort_by("w")
    terms = dict(zip(chosen.column(0).to_pylist(), chosen.column(1).to_pylist()))
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(terms)})

    def vectors(batches):
        numbers = shared.value
        for batch in batches:
            found = [Counter([numbers[w] for w in terms_of(t)]) for t in batch.column(2).to_pylist()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(c) for c in found], kind), pa.array([list(c.values()) for c in found], kind)], ["doc_id", "toxic", "term", "n"])

    rows = examples.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "t").mapInArrow(vectors, "doc_id bigint, toxic int, term array<int>, n array<int>").toArrow()
    weight = {y: 1.0 / share[y] for y in (0, 1)}
    each = (r for batch in rows.to_batches(256) for r in zip(*[c.to_pylist() for c in batch.columns]))
    index = Index(terms, ((doc, float(y), weight[y], dict(zip(t, n))) for doc, y, t, n in each))
    shared.destroy()
    index.calibrate()
    return index


def _sums(held: list[Counter]) -> pa.RecordBatch:
    words = list(held[0].keys() | held[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[0][w] for w in words], pa.int64()), pa.array([held[1][w] for w in words], pa.int64())], ["w", "c0", "c1"])


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence array<bigint>, terms array<string>) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            found = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.string()))], ["doc_id", "score", "evidence", "terms"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id bigint, score double, evidence array<bigint>, terms array<string>")


def learning_rows(rows: DataFrame) -> DataFrame:
    """Rows that may teach: crc32(doc_id as text) modulo 3 is not 1."""
    return rows.filter(fold(F.col("doc_id"), 3) != 1)
