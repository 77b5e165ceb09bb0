"""Approximate nearest neighbours by balanced posting lists.

A bounded sample of the vectors (SAMPLE at most in expectation) gives centroids,
by k-means with a price on full clusters so that lists come out balanced.  Every
vector goes to the list of its nearest centroid and, near a boundary, to others
whose distance is at most 1 + SPREAD times the nearest, REPLICAS lists at most.
The centroids are searched by a graph held in memory: links to the nearest
centroids, walked best first from a few entries, ever wider until the distance
ratio is met.  A query visits the lists whose centroid is within 1 + ratio times
the nearest centroid's distance, at least LEAST_LISTS of them.  The ratio is chosen
on the sample: the least one with which a share TARGET of the true neighbours of
CHECKED sample vectors (by brute force over the sample) are in a list visited.  The
whole table is denser than the sample, so its neighbours are nearer and found more
often.

Lists are cut into parts of about PART vectors, so a vector that is very common
fills many tasks and not one; each part gives its own nearest for a query, by
exact cosine in double precision on the original vectors, and the parts' results
are merged.  Queries meet the parts of their lists in one shuffle, sorted so that a
part's vectors come first and its queries stream past them: a task holds one part and
a batch of queries, however many queries visit a list.

Defined results: vectors that are null, zero, of another length than most or
hold null or non-finite values take no part, neither do rows without vec_id;
rows with one vec_id and one vector are one candidate; with fewer candidates
than asked, all found are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import uniform, written

#: Sample vectors; at MAX_LISTS there are 20 for each centroid.
SAMPLE = 40_000
LIST_SIZE, MAX_LISTS = 256, 2000
REPLICAS, SPREAD = 4, 0.10
LEAST_LISTS, TARGET, CHECKED = 8, 0.93, 500
PART = 2048
#: Rows of lists to visit that are given out at once.
VISITS = 8192
DEGREE, BREADTH = 24, 96


def usable(x: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines stay what they are."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def unit(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def distances(cos: np.ndarray) -> np.ndarray:
    """Between unit vectors, from their cosines."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def lists_near(m: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the lists of some unit vectors, with boundary replicas."""
    far = distances(m @ centre.T)
    few = min(REPLICAS, far.shape[1])
    near = np.argpartition(far, few - 1, axis=1)[:, :few]
    d = np.take_along_axis(far, near, 1)
    r, c = np.nonzero(d <= (1 + SPREAD) * d.min(1, keepdims=True))
    return r, near[r, c]


def least_ratio(sample: np.ndarray, centre: np.ndarray, k: int) -> float:
    """The ratio with which lists visited hold a share TARGET of the k nearest of some sample vectors."""
    held = np.full((len(sample), REPLICAS), -1)
    for i in range(0, len(sample), 2048):
        r, c = lists_near(sample[i : i + 2048], centre)
        first = np.flatnonzero(np.diff(r, prepend=-1))
        held[r + i, np.arange(len(r)) - first[r]] = c
    need = []
    for i in np.linspace(0, len(sample) - 1, min(CHECKED, len(sample))).astype(np.int64).tolist():
        cos = sample @ sample[i]
        cos[i] = -np.inf
        near = np.argsort(-cos, kind="stable")[: min(k, len(sample) - 1)]
        far = distances(centre @ sample[i])
        lists = held[near]
        need.append(np.where(lists >= 0, far[lists], np.inf).min(1) / max(far.min(), 1e-12))
    need = np.concatenate(need) if need else np.zeros(0)
    return float(np.quantile(need, TARGET)) - 1.0 + 1e-9 if len(need) else 0.0


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors; a cluster's price rises with its surplus over the mean size."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), k, replace=False)].copy()
    price = np.zeros(k)
    for _ in range(rounds):
        sums, counts = np.zeros_like(centre), np.zeros(k)
        for i in range(0, len(sample), 4096):
            part = sample[i : i + 4096]
            best = (part @ centre.T - price).argmax(1)
            np.add.at(sums, best, part)
            counts += np.bincount(best, minlength=k)
        price += 0.02 * (counts * k / len(sample) - 1.0).clip(-1, 3)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-9)
        sums[empty] = sample[rng.choice(len(sample), len(empty))]
        centre = unit(sums)
    return centre


class Graph:
    """Centroids with links to near ones, searched best first."""

    def __init__(self, centre: np.ndarray, ratio: float):
        self.centre, self.ratio = centre, ratio
        k = len(centre)
        near = np.argsort(-(centre @ centre.T), axis=1, kind="stable")[:, 1 : DEGREE + 1]
        links = [set(row.tolist()) for row in near]
        for i, row in enumerate(near):
            for j in row[: DEGREE // 2].tolist():
                links[j].add(i)
        # A ring keeps the graph in one piece.
        for i in range(k):
            if k > 1:
                links[i].add((i + 1) % k)
        self.links = [np.array(sorted(x - {i}), np.int64) for i, x in enumerate(links)]
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(np.int64))

    def search(self, q: np.ndarray, breadth: int = BREADTH) -> tuple[np.ndarray, np.ndarray]:
        """Centroids by rising distance, and the distances; breadth of them at most."""
        seen = np.zeros(len(self.centre), bool)
        seen[self.entries] = True
        at = self.entries
        cos = self.centre[at] @ q
        open_ = np.ones(len(at), bool)
        while True:
            order = np.argsort(-cos, kind="stable")[:breadth]
            at, cos, open_ = at[order], cos[order], open_[order]
            todo = np.flatnonzero(open_)[:8]
            if not len(todo):
                break
            open_[todo] = False
            new = np.unique(np.concatenate([self.links[i] for i in at[todo]])) if len(todo) else at[:0]
            new = new[~seen[new]]
            seen[new] = True
            at, cos, open_ = np.concatenate((at, new)), np.concatenate((cos, self.centre[new] @ q)), np.concatenate((open_, np.ones(len(new), bool)))
        return at, distances(cos)

    def within(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As search, with a breadth that doubles until the last centroid found is beyond 1 + ratio."""
        breadth = BREADTH
        while True:
            at, distance = self.search(q, breadth)
            if len(at) < breadth or distance[-1] > (1 + self.ratio) * distance[0]:
                return at, distance
            breadth *= 2


def lists_of(distance: np.ndarray, ratio: float) -> int:
    """Lists a query visits, of those at ascending distance."""
    return max(min(LEAST_LISTS, len(distance)), int((distance <= (1 + ratio) * distance[0]).sum()))


def built(sample: np.ndarray, total: int, k: int) -> Graph:
    """Centroids for ``total`` vectors from a sample of distinct unit vectors, and the ratio for the k nearest."""
    centre = balanced_centroids(sample, int(max(1, min(MAX_LISTS, total // LIST_SIZE, len(sample)))))
    return Graph(centre, least_ratio(sample, centre, k))


def streamed(frames, nearest):
    """nearest(vectors, queries) of each part, for a batch of its queries at a time; frames: sorted by list, part and asks."""
    part, held = None, []
    for pdf in frames:
        for (*key, asks), rows in pdf.groupby(["list", "part", "asks"]):
            if key != part:
                part, held = key, []
            if not asks:
                held.append(rows[["vec_id", "v"]])
            elif held:
                held = [pd.concat(held, ignore_index=True)]
                for i in range(0, len(rows), 512):
                    yield nearest(held[0], rows[i : i + 512].rename(columns={"vec_id": "query_id", "v": "q"}))


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which ``queries`` (on the id column) holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    width, total = sizes[0]["d"], sizes[0]["count"]
    rows = rows.filter(F.size("v") == width)
    drawn = rows.filter(uniform(F.col("vec_id")) < min(1.0, SAMPLE / total)).select("vec_id", "v").toPandas()
    if not len(drawn):
        drawn = rows.limit(SAMPLE).select("vec_id", "v").toPandas()
    sample = np.stack(drawn.sort_values("vec_id")["v"].to_numpy())
    shared = spark.sparkContext.broadcast(built(np.unique(unit(sample), axis=0), total, k))

    def placed(frames):
        """Lists of each vector, with boundary replicas."""
        centre = shared.value.centre
        for pdf in frames:
            m = unit(np.stack(pdf["v"].to_numpy()))
            out_row, out_list = [], []
            for i in range(0, len(m), 2048):
                r, c = lists_near(m[i : i + 2048], centre)
                out_row.append(r + i)
                out_list.append(c)
            r = np.concatenate(out_row)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[r], "v": pdf["v"].to_numpy()[r], "list": np.concatenate(out_list).astype(np.int32)})

    def probes(frames):
        for pdf in frames:
            at, to = [], []
            for i, q in enumerate(unit(np.stack(pdf["v"].to_numpy()))):
                lists, distance = shared.value.within(q)
                n = lists_of(distance, shared.value.ratio)
                at += [i] * n
                to.append(lists[:n])
                if len(at) >= VISITS or i + 1 == len(pdf):
                    yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[at], "v": pdf["v"].to_numpy()[at], "list": np.concatenate(to).astype(np.int32)})
                    at, to = [], []

    kind = "vec_id bigint, v array<double>, list int"
    index = written(rows.mapInPandas(placed, kind), "postings")
    lengths = index.groupBy("list").count().select("list", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    lengths = written(lengths, "posting-lengths")  # a row for each list, MAX_LISTS at most
    parts = F.broadcast(lengths)
    left = index.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("list", "part", "vec_id", "v")
    asked = rows.filter(queries).mapInPandas(probes, kind).join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def nearest(lists: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of one part for each query that visits it."""
        if not len(lists) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        lists = lists.sort_values("vec_id", ignore_index=True)
        ids, m = lists["vec_id"].to_numpy(), scaled(np.stack(lists["v"].to_numpy()))
        size = np.linalg.norm(m, axis=1)
        q_ids, out = asks["query_id"].to_numpy(), []
        for i in range(0, len(asks), 512):
            q = scaled(np.stack(asks["q"].to_numpy()[i : i + 512]))
            cos = (q @ m.T) / (np.linalg.norm(q, axis=1)[:, None] * size[None, :])
            for j in range(len(q)):
                c = np.where(ids == q_ids[i + j], -np.inf, cos[j])
                # Candidates near the k-th are scored again, each by itself.
                floor = np.partition(c, -min(k, len(c)))[-min(k, len(c))] - 1e-9
                near = np.flatnonzero((c >= floor) & (c > -np.inf))
                exact = (m[near] * q[j]).sum(1) / (np.sqrt((q[j] * q[j]).sum()) * np.sqrt((m[near] * m[near]).sum(1)))
                best = np.lexsort((ids[near], -exact))[:k]
                out.append(pd.DataFrame({"query_id": q_ids[i + j], "vec_id": ids[near[best]], "score": exact[best]}))
        return pd.concat(out, ignore_index=True)

    both = left.withColumn("asks", F.lit(False)).unionByName(asked.select("list", "part", F.col("query_id").alias("vec_id"), F.col("q").alias("v"), F.lit(True).alias("asks")))
    dealt = both.repartition("list", "part").sortWithinPartitions("list", "part", "asks")
    met = dealt.mapInPandas(lambda frames: streamed(frames, nearest), "query_id bigint, vec_id bigint, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
