"""Repeated passages, by content-defined chunks and their digests.

Each text is cut by a gear rolling hash (``gear``), so that a passage falls into
the same chunks wherever it stands and an insertion moves only the chunks around
it.  Cuts move on to the next white space within REACH bytes.  A chunk is known
by its 128-bit digest.  The first place of a digest - smallest doc_id, then text
digest, then position - keeps it; every other place repeats it.  Neighbouring
repeated chunks join into runs, and a run of ``least_chars`` or more is a
repeated passage.  The limit keeps short phrases and stock lines that many
documents share.

The table of chunks holds digests and positions, no text.  Digests are counted
with partial sums, so a line that a third of the documents holds is one row for
each task; places then join the repeated digests only, and the places of a digest
that very many hold are dealt to several tasks.

Defined results: null and empty texts have no chunk; rows with equal doc_id and
text are one document with one result; a null doc_id comes after all others;
a text with no white space is cut between code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written
from .gear import cuts

CHUNK_BITS, CHUNK_LEAST, REACH = 5, 16, 24
LEAST_CHARS = 150
LAST = 2**63 - 1


def chunk_ends(raw: bytes) -> np.ndarray:
    """Byte ends of the chunks of one text."""
    ends = cuts(raw, CHUNK_BITS, CHUNK_LEAST)
    if len(ends) < 2:
        return ends
    data = np.frombuffer(raw, np.uint8)
    spaces = np.flatnonzero((data == 32) | (data == 10)) + 1
    if len(spaces):
        after = spaces[np.minimum(np.searchsorted(spaces, ends), len(spaces) - 1)]
        ends = np.unique(np.where((after >= ends) & (after - ends <= REACH), after, ends))
    return ends


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, pos, len, k1, k2): the chunks of each text; positions in code points, t the text's digest."""

    def run(batches):
        for batch in batches:
            held: list[list] = [[], [], [], [], [], []]
            count = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                raw = text.encode("utf-8")
                ends = chunk_ends(raw)
                digest = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())])
                if len(text) == len(raw):
                    at = ends
                else:
                    at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[ends - 1]
                start = np.concatenate(([0], at[:-1]))
                held[0].append(np.full(len(ends), LAST if key is None else key, np.int64))
                held[1].append(np.full(len(ends), xxhash.xxh64_intdigest(raw, 42), np.uint64).view(np.int64))
                held[2].append(start)
                held[3].append(at - start)
                both = np.frombuffer(digest, np.int64).reshape(-1, 2)
                held[4].append(both[:, 0])
                held[5].append(both[:, 1])
                count += len(ends)
                if count >= 100_000:
                    yield _rows(held)
                    held, count = [[], [], [], [], [], []], 0
            if count:
                yield _rows(held)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("x")).mapInArrow(run, "id bigint, t bigint, pos int, len int, k1 bigint, k2 bigint")


def _rows(held: list[list]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k, copy=False)) for x, k in zip(held, kinds)], ["id", "t", "pos", "len", "k1", "k2"])


def joined(places: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Runs of neighbouring (pos, len) of ``least`` characters or more, as (start, end)."""
    runs: list[list[int]] = []
    for pos, size in sorted(places):
        if runs and runs[-1][1] >= pos:
            runs[-1][1] = max(runs[-1][1], pos + size)
        else:
            runs.append([pos, pos + size])
    return [(a, b) for a, b in runs if b - a >= least]


def repeats(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, spans array<struct<s,e>>): documents that repeat passages, and where.

    id is LAST where doc_id is null.
    """
    table = written(chunks(docs, id_col, text_col), "chunks")
    # The digests that repeat: read twice by each join, once for those in very many places.
    twice = written(table.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1"), "chunks-repeated")
    total = table.count()
    shared = written(salted_join(table, twice, ["k1", "k2"], total), "chunks-shared")
    first = shared.groupBy("k1", "k2").agg(F.min(F.struct("id", "t", "pos")).alias("first"), F.count("*").alias("n"))
    again = salted_join(shared, written(first, "chunks-first"), ["k1", "k2"], total).filter(F.struct("id", "t", "pos") != F.col("first")).select("id", "t", "pos", "len")
    lists = again.groupBy("id", "t").agg(F.collect_set(F.struct("pos", "len")).alias("places"))

    def run(batches):
        for batch in batches:
            spans = [joined([(p["pos"], p["len"]) for p in x], least_chars) for x in batch.column(2).to_pylist()]
            keep = pa.array([bool(x) for x in spans])
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            out = pa.array([[{"s": a, "e": b} for a, b in x] for x in spans], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["id", "t", "spans"]).filter(keep)

    return lists.mapInArrow(run, "id bigint, t bigint, spans array<struct<s:int,e:int>>")


def without(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of :func:`repeats` cut out of the texts; all columns and rows stay."""
    names = docs.columns
    x = F.col(f"d.{text_col}")
    spans = F.coalesce("f.spans", F.expr("CAST(array() AS array<struct<s:int,e:int>>)"))
    # The pieces between the spans: each starts where a span ends.
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda p: p["e"]))
    ends = F.concat(F.transform(spans, lambda p: p["s"]), F.array(F.length(x)))
    kept = F.when(F.size(spans) == 0, x).otherwise(F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(x, a + 1, b - a)), ""))
    joined_up = docs.alias("d").join(found.alias("f"), (F.coalesce(F.col(f"d.{id_col}").cast("bigint"), F.lit(LAST)) == F.col("f.id")) & (text_key(x) == F.col("f.t")), "left")
    return joined_up.select(*[kept.alias(n) if n == text_col else F.col(f"d.`{n}`") for n in names])
