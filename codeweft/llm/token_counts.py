"""Token counts of the sections of a document, by offset-mapped attribution.

A document's fields are joined by newlines and encoded once, whole.  The byte
lengths of its tokens sum to their spans; each span is then joined with the
sections' intervals by binary search, as both are sorted.  Counts of sections
thus sum to the count of the whole document, which separate encodings don't.

A token that crosses a boundary is allocated by a rule: ``start`` - to the
section that holds its first byte; ``most`` - to the section that holds most of
its bytes, the earlier one of equals.

A section is a field or, with ``by_line``, a line of a field.  Its line end, or
the newline between two fields, belongs to it.

Defined results: a null field is empty; a document without any text has one
section (one for each field) with no tokens; equal rows get equal results; very
long texts are encoded whole, one document at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, field int, section int, char_start bigint, char_end bigint, n_tokens bigint"


#: One for each vocabulary and pattern in a worker process, which runs many tasks.
_ENCODINGS: dict[tuple[str, str], tuple] = {}


def encoding(path: str, pattern: str) -> tuple:
    """A byte-level BPE from a file of ranks, and the byte length of each token; read once in a process."""
    if (path, pattern) not in _ENCODINGS:
        _ENCODINGS[path, pattern] = _read(path, pattern)
    return _ENCODINGS[path, pattern]


def _read(path: str, pattern: str) -> tuple:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(sizes: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. sizes: bytes of each token; ends: ascending byte ends of the sections."""
    stop = np.cumsum(sizes)
    start = stop - sizes
    first = np.searchsorted(ends, start, side="right")
    if rule == "most":
        last = np.searchsorted(ends, stop - 1, side="right")
        for i in np.flatnonzero(last > first):
            edges = np.concatenate(([start[i]], ends[first[i] : last[i]], [stop[i]]))
            first[i] += int(np.argmax(np.diff(edges)))
    return np.bincount(first, minlength=len(ends))


def sections_of(fields: list[str | None], by_line: bool) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The document's bytes, the byte ends of its sections, the field of each."""
    raws = [(f or "").encode("utf-8") for f in fields]
    ends, of, base = [], [], 0
    for k, raw in enumerate(raws):
        stop = base + len(raw) + (k + 1 < len(raws))
        lines = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1 + base if by_line else np.zeros(0, np.int64)
        mine = np.append(lines[lines < base + len(raw)], stop)
        ends.append(mine)
        of.append(np.full(len(mine), k))
        base = stop
    return b"\n".join(raws), np.concatenate(ends), np.concatenate(of)


def section_counts(docs: DataFrame, path: str, pattern: str, fields: Sequence[str] = ("text",), by_line: bool = True, rule: str = "start", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, field, section, char_start, char_end, n_tokens): one row for each section of each row of docs."""
    if rule not in ("start", "most"):
        raise ValueError(f"no such rule: {rule}")

    def run(batches):
        enc, lengths = encoding(path, pattern)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = list(zip(*[c.to_pylist() for c in batch.columns[1:]]))
            held: list[list] = [[], [], [], [], [], []]
            for key, row in zip(ids, texts):
                raw, ends, of = sections_of(list(row), by_line)
                tokens = np.array(enc.encode_ordinary(raw.decode("utf-8")), np.int64)
                counts = attribute(lengths[tokens], ends, rule)
                heads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                stops = heads[ends]
                for to, values in zip(held, ([key] * len(ends), of, range(len(ends)), np.concatenate(([0], stops[:-1])), stops, counts)):
                    to.extend(values)
                if len(held[0]) >= 20_000:
                    yield _rows(held)
                    held = [[], [], [], [], [], []]
            if held[0]:
                yield _rows(held)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return slim.mapInArrow(run, SCHEMA)


def _rows(held: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    arrays = [pa.array(held[0], kinds[0]), *[pa.array(np.array(v, np.int64)).cast(k) for v, k in zip(held[1:], kinds[1:])]]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "field", "section", "char_start", "char_end", "n_tokens"])
