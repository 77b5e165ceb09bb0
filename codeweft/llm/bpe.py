"""BPE encoding and decoding with reuse of content-defined chunks.

A text's UTF-8 bytes are cut by a rolling hash (``gear``), so that a passage
that several documents share falls into the same chunks wherever it stands.  The
interior of a chunk, from its first to its last white space, is encoded the first
time a worker meets the chunk and its ids are kept; later documents copy them.

A cut falls anywhere, also within a word, so the joins of chunks are repaired: the
region over a cut - what follows the last white space of one chunk and what comes
before the first one of the next - is encoded anew together with a piece of either
neighbour.  The join agrees when the region's ids begin with the ids of the left
neighbour's piece and end with those of the right one's; what lies between is the
join's own.  A chunk without white space has no interior and the region grows over
it.  Where a join doesn't agree the region grows to the whole text, which is then
encoded by the library at once, so that the ids always are the library's.  A
vocabulary that gives white space ids of its own is refused.

Memory: a worker process keeps at most about CHUNK_BYTES of chunks and PIECES pieces
with PIECE_IDS ids over its tasks, then starts the table anew.  A chunk is kept from the second time on: of text that
never comes again only 8 bytes a chunk are held, SEEN chunks at most.  Batches are
worked off in slices of SLICE_BYTES, one whole text at least.  The table is each
worker's own: it changes the work done, never the result.

Defined results: null is the empty text, with no ids; equal rows get equal
results; the operator returns one row for each row with the ids and the decoded
text; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gear import cuts

CHUNK_BYTES = 48_000_000
SEEN = 500_000
#: Bytes of text that become Python strings at one time.
SLICE_BYTES = 2_000_000
CHUNK_BITS, CHUNK_LEAST = 9, 64
PIECES, PIECE_IDS = 600_000, 6_000_000
#: Normalisers and pre-tokenisers, as a vocabulary file tells them, under which no token, composition or case depends on what is
#: beyond a space.
APART = (
    {"type": "NFC"},
    {"type": "Lowercase"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    {"type": "WhitespaceSplit"},
)
#: Bytes that a kept chunk costs beside its ids, about.
HELD = 600


#: One for each vocabulary in a worker process, which runs many tasks.
_ENCODERS: dict[str, Encoder] = {}


class Chunk:
    """What is kept of a chunk with an interior."""

    __slots__ = ("head", "tail", "ids", "first", "last")

    def __init__(self, head: str, tail: str, ids: bytes, first: tuple[str, bytes], last: tuple[str, bytes]):
        #: Text before the first and after the last white space.
        self.head, self.tail = head, tail
        self.ids = ids
        #: The interior's first and last piece with their ids: the context of a join.
        self.first, self.last = first, last


class Encoder:
    """Encodes whole texts; equal to the library on each of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        if self.tok.decoder is not None:
            raise ValueError("a vocabulary with a decoder of its own: tokens aren't joined by single spaces")
        if any(self.raw([" ", "\n", " \n  "])):
            raise ValueError("a vocabulary with ids for white space: chunks have no safe interior")
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.names = pa.array([self.tok.id_to_token(i) for i in range(size)], pa.string())
        told = json.loads(self.tok.to_str())
        steps = [y for x in (told["normalizer"], told["pre_tokenizer"]) if x for y in x.get("normalizers", x.get("pretokenizers", [x]))]
        reach = [x for x in told["added_tokens"] if x["lstrip"] or x["rstrip"] or " " in x["content"]]
        self.apart = all(x in APART for x in steps) and bool(told["pre_tokenizer"]) and not reach
        #: Joins that did not agree and were mended by the whole text.
        self.mended = 0
        self.forget()
        self.forget_pieces()

    def forget(self) -> None:
        #: digest -> what is kept of the chunk; None: it has no interior
        self.chunks: dict[bytes, Chunk | None] = {}
        self.seen: set[bytes] = set()
        self.held = 0

    def forget_pieces(self) -> None:
        #: piece -> its row; of each row the first id and their number
        self.rows: dict[bytes, int] = {}
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def by_piece(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are put together from what is between their spaces."""
        if len(self.rows) > PIECES or len(self.flat) > PIECE_IDS:
            self.forget_pieces()
        if not texts:
            return []
        data = (" ".join(texts) + " ").encode("utf-8")
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
        bounds = np.concatenate(([0], ends)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        kinds = pieces.dictionary.to_pylist()
        rows = self.rows
        fresh = [x for x in kinds if x not in rows]
        if fresh:
            found = self.raw([x.decode("utf-8") for x in fresh])
            rows.update(zip(fresh, range(len(rows), len(rows) + len(fresh))))
            size = np.array([len(x) // 4 for x in found], np.int64)
            self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(found), "<u4")))
        row = np.array([rows[x] for x in kinds], np.int64)[pieces.indices.to_numpy()]
        size = self.size[row]
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[row] - (upto - size), size) + np.arange(int(upto[-1]))].tobytes()
        last = np.cumsum([x.count(" ") + 1 for x in texts])
        stop = (upto[last - 1] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stop[:-1]], stop)]

    def raw(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, as little-endian 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        if self.held > CHUNK_BYTES or len(self.seen) > SEEN:
            self.forget()
        whole = [t or "" for t in texts]
        plans, fresh = [], {}
        for text in whole:
            raw = text.encode("utf-8")
            plan, start = [], 0
            for end in cuts(raw, CHUNK_BITS, CHUNK_LEAST).tolist():
                part = raw[start:end]
                start = end
                key = xxhash.xxh3_128_digest(part)
                if key not in self.chunks and key not in fresh:
                    fresh[key] = part.decode("utf-8").replace("\n", " ")
                plan.append((key, part))
            plans.append(plan)
        known = self._learn(fresh)
        regions: dict[str, int] = {}
        drafts = [self._drafted(plan, known, regions) for plan in plans]
        found = self.raw(list(regions))
        out, again = [], []
        for i, draft in enumerate(drafts):
            ids = self._joined(draft, found)
            if ids is None:
                again.append(i)
            out.append(ids or b"")
        for i, ids in zip(again, self.raw([whole[i] for i in again])):
            out[i] = ids
        self.mended += len(again)
        return out

    def _learn(self, fresh: dict[bytes, str]) -> dict[bytes, Chunk | None]:
        """Encodes new chunks, each once, and keeps those met before."""
        cut = {}
        for key, text in fresh.items():
            a, b = text.find(" "), text.rfind(" ")
            inner = text[a + 1 : b].strip(" ") if b > a >= 0 else ""
            if inner:
                cut[key] = text[:a], inner, text[b + 1 :], inner.split(" ", 1)[0], inner.rsplit(" ", 1)[-1]
        pieces = list({x for c in cut.values() for x in c[3:]})
        of = dict(zip(pieces, self.raw(pieces)))
        encode = self.by_piece if self.apart else self.raw
        inner = dict(zip(cut, encode([c[1] for c in cut.values()])))
        known: dict[bytes, Chunk | None] = {}
        for key in fresh:
            chunk = None
            if key in cut:
                head, _, tail, first, last = cut[key]
                ids = inner[key]
                # The context must agree with the chunk itself; else the chunk has no safe interior.
                if ids.startswith(of[first]) and ids.endswith(of[last]):
                    chunk = Chunk(head, tail, ids, (first, of[first]), (last, of[last]))
            known[key] = chunk
            if key in self.seen:
                self.chunks[key] = chunk
                self.held += HELD + (len(chunk.ids) if chunk else 0)
            else:
                self.seen.add(key)
        return known

    def _drafted(self, plan: list[tuple[bytes, bytes]], known: dict[bytes, Chunk | None], regions: dict[str, int]) -> list:
        """The chunks of a text and, between them, the joins: (number of the region's text, ids that it must begin and end with)."""
        draft: list = []
        left, carry = None, ""

        def join(right: Chunk | None) -> None:
            if not carry.strip(" ") and not (left and right):
                return
            text = f"{left.last[0]} {carry}" if left else carry
            text = f"{text} {right.first[0]}" if right else text
            draft.append((regions.setdefault(text, len(regions)), left.last[1] if left else b"", right.first[1] if right else b""))

        for key, part in plan:
            chunk = known[key] if key in known else self.chunks[key]
            if chunk is None:
                carry += part.decode("utf-8").replace("\n", " ")
                continue
            carry += chunk.head
            join(chunk)
            draft.append(chunk)
            left, carry = chunk, chunk.tail
        join(None)
        return draft

    @staticmethod
    def _joined(draft: list, found: list[bytes]) -> bytes | None:
        """The ids of a text, or None where a join does not agree."""
        parts = []
        for x in draft:
            if isinstance(x, Chunk):
                parts.append(x.ids)
                continue
            number, begin, end = x
            ids = found[number]
            if len(ids) < len(begin) + len(end) or not ids.startswith(begin) or not ids.endswith(end):
                return None
            parts.append(ids[len(begin) : len(ids) - len(end)])
        return b"".join(parts)

    def decoded(self, ids: list[bytes]) -> pa.Array:
        """The decoded text of each text's ids: names joined by single spaces."""
        flat = pa.array(np.frombuffer(b"".join(ids), "<u4"))
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.names.take(flat)), " ")


def batches_of(texts: pa.Array, most_bytes: int | None = None):
    """Slices of an Arrow array of texts with so many bytes at most, one text at least."""
    most_bytes = SLICE_BYTES if most_bytes is None else most_bytes
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n or 0
        if held >= most_bytes:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, ids binary, decoded string) for each row: ids as little-endian 32-bit integers.

    digests: (doc_id, n_tokens, ids_sha256, decoded_sha256) instead.
    """

    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in batches_of(texts):
                ids = encoder.batch(texts.slice(a, b - a).to_pylist())
                decoded = encoder.decoded(ids)
                key = keys.slice(a, b - a)
                if digests:
                    yield pa.RecordBatch.from_arrays(
                        [key, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(y.as_buffer()).hexdigest() for y in decoded])],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays([key, pa.array(ids, pa.binary()), decoded], ["doc_id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "doc_id bigint, ids binary, decoded string")
