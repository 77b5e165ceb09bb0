"""Content-defined cuts by a gear rolling hash.

The hash of a position is the sum of ``G[byte] << age`` over the last 16 bytes,
modulo 2**16, so a cut depends on the 16 bytes before it alone and cuts fall in
step again soon after an insertion.  A text is hashed whole, by doubling: sums
over 1, 2, 4, 8 and 16 bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash

WINDOW = 16
#: One 16-bit value for each byte.
G = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)


def rolling(data: np.ndarray) -> np.ndarray:
    h = G[data]
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s] << np.uint16(s)
    return h


def cuts(raw: bytes, bits: int, least: int) -> np.ndarray:
    """Ends of the chunks of UTF-8 bytes, ascending; the last is len(raw).

    A cut comes once in 2**bits positions, not less than ``least`` bytes after
    the one before, and only between code points.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    mask = np.uint16(((1 << bits) - 1) << (16 - bits))
    at = np.flatnonzero((rolling(data) & mask) == mask) + 1
    for _ in range(3):
        at = at[at < n]
        at += (data[at] & 0xC0) == 0x80
    out, last = [], 0
    for p in at.tolist():
        if p - last >= least and p < n:
            out.append(p)
            last = p
    out.append(n)
    return np.array(out, np.int64)
