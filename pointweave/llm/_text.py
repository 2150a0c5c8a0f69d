"""Words and shingles of whole Arrow batches, by numpy over their UTF-8 bytes.

A batch of texts is one byte array with offsets. Word borders, word hashes and
shingle hashes come from array operations over it, so no Python runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at once: the temporary arrays take some 30 bytes for each.
BLOCK = 1 << 18
#: Bytes of text that one step over a batch takes, unless one text is longer.
STEP = 4 << 20

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWERED = np.arange(256, dtype=U64)
_LOWERED[65:91] += U64(32)
_LOWERED += U64(1)
_PLAIN = np.arange(256, dtype=U64) + U64(1)

#: Separators of ``[^\x20\x09-\x0D]+``.
BLANK_BYTES = np.zeros(256, bool)
BLANK_BYTES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
SYMBOL_BYTES = np.zeros(256, bool)
SYMBOL_BYTES[:0x80] = True
SYMBOL_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=U64)


_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(_INVERSE, BLOCK + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all bits of x."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and their n + 1 offsets; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    size = int(at[-1] - at[0])
    body = np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    return body, at - at[0]


def steps(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about STEP bytes of text, or of one longer text."""
    at = raw(batch.column(column))[1]
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + STEP, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def borders(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses from one text to the next."""
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range, A-Z lower-cased if asked. Ranges ascend and don't overlap."""
    out = np.empty(len(starts), U64)
    codes = _LOWERED if lower else _PLAIN
    low = 0
    while low < len(starts):
        base = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        n = int(ends[high - 1]) - base
        up, down = (_UP, _DOWN) if n <= BLOCK else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
        sums = np.zeros(n + 1, U64)
        np.cumsum(codes[data[base : base + n]] * up[:n], out=sums[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = (sums[e] - sums[s]) * down[s]
        low = high
    return mixed(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(texts: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, lower-cased, and n + 1 word offsets of the texts."""
    data, at = raw(texts)
    starts, ends = borders(data, at, separators)
    return hashes(data, starts, ends), np.searchsorted(starts, at)


def shingles(w: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of one text's word hashes, ascending; shorter texts are one shingle."""
    if len(w) == 0:
        return w
    width = min(size, len(w))
    total = np.full(len(w) - width + 1, U64(width), U64)
    for k in range(width):
        total = mixed(total + w[k : len(w) - width + 1 + k])
    total.sort()
    keep = np.empty(len(total), bool)
    keep[0] = True
    np.not_equal(total[1:], total[:-1], out=keep[1:])
    return total[keep]
