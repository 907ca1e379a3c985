"""Words, rolling hashes and byte arrays of Arrow text columns, vectorised over small slices.

All hashes are polynomials modulo 2**64 over a random byte table, taken from prefix sums, so the hash of any
range of bytes or words is a difference of two sums. They are fixed by the seeds below: every task and every
rerun hashes alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed at once: small enough for the arrays to stay in a core's cache.
SLICE = 1 << 16

_RANDOM = np.random.default_rng(20240229)
BYTE_TABLE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE, BASE2, WORD_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * SLICE), U64(base), dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, target: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about `target` bytes of text each (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    total = np.cumsum(np.asarray(lengths, dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + target, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: where they start and end, and in which text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside
        last[:-1] = last[:-1] & (SPACE[data[1:]] | edge[1:n])
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.doc_starts = np.searchsorted(self.starts, offsets)  # first word of each text, and the count
        self.counts = np.diff(self.doc_starts)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return range_hashes(self.data, self.starts, self.ends)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes; starts and ends do not fall."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, side="right")))
        at = int(starts[i])
        part = data[at:int(ends[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_TABLE[part] * powers(BASE, len(part)), out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * powers(inverse(BASE), len(part) + 1)[s]
        i = j
    return mix(out)


def window_hashes(hashes: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """A hash of every run of k consecutive elements (also of those that cross texts: see `within`)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    back, forth = powers(inverse(base), SLICE), powers(base, SLICE + k)
    for i in range(0, n, SLICE):
        m = min(SLICE, n - i)
        sums = np.zeros(m + k, np.uint64)
        np.cumsum(hashes[i:i + m + k - 1] * forth[:m + k - 1], out=sums[1:])
        out[i:i + m] = mix((sums[k:] - sums[:m]) * back[:m])
    return out


def within(counts: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k consecutive elements lie in one text; `counts` are the elements of each text."""
    total = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return (np.arange(total) + k <= ends)[:max(0, total - k + 1)]


def grouped(sorted_keys: np.ndarray) -> np.ndarray:
    """True where a value of a sorted array differs from the one before it."""
    new = np.ones(len(sorted_keys), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new


def runs(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal values of a sorted array."""
    cuts = np.flatnonzero(grouped(sorted_keys)).tolist() if len(sorted_keys) else []
    return list(zip(cuts, [*cuts[1:], len(sorted_keys)], strict=True)) if cuts else []


def members(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(sorted_set, values)
    return sorted_set[np.minimum(at, len(sorted_set) - 1)] == values


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The non-empty ranges of sorted 64-bit hashes that fall into each of `buckets` equal ranges of values."""
    number = ((keys >> U64(32)) * U64(buckets)) >> U64(32)
    for a, b in runs(number):
        yield int(number[a]), slice(a, b)


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpack(column: pa.Array | pa.ChunkedArray, dtype) -> list[np.ndarray]:
    """One array for each row (null: none)."""
    return [np.frombuffer(b, dtype) if b else np.zeros(0, dtype) for b in column.to_pylist()]
