"""Vectorised text kernels used inside Arrow tasks.

A batch's text column is viewed as one byte buffer plus row offsets, so words of
thousands of rows are found and hashed by a handful of numpy passes. Buffers are
walked in slices of about `CHUNK_BYTES` (a longer row is a slice of its own), so the
temporaries stay a small multiple of that size whatever the batch holds.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; letters A-Z are
lower-cased. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64)
_powers = np.multiply.accumulate(np.full(64, _BASE))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    array = column.cast(pa.large_binary())
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offs


def slices(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for runs of rows of about `limit` bytes."""
    data, offs = byte_view(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(column: pa.Array | pa.ChunkedArray, rows: int = 64, limit: int = 16 << 20) -> Iterator[tuple[int, int]]:
    """(first row, last row + 1) of runs of at most `rows` rows and about `limit` bytes; a longer row is a run of its own."""
    offs = byte_view(column)[1]
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row pointer, in-word mask) of the words of a byte slice."""
    inside = ~_GAP[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[offs[:-1][offs[:-1] < len(data)]] = False
        after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs), inside


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, row pointer, starts, ends)."""
    global _powers
    starts, ends, ptr, inside = word_bounds(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), ptr, starts, ends
    lens = ends - starts
    if (longest := int(lens.max())) > len(_powers):
        _powers = np.multiply.accumulate(np.full(2 * longest, _BASE))
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    letters = _TABLE[_LOWER[data[inside]]]
    letters *= _powers[place]
    return mix64(np.add.reduceat(letters, first) + lens.astype(np.uint64)), ptr, starts, ends


def stem_hashes(data: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, the hash of the first letters (bytes) of every word, whole where it is shorter."""
    starts, ends, _, inside = word_bounds(data, offs)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in sizes]
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.minimum(np.arange(int(lens.sum())) - np.repeat(first, lens), 63)
    sums = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(_TABLE[_LOWER[data[inside]]] * _powers[place], out=sums[1:])
    out = []
    for size in sizes:
        kept = np.minimum(lens, size)
        out.append(mix64(sums[first + kept] - sums[first] + kept.astype(np.uint64) + np.uint64(size << 20)))
    return out


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of `k` consecutive entries of `words` (row borders are the caller's)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = (total + words[j : j + n]) * _BASE
    return mix64(total)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the `k`-word shingles of each row.

    A row of fewer words (one at least) has its whole sequence as its only shingle;
    a row without words has none.
    """
    words, ptr, _, _ = word_hashes(data, offs)
    grams = ngram_hashes(words, k)
    out = []
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
        if b - a >= k:
            got = np.sort(grams[a : b - k + 1])
            out.append(got[np.r_[True, got[1:] != got[:-1]]] if len(got) > 1 else got)
        elif b > a:
            out.append(ngram_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
