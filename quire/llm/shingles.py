"""Word shingles of many texts at once, as 64-bit hashes, in numpy over raw UTF-8.

Words are runs of bytes outside `[\\x20\\x09-\\x0D]`, with A-Z lowered. A word's hash is a polynomial
over its bytes, taken from running sums, then mixed; a shingle's hash combines its words' hashes with
a factor for each place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .hashing import Powers, splitmix

_U64 = np.uint64
_POWERS = Powers(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[[32, 9, 10, 11, 12, 13]] = False


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text and at the end)."""
    data, offsets = utf8(texts)
    n = len(data)
    if not n:
        return np.zeros(0, _U64), np.zeros(len(texts) + 1, np.int64)
    data = _LOWER[data]
    inside = _INSIDE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    sums = np.cumsum((data.astype(_U64) + _U64(1)) * _POWERS.up(n), dtype=_U64)
    before = np.where(starts > 0, sums[starts - 1], _U64(0))
    hashes = splitmix((sums[ends] - before) * _POWERS.down(n)[starts] + (ends - starts).astype(_U64) * _U64(0xA24BAED4963EE407))
    return hashes, np.searchsorted(starts, offsets)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the k-word shingles, number of them before each text and at the end), repeats kept.

    A text with fewer words gives its whole sequence as one shingle; without words, none.
    """
    hashes, at = words(texts)
    counts = np.diff(at)
    n = len(hashes)
    factors = splitmix(np.arange(1, k + 1, dtype=_U64)) | _U64(1)
    sums = np.zeros(n, _U64)
    for j in range(k):  # place j of every window; a window may run into the next text and is then not used
        sums[: n - j] += hashes[j:] * factors[j]
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(made)])
    use = np.repeat(at[:-1] - out_at[:-1], made) + np.arange(out_at[-1])
    out = sums[use]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        m = counts[i]
        out[out_at[i]] = np.sum(hashes[at[i] : at[i + 1]] * factors[:m], dtype=_U64) + _U64(int(m))
    return splitmix(out), out_at


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, at = shingles(texts, k)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
