"""64-bit hashing in numpy."""

from __future__ import annotations

import weakref

import numpy as np

_U64 = np.uint64
_ALL: weakref.WeakSet[Powers] = weakref.WeakSet()


def forget_powers() -> None:
    """Drop all tables of powers; they are made again when needed."""
    for powers in _ALL:
        powers.forget()


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (public domain constants)."""
    x = x.astype(_U64, copy=True)
    x += _U64(0x9E3779B97F4A7C15)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class Powers:
    """Running powers of an odd base modulo 2**64 and of its inverse, grown when a longer array comes."""

    def __init__(self, base: int):
        self.base = (_U64(base), _U64(pow(base, -1, 1 << 64)))
        self.forget()
        _ALL.add(self)

    def forget(self) -> None:
        self.tables = [np.ones(1, _U64), np.ones(1, _U64)]

    def _upto(self, i: int, n: int) -> np.ndarray:
        if len(self.tables[i]) < n:
            steps = np.full(max(n + n // 4, 1 << 16), self.base[i], _U64)
            steps[0] = 1
            self.tables[i] = np.multiply.accumulate(steps)
        return self.tables[i][:n]

    def up(self, n: int) -> np.ndarray:
        return self._upto(0, n)

    def down(self, n: int) -> np.ndarray:
        return self._upto(1, n)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of runs that start at `starts` and are `sizes` long, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers, small: their steps by byte planes (the upper ones are zero), compressed."""
    import zstandard

    steps = np.diff(values.astype(_U64), prepend=_U64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(content: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(content), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=_U64)
