"""Word shingles of Arrow text columns as 64-bit hashes, computed on whole buffers at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_VALUES = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = _RNG.integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    def __init__(self, words: int):
        self.words = words
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, CHUNK + 1)
            self.up, self.down = _powers(_BASE, self.size), _powers(_INVERSE, self.size)

    def _chunk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of the texts ``data[starts[i]:ends[i]]``, which lie one behind the other."""
        n, k = len(data), self.words
        self._grow(n + 1)
        text = ~_SPACE[data]
        begin, end = text.copy(), text.copy()
        begin[1:] &= ~text[:-1]
        end[:-1] &= ~text[1:]
        inner = starts[(starts > 0) & (starts < n)]
        begin[inner] = text[inner]
        end[inner - 1] = text[inner - 1]
        a, z = np.flatnonzero(begin), np.flatnonzero(end) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * self.up[:n], dtype=np.uint64)])
        word = mix((total[z] - total[a]) * self.down[a] + (z - a).astype(np.uint64))
        first = np.searchsorted(a, starts)
        count = np.searchsorted(a, ends) - first
        run = np.zeros(max(0, len(word) - k + 1), np.uint64)
        for i in range(k):
            run += word[i:i + len(run)] * _FACTORS[i]
        run = mix(run)
        out = []
        for f, c in zip(first.tolist(), count.tolist()):
            if c >= k:
                out.append(np.unique(run[f:f + c - k + 1]))
            elif c:
                out.append(mix(np.array([int((word[f:f + c] * _FACTORS[:c]).sum(dtype=np.uint64)) ^ c], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """One sorted array of distinct shingles per text; null and blank texts have none."""
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        if not n:
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset:]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            lo = offsets[at]
            yield from self._chunk(data[lo:offsets[stop]], offsets[at:stop] - lo, offsets[at + 1:stop + 1] - lo)
            at = stop
