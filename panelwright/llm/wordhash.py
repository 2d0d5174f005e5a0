"""64-bit hashes of all words of a column of texts at once, from the column's own bytes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

A = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(6)]
BASE = 0x2545F4914F6CDD1D


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int, powers: list) -> np.ndarray:
    """Polynomial hashes of all n-word grams of word hashes, from those of 1, 2, 4, ... words."""
    parts, p, size, out, have = [], h, 1, None, 0
    for i in range(n.bit_length()):
        if n >> i & 1:
            parts.append((size, p))
        if size * 2 <= n and len(p) > size:
            p = p[: len(p) - size] * powers[i] + p[size:]
        size *= 2
    for size, p in reversed(parts):
        if out is None:
            out, have = p, size
        else:
            m = len(h) - have - size + 1
            out = out[:m] * powers[size.bit_length() - 1] + p[have : have + m]
            have += size
    return out


class WordHashes:
    """Hashes the words (runs of bytes other than space and \\x09-\\x0D) of texts."""

    def __init__(self):
        self.word = np.ones(256, bool)
        self.word[[9, 10, 11, 12, 13, 32]] = False
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up, self.down = (np.full(n, base, np.uint64) for base in (BASE, pow(BASE, -1, 1 << 64)))
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, out=powers)

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The word hashes of each text, in order; none for null. Texts are taken in groups of about a megabyte."""
        column = pa.compute.fill_null(column, "") if column.null_count else column
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 20), "right")) - 1)
            yield from self._group(data[off[i] : off[j]], off[i : j + 1] - off[i])
            i = j

    def _group(self, data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        n = len(data)
        word = np.zeros(n + 1, bool)
        word[:n] = self.word[data]
        first = word[:n].copy()
        first[1:] &= ~word[: n - 1]
        heads = off[:-1][off[:-1] < n]
        first[heads] = word[heads]
        last = word[:n] & ~word[1:]
        tails = off[1:][off[1:] > 0] - 1
        last[tails] = word[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = mixed((sums[ends] - sums[starts]) * self.down[starts])
        cut = np.searchsorted(starts, off)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield h[a:b]
