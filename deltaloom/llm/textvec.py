"""Vectorised hashing of words and word sequences, on whole batches of texts at once (numpy, no loop over words)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd: each power is invertible modulo 2**64
_C1, _C2, _C3 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        both = []
        for b in (_BASE, _INVERSE):
            base = np.full(n, b, _U)
            base[0] = 1
            both.append(np.multiply.accumulate(base))
        _powers = (both[0], both[1])
    return _powers


class Words:
    """The white-space words of a run of texts, A-Z lower-cased, as flat arrays.

    buf: all bytes, the texts parted by newlines; start, end: byte ranges of the words; doc: text of each word;
    first: word numbers where the texts begin (one more at the end).
    """

    def __init__(self, texts: list[bytes]):
        self.count = len(texts)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw, self.buf = raw, _LOWER[raw]
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.begin = begin
        self.first = np.searchsorted(self.start, begin)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.count), self.n)

    def hashes(self) -> np.ndarray:
        size = len(self.buf)
        power, inverse = _power(size + 1)
        total = np.zeros(size + 1, _U)
        np.cumsum((self.buf.astype(_U) + _U(1)) * power[:size], out=total[1:])
        # the sums carry the power of the word's start, which the inverse takes off: a word's hash is its own
        return mix((total[self.end] - total[self.start]) * inverse[self.start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of each k-word sequence, in order; a text of fewer words, but not none, gives one."""
        h = self.hashes()
        m = len(h)
        left = np.repeat(self.first[1:], self.n) - np.arange(m)  # words from here to the end of the text
        position = np.arange(m) - np.repeat(self.first[:-1], self.n)
        keep = (left >= k) | (position == 0)
        at = np.flatnonzero(keep)
        room = left[at]
        acc = mix(h[at])
        for j in range(1, k):
            use = room > j
            nxt = h[np.minimum(at + j, m - 1)] if m else h
            acc = np.where(use, mix(acc * _C3 + nxt), acc)
        return self.doc[at], acc


def chunks(batches: Iterator[pa.RecordBatch], text: int, limit: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts have about `limit` bytes; a longer text stands alone.  Null: empty."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in column.cast(pa.large_binary())), np.int64, batch.num_rows)
        at = 0
        while at < batch.num_rows:
            total = np.cumsum(sizes[at:at + 8192])
            take = max(1, int(np.searchsorted(total, limit, "right")))
            part = batch.slice(at, take)
            yield part, [x or b"" for x in part.column(text).cast(pa.large_binary()).to_pylist()]
            at += take
