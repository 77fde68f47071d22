"""Words of many texts at once: positions and 64-bit hashes, in numpy.

A word is a maximal run of bytes that the given 256-entry table does not mark
as separators.  Its hash is a polynomial over its bytes, taken from prefix
sums, and mixed; it depends on the bytes alone, so it is the same in every
task.  Texts are worked on in pieces of a few MB cut between words, so a very
long text needs no array of eight bytes per character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from mercato.llm._arrow import PIECE_BYTES, doc_rank, text_view

_BASE = 0x9E3779B97F4A7C15
_MULTIPLIERS = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))

#: Separators: the white space ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Separators: every ASCII character but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, twice), elementwise."""
    h = h ^ (h >> np.uint64(33))
    h *= _MULTIPLIERS[0]
    h ^= h >> np.uint64(33)
    h *= _MULTIPLIERS[1]
    h ^= h >> np.uint64(33)
    return h


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(
                np.full(size, x, np.uint64))]) for x in (_BASE, inverse))
        return self.up, self.down


_POWERS = _Powers()


def pieces(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray,
           most: int = PIECE_BYTES):
    """(begin, end) of consecutive pieces of about ``most`` bytes, cut at a
    text's end, or within a longer text behind a separator; a longer word
    stays whole."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + most, end)
        while to < end:
            last = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if last <= at:
                found = np.flatnonzero(separators[data[at:to]])
                last = at + int(found[-1]) + 1 if len(found) else at
            if last > at:
                to = last
                break
            to = min(to + most, end)
        yield at, to
        at = to


class Words:
    """``start``, ``end`` (bytes), ``doc`` (rank of the text), ``hash``."""

    def __init__(self, array: pa.Array, separators: np.ndarray = SPACE):
        self.data, self.offsets = text_view(array)
        found = [self._piece(a, b, separators)
                 for a, b in pieces(self.data, self.offsets, separators)]
        empty = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*(found or empty)))
        self.doc = doc_rank(self.offsets, self.start)
        #: index of each text's first word; one more entry than texts
        self.first = np.searchsorted(self.start, self.offsets)

    def _piece(self, a: int, b: int, separators: np.ndarray):
        data = self.data[a:b]
        inside = ~separators[data]
        edge = np.zeros(b - a + 1, bool)
        low, high = np.searchsorted(self.offsets, [a, b + 1])
        edge[self.offsets[low:high] - a] = True
        edge[0] = edge[-1] = True
        before = np.empty(b - a + 1, bool)
        before[0], before[1:] = False, inside
        start = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
        after = np.empty(b - a, bool)
        after[:-1], after[-1] = inside[1:], False
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        up, down = _POWERS.upto(b - a + 1)
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:b - a], out=total[1:])
        hashed = mix((total[end] - total[start]) * down[start]
                     + (end - start).astype(np.uint64) * _MULTIPLIERS[0])
        return start + a, end + a, hashed


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` consecutive items (len - n + 1 of them)."""
    size = len(hashes) - n + 1
    out = np.zeros(max(size, 0), np.uint64)
    for k in range(n if size > 0 else 0):
        out = out * np.uint64(_BASE) + hashes[k:k + size]
    return mix(out)
