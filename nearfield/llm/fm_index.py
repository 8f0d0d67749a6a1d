"""A compressed full-text index over word numbers: wavelet matrix of the Burrows-Wheeler text.

Suffixes are ordered by their first ``depth`` words, which is all that searches of up to
that many words need. Searches run for many texts at once, one word of each per step.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class _Bits:
    """A bit vector of packed words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        word = at >> 6
        low = self.words[word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE)
        return self.before[word] + np.bitwise_count(low)


class FMIndex:
    """Index of ``text``: word numbers from 1, parted by zeros, which match nothing."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text, self.depth, n = text.astype(np.int64), depth, len(text)
        self._order(depth)
        last = self.text[self.suffixes - 1]
        counts = np.bincount(last, minlength=int(self.text.max(initial=0)) + 1)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[int, _Bits, int]] = []
        column, codes = last, np.arange(len(counts))
        self.base = np.zeros(len(counts), np.int64)
        for shift in range(max(int(len(counts) - 1).bit_length(), 1) - 1, -1, -1):
            bit = (column >> shift & 1).astype(np.uint8)
            bits, zeros = _Bits(bit), int(n - bit.sum())
            self.levels.append((shift, bits, zeros))
            self.base = self._down(self.base, codes, shift, bits, zeros)
            column = np.concatenate([column[bit == 0], column[bit == 1]])

    def _order(self, depth: int) -> None:
        """Suffixes by their first ``depth`` words, ties by position; where depths part them."""
        n, size = len(self.text), 1
        ranks = {1: self.text}
        while size < depth:
            more = min(size, depth - size)
            follow = np.zeros(n, np.int64)
            # The second half may overlap the first: both together still cover all words.
            shift = size if more == size else depth - size
            follow[: n - shift] = ranks[size][shift:] + 1
            _, rank = np.unique(ranks[size] * (n + 2) + follow, return_inverse=True)
            size += more
            ranks[size] = rank
        rank = ranks[depth]
        self.suffixes = np.argsort(rank, kind="stable")
        whole = rank[self.suffixes]
        self.starts = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if n else np.empty(0, np.int64)
        # Suffixes that share one word less than ``depth`` are neighbours too.
        self.least = np.minimum.reduceat(self.suffixes, self.starts) if n else self.suffixes
        less = depth - 1
        half = max(s for s in ranks if s <= less)
        a, b = ranks[half], np.zeros(n, np.int64)
        b[: n - (less - half)] = ranks[half][less - half :]
        pa, pb = a[self.suffixes], b[self.suffixes]
        self.shorter = np.flatnonzero(np.concatenate([[True], (pa[1:] != pa[:-1]) | (pb[1:] != pb[:-1]), [True]]))

    @staticmethod
    def _down(at: np.ndarray, codes: np.ndarray, shift: int, bits: _Bits, zeros: int) -> np.ndarray:
        ones = bits.ones(at)
        return np.where(codes >> shift & 1, zeros + ones, at - ones)

    def extend(self, low: np.ndarray, high: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``words`` prepended to the patterns whose suffix intervals are given."""
        at, codes = np.concatenate([low, high]), np.concatenate([words, words])
        for shift, bits, zeros in self.levels:
            at = self._down(at, codes, shift, bits, zeros)
        at += self.smaller[codes] - self.base[codes]
        return at[: len(low)], at[len(low) :]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns without their last word, for patterns of ``depth`` words."""
        group = np.searchsorted(self.shorter, low, side="right") - 1
        return self.shorter[group], self.shorter[group + 1]

    def earliest(self, low: np.ndarray) -> np.ndarray:
        """First position in the text of the ``depth`` words whose interval starts there."""
        return self.least[np.searchsorted(self.starts, low, side="right") - 1]

    def matches(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streams stretches of the text through the index, from their last word backward.

        Returns (stretch, offset, position): for each offset from which ``depth`` words of
        the stretch match, the first position in the text where they do.
        """
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.text))
        length = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > step)
            full = on[length[on] == self.depth]
            if len(full):
                low[full], high[full] = self.shorten(low[full])
                length[full] -= 1
            offset = sizes[on] - 1 - step
            low[on], high[on] = self.extend(low[on], high[on], self.text[starts[on] + offset])
            # Nothing left of a pattern: the match starts anew before this word.
            gone = high[on] <= low[on]
            low[on[gone]], high[on[gone]] = 0, len(self.text)
            length[on] = np.where(gone, 0, length[on] + 1)
            hit = length[on] == self.depth
            if hit.any():
                found.append((on[hit], offset[hit], self.earliest(low[on[hit]])))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found))
