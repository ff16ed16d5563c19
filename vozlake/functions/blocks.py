"""Matching of two word lists by longest blocks.

The longest run of words that both lists hold comes first (the earliest in the first list, then in the
second); the words before it and the words after it are matched among themselves the same way.

Runs of one length are compared by numbers: equal runs of 2^p words have equal ranks, and a run of any length
is the pair of ranks of its first and last 2^p words.  So the longest common run of two stretches is found by
halving the range of lengths, with sorted ranks only; no table of pairs of words is made.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np


class Runs:
    """Ranks of all runs of 2^p words of two lists."""

    def __init__(self, one: list[str], other: list[str]):
        numbers: dict[str, int] = {}
        ranks = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in (one, other)]
        self.levels = [tuple(ranks)]
        while self._meet(*self.levels[-1]):
            longer = [self._paired(r, 1 << len(self.levels)) for r in self.levels[-1]]
            _, dense = np.unique(np.concatenate(longer), return_inverse=True)
            self.levels.append((dense[: len(longer[0])], dense[len(longer[0]) :]))

    @staticmethod
    def _meet(one: np.ndarray, other: np.ndarray) -> bool:
        return bool(len(one) and len(other) and np.isin(one, other).any())

    def _paired(self, ranks: np.ndarray, size: int, half: int | None = None) -> np.ndarray:
        """Numbers of runs of ``size`` words from ranks of their first and last ``half`` words."""
        half = half or size // 2
        n = max(0, len(ranks) - (size - half))
        return ranks[:n] * (1 << 31) + ranks[size - half :][:n]

    def of(self, side: int, size: int, start: int, end: int) -> np.ndarray:
        """Numbers of all runs of ``size`` words inside [start, end)."""
        level = size.bit_length() - 1
        half = 1 << level
        return self._paired(self.levels[level][side][start : max(start, end - half + 1)], size, half)

    def longest(self, start: int, end: int, other_start: int, other_end: int, most: int) -> tuple[int, int, int] | None:
        """(place, other place, size) of the longest common run of two stretches, of at most ``most`` words."""
        low, high, found = 0, min(most, end - start, other_end - other_start, (1 << len(self.levels)) - 1), None
        size = high
        while low < high:
            one, other = self.of(0, size, start, end), self.of(1, size, other_start, other_end)
            hit = np.flatnonzero(np.isin(one, other))
            if len(hit):
                low, found = size, (start + int(hit[0]), other_start + int(np.flatnonzero(other == one[hit[0]])[0]), size)
            else:
                high = size - 1
            size = (low + high + 1) // 2
        return found


#: Lists of up to this many words together are matched word by word, which is faster there; the result is the same.
SHORT_LISTS = 512


def longest_blocks(one: list[str], other: list[str], short: int = SHORT_LISTS) -> list[tuple[int, int, int]]:
    """(place, other place, size) of all blocks, in order."""
    if len(one) + len(other) <= short:
        return [tuple(b) for b in SequenceMatcher(None, one, other, autojunk=False).get_matching_blocks() if b.size]
    runs, found = Runs(one, other), []
    todo = [(0, len(one), 0, len(other), min(len(one), len(other)))]
    while todo:
        start, end, other_start, other_end, most = todo.pop()
        block = runs.longest(start, end, other_start, other_end, most) if start < end and other_start < other_end else None
        if block:
            i, j, size = block
            found.append(block)
            todo += [(start, i, other_start, j, size), (i + size, end, j + size, other_end, size)]
    return sorted(found)


def block_matches(one: list[str], other: list[str]) -> np.ndarray:
    """For each word of ``one`` the place in ``other`` that its block gives it, or -1."""
    out = np.full(len(one), -1)
    for i, j, size in longest_blocks(one, other):
        out[i : i + size] = np.arange(j, j + size)
    return out
