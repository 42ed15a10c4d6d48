"""How values become bins: a pooled bin budget, equal-mass range bins, balanced equality bins.

The inputs are a segment's distinct values with their numbers of rows; they can come in batches, so that a task holds the bins only.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Callable

import numpy as np


def bin_budget(distinct: list[int], rho: float) -> list[int]:
    """Bins for each attribute. floor(attributes / rho) bins are shared out one by one to the attribute that gains most,
    1 / (b (b + 1)) from its b-th to its next bin, never beyond its number of values; of equal gains the later attribute."""
    bins = [1] * len(distinct)
    left = math.floor(len(distinct) / rho + 1e-9) - len(distinct)
    heap = [(-0.5, -i) for i, n in enumerate(distinct) if n > 1]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, at = heapq.heappop(heap)
        i, left = -at, left - 1
        bins[i] += 1
        if bins[i] < distinct[i]:
            heapq.heappush(heap, (-1.0 / (bins[i] * (bins[i] + 1)), at))
    return bins


class RangeCuts:
    """Equal-mass bins over values that come in batches, ascending; what is held grows with the bins, not with the values.

    A bin aims at the share that the rows not yet binned leave for the bins not yet closed. It takes values until the next
    one would reach that share; it then ends after that value or before it, whichever comes nearer, and before it where both
    are equally near; a value that alone reaches the share never joins what was taken before it. So a value never spans two bins, and
    every boundary is a value that occurs. Boundaries that are not needed repeat the largest value, whose rows stand in the last bin.
    """

    def __init__(self, distinct: int, total: int, bins: int):
        self.distinct, self.total, self.bins = distinct, total, bins
        self.cuts, self.below, self.keys = [0], [0], []  # each bin's first value by number, the rows below it, its key
        self.seen, self.upto, self.more, self.last = 0, 0, True, (b"", 0)

    def add(self, key_at: Callable[[int], bytes], counts: np.ndarray) -> None:
        """The next values: their numbers of rows, and their keys by place."""
        upto = self.upto + np.cumsum(counts, dtype=np.int64)
        while self.more and len(self.cuts) < self.bins:
            first, taken = self.cuts[-1], self.below[-1]
            open_bins = self.bins - len(self.cuts) + 1
            # The first value with which the bin reaches its share.
            i = int(np.searchsorted(upto, taken + -(-(self.total - taken) // open_bins)))
            if i == len(upto):
                break
            before, after = (int(upto[i - 1]) if i else self.upto) - taken, int(upto[i]) - taken
            share = (self.total - taken) / open_bins
            alone, at = after - before >= share, self.seen + i
            ends_before = at > first and (alone or share - before <= after - share)
            self.more = at + (not ends_before) < self.distinct
            if self.more:
                self.cuts.append(at + (not ends_before))
                self.below.append(taken + (before if ends_before else after))
        while len(self.keys) < len(self.cuts) and self.cuts[len(self.keys)] < self.seen + len(upto):
            self.keys.append(key_at(self.cuts[len(self.keys)] - self.seen))
        self.seen, self.upto, self.last = self.seen + len(upto), int(upto[-1]), (key_at(len(upto) - 1), int(counts[-1]))

    def done(self) -> tuple[list[bytes], list[int]]:
        """Boundaries (bins + 1 of them, the last is the largest value) and counts."""
        spare = self.bins - len(self.cuts)
        edges = [*self.below, self.total]
        counts = [hi - lo for lo, hi in zip(edges, edges[1:], strict=False)] + [0] * spare
        if spare:  # boundaries that repeat the largest value: its rows stand in the last bin
            counts[len(self.cuts) - 1] -= self.last[1]
            counts[-1] += self.last[1]
        return self.keys + [self.last[0]] * (spare + 1), counts


def range_bins(runs: list[tuple[bytes, int]], bins: int) -> tuple[list[bytes], list[int]]:
    """Boundaries and counts of RangeCuts over values with their numbers of rows, ascending."""
    if not runs:
        return [b"", b""], [0]
    found = RangeCuts(len(runs), sum(n for _, n in runs), bins)
    found.add(lambda i: runs[i][0], np.array([n for _, n in runs], np.int64))
    return found.done()


def bin_of(boundaries: list[bytes], value: bytes) -> int:
    """The bin of a value between the first and the last boundary."""
    return min(bisect.bisect_right(boundaries, value) - 1, len(boundaries) - 2)


class EqualityBins:
    """Bins for values that come by falling count: each goes into the lightest bin so far."""

    def __init__(self, bins: int):
        self.heap = [(0, b) for b in range(bins)]

    def add(self, counts: list[int]) -> list[int]:
        """The next values' bins."""
        out, heap = [], self.heap
        for n in counts:
            mass, b = heap[0]
            heapq.heapreplace(heap, (mass + n, b))
            out.append(b)
        return out

    def sizes(self) -> list[int]:
        return [mass for mass, _ in sorted(self.heap, key=lambda h: h[1])]


def equality_bins(counts: list[tuple[bytes, int]], bins: int) -> dict[bytes, int]:
    """Each value's bin: values by falling count, of equal counts the smaller value first."""
    by = sorted(counts, key=lambda c: (-c[1], c[0]))
    return dict(zip([v for v, _ in by], EqualityBins(bins).add([n for _, n in by]), strict=True))
