"""Elias-Fano sequences, and an n-gram trie of them in one memory-mapped file."""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Elements between two entries of a sequence's skip list.
STRIDE = 4096


class EliasFano:
    """A non-decreasing sequence of integers below 2**63.

    The low bits of each value are packed side by side; the high parts are written in unary. A skip list holds every
    STRIDE-th value and its place in the unary part, so that a stretch is decoded without what stands before it.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, skip_value: np.ndarray, skip_bit: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.skip_value, self.skip_bit = n, low_bits, low, high, skip_value, skip_bit

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        low = np.packbits(((v[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel(), bitorder="little") if n and low_bits else np.empty(0, np.uint8)
        at = (v >> low_bits) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), v[::STRIDE].copy(), at[::STRIDE].copy())

    def decode(self, begin: int, end: int) -> np.ndarray:
        """Values begin to end; begin is a multiple of STRIDE."""
        if begin >= end:
            return np.empty(0, np.int64)
        start = int(self.skip_bit[begin // STRIDE])
        stop = int(self.skip_bit[end // STRIDE]) if end % STRIDE == 0 and end < self.n else None
        if stop is None:
            upto = -(-end // STRIDE)
            stop = int(self.skip_bit[upto]) if upto < len(self.skip_bit) else len(self.high) * 8
        first = start // 8
        bits = np.unpackbits(self.high[first : -(-stop // 8)], bitorder="little")
        ones = (np.flatnonzero(bits[start - first * 8 :])[: end - begin]) + start
        out = (ones - np.arange(begin, end)) << self.low_bits
        if self.low_bits:
            a, b = begin * self.low_bits, end * self.low_bits
            low = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(end - begin, self.low_bits)
            out |= low.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def at(self, index: np.ndarray) -> np.ndarray:
        """The values at the given places (any order), stretch by stretch."""
        out = np.empty(len(index), np.int64)
        order = np.argsort(index, kind="stable")
        stretch = index[order] // STRIDE
        for lo, hi in _runs(stretch):
            s = int(stretch[lo])
            values = self.decode(s * STRIDE, min(self.n, (s + 1) * STRIDE))
            out[order[lo:hi]] = values[index[order[lo:hi]] - s * STRIDE]
        return out

    def successor(self, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For ascending keys the place of each between its begin and its end, -1 where it is not there.

        Begins and ends ascend as well; only stretches that the ranges touch are decoded.
        """
        out = np.full(len(keys), -1, np.int64)
        on = np.flatnonzero(begin < end)
        for lo, hi in _runs(begin[on] // STRIDE):
            i = on[lo:hi]
            first = int(begin[i[0]]) // STRIDE * STRIDE
            values = self.decode(first, min(self.n, -(-int(end[i[-1]]) // STRIDE) * STRIDE))
            at = first + np.searchsorted(values, keys[i])
            good = (at >= begin[i]) & (at < end[i])
            good[good] = values[at[good] - first] == keys[i][good]
            out[i[good]] = at[good]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.skip_value, self.skip_bit]


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True))


class Mapped:
    """Arrays in one file that is mapped into memory and has no name any more, so it goes with its last reader."""

    def __init__(self, arrays: list[np.ndarray]):
        handle, path = tempfile.mkstemp(prefix="trie-")
        self.places, at = [], 0
        with os.fdopen(handle, "wb") as f:
            for a in arrays:
                pad = -at % 8
                f.write(b"\0" * pad + a.tobytes())
                self.places.append((at + pad, a.dtype, len(a)))
                at += pad + a.nbytes
        self.size = at
        self.map = np.memmap(path, np.uint8, "r", shape=(at,)) if at else np.empty(0, np.uint8)
        os.unlink(path)

    def __getitem__(self, i: int) -> np.ndarray:
        at, dtype, n = self.places[i]
        return self.map[at : at + n * dtype.itemsize].view(dtype)


NONE = np.uint16(0xFFFF)
#: Probabilities are kept as steps of -log10.
STEPS = 512


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; NONE for zero."""
    with np.errstate(divide="ignore"):
        steps = np.rint(-np.log10(p) * STEPS)
    return np.where(p > 0, np.minimum(np.nan_to_num(steps, posinf=0), 0xFFFE), NONE).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    """Probabilities of codes; zero for NONE."""
    return np.where(codes == NONE, 0.0, 10.0 ** (-codes.astype(np.float64) / STEPS))


class Trie:
    """n-grams of word numbers with the probability that their last word takes from their context, and what contexts leave.

    Level j holds the prefixes of j words: the words of a node's successors ascend, and adding the parent's rank times
    the number of words makes the whole level ascend, so one Elias-Fano sequence holds it; pointers[j] holds where the
    successors of each node of level j begin, ascending as well. A successor is searched between its context's pointers
    only, and its key has the context's rank in front. Each node has two codes: `takes` for n-grams that were counted here and
    `leaves` for contexts. All of it lies in one mapped file.
    """

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], contexts: dict[int, tuple[np.ndarray, np.ndarray]], width: int):
        """grams[k]: (rows of k words, takes); contexts[k]: (rows of k - 1 words, leaves)."""
        self.width = width
        depth = max([k for k, (g, _) in grams.items() if len(g)] + [k - 1 for k, (c, _) in contexts.items() if len(c)], default=0)
        sets = [(g, t, True) for g, t in grams.values()] + [(c, t, False) for c, t in contexts.values()]
        ranks = [np.zeros(len(g), np.int64) for g, _, _ in sets]
        arrays: list[np.ndarray] = []
        self.levels, before = [], 1
        for j in range(depth):
            keys = [r * width + g[:, j] for (g, _, _), r in zip(sets, ranks, strict=True) if g.shape[1] > j]
            level = np.sort(np.concatenate(keys), kind="stable") if keys else np.empty(0, np.int64)  # a merge of sorted runs
            level = level[np.concatenate([np.ones(min(1, len(level)), bool), level[1:] != level[:-1]])]
            takes, leaves = np.full(len(level), NONE), np.full(len(level), NONE)
            for i, (g, values, is_gram) in enumerate(sets):
                if g.shape[1] > j:
                    ranks[i] = np.searchsorted(level, ranks[i] * width + g[:, j])
                    if g.shape[1] == j + 1:
                        (takes if is_gram else leaves)[ranks[i]] = quantise(values)
            starts = np.searchsorted(level, np.arange(before + 1) * width)
            self.levels.append(len(arrays))
            arrays += [*EliasFano.of(level).arrays(), *EliasFano.of(starts).arrays(), takes, leaves]
            before = len(level)
        self.file = Mapped(arrays)

    def _sequence(self, at: int) -> EliasFano:
        n, low_bits = self.file[at].tolist()
        return EliasFano(n, low_bits, *(self.file[at + i] for i in range(1, 5)))

    def find(self, rows: np.ndarray) -> np.ndarray:
        """Rank of each row's node in the level of its length, -1 if it has none. Rows ascend."""
        if rows.shape[1] > len(self.levels) or not len(rows):
            return np.full(len(rows), -1, np.int64)
        node, new = np.zeros(1, np.int64), np.zeros(len(rows), bool)
        new[0] = True
        of = np.zeros(len(rows), np.int64)  # each row's place among the distinct prefixes that were searched so far
        for j in range(rows.shape[1]):
            new[1:] |= rows[1:, j] != rows[:-1, j]
            first = np.flatnonzero(new)
            node = node[of[first]]
            of = np.cumsum(new) - 1
            on = np.flatnonzero(node >= 0)
            at = self.levels[j]
            starts = self._sequence(at + 5)
            begin, end = starts.at(node[on]), starts.at(node[on] + 1)  # a context's successors stand between its pointers
            node[on] = self._sequence(at).successor(node[on] * self.width + rows[first[on], j], begin, end)
        return node[of]

    def takes(self, rows: np.ndarray) -> np.ndarray:
        return self._codes(rows, 10)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        return self._codes(rows, 11)

    def _codes(self, rows: np.ndarray, which: int) -> np.ndarray:
        node = self.find(rows)
        out = np.full(len(rows), NONE)
        on = node >= 0
        if on.any():
            out[on] = self.file[self.levels[rows.shape[1] - 1] + which][node[on]]
        return out
