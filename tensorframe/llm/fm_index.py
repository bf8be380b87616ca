"""A full-text index in compressed form, and matching statistics by backward search over it.

What stays of the texts is the Burrows-Wheeler transform in a wavelet matrix, the lengths of common
prefixes of neighbouring suffixes (a byte each), and for each of these the distance to the next smaller one
on either side (a byte, longer ones apart). Text and suffix array go once these are built. All steps work on
arrays, many documents at once.
"""

from __future__ import annotations

import numpy as np

#: Common prefixes are known up to this length.
DEPTH = 31


class Bits:
    """A packed bit vector with counts of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = -(-(len(bits) + 1) // 64) * 64
        padded = np.zeros(n, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """rank(c, i): occurrences of c before place i, in one step per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(len(symbols) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(1 << bits)
        self.base = self._down(every, np.zeros(1 << bits, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, level, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros, strict=True):
            ones = level.ones(i)
            i = np.where((c >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self.base[c]


class Near:
    """Small non-negative numbers, a byte each; the few of 255 and more apart."""

    def __init__(self, numbers: np.ndarray):
        self.low = np.minimum(numbers, 255).astype(np.uint8)
        self.at = np.flatnonzero(self.low == 255)
        self.high = numbers[self.at]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        out = self.low[i].astype(np.int64)
        far = np.flatnonzero(out == 255)
        out[far] = self.high[np.searchsorted(self.at, i[far])]
        return out


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, by doubling, and the ranks by the first 1, 2, 4, 8 and 16 symbols; no suffix may be the start of another.

    A rank is the number of suffixes below all that share it, so only those that share one are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else 0
    kept, step = [rank.copy()], 1
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order
        if len(tied):
            own = order[tied]
            first, second = rank[own], rank[np.minimum(own + step, n - 1)]
            again = np.lexsort((second, first))
            own, first, second = own[again], first[again], second[again]
            order[tied] = own
            fresh = np.ones(len(own), bool)
            fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            new[tied] = fresh
            rank[own] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))]
        step *= 2
        if step <= 16:
            kept.append(rank.copy())
        elif not len(tied):
            return order, kept


class FMIndex:
    """Index of several word sequences, each ended by a separator of its own.

    ``places`` gives every position of the sequences (separators left out) its place in the corpus; the index
    keeps the least one of every ``window`` words that occur more than once.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, alphabet: int, places: np.ndarray, window: int):
        ends = np.cumsum(sizes + 1) - 1  # places of the separators
        n = len(words) + len(sizes)
        inside = np.ones(n, bool)
        inside[ends] = False
        text = np.zeros(n, np.int64)
        text[inside] = words + 1  # 0: separator
        symbols = text + len(sizes)
        symbols[ends] = np.arange(len(sizes))
        suffixes, ranks = suffix_order(symbols)
        self.n = n
        self.tree = WaveletMatrix(text[suffixes - 1], max(1, int(alphabet).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        common = np.zeros(n + 1, np.int64)  # of each suffix and the one before it
        a, b, length = suffixes[:-1], suffixes[1:], np.zeros(max(n - 1, 0), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            length += (ranks[k][np.minimum(a + length, n - 1)] == ranks[k][np.minimum(b + length, n - 1)]).astype(np.int64) << k
        common[1:n] = length
        self.common = common.astype(np.uint8)
        before, after = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        at = np.arange(n + 1)
        for d in range(1, int(common.max(initial=0)) + 1):
            own = np.flatnonzero(common == d)
            if len(own):
                less = np.flatnonzero(common < d)  # the first and the last are always among these
                k = np.searchsorted(less, own)
                before[own], after[own] = own - less[k - 1], less[k] - own
        self.before, self.after = Near(before), Near(after)
        # of the groups of suffixes that share their first `window` words: the first suffix and the least place
        least = np.full(n, np.iinfo(np.int64).max)
        least[inside] = places
        least = least[suffixes]
        edge = np.flatnonzero(common[:n] < window)
        many = np.diff(np.append(edge, n)) > 1
        self.groups = edge[many]
        self.earliest = np.minimum.reduceat(least, edge)[many] if n else least

    def extended(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of c before what the given intervals match."""
        base = self.first[c]
        return base + self.tree.rank(c, lo), base + self.tree.rank(c, hi)

    def shortened(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger intervals, and how many words these match: the parents in the tree of common prefixes."""
        x, y = self.common[lo], self.common[hi]
        depth = np.maximum(x, y).astype(np.int64)
        lo = np.where(x == depth, lo - self.before[lo], lo)
        hi = np.where(y == depth, hi + self.after[hi], hi)
        return np.where(depth > 0, lo, 0), np.where(depth > 0, hi, self.n), depth

    def statistics(self, words: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Streams documents (stretches of ``words`` that the index holds too) from right to left.

        At each place the longest match that occurs at least twice is carried on from the place to its
        right: it grows by the word there, or shrinks to its parent until it can. Returns the places
        from which at least ``window`` words match, and the least places of these words.
        """
        live = np.flatnonzero(sizes > 0)
        at, stop = (firsts + sizes - 1)[live], firsts[live]
        lo, hi, q = np.zeros(len(live), np.int64), np.full(len(live), self.n), np.zeros(len(live), np.int64)
        places, starts = [], []
        while len(at):
            a, z = self.extended(words[at] + 1, lo, hi)
            ok = z - a > 1
            lo, hi, q = np.where(ok, a, lo), np.where(ok, z, hi), q + ok
            long = ok & (q >= window)
            places.append(at[long])
            starts.append(lo[long])
            shrink = np.flatnonzero(~ok & (q > 0))
            lo[shrink], hi[shrink], q[shrink] = self.shortened(lo[shrink], hi[shrink])
            at = at - 1
            at[shrink] += 1
            more = at >= stop
            at, stop, lo, hi, q = at[more], stop[more], lo[more], hi[more], q[more]
        places, starts = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)
        return places, self.earliest[np.searchsorted(self.groups, starts, "right") - 1] if len(places) else starts
