"""Words of many texts as 64-bit hashes, computed on the bytes of a whole batch at once.

The hashes choose where equal words meet; whatever removes or merges documents compares
the words themselves, or 128 bits from two independent seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """The words (runs of bytes other than blank and \\t to \\r) of some texts: their places in ``data``, and how many each text has."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join([*texts, b"\n" * 8])  # loads of 8 bytes stay inside
        self.data = np.frombuffer(self.raw, np.uint8)
        self.space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.flatnonzero(np.diff(self.space, prepend=True))  # starts and ends in turn, as the data ends in white space
        self.starts, self.ends = edge[0::2], edge[1::2]
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.counts = np.diff(np.searchsorted(self.starts, firsts))

    def ids(self) -> tuple[np.ndarray, int]:
        """A number for each word, equal for equal words only, and how many there are."""
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        letters = self.data[~self.space]
        found = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), len(found.dictionary)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """Every group of eight bytes is mixed with its place in the word before the groups are added up."""
        out = np.zeros(len(self.starts), np.uint64)
        if not len(out):
            return out
        eight = np.lib.stride_tricks.as_strided(self.data, (len(self.data) - 7, 8), (1, 1))
        sizes = self.ends - self.starts

        def mixed(word: np.ndarray, k: np.ndarray) -> np.ndarray:
            group = eight[self.starts[word] + 8 * k].copy().view("<u8")[:, 0]
            left = sizes[word] - 8 * k
            group &= np.where(left >= 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - U(1))
            return mix(mix(group + U((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64)) + k.astype(np.uint64) * U(0x9E3779B97F4A7C15)) ^ k.astype(np.uint64))

        every = np.arange(len(out))
        for k in range(4):  # most words end here
            todo = every if k == 0 else every[sizes > 8 * k]
            out[todo] += mixed(todo, np.full(len(todo), k))
        if len(todo := every[sizes > 32]):
            n = (sizes[todo] - 25) // 8  # groups from the fifth on
            head = np.cumsum(n) - n
            out[todo] += np.add.reduceat(mixed(np.repeat(todo, n), np.arange(n.sum()) - np.repeat(head, n) + 4), head)
        return mix(out + sizes.astype(np.uint64) * U(0xD6E8FEB86659FD93))


def encoded(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def words_of(texts: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words of each text."""
    words = Words(encoded(texts))
    return words.hashes(seed), words.counts


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words from each word on (shorter by n - 1); a multilinear hash with fixed odd factors."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) + U(1000 * seed + 17)) | U(1)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += hashes[j : j + m] * factors[j]
    return mix(out)
