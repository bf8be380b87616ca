"""SentencePiece merge-type encoding with seeded merge-dropout, and decoding.

A text becomes blanks as U+2581 behind a dummy prefix, and is cut into chunks
before every run of U+2581 (no piece of such a vocabulary spans that place).
Within a chunk the best pair of neighbouring pieces — highest score, then
leftmost — is merged again and again, as an agenda would. A candidate merge is
skipped for good if the keyed hash of (seed, doc_id, place, chunk, its three bounds)
falls below the dropout rate; with rate 0 the result is the vocabulary's plain
encoding. So each occurrence of a chunk is segmented by itself, and every run gives
the same ids.

A worker holds the plain segmentation of the chunks it met and the merges that lead to it.
An occurrence that skips none of these has the plain segmentation, whatever else it
skips; all others are merged anew. Many are merged at once: rows of a matrix hold their
pieces, and one step merges the best pair of every row. Characters outside the vocabulary, and U+2581 itself where the
text holds it, are written as byte pieces, so decoding gives back every text
exactly. Null texts have null ids, empty ones none. Null doc_ids share one hash key.
Repeated rows get equal ids. Extra columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import row_slices, text_slices
from .textwords import U, mix
from .wordcodes import Numbered

BLANK = "▁"
CHUNK = re.compile(" *[^ ]+| +")
#: Chunks held by a worker, and the longest that is merged in a matrix.
HELD, LONGEST = 350_000, 32
#: Occurrences whose plain merges are tested at once.
TESTED = 100_000
NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces, byte pieces and the merges that lead to each piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {pieces[i]: i for i in plain}
        self.byte = np.zeros(256, np.int64)
        self.bytes: list[bytes] = [b""] * self.size
        for i in range(self.size):
            if model.is_byte(i):
                self.byte[int(pieces[i][3:5], 16)] = i
                self.bytes[i] = bytes([int(pieces[i][3:5], 16)])
        for i in plain:
            self.bytes[i] = pieces[i].replace(BLANK, " ").encode()
        score = {i: model.get_score(i) for i in plain}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        # of each code point in a chunk: its piece, or below 0 if it is written as bytes
        self.symbols = -1 - np.arange(0x110000)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        self.symbols[0x20], self.symbols[ord(BLANK)] = self.ids[BLANK], -1 - ord(BLANK)
        merges = []
        for i in plain:
            p = pieces[i]
            for k in range(1, len(p)):
                if p[:k] in self.ids and p[k:] in self.ids:
                    merges.append((self.ids[p[:k]] * self.size + self.ids[p[k:]], place[score[i]], i))
        merges.sort()
        self.pair, self.rank, self.made = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        # a table of hash slots; a pair whose slot another one holds is found by binary search
        self.slots = np.full(1 << 21, -1, np.int32)
        at = self._slot(self.pair)
        self.slots[at[::-1]] = np.arange(len(at) - 1, -1, -1)
        self.crowded = np.zeros(1 << 21, bool)
        self.crowded[at[self.slots[at] != np.arange(len(at))]] = True
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is none) and id of the merge of two pieces."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        slot = self._slot(key)
        at = self.slots[slot]
        ok = (at >= 0) & (self.pair[at] == key)
        retry = np.flatnonzero(~ok & self.crowded[slot])
        if len(retry):
            at[retry] = np.minimum(np.searchsorted(self.pair, key[retry]), len(self.pair) - 1)
            ok[retry] = self.pair[at[retry]] == key[retry]
        return np.where(ok, self.rank[at], NONE), self.made[at]

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(43)).astype(np.int64)

    def spelled(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            out.extend([s] if s >= 0 else self.byte[list(chr(-1 - s).encode("utf-8", "surrogatepass"))].tolist())
        return out


def bounds(middle, end) -> np.ndarray:
    """A hash of the two later bounds of a candidate merge."""
    return mix(np.asarray(middle).astype(np.uint64) * U(0x9E3779B97F4A7C15) + np.asarray(end).astype(np.uint64))


def below(key: np.ndarray, start: np.ndarray, later: np.ndarray, rate: float) -> np.ndarray:
    return (mix(mix(key + start) + later) >> U(11)).astype(np.float64) * 2.0**-53 < rate


def skipped(key: np.ndarray, start, middle, end, rate: float) -> np.ndarray:
    """Whether the candidate merge of [start, middle) and [middle, end) is dropped; `key` names chunk, occurrence and seed."""
    return below(key, np.asarray(start).astype(np.uint64), bounds(middle, end), rate)


def agenda(v: Vocabulary, symbols: list[int], key: int, rate: float) -> list[int]:
    """Merges one chunk by a priority queue; for chunks too long for the matrix."""
    n = len(symbols)
    ids, start = list(symbols), list(range(n + 1))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    end = list(range(1, n + 1))
    seen = np.array([key], np.uint64)
    queue: list[tuple[int, int, int, int, int]] = []

    def push(pairs: list[tuple[int, int]]) -> None:
        if pairs:
            a, b = (np.array(x) for x in zip(*pairs, strict=True))
            rank, made = v.look_up(np.array([ids[i] for i in a]), np.array([ids[i] for i in b]))
            drop = skipped(seen, [start[i] for i in a], [start[i] for i in b], [end[i] for i in b], rate)
            for k in np.flatnonzero((rank < NONE) & ~drop):
                heapq.heappush(queue, (int(rank[k]), start[a[k]], start[b[k]], end[b[k]], int(made[k])))

    push([(i, i + 1) for i in range(n - 1)])
    while queue:
        _, i, j, e, made = heapq.heappop(queue)
        if i >= 0 and ids[i] is not None and after[i] == j and j < n and ids[j] is not None and end[j] == e and end[i] == j:
            ids[i], ids[j], end[i], after[i] = made, None, e, after[j]
            if after[j] < n:
                before[after[j]] = i
            push([(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y < n])
    return [x for x in ids if x is not None]


def merge_rows(v: Vocabulary, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, rate: float, merges: list | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Merges every row of a matrix of symbols; gives (row numbers, symbols, sizes) of the rows as they finish.

    Appends (row numbers, start, middle, end) of every step to `merges`.
    """
    rows, width = np.arange(len(symbols)), symbols.shape[1]
    start = np.broadcast_to(np.arange(width + 1), (len(symbols), width + 1)).copy()
    done = []

    def ranks(i: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair at column `at` of rows i."""
        rank, _ = v.look_up(symbols[i, at], symbols[i, at + 1])
        ok = np.flatnonzero((rank < NONE) & (at + 1 < sizes[i]))
        out = np.full(len(i), NONE, np.int64)
        out[ok] = rank[ok]
        if rate > 0 and len(ok):
            r, c = i[ok], at[ok]
            out[ok[skipped(keys[r], start[r, c], start[r, c + 1], start[r, c + 2], rate)]] = NONE
        return out

    if width < 2:
        return [(rows, symbols, sizes)]
    every = np.repeat(rows, width - 1)
    rank = ranks(every, np.tile(np.arange(width - 1), len(rows))).reshape(len(rows), width - 1)
    while len(rows):
        at = rank.argmin(axis=1)
        left = rank[np.arange(len(rows)), at] < NONE
        if not left.all():
            done.append((rows[~left], symbols[~left], sizes[~left]))
            rows, symbols, sizes, keys, start, rank, at = (x[left] for x in (rows, symbols, sizes, keys, start, rank, at))
        if not len(rows):
            break
        i = np.arange(len(rows))
        if merges is not None:
            merges.append((rows, start[i, at], start[i, at + 1], start[i, at + 2]))
        symbols[i, at] = v.look_up(symbols[i, at], symbols[i, at + 1])[1]
        shift = np.arange(width - 1)
        symbols[:, 1:] = np.where(shift >= at[:, None], np.concatenate([symbols[:, 2:], np.full((len(rows), 1), -1)], 1), symbols[:, 1:])
        start[:, 1:-1] = np.where(shift >= at[:, None], start[:, 2:], start[:, 1:-1])
        rank[:, :-1] = np.where(shift[:-1] >= at[:, None], rank[:, 1:], rank[:, :-1])
        rank[:, -1] = NONE
        sizes = sizes - 1
        rank[i, at] = ranks(i, at)
        some = np.flatnonzero(at > 0)
        rank[some, at[some] - 1] = ranks(some, at[some] - 1)
    return done


class Encoder:
    """Holds the plain segmentations of the chunks met so far."""

    def __init__(self, path: str, rate: float, seed: int):
        self.v, self.rate, self.seed = Vocabulary(path), rate, seed
        self._reset()

    def _reset(self) -> None:
        self.known = Numbered()
        self.codes = np.zeros(0, np.uint32)
        self.cuts = self.lengths = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16 if self.v.size <= 65536 else np.uint32)
        # the merges of each chunk's plain segmentation
        self.first = self.merges = np.zeros(0, np.int64)
        self.start, self.later = np.zeros(0, np.uint8), np.zeros(0, np.uint64)

    def _learn(self) -> None:
        have = len(self.hashes)
        new = list(islice(self.known, have, None))
        if not new:
            return
        codes = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        cut = np.cumsum(sizes) - sizes
        inside = (np.arange(len(codes)) - np.repeat(cut, sizes)).astype(np.uint64)
        own = np.add.reduceat(mix(codes + mix(inside + U(7))), cut) if len(codes) else np.zeros(0, np.uint64)
        self.hashes = np.concatenate([self.hashes, mix(own + sizes.astype(np.uint64))])
        self.cuts = np.concatenate([self.cuts, len(self.codes) + cut])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.codes = np.concatenate([self.codes, codes.astype(np.uint32)])
        # with dropout, long chunks are merged at every occurrence
        plain = np.flatnonzero(sizes <= LONGEST) if self.rate > 0 else np.arange(len(new))
        merges: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        starts, counts, flat = self._segment(have + plain, np.zeros(len(plain), np.uint64), 0.0, merges if self.rate > 0 else None)
        more = np.zeros((3, len(new)), np.int64)
        more[0, plain], more[1, plain] = len(self.flat) + starts, counts
        if merges:
            row, start, middle, end = (np.concatenate(x) for x in zip(*merges, strict=True))
            order = np.argsort(row, kind="stable")
            more[2, plain] = np.bincount(row, minlength=len(plain))
            self.start = np.concatenate([self.start, start[order].astype(np.uint8)])
            self.later = np.concatenate([self.later, bounds(middle[order], end[order])])
        self.first = np.concatenate([self.first, len(self.start) - more[2].sum() + np.cumsum(more[2]) - more[2]])
        self.starts, self.sizes, self.merges = (np.concatenate([x, y]) for x, y in zip((self.starts, self.sizes, self.merges), more, strict=True))
        self.flat = np.concatenate([self.flat, flat])

    def _segment(self, chunk: np.ndarray, keys: np.ndarray, rate: float, merges: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges an occurrence of each of the chunks: starts and sizes in the third array, their ids."""
        v = self.v
        lengths, first = self.lengths[chunk], self.cuts[chunk]
        starts, sizes, out, n_out = np.zeros(len(chunk), np.int64), np.zeros(len(chunk), np.int64), [self.flat[:0]], 0

        def add(rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
            nonlocal n_out
            starts[rows], sizes[rows] = n_out + np.cumsum(counts) - counts, counts
            out.append(ids.astype(self.flat.dtype))
            n_out += len(ids)

        for low, high in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 14), (14, 20), (20, LONGEST)):
            at = np.flatnonzero((lengths > low) & (lengths <= high))
            for a in range(0, len(at), 50_000):
                own = at[a : a + 50_000]
                inside = np.arange(high) < lengths[own, None]
                symbols = np.where(inside, v.symbols[self.codes[np.minimum(first[own, None] + np.arange(high), len(self.codes) - 1)]], -1)
                steps = None if merges is None else []
                for rows, made, counts in merge_rows(v, symbols, lengths[own], keys[own], rate, steps):
                    used = np.arange(high) < counts[:, None]
                    plain = ~((made < 0) & used).any(axis=1)
                    add(own[rows[plain]], made[plain][used[plain]], counts[plain])
                    for k in np.flatnonzero(~plain):
                        ids = np.array(v.spelled(made[k, : counts[k]].tolist()))
                        add(own[rows[k : k + 1]], ids, np.array([len(ids)]))
                if steps:
                    merges.extend((own[rows], *rest) for rows, *rest in steps)
        for i in np.flatnonzero(lengths > LONGEST):
            symbols = v.symbols[self.codes[first[i] : first[i] + lengths[i]]].tolist()
            ids = np.array(v.spelled(agenda(v, symbols, int(keys[i]), rate)))
            add(np.array([i]), ids, np.array([len(ids)]))
        return starts, sizes, np.concatenate(out)

    def _deviating(self, chunk: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of the occurrences that are not known to have the plain segmentation."""
        out = self.lengths[chunk] > LONGEST
        for a in range(0, len(chunk), TESTED):
            own = chunk[a : a + TESTED]
            counts = self.merges[own]
            at = np.repeat(self.first[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            drop = below(np.repeat(keys[a : a + TESTED], counts), self.start[at].astype(np.uint64), self.later[at], self.rate)
            out[a + np.repeat(np.arange(len(own)), counts)[drop]] = True
        return np.flatnonzero(out)

    def encode(self, texts: list[str], doc_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the texts' end offsets; `doc_keys` vary the skips."""
        parts = [CHUNK.findall(f" {t}") if t else [] for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        chunk = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        self._learn()
        starts, sizes, flat = self.starts[chunk], self.sizes[chunk], self.flat
        if self.rate > 0:
            place = np.arange(len(chunk)) - np.repeat(np.cumsum(counts) - counts, counts)
            seed = U((self.seed * 2_654_435_761 + 5) % (1 << 64))
            keys = mix(self.hashes[chunk] + mix(np.repeat(mix(doc_keys.astype(np.uint64) + seed), counts) + place.astype(np.uint64)))
            own = self._deviating(chunk, keys)
            more, sizes[own], ids = self._segment(chunk[own], keys[own], self.rate)
            starts[own] = len(flat) + more
            flat = np.concatenate([flat, ids])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])].astype(np.uint32)
        if len(self.known) > HELD:
            self._reset()
        return ids, ends[np.cumsum(counts)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts' bytes."""
        v = self.v
        sizes = v.sizes[ids]
        stop = np.concatenate([[0], np.cumsum(sizes)])
        data = v.flat[np.repeat(v.starts[ids] - stop[:-1], sizes) + np.arange(stop[-1])].tobytes()
        cut = stop[np.concatenate([[0], ends])]
        return [data[a + 1 : b] for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]  # without the dummy prefix


_loaded: dict[tuple, Encoder] = {}


def encoder(path: str, rate: float, seed: int) -> Encoder:
    """One per worker process, so that later tasks find its chunks."""
    if (path, rate, seed) not in _loaded:
        _loaded[path, rate, seed] = Encoder(path, rate, seed)
    return _loaded[path, rate, seed]


def encode(docs: DataFrame, model: str, *, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """All columns of ``docs`` and ids: the text's ids as little-endian unsigned 32-bit integers."""
    name = "ids"
    while name in docs.columns:
        name += "_"
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def add(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                keys = part.column(id_at).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                ids, ends = encoder(model, dropout, seed).encode(texts, keys)
                raw, cut = ids.astype("<u4").tobytes(), np.concatenate([[0], ends * 4]).tolist()
                blobs = pa.array([raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary(), mask=part.column(text_at).is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, blobs], [*part.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def decode(rows: DataFrame, model: str, *, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text of its ids (null for null ids), under ``text_column`` with "_" added while a column has that name."""
    while text_column in rows.columns:
        text_column += "_"
    at = rows.columns.index(ids_column)

    def add(batches):
        for batch in (part for x in batches for part in row_slices(x, ids_column)):
            blobs = [b or b"" for b in batch.column(at).to_pylist()]
            ids = np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)
            texts = encoder(model, 0.0, 0).decode(ids, np.cumsum([len(b) // 4 for b in blobs]))
            column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string(), mask=batch.column(at).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, text_column])

    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField(text_column, T.StringType())]))
