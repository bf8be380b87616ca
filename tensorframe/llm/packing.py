"""Packing along a space-filling curve.

Each document's words are hashed into a count vector, a fixed random matrix
projects it to three dimensions, and the Hilbert index of the point is its
place on a curve: documents with similar words lie near each other. Documents
are range-partitioned by (Hilbert key, hash of doc_id) — so that a group of
copies, which share one key, still spreads — sorted, and concatenated in that
order; sequences are cut every 4096 tokens. Only the last sequence of a
partition is short.

Null and empty texts have the end token alone. Repeated rows are separate
documents (told apart by nothing else, so their pieces carry the same doc_id).
Null doc_ids are kept. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, partitions, row_slices, text_slices
from .wordcodes import forget, with_end, word_codes, word_hash, words_apart

DIMS, BITS = 3, 10
WIDTH = 1 << 14
#: Sampled documents per partition for the range bounds; they balance partitions and decide nothing else.
BOUND_SAMPLES = 64


def projection(width: int = WIDTH, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of non-negative integers below 2**bits (Skilling's transposed form)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curve:
    """Hilbert keys of texts, from their words' hashes."""

    def __init__(self):
        self.matrix = projection()

    def keys(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        counts = np.diff(ends, prepend=0)
        total = np.concatenate([np.zeros((1, DIMS)), np.cumsum(self.matrix[hashes % WIDTH], axis=0, dtype=np.float64)])
        sums = total[ends] - total[ends - counts]
        # each coordinate is about normal with variance `counts`; spread it evenly over the grid
        z = sums / np.sqrt(np.maximum(counts, 1))[:, None]
        even = 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))
        return hilbert(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))

    def of_texts(self, texts: list[str], keep_space: bool) -> np.ndarray:
        parts = [t.split() if keep_space else words_apart(t) for t in texts]
        return self.keys(np.array([word_hash(w) for p in parts for w in p], np.int64), np.cumsum([len(p) for p in parts]))


_curve: list[Curve] = []


def curve() -> Curve:
    if not _curve:
        _curve.append(Curve())
    return _curve[0]


def range_bounds(docs: DataFrame, parts: int, keep_space: bool) -> np.ndarray:
    """`parts` - 1 bounds of the (Hilbert key, salt) order that halve, third, ... the characters of a sample."""
    n = docs.count()
    share = min(1.0, BOUND_SAMPLES * parts / max(n, 1) * 1.2)
    sample = docs if share >= 1 else docs.sample(False, share, 7)

    def place(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                key = (curve().of_texts(texts, keep_space) << 32) | part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([len(t) + 1 for t in texts], pa.int64())], ["key", "n"])

    got = sample.select("text", "salt").mapInArrow(place, "key long, n long").toPandas().sort_values("key")  # BOUND_SAMPLES a partition
    if not len(got):
        return np.zeros(0, np.int64)
    share_below = np.cumsum(got.n.to_numpy()) / got.n.sum()
    return got.key.to_numpy()[np.minimum(np.searchsorted(share_below, np.arange(1, parts) / parts), len(got) - 1)]


def chopped(batches: Iterator[pa.RecordBatch], length: int, base: int, keep_codes: bool = True) -> Iterator[pa.RecordBatch]:
    """The pieces of encoded documents in order; sequences are numbered from ``base``. Encoders of the process go unless ``keep_codes``."""
    if not keep_codes:
        forget()
    give_back()  # what encoding freed
    number, filled = 0, 0
    for batch in (part for x in batches for part in row_slices(x, "ids")):
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
        for doc, width, raw in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
            ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
            start = 0
            while start < len(ids):
                take = min(length - filled, len(ids) - start)
                for k, v in zip(out, (doc, start, take, len(ids), base + number, filled, ids[start : start + take].tobytes()), strict=True):
                    out[k].append(v)
                start, filled = start + take, filled + take
                if filled == length:
                    number, filled = number + 1, 0
        yield pa.RecordBatch.from_pydict(out, schema=PIECES)


def pack(docs: DataFrame, tokenizer: str, *, end_id: int, length: int = 4096, keep_space: bool = False, special_as_text: bool = False, keep_codes: bool = True) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens.

    Without ``keep_codes`` workers drop their encoders, with some hundred MB of chunks, when all is encoded.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset and the piece's
    ids (binary, little-endian unsigned 32-bit).
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (F.xxhash64("doc_id", "text").bitwiseAND(0xFFFFFFFF)).alias("salt"),
    )
    bounds = range_bounds(rows, parts, keep_space)

    def encode(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                ids, ends, *hashed = word_codes(tokenizer, keep_space, True, special_as_text).encode_and_hash(texts)
                key = (curve().keys(*hashed) << 32) | part.column(2).to_numpy()
                ids, ends = with_end(ids, ends, end_id)
                cut = np.append(0, ends)
                data = ids.astype("<u2" if ids.max(initial=0) < 65536 else "<u4")
                raw = data.tobytes()
                w = data.itemsize
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(key), pa.array(np.searchsorted(bounds, key, "left").astype(np.int32)), pa.array(np.full(len(key), w, np.int32)), pa.array([raw[a * w : b * w] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())],
                    ["doc_id", "key", "part", "width", "ids"],
                )

    def chop(batches):
        yield from chopped(batches, length, TaskContext.get().partitionId() << 32, keep_codes)

    coded = rows.mapInArrow(encode, "doc_id long, key long, part int, width int, ids binary")
    return coded.repartitionById(parts, "part").sortWithinPartitions("key", "doc_id", F.length("ids")).mapInArrow(chop, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


PIECES = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
