"""Token-ID output: fixed-width bit packing with block offsets.

A corpus is written as numbered shards. A shard is

    header   magic, version, bits, ids per block
    blocks   every id in `bits` bits, least significant bit first; each block starts on a byte
    footer   int64 arrays: doc_id, null flag, first id of each document, offset of each block
    trailer  counts of documents, ids and blocks, the footer's offset, magic

so any document is read by seeking to the blocks that hold it, and blocks are
unpacked with a few numpy operations per lane of eight ids.

Shards follow ascending (doc_id, text hash); null doc_ids come first. Null and
empty texts give the end id alone; a special token's string in a text becomes that token, as the
library has it, unless ``special_as_text``; repeated rows are separate documents; other
columns are ignored; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, opened, partitions, text_slices
from .wordcodes import with_end, word_codes

MAGIC = b"TFIDS001"
HEADER = struct.Struct("<8sII")
TRAILER = struct.Struct("<qqqq8s")
BLOCK_IDS = 65_536  # a multiple of 8


def bits_for(vocabulary: int) -> int:
    """Bits that hold ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, least significant first, padded to whole bytes."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    n = -(-len(ids) // 8) * 8
    lanes = np.zeros(n, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, 8)
    out = np.zeros((len(lanes), bits), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range(-(-(bits + shift) // 8)):
            out[:, byte + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The `count` ids that pack() wrote."""
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    groups = -(-count // 8)
    raw = np.zeros(groups * bits, np.uint8)
    have = np.frombuffer(data, np.uint8)[: groups * bits]
    raw[: len(have)] = have
    raw = raw.reshape(groups, bits)
    out = np.empty((groups, 8), np.uint32)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(groups, np.uint64)
        for k in range(-(-(bits + shift) // 8)):
            value |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:count]


class ShardWriter:
    """Streams documents into one shard; only the index and one block stay in memory."""

    def __init__(self, path: str, bits: int):
        fs, at = opened(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(at)
        self.bits, self.rest, self.n = bits, np.zeros(0, np.uint32), 0
        self.doc_ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.offsets: list[int] = []
        self.at = self.out.write(HEADER.pack(MAGIC, bits, BLOCK_IDS))

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.out.write(pack(ids, self.bits))

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.nulls.append(nulls)
        self.firsts.append(self.n + np.concatenate([[0], ends[:-1]]))
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, full, BLOCK_IDS):
            self._block(self.rest[i : i + BLOCK_IDS])
        self.rest = self.rest[full:].copy()

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._block(self.rest)
        arrays = [np.concatenate(x).astype("<i8") for x in (self.doc_ids, self.nulls, self.firsts)] + [np.array(self.offsets, "<i8")]
        for x in arrays:
            self.out.write(x.tobytes())
        self.out.write(TRAILER.pack(len(arrays[0]), self.n, len(self.offsets), self.at, MAGIC))
        self.out.close()
        return len(arrays[0]), self.n


class ShardReader:
    """Random access to a shard's documents."""

    def __init__(self, path: str):
        self.fs, self.path = opened(path)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        magic, self.bits, self.block_ids = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        docs, self.n, blocks, self.footer, again = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{path} is no token shard")
        index = np.frombuffer(self.file.read_at(size - TRAILER.size - self.footer, self.footer), "<i8")
        self.doc_ids, self.nulls, self.firsts = index[: 3 * docs].reshape(3, docs)
        self.offsets = np.append(index[3 * docs : 3 * docs + blocks], self.footer)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids `start` to `end` of the shard; reads only the blocks that hold them."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        base, got = first * self.block_ids, []
        for b in range(first, last + 1):
            count = min(self.block_ids, self.n - b * self.block_ids)
            at = int(self.offsets[b] - self.offsets[first])
            got.append(unpack(data[at : at + -(-count * self.bits // 8)], self.bits, count))
        return np.concatenate(got)[start - base : end - base]

    def document(self, i: int) -> np.ndarray:
        ends = self.firsts[i + 1] if i + 1 < len(self) else self.n
        return self.ids(int(self.firsts[i]), int(ends))

    def runs(self, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Document ranges of about `most` ids each."""
        ends = np.append(self.firsts[1:], self.n)
        first = 0
        while first < len(self):
            last = max(first + 1, int(np.searchsorted(ends, self.firsts[first] + most, "right")))
            yield first, last
            first = last

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, tokenizer: str, *, vocabulary: int, end_id: int, path: str, keep_space: bool = True, special_as_text: bool = False) -> list[tuple[str, int, int]]:
    """Writes every text's ids as shards under ``path``; returns (shard, documents, ids) in corpus order.

    Texts are range-partitioned by (doc_id, text hash), so that rows sharing a doc_id still spread.
    """
    spark = docs.sparkSession
    bits = bits_for(vocabulary)

    def write(batches):
        out = None
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                if out is None:
                    shard = TaskContext.get().partitionId()
                    file = f"{path}/{shard:08d}-{uuid.uuid4().hex}.ids"  # a repeated task writes a file of its own; that of the last attempt counts
                    out = ShardWriter(file, bits)
                ids, ends = with_end(*word_codes(tokenizer, keep_space, special_as_text=special_as_text).encode(texts), end_id)
                doc = part.column(0)
                out.add(doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), ids, ends)
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [file], "docs": [n_docs], "ids": [n_ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    done = sorted(ordered.mapInArrow(write, "shard long, file string, docs long, ids long").collect())  # a row per shard
    return [tuple(r)[1:] for r in done]


def read_tokens(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of every document in the shards."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)
    paths = [s[0] for s in shards]
    bases = [0, *np.cumsum([s[2] for s in shards]).tolist()]

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard = ShardReader(paths[k])
                for first, last in shard.runs():
                    at = shard.firsts[first:last]
                    ends = np.append(at[1:], shard.firsts[last] if last < len(shard) else shard.n)
                    ids = shard.ids(int(at[0]), int(ends[-1])).astype("<u4")
                    cut = (np.append(at, ends[-1]) - at[0]) * 4
                    held = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(cut.astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids[first:last], pa.int64(), mask=shard.nulls[first:last].astype(bool)),
                            pa.array(bases[k] + at, pa.int64()),
                            pa.array(ends - at, pa.int64()),
                            held.cast(pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                shard.close()

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, *, vocabulary: int, end_id: int, keep_space: bool = True, path: str | None = None, special_as_text: bool = False) -> DataFrame:
    """Writes the table's token shards and reads them back (see the module's text for odd rows)."""
    spark = docs.sparkSession
    shards = write_tokens(docs, tokenizer, vocabulary=vocabulary, end_id=end_id, path=path or new_path(spark, "token-files"), keep_space=keep_space, special_as_text=special_as_text)
    return read_tokens(spark, shards)
