"""Exact top-k search by inner product, over integer vectors.

Queries are written once, as blocks. Candidates are dealt into partitions of about PART_ROWS rows,
whatever their ids; every partition holds its vectors as matrices, reads the query blocks from the shared
folder and streams them past: one matrix product per (query block, tile), a partial selection of the best
k per tile, and a merge into the block's running list. The partitions' lists meet in a tree of groups of
FAN_IN. Memory of a task: its partition's vectors, one query block and one tile of scores.

Ties go to the smaller id. Rows with a null id, a null vector or null components take no part.
Every row is a candidate; a query's list leaves out the rows of its own id. Rows that share an id
are candidates one by one, so an id can be listed more than once; several query rows of one id share one
list, the best k of all. Vectors are compared only with those of the same dimension. Scores beyond a signed
64-bit integer are clamped to its range. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import files_of, opened, partitions, written

BLOCK, TILE, FAN_IN, PART_ROWS = 512, 8192, 16, 200_000
EXACT = float(2**53)


def quantised(embedding: Column | str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where a component is null or not finite."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # numbers beyond 64 bits are clamped by the cast's range check
    top = float(2**62)
    return F.when(fine, F.transform(e, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(top)), F.lit(-top))).cast("long")))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row; columns must ascend by id, so that earlier columns win ties."""
    k = min(k, scores.shape[1])
    if k == 0:
        return scores[:, :0], np.broadcast_to(ids[:0], (len(scores), 0))
    if scores.dtype == np.float64 and scores.shape[1] > 4 * k:
        low = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]  # the k-th highest
        out = np.empty((len(scores), k), np.int64)
        over = scores >= low[:, None]
        rows, cols = np.nonzero(over)
        cut = np.searchsorted(rows, np.arange(len(scores) + 1))
        for r in range(len(scores)):
            c = cols[cut[r] : cut[r + 1]]
            out[r] = c[np.argsort(-scores[r, c], kind="stable")[:k]]
    else:
        out = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, out, 1), ids[out]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while sums stay below 2**53, else in Python integers."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)))
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < EXACT:
        return q.astype(np.float64) @ c.astype(np.float64).T
    return q.astype(object) @ c.astype(object).T


def merge(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of each row by (score descending, id ascending), columns in any order."""
    order = np.argsort(ids, axis=1, kind="stable")
    s, i = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)


LIST = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))
LONG = 2**63 - 1


class Shard:
    """One partition's candidates, by dimension, ascending by id."""

    def __init__(self, ids: list[np.ndarray], vectors: list[np.ndarray], sizes: list[np.ndarray]):
        i, s = np.concatenate(ids), np.concatenate(sizes)
        ends = np.cumsum(s)
        flat = np.concatenate(vectors)
        self.by = {}
        for d in np.unique(s):
            at = np.flatnonzero(s == d)
            at = at[np.argsort(i[at], kind="stable")]
            self.by[int(d)] = i[at], flat[(ends[at] - d)[:, None] + np.arange(d)] if d else np.zeros((len(at), 0), np.int64)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        if queries.shape[1] not in self.by:
            return None
        ids, vectors = self.by[queries.shape[1]]
        got = []
        for a in range(0, len(ids), TILE):
            own = ids[a : a + TILE]
            scores = products(queries, vectors[a : a + TILE])
            first, last = np.searchsorted(own, query_ids), np.searchsorted(own, query_ids, "right")
            for r in np.flatnonzero(first < last):
                scores[r, first[r] : last[r]] = -np.inf
            got.append(best(scores, own, k))
        return merge(np.concatenate([s for s, _ in got], 1), np.concatenate([i for _, i in got], 1), k)


def query_blocks(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each block that the files hold, one at a time."""
    for uri in files:
        fs, path = opened(uri)
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(16):
                for ids, flat in zip(batch.column(0), batch.column(1), strict=True):
                    q = ids.values.to_numpy()
                    yield q, flat.values.to_numpy().reshape(len(q), -1)


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int, *, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    """query_id, rank (from 1), id, score: the k candidates of highest inner product for each query, other than its own id."""
    spark = candidates.sparkSession
    fine = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).filter("id is not null and v is not null and forall(v, x -> x is not null)")
    parts = max(partitions(spark), -(-candidates.count() // PART_ROWS))

    def blocks(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for d in np.unique(sizes):
                every = np.flatnonzero(sizes == d)
                for a in range(0, len(every), BLOCK):
                    at = every[a : a + BLOCK]
                    own = flat[(ends[at] - d)[:, None] + np.arange(d)] if d else np.zeros((len(at), 0), np.int64)
                    yield pa.RecordBatch.from_pydict({"ids": [ids[at]], "v": [own.reshape(-1)]}, schema=pa.schema([("ids", pa.list_(pa.int64())), ("v", pa.list_(pa.int64()))]))

    files = files_of(written(fine(queries).mapInArrow(blocks, "ids array<long>, v array<long>"), "queries"))

    def search(batches):
        ids, vectors, sizes = [], [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            sizes.append(np.diff(batch.column(1).offsets.to_numpy()))
            vectors.append(batch.column(1).flatten().to_numpy(zero_copy_only=False))
        if not sum(map(len, ids)):
            return
        shard, part = Shard(ids, vectors, sizes), TaskContext.get().partitionId()
        for q, rows in query_blocks(files):
            found = shard.top(q, rows, k)
            if found is not None:
                lists = [[{"score": max(-LONG - 1, min(LONG, int(s))), "id": int(i)} for s, i in zip(*row, strict=True) if s != -np.inf] for row in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), part, np.int32)), pa.array(lists, LIST)], ["query_id", "part", "top"])

    lists = fine(candidates).repartition(parts).mapInArrow(search, "query_id long, part int, top array<struct<score: long, id: long>>")
    while True:
        parts = -(-parts // FAN_IN)
        joined = F.array_sort(F.flatten(F.collect_list("top")), lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)))
        lists = lists.groupBy("query_id", F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).agg(F.slice(joined, 1, k).alias("top"))
        if parts == 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
