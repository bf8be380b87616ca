"""Element-wise operations, products and counts of tensors."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.semiring import Semiring, common
from ..sources.storage import partitions
from ..tensor import ShapeError, Tensor
from . import dense
from .einsum import compile_spec


def _same(a: Tensor, b: Tensor) -> None:
    if a.shape != b.shape:
        raise ShapeError(f"shapes {a.shape} and {b.shape} differ")


def _square(a: Tensor) -> int:
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ShapeError("requires a square 2D matrix")
    return a.shape[0]


def add(a: Tensor, b: Tensor) -> Tensor:
    """Union of the patterns; cells of both are added (saturating, if the semiring does), zero results go."""
    _same(a, b)
    return a.with_df(a.df.unionByName(b.df)).canonical()


def tolerant_add(a: Tensor, b: Tensor) -> Tensor:
    """add() that also drops cells where opposite values cancel to almost nothing."""
    _same(a, b)
    y = b.df.withColumnRenamed("v", "w")
    both = a.df.join(y, a.index, "full")
    v = F.when(F.col("v").isNull(), F.col("w")).when(F.col("w").isNull(), F.col("v")).otherwise(scalars.tolerant_add(F.col("v"), F.col("w")))
    return a.with_df(both.select(*a.index, v.alias("v")).filter("v <> 0"))


def multiply(a: Tensor, b: Tensor, tolerant: bool = False) -> Tensor:
    """Intersection of the patterns, cell by cell; ``tolerant`` drops products of almost nothing."""
    _same(a, b)
    both = a.df.join(b.df.withColumnRenamed("v", "w"), a.index)
    v = scalars.tolerant_multiply(F.col("v"), F.col("w")) if tolerant else a.arithmetic.multiply(F.col("v"), F.col("w"))
    return a.with_df(both.select(*a.index, v.alias("v")).filter("v <> 0"))


def rel_diff(a: Tensor, b: Tensor) -> float:
    """Greatest relative difference of two cells; 0 for equal tensors."""
    return rel_diff_frame(a, b).first().rel_diff


def rel_diff_frame(a: Tensor, b: Tensor) -> DataFrame:
    _same(a, b)
    both = a.df.join(b.df.withColumnRenamed("v", "w"), a.index, "full")
    v, w = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("v", "w"))
    return both.agg(F.coalesce(F.max(scalars.relative_difference(v, w)), F.lit(0.0)).alias("rel_diff"))


def pattern_difference(a: Tensor, b: Tensor) -> DataFrame:
    """Cells that only one of the tensors stores."""
    return a.df.join(b.df, a.index, "left_anti").select(*a.index).unionByName(b.df.join(a.df, a.index, "left_anti").select(*a.index))


def same_pattern(a: Tensor, b: Tensor) -> bool:
    return a.shape == b.shape and pattern_difference(a, b).isEmpty()


def matmul(a: Tensor, b: Tensor, semiring: Semiring | None = None) -> Tensor:
    """Matrix product under the tensors' semiring (saturating, if it does)."""
    if a.ndim != 2 or b.ndim != 2 or a.shape[1] != b.shape[0]:
        raise ShapeError(f"cannot multiply {a.shape} by {b.shape}")
    ring = semiring or common([a.semiring, b.semiring], [a.kind, b.kind])
    plan = compile_spec("ab,bc->ac", [a.shape, b.shape], [a.estimate, b.estimate], a.rows is not None and b.rows is not None)
    return replace(plan.run(a, b, semiring=ring)[0], semiring=semiring or a.semiring)


def batched_matmul(a: Tensor, b: Tensor) -> Tensor:
    """Dense products a (.., m, k) by b (.., k, n), one for every leading index, in blocks."""
    if a.ndim != b.ndim or a.ndim < 2 or a.shape[:-2] != b.shape[:-2] or a.shape[-1] != b.shape[-2]:
        raise ShapeError(f"cannot multiply {a.shape} by {b.shape}")
    lead = "abcdefghijklmnopqrstuvw"[: a.ndim - 2]
    sizes = dict(zip(lead + "xyz", (*a.shape, b.shape[-1]), strict=True))
    ring = common([a.semiring, b.semiring], [a.kind, b.kind])
    if not ring.plain or ring.type not in ("bigint", "double"):
        raise ShapeError(f"no blocks of {ring.name}")
    df = dense.contract(a.named(lead + "xy"), frozenset(lead + "xy"), b.named(lead + "yz"), frozenset(lead + "yz"), frozenset(lead + "xz"), sizes, ring)
    return Tensor(df.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(lead + "xz")), "v"), (*a.shape[:-1], b.shape[-1]))


def symbolic_nnz(a: Tensor, b: Tensor) -> DataFrame:
    """Per row of a*b the number of cells that its pattern has: i0, nnz. A product of ones, in which nothing cancels."""
    x, y = (replace(t, df=t.df.withColumn("v", F.lit(1).cast("bigint")), semiring=None) for t in (a, b))
    return matmul(x, y).df.groupBy("i0").agg(F.count(F.lit(1)).alias("nnz"))


def scaled(a: Tensor, factor: int) -> Tensor:
    return a.with_df(a.df.withColumn("v", (F.col("v") * factor).cast(a.kind)))


def widened(a: Tensor) -> Tensor:
    """Whole numbers with 38 digits, for products and sums that 64 bits may not hold; beyond 38 digits an overflow is an error."""
    return replace(a, df=a.df.withColumn("v", F.col("v").cast("decimal(38,0)")), semiring=None)


def narrowed(a: Tensor) -> Tensor:
    """Whole numbers as 64-bit ones if all of them fit, else as they are."""
    a = a.materialised("wide")
    beyond = a.df.filter(~F.col("v").between(F.lit(-(2**63)), F.lit(2**63 - 1)))
    return replace(a, df=a.df.withColumn("v", F.col("v").cast("bigint")), semiring=None) if beyond.isEmpty() else a


def density(a: Tensor) -> DataFrame:
    """nnz, cells, density and, for a matrix, cells stored per row."""
    from math import prod

    total = prod(a.shape)
    return a.df.agg(F.count(F.lit(1)).alias("nnz")).select("nnz", F.lit(total).cast("bigint").alias("cells"), (F.col("nnz") / F.lit(max(total, 1))).alias("density"), (F.col("nnz") / F.lit(max(a.shape[0] if a.shape else 1, 1))).alias("per_row"))


#: Places that a task gathers before it sends them on, and places that are marked at once.
PIECE, SPAN = 1 << 22, 1 << 23


def distinct_cells(a: Tensor) -> DataFrame:
    """places: the exact number of different index tuples within the shape, for tensors of too many cells to send each as a row.

    Places (row-major) are sorted in pieces and sent by span of places, as gaps in planes of bytes, which storage compresses to
    little over a byte each; a span's places are marked in an array.
    """
    piece, span = PIECE, SPAN
    inside = F.lit(True)
    for c, n in zip(a.index, a.shape, strict=True):
        inside = inside & F.col(c).between(0, n - 1)
    places = a.df.filter(inside).select(scalars.linear_index([F.col(c) for c in a.index], a.shape).alias("place"))

    def packed(held):
        x = np.unique(np.concatenate(held))
        keys, first = np.unique(x // span, return_index=True)
        parts = [np.diff(part, prepend=key * span).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for key, part in zip(keys.tolist(), np.split(x, first[1:]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], ["span", "gaps"])

    def gathered(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy())
                n += batch.num_rows
            if n >= piece:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def counted(batches):
        now, marked, n = None, np.zeros(span, bool), 0
        for batch in batches:
            for key, gaps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key != now:
                    n += int(marked.sum())
                    now, marked[:] = key, False
                planes = np.frombuffer(gaps.as_buffer(), np.uint8).reshape(4, -1)
                marked[np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([n + int(marked.sum())], pa.int64())], ["n"])

    sent = places.mapInArrow(gathered, "span bigint, gaps binary").repartition(4 * partitions(a.df.sparkSession), "span").sortWithinPartitions("span")
    return sent.mapInArrow(counted, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("places"))


def search(sorted_values: DataFrame, queries: DataFrame) -> DataFrame:
    """Binary search as a join: for each q its place among the distinct x (rank) and whether it is there.

    Values and queries are sorted together; a query's place is the number of values before it.
    """
    from ..sources.constructors import ranked

    x = sorted_values.select("x").distinct().select("x", F.lit(1).alias("is_value"), F.lit(0).alias("is_query"))
    q = queries.select(F.col("q").alias("x")).distinct().select("x", F.lit(0).alias("is_value"), F.lit(1).alias("is_query"))
    both = x.unionByName(q).groupBy("x").agg(F.max("is_value").alias("found"), F.max("is_query").alias("asked"))
    places = ranked(both, "x")
    # a query that is no value shifts later ranks, so count those before it in the same way
    extra = ranked(both.filter("found = 0"), "x").select("x", F.col("rank").alias("not_values"))
    values = ranked(both.filter("found = 1"), "x").select("x", F.col("rank").alias("place"))
    out = places.filter("asked = 1").join(extra, "x", "left").join(values, "x", "left")
    return out.select(F.col("x").alias("q"), (F.col("found") == 1).alias("found"), F.coalesce("place", F.col("rank") - F.col("not_values")).alias("place"))
