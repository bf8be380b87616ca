"""Constructors of tensors and matrices."""

from __future__ import annotations

from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.semiring import LONG, Semiring
from ..tensor import ShapeError, Tensor
from .storage import partitions


def empty(spark: SparkSession, shape: tuple[int, ...], kind: str = "bigint") -> Tensor:
    columns = ", ".join([*(f"i{k} bigint" for k in range(len(shape))), f"v {kind}"])
    return Tensor(spark.createDataFrame([], columns), shape, rows=0)


def identity(spark: SparkSession, n: int, semiring: Semiring | None = None) -> Tensor:
    ring = semiring or LONG()
    return Tensor(spark.range(n).select(F.col("id").alias("i0"), F.col("id").alias("i1"), ring.lit(1).alias("v")), (n, n), semiring, n)


def from_coo(cells: DataFrame, shape: tuple[int, ...], semiring: Semiring | None = None) -> Tensor:
    """Cells (i0 .., v): repeated ones summed by the semiring, zeros dropped after that."""
    return Tensor(cells, shape, semiring).canonical()


def from_edges(edges: DataFrame, n: int, semiring: Semiring | None = None) -> Tensor:
    """Directed edges (src, dst): every edge adds one, so parallel edges sum."""
    ring = semiring or LONG()
    cells = edges.select(F.col("src").cast("bigint").alias("i0"), F.col("dst").cast("bigint").alias("i1"), ring.lit(1).alias("v"))
    return from_coo(cells, (n, n), semiring)


def from_edges_undirected(edges: DataFrame, n: int, semiring: Semiring | None = None) -> Tensor:
    """Both directions of every edge; a self-loop counts once."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return from_edges(edges.select("src", "dst").unionByName(back), n, semiring)


def from_parts(parts: DataFrame, shape: tuple[int, ...]) -> Tensor:
    """Compressed rows (row, col_idx, values; row is the compound row's place). Only lengths are checked: nothing is sorted, merged or dropped."""
    if len(shape) < 2:
        raise ShapeError("compressed rows need two dimensions at least")
    checked = parts.select("row", F.assert_true(F.size("col_idx") == F.size("values"), "as many columns as values").alias("ok"), "col_idx", "values")
    cells = checked.filter("ok is null").select("row", F.explode(F.arrays_zip("col_idx", "values")).alias("x"))
    lead = [c.alias(f"i{k}") for k, c in enumerate(scalars.coordinates(F.col("row"), shape[:-1]))]
    return Tensor(cells.select(*lead, F.col("x.col_idx").alias(f"i{len(shape) - 1}"), F.col("x.values").alias("v")), shape)


def parts_of_arrays(spark: SparkSession, row_ptr: list[int], col_idx: list[int], values: list, shape: tuple[int, ...]) -> Tensor:
    """The classical three arrays of compressed rows."""
    if len(row_ptr) != prod(shape[:-1]) + 1 or len(col_idx) != len(values) or row_ptr[-1] != len(values):
        raise ShapeError("array lengths do not fit the shape")
    rows = [(r, col_idx[a:b], values[a:b]) for r, (a, b) in enumerate(zip(row_ptr, row_ptr[1:], strict=False)) if b > a]
    kind = "double" if any(isinstance(v, float) for v in values) else "bigint"
    return from_parts(spark.createDataFrame(rows, f"row bigint, col_idx array<bigint>, values array<{kind}>"), shape)


def from_adjacency(pairs: DataFrame, semiring: Semiring | None = None) -> tuple[DataFrame, DataFrame]:
    """Named edges (pos, src, dst): cells (i0, i1, v) and ids (name, id) in order of first appearance.

    Ids are dense ranks of (position, side). They come from a range sort and counts
    per sorted partition, not from one window over all names.
    """
    names = pairs.select(F.explode(F.array(F.struct((F.col("pos") * 2).alias("at"), F.col("src").alias("name")), F.struct((F.col("pos") * 2 + 1).alias("at"), F.col("dst").alias("name")))).alias("x"))
    first = names.groupBy("x.name").agg(F.min("x.at").alias("at"))
    ids = ranked(first, "at").select("name", F.col("rank").alias("id"))
    left = ids.select(F.col("name").alias("src"), F.col("id").alias("i0"))
    right = ids.select(F.col("name").alias("dst"), F.col("id").alias("i1"))
    cells = pairs.join(left, "src").join(right, "dst").select("i0", "i1", (semiring or LONG()).lit(1).alias("v"))
    return Tensor(cells, (0, 0), semiring).canonical().df, ids


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with rank: the row's place (from 0) in the order of columns that tell all rows apart.

    Rows are range-partitioned; a window works within a partition and the counts per partition (as many
    as partitions) give each partition's first place.
    """
    from pyspark.sql import Window

    from .storage import written

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    firsts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("_part").orderBy(*order)
    return placed.join(firsts, "_part").withColumn("rank", F.col("_first") + F.row_number().over(own) - 1).drop("_part", "_first")


def lattice(spark: SparkSession, dims: tuple[int, ...], torus: bool = False, dedupe: bool = False) -> Tensor:
    """Neighbours (Moore) of every cell of a grid, cells numbered row by row; on a torus both ways round to one cell count twice unless ``dedupe``."""
    total, axes = prod(dims), range(len(dims))
    steps = F.transform(F.sequence(F.lit(0), F.lit(3 ** len(dims) - 1)), lambda k: k.cast("bigint"))
    at = spark.range(total).select(F.col("id").alias("i0"), *(c.alias(f"c{k}") for k, c in zip(axes, scalars.coordinates(F.col("id"), dims), strict=True)), F.explode(steps).alias("step"))
    at = at.filter(F.col("step") != (3 ** len(dims) - 1) // 2)  # the step that stays
    moved = [F.col(f"c{k}") + F.floor(F.col("step") / 3**k).cast("bigint") % 3 - 1 for k in axes]
    if torus:
        moved = [scalars.wrap(m, d) for m, d in zip(moved, dims, strict=True)]
    else:
        inside = F.lit(True)
        for m, d in zip(moved, dims, strict=True):
            inside = inside & (m >= 0) & (m < d)
        at = at.filter(inside)
    cells = at.select("i0", scalars.linear_index(moved, dims).cast("bigint").alias("i1"))
    counted = cells.groupBy("i0", "i1").agg(F.count(F.lit(1)).alias("v")) if torus else cells.select("i0", "i1", F.lit(1).cast("bigint").alias("v"))
    if dedupe:
        counted = counted.select("i0", "i1", F.lit(1).cast("bigint").alias("v"))
    return Tensor(counted, (total, total), rows=total * (3 ** len(dims) - 1))


def thin(a: Tensor, keep) -> Tensor:
    """Keeps upper cells (i0 <= i1) for which ``keep`` (a condition on i0, i1) holds, and the mirrored cell if there is one; other lower cells go."""
    upper = a.df.filter(F.col("i0") <= F.col("i1")).filter(keep)
    back = upper.filter("i0 <> i1").select(F.col("i1").alias("i0"), F.col("i0").alias("i1"))
    return a.with_df(upper.unionByName(a.df.join(back, ["i0", "i1"], "left_semi")))


def hashed_share(share: float, seed: int = 0):
    """A condition for thin(): about this share of pairs, chosen by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), "i0", "i1"), F.lit(1 << 30)) < int(share * (1 << 30))


def random_graph(spark: SparkSession, n: int, m: int, seed: int = 0) -> Tensor:
    """m draws of edges without self-loops; repeated ones sum."""
    if n < 2:
        raise ShapeError("a graph without self-loops needs two nodes")
    src = F.pmod(F.xxhash64(F.lit(seed), F.lit("s"), "id"), F.lit(n))
    dst = F.pmod(F.xxhash64(F.lit(seed), F.lit("d"), "id"), F.lit(n - 1))
    return from_edges(spark.range(m).select(src.alias("src"), F.when(dst >= src, dst + 1).otherwise(dst).alias("dst")), n)


#: Places (row-major) that are drawn at once.
BLOCK = 1 << 17


def density_blocks(spark: SparkSession, shape: tuple[int, ...], density: float, seed: int = 0):
    """The parts of with_density(): a table of blocks (block, cells) and a function of both to a block's first place, its index columns and values.

    Every set of floor(density * cells) cells is as likely as any other: the blocks' counts are binomial, and what they sum to too much (or too little) is
    taken from members (or given to others) drawn from all blocks; within a block the same is done with single places. So a block's cells are known without
    the others, lie within its own places and are the same wherever they are made.
    """
    total, block = prod(shape), BLOCK
    count = int(density * total)
    sizes = np.full(-(-total // block), block, np.int64)
    if total:
        sizes[-1] = total - block * (len(sizes) - 1)
    rng = np.random.Generator(np.random.SFC64(np.random.SeedSequence([seed & (2**64 - 1), 0])))
    found = rng.binomial(sizes, count / max(total, 1))
    beyond = int(found.sum()) - count
    if beyond:
        ends = np.cumsum(found if beyond > 0 else sizes - found)
        some = np.empty(0, np.int64)
        while len(some) < abs(beyond):  # the same member may be drawn twice
            some = np.unique(np.concatenate([some, rng.integers(ends[-1], size=abs(beyond) - len(some))]))
        found -= (1 if beyond > 0 else -1) * np.bincount(np.searchsorted(ends, some, side="right"), minlength=len(sizes))

    def drawn(number, cells):
        first = number * block
        size = min(block, total - first)
        rng = np.random.Generator(np.random.SFC64(np.random.SeedSequence([seed & (2**64 - 1), 1, number])))
        taken = rng.integers(0, 2**64, size // 4 + 1, np.uint64).view(np.uint16)[:size] < round(cells / size * 2**16)
        beyond = int(np.count_nonzero(taken)) - cells
        if beyond:
            pool = np.flatnonzero(taken if beyond > 0 else ~taken)
            taken[pool[rng.choice(len(pool), abs(beyond), replace=False, shuffle=False)]] = beyond < 0
        rest, index = np.flatnonzero(taken), []
        rest += first
        low, high = first, first + size - 1
        for n in shape[:0:-1]:
            low, high = low // n, high // n
            up = rest // n if low < high else low  # most blocks of a wide shape lie in one row
            index.append(rest - up * n)
            rest = up if low < high else np.full(cells, low)
        return first, [rest, *index[::-1]][: len(shape)], rng.random(cells)

    table = pa.table({"block": pa.array(np.flatnonzero(found)), "cells": pa.array(found[found > 0])})
    return spark.createDataFrame(table).repartition(max(1, min(len(table), 4 * partitions(spark)))), drawn


def with_density(spark: SparkSession, shape: tuple[int, ...], density: float, seed: int = 0) -> Tensor:
    """Exactly floor(density * cells) distinct cells with values uniform in [0, 1)."""
    blocks, drawn = density_blocks(spark, shape, density, seed)
    names = [f"i{k}" for k in range(len(shape))]

    def cells(batches):
        for batch in batches:
            for number, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, index, values = drawn(number, count)
                yield pa.RecordBatch.from_arrays([*map(pa.array, index), pa.array(values)], [*names, "v"])

    return Tensor(blocks.mapInArrow(cells, ", ".join([*(f"{c} bigint" for c in names), "v double"])), shape, rows=int(density * prod(shape)))


def random_index(spark: SparkSession, shape: tuple[int, ...], count: int, seed: int = 0) -> DataFrame:
    """Uniform index tuples."""
    return spark.range(count).select(*(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(d)).alias(f"i{k}") for k, d in enumerate(shape)))


def filled(values: DataFrame, shape: tuple[int, ...]) -> Tensor:
    """A dense tensor of one array (column ``a``) in row-major order; its length must be the number of cells."""
    total = prod(shape)
    cells = values.select(F.posexplode("a").alias("place", "v"), F.assert_true(F.size("a") == total, "as many values as cells").alias("ok")).filter("ok is null")
    return Tensor(cells.select(*(c.cast("bigint").alias(f"i{k}") for k, c in enumerate(scalars.coordinates(F.col("place").cast("bigint"), shape))), "v").filter("v <> 0"), shape)
