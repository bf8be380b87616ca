"""Block-sparse tensors: the last two axes in N x N tiles, a tile present or absent.

Columns o0 .. (outer indices), br, bc and block, an array of N*N floats in row-major order.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.storage import partitions, written
from ..tensor import ShapeError, Tensor
from . import dense


@dataclass(frozen=True)
class Blocked:
    df: DataFrame
    shape: tuple[int, ...]
    n: int = 8

    @property
    def outer(self) -> list[str]:
        return [f"o{k}" for k in range(len(self.shape) - 2)]

    @property
    def keys(self) -> list[str]:
        return [*self.outer, "br", "bc"]

    @property
    def grid(self) -> tuple[int, int]:
        """Tiles along the last two axes."""
        return tuple(-(-d // self.n) for d in self.shape[-2:])

    def nnz(self) -> int:
        return self.df.agg(F.coalesce(F.sum(F.size(F.filter("block", lambda x: x != 0))), F.lit(0)).alias("n")).first().n

    def memory(self) -> int:
        """Bytes of the present tiles."""
        return 4 * self.n * self.n * self.df.count()

    def to_tensor(self) -> Tensor:
        cells = self.df.select(*self.keys, F.posexplode("block").alias("at", "v")).filter("v <> 0")
        k = len(self.outer)
        row = (F.col("br") * self.n + F.floor(F.col("at") / self.n)).cast("bigint")
        col = (F.col("bc") * self.n + F.col("at") % self.n).cast("bigint")
        return Tensor(cells.select(*(F.col(o).alias(f"i{j}") for j, o in enumerate(self.outer)), row.alias(f"i{k}"), col.alias(f"i{k + 1}"), "v"), self.shape)

    def get_opt(self, *cell: int):
        """The value; None in an absent tile and for a zero."""
        return self.to_tensor().get_opt(*cell)


def empty(spark: SparkSession, shape: tuple[int, ...], n: int = 8) -> Blocked:
    if len(shape) < 2:
        raise ShapeError("tiles need two dimensions at least")
    keys = ", ".join(f"{k} bigint" for k in [*(f"o{j}" for j in range(len(shape) - 2)), "br", "bc"])
    return Blocked(spark.createDataFrame([], f"{keys}, block array<float>"), shape, n)


def to_blocks(t: Tensor, n: int = 8) -> Blocked:
    """Tiles that hold a cell; missing cells of such a tile are 0."""
    if t.ndim < 2:
        raise ShapeError("tiles need two dimensions at least")
    k = t.ndim - 2
    r, c = F.col(f"i{k}"), F.col(f"i{k + 1}")
    at = (r % n * n + c % n).cast("int")
    cells = t.df.select(*(F.col(f"i{j}").alias(f"o{j}") for j in range(k)), F.floor(r / n).cast("bigint").alias("br"), F.floor(c / n).cast("bigint").alias("bc"), at.alias("at"), F.col("v").cast("float").alias("v"))
    keys = [*(f"o{j}" for j in range(k)), "br", "bc"]
    held = cells.groupBy(*keys).agg(F.collect_list(F.struct("at", "v")).alias("cells"))  # n * n entries at most

    def fill(batches):
        for b in batches:
            cells = b.column(len(keys))
            ends = cells.offsets.to_numpy()
            at, v = (cells.flatten().field(j).to_numpy() for j in (0, 1))
            out = np.zeros((b.num_rows, n * n), np.float32)
            out[np.repeat(np.arange(b.num_rows), np.diff(ends)), at] = v
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], _tiles(out)], [*keys, "block"])

    return Blocked(held.mapInArrow(fill, _schema(keys)), t.shape, n)


def _schema(keys: list[str]) -> str:
    return ", ".join(f"{k} bigint" for k in keys) + ", block array<float>"


def _tiles(cells: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    rows, width = cells.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32)), pa.array(cells.reshape(-1)))


def _pairwise(a: Blocked, b: Blocked, how: str) -> DataFrame:
    if a.shape != b.shape or a.n != b.n:
        raise ShapeError("tensors of different shapes or tiles")
    return a.df.join(b.df.withColumnRenamed("block", "other"), a.keys, how)


def add(a: Blocked, b: Blocked) -> Blocked:
    """Tiles of either; those of both are summed."""
    both = _pairwise(a, b, "full")
    block = F.when(F.col("block").isNull(), F.col("other")).when(F.col("other").isNull(), F.col("block")).otherwise(F.zip_with("block", "other", lambda x, y: x + y))
    return Blocked(both.select(*a.keys, block.alias("block")), a.shape, a.n)


def multiply(a: Blocked, b: Blocked) -> Blocked:
    """Cell by cell; tiles of both, and of these the ones that are not all zero."""
    both = _pairwise(a, b, "inner").select(*a.keys, F.zip_with("block", "other", lambda x, y: x * y).alias("block"))
    return Blocked(both.filter(F.exists("block", lambda x: x != 0)), a.shape, a.n)


def rel_diff(a: Blocked, b: Blocked) -> float:
    """Greatest relative difference of cells; 1 as soon as a tile is present on one side only."""
    both = _pairwise(a, b, "full")
    cells = F.zip_with("block", "other", lambda x, y: scalars.relative_difference(x.cast("double"), y.cast("double")))
    worst = F.when(F.col("block").isNull() | F.col("other").isNull(), F.lit(1.0)).otherwise(F.array_max(cells))
    return both.agg(F.coalesce(F.max(worst), F.lit(0.0)).alias("d")).first().d


def attention(q: Blocked, k: Blocked) -> Blocked:
    """Scores of q (.., rows, d) against k (.., columns, d): products of tile pairs that are both present.

    Tiles are grouped to about SIDE rows. For each pair of such groups with equal outer indices one task multiplies and
    adds up what meets along d, and emits the score tiles that any pair of tiles contributed to.
    """
    if q.shape[:-2] != k.shape[:-2] or q.shape[-1] != k.shape[-1] or q.n != k.n:
        raise ShapeError(f"cannot score {q.shape} against {k.shape}")
    n, keys = q.n, q.outer
    wide = max(1, dense.SIDE // n)
    grouped = lambda t: t.df.select(*keys, F.expr(f"br div {wide}").alias("block"), F.col("bc").alias("k"), (F.col("br") % wide).cast("int").alias("at"), F.col("block").alias("tile"))
    width = len(keys) + 4  # outer indices, i, j, k, side

    def read(rows) -> tuple[np.ndarray, np.ndarray]:
        at = np.array([batch.column(width)[row].as_py() for batch, row in rows])
        tiles = []
        for batch, row in rows:
            held = batch.column(width + 1)
            tiles.append(held.values.to_numpy()[held.offsets[row].as_py() :][: n * n].reshape(n, n))
        return at, np.concatenate(tiles).astype(np.float64)

    def score(batches):
        total, there = np.zeros((wide, wide, n, n)), np.zeros((wide, wide), bool)

        def add(x, y) -> None:
            at = np.ix_(x[0], y[0])
            total[at] += (x[1] @ y[1].T).reshape(len(x[0]), n, len(y[0]), n).transpose(0, 2, 1, 3)
            there[at] = True

        def done(key):
            *outer, i, j = key
            at = np.nonzero(there)
            columns = [np.full(len(at[0]), o) for o in outer] + [at[0] + i * wide, at[1] + j * wide]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), _tiles(total[at].reshape(-1, n * n).astype(np.float32))], [*keys, "br", "bc", "block"])
            total[:], there[:] = 0, False

        yield from dense.streamed(batches, len(keys) + 2, read, add, done)

    sent = dense.paired(grouped(q), grouped(k), keys, ["at", "tile"], 4 * partitions(q.df.sparkSession), tuple(-(-t.grid[0] // wide) for t in (q, k)))
    return Blocked(sent.mapInArrow(score, _schema([*keys, "br", "bc"])), (*q.shape[:-1], k.shape[-2]), n)


def transpose(a: Blocked) -> Blocked:
    """The last two axes exchanged."""
    n = a.n
    block = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda p: F.get("block", (p % n * n + F.floor(p / n)).cast("int")))
    df = a.df.select(*a.outer, F.col("bc").alias("br"), F.col("br").alias("bc"), block.alias("block"))
    return Blocked(df, (*a.shape[:-2], a.shape[-1], a.shape[-2]), n)


def matmul(a: Blocked, b: Blocked) -> Blocked:
    """Matrix product of tiles (batched over the outer axes): dense arithmetic where both tiles are present."""
    return attention(a, transpose(b))


def power(a: Blocked, k: int) -> Blocked:
    """a^k for k >= 1, step by step."""
    out = a
    for _ in range(k - 1):
        step = matmul(out, a)
        out = Blocked(written(step.df, "tiles"), step.shape, step.n)
    return out


def attention_macs(q: Blocked, k: Blocked) -> int:
    """Multiplications of attention(): tile pairs times n cubed."""
    keys = [*q.outer, "bc"]
    pairs = q.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("a")).join(k.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("b")), keys)
    return pairs.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n")).first().n * q.n**3


def dense_memory(shape: tuple[int, ...]) -> int:
    """Bytes of a dense tensor of 4-byte values."""
    return 4 * prod(shape)
