"""Tensors as coordinate DataFrames: columns i0 .. ik-1 (bigint) and v, one row per non-zero cell."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import scalars
from .functions.semiring import Semiring, of_type
from .sources.storage import written


class ShapeError(ValueError):
    """Shapes that an operator cannot combine."""


@dataclass(frozen=True)
class Tensor:
    """``df`` has unique index rows and no zero values; ``shape`` is authoritative; ``rows`` is a size hint for planning."""

    df: DataFrame
    shape: tuple[int, ...]
    semiring: Semiring | None = field(default=None, compare=False)
    rows: float | None = None

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def index(self) -> list[str]:
        return [f"i{k}" for k in range(self.ndim)]

    @property
    def kind(self) -> str:
        return dict(self.df.dtypes)["v"]

    @property
    def arithmetic(self) -> Semiring:
        return self.semiring or of_type(self.kind)

    @property
    def estimate(self) -> float:
        return float(self.rows if self.rows is not None else prod(self.shape))

    def with_df(self, df: DataFrame, shape: tuple[int, ...] | None = None) -> Tensor:
        return replace(self, df=df, shape=self.shape if shape is None else shape, rows=None)

    def named(self, letters: str, value: str = "v") -> DataFrame:
        """The rows under fresh column names (so that a tensor can meet itself in a join)."""
        return self.df.select(*(F.col(c).alias(x) for c, x in zip(self.index, letters, strict=True)), F.col("v").alias(value))

    def materialised(self, name: str = "tensor") -> Tensor:
        """The same tensor as a written table, its cells counted: for operands that are used more than once."""
        kept = written(self.df, name)
        return replace(self, df=kept, rows=kept.count())

    # point access

    def _at(self, cell: tuple[int, ...]) -> Column:
        if len(cell) != self.ndim:
            raise ShapeError(f"{len(cell)} indices for {self.ndim} dimensions")
        return F.expr(" and ".join([f"i{k} = {int(c)}" for k, c in enumerate(cell)] or ["true"]))

    def get_opt(self, *cell: int):
        """The stored value, None if the cell is absent."""
        row = self.df.filter(self._at(cell)).select("v").first()
        return None if row is None else row.v

    def get(self, *cell: int):
        found = self.get_opt(*cell)
        return 0 if found is None else found

    def get_many(self, cells: DataFrame) -> DataFrame:
        """``cells`` (columns i0 ..) with their values, 0 where absent."""
        return cells.join(self.df, self.index, "left").select(*self.index, F.coalesce("v", F.lit(0)).cast(self.kind).alias("v"))

    def set(self, cells: DataFrame) -> Tensor:
        """Cells (i0 .., v) replaced; value 0 removes a cell."""
        keep = self.df.join(cells, self.index, "left_anti")
        new = cells.filter("v <> 0").select(*self.index, F.col("v").cast(self.kind).alias("v"))
        return self.with_df(keep.unionByName(new))

    def remove(self, cells: DataFrame) -> Tensor:
        return self.with_df(self.df.join(cells, self.index, "left_anti"))

    # rows

    def row(self, r: int) -> DataFrame:
        """Stored cells of one row in column order."""
        return self.df.filter(F.col("i0") == r).orderBy(*self.index[1:])

    def row_nnz(self) -> DataFrame:
        """Stored cells per row (rows without any are absent)."""
        return self.df.groupBy(*self.index[:-1]).agg(F.count(F.lit(1)).alias("nnz"))

    def row_entry(self, k: int) -> DataFrame:
        """The k-th stored cell of every row that has one; of a row only its first cells are kept while sorting."""
        *lead, last = self.index
        if not lead:
            return self.df.orderBy(last).offset(k).limit(1).select("v")
        place = F.row_number().over(Window.partitionBy(*lead).orderBy(last))
        return self.df.withColumn("_place", place).filter(F.col("_place") == k + 1).select(*lead, last, "v")

    def nnz(self) -> int:
        return self.df.count()

    # shape

    def transpose(self, *axes: int) -> Tensor:
        axes = axes or tuple(reversed(range(self.ndim)))
        df = self.df.select(*(F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(axes)), "v")
        return replace(self, df=df, shape=tuple(self.shape[a] for a in axes))

    def diagonal(self) -> DataFrame:
        """Cells whose indices are all equal: i0, v."""
        equal = F.lit(True)
        for c in self.index[1:]:
            equal = equal & (F.col("i0") == F.col(c))
        return self.df.filter(equal).select("i0", "v")

    def linear(self) -> DataFrame:
        """place (row-major), v."""
        return self.df.select(scalars.linear_index([F.col(c) for c in self.index], self.shape).alias("place"), "v")

    def cells(self) -> DataFrame:
        """Every index tuple of the shape."""
        spark = self.df.sparkSession
        places = scalars.coordinates(F.col("id"), self.shape)
        return spark.range(prod(self.shape)).select(*(p.alias(c) for p, c in zip(places, self.index, strict=True)))

    def densify(self) -> DataFrame:
        """Every cell of the shape with its value, 0 where absent."""
        return self.get_many(self.cells())

    def canonical(self) -> Tensor:
        """Repeated cells summed by the tensor's semiring, zeros dropped."""
        if not self.ndim:
            return self.with_df(self.df.agg(F.coalesce(self.arithmetic.total(F.col("v")), self.arithmetic.lit(0)).alias("v")))
        return self.with_df(self.df.groupBy(*self.index).agg(self.arithmetic.total(F.col("v")).alias("v")).filter("v <> 0"))

    # other layouts

    def to_csr(self) -> DataFrame:
        """Per compound row (all indices but the last): its place, sorted columns and values."""
        last = self.index[-1]
        place = scalars.linear_index([F.col(c) for c in self.index[:-1]], self.shape[:-1])
        cells = F.array_sort(F.collect_list(F.struct(last, "v")))
        return self.df.filter("v <> 0").groupBy(place.alias("row")).agg(cells.alias("x")).select("row", F.col(f"x.{last}").alias("col_idx"), F.col("x.v").alias("values"))

    def to_numpy(self):
        """A dense array on the driver; for tests and small results."""
        import numpy as np

        out = np.zeros(self.shape, dtype=float if self.kind in ("float", "double") else object)
        for r in self.df.collect():
            out[tuple(r[c] for c in self.index)] = r.v
        return out

    def picture(self) -> DataFrame:
        """A matrix as text, one row per row of the matrix, ``.`` for absent cells."""
        if self.ndim != 2:
            raise ShapeError("a picture needs a matrix")
        line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(self.shape[1] - 1)), lambda k: F.coalesce(F.element_at("m", k.cast("bigint")), F.lit("."))), " ")
        held = self.df.groupBy("i0").agg(F.map_from_entries(F.collect_list(F.struct("i1", F.col("v").cast("string")))).alias("m"))
        rows = self.df.sparkSession.range(self.shape[0]).select(F.col("id").alias("i0"))
        return rows.join(held, "i0", "left").select("i0", F.coalesce(line, F.lit(" ".join("." * self.shape[1]))).alias("line"))


def schema(ndim: int, kind: T.DataType) -> T.StructType:
    return T.StructType([*(T.StructField(f"i{k}", T.LongType(), False) for k in range(ndim)), T.StructField("v", kind, False)])


def from_rows(spark: SparkSession, rows, shape: tuple[int, ...], kind: str = "bigint", semiring: Semiring | None = None) -> Tensor:
    """A tensor of (i0, .., v) tuples; repeated cells are summed, zeros dropped."""
    columns = ", ".join([*(f"i{k} bigint" for k in range(len(shape))), f"v {kind}"])
    return Tensor(spark.createDataFrame(list(rows), columns), shape, semiring, len(rows)).canonical()


def from_numpy(spark: SparkSession, array, kind: str | None = None) -> Tensor:
    """A tensor of an array's non-zero cells."""
    import numpy as np

    array = np.asarray(array)
    kind = kind or ("double" if array.dtype.kind == "f" else "bigint")
    cast = float if kind in ("double", "float") else int
    places = zip(*np.nonzero(array), strict=True) if array.ndim else [()] * bool(array)
    return from_rows(spark, [(*map(int, p), cast(array[p])) for p in places], array.shape, kind)
