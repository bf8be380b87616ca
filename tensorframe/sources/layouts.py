"""Layouts: how a DataFrame holds a tensor's cells. A layout is a function to cells (i0 .., v); new ones are registered by name.

Built in: ``cells`` (one row per cell), ``rows`` (compressed rows: row, col_idx, values), ``dense`` (one array in
row-major order, column a) and ``tiles`` (N x N tiles: o0 .., br, bc, block).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semiring import Semiring
from ..tensor import Tensor
from . import constructors

Layout = Callable[[DataFrame, tuple[int, ...]], DataFrame]
_known: dict[str, Layout] = {}


def register(name: str, layout: Layout) -> None:
    """Makes a layout known, or replaces it."""
    _known[name] = layout


def names() -> list[str]:
    return sorted(_known)


def tensor(df: DataFrame, layout: str, shape: tuple[int, ...], semiring: Semiring | None = None) -> Tensor:
    """The tensor that ``df`` holds; repeated cells are summed, zeros dropped."""
    if layout not in _known:
        raise KeyError(f"no layout {layout!r}; known: {', '.join(names())}")
    return constructors.from_coo(_known[layout](df, shape), shape, semiring)


def _tiles(df: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    k = len(shape) - 2
    cells = df.select(*(F.col(f"o{j}").alias(f"i{j}") for j in range(k)), "br", "bc", F.size("block").alias("size"), F.posexplode("block").alias("at", "v"))
    side = F.round(F.sqrt("size")).cast("bigint")
    row, column = F.col("br") * side + F.expr("at div cast(round(sqrt(size)) as bigint)"), F.col("bc") * side + F.col("at") % side
    return cells.select(*(f"i{j}" for j in range(k)), row.cast("bigint").alias(f"i{k}"), column.cast("bigint").alias(f"i{k + 1}"), "v").filter("v <> 0")


register("cells", lambda df, shape: df.select(*(F.col(f"i{k}").cast("bigint").alias(f"i{k}") for k in range(len(shape))), "v"))
register("rows", lambda df, shape: constructors.from_parts(df, shape).df)
register("dense", lambda df, shape: constructors.filled(df, shape).df)
register("tiles", _tiles)
