"""Static search indexes: many sorted lists, each with separator levels above its data.

A list of n values has a level for every FANOUT-fold reduction: the lowest level holds the first value of every run of
FANOUT values, the next the first value of every run of FANOUT of those, up to a single node; nodes are filled up with
nulls. Columns list, data (sorted), internal (levels from the top down) and data_start (values of all lists before it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tensor import Tensor
from .constructors import ranked

FANOUT, LEVELS = 16, 12


def _separators(data: Column) -> Column:
    """The levels above sorted data, top first."""
    runs = lambda x: F.ceil(F.size(x) / FANOUT).cast("int")
    firsts = lambda x: F.transform(F.sequence(F.lit(0), runs(x) - 1), lambda k: F.get(x, k * FANOUT))
    filled = lambda x: F.concat(x, F.array_repeat(F.lit(None).cast("bigint"), runs(x) * FANOUT - F.size(x)))

    def above(state: Column, _) -> Column:
        level = firsts(state["level"])
        more = F.size(state["level"]) > FANOUT
        return F.struct(F.when(more, F.concat(filled(level), state["internal"])).otherwise(state["internal"]).alias("internal"), F.when(more, level).otherwise(state["level"]).alias("level"))

    start = F.struct(F.array().cast("array<bigint>").alias("internal"), data.alias("level"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, above)["internal"]


def build(values: DataFrame) -> DataFrame:
    """Index of the distinct values (x) of each list (list): list, data, internal, data_start."""
    held = values.select(F.col("list").cast("bigint").alias("list"), F.col("x").cast("bigint").alias("x")).distinct()
    lists = held.groupBy("list").agg(F.sort_array(F.collect_list("x")).alias("data"))  # a list is one value, as in the compressed rows of a tensor
    placed = ranked(lists, "list")
    sized = placed.select("list", "data", "rank", F.size("data").cast("bigint").alias("n"))
    # running totals: within stretches of ranks, after the totals of the stretches before
    stretch = F.floor(F.col("rank") / 4096).cast("bigint")
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row per 4096 lists
    totals = sized.groupBy(stretch.alias("stretch")).agg(F.sum("n").alias("total")).select("stretch", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("stretch").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    found = sized.withColumn("stretch", stretch).join(totals, "stretch")
    start = (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).cast("bigint")
    return found.select("list", "data", _separators(F.col("data")).alias("internal"), start.alias("data_start"))


def of_rows(t: Tensor) -> DataFrame:
    """Index of the columns of every row of a matrix."""
    return build(t.df.select(F.col("i0").alias("list"), F.col("i1").alias("x")))


def accessors(index: DataFrame) -> DataFrame:
    """list, len, internal_len, data_start, is_empty of each list."""
    return index.select("list", F.size("data").cast("bigint").alias("len"), F.size("internal").cast("bigint").alias("internal_len"), "data_start", (F.size("data") == 0).alias("is_empty"))


def find(index: DataFrame, queries: DataFrame) -> DataFrame:
    """list, q, found, place: where each query stands, or would, among its list's data; walks down the levels, a node at a time."""
    both = queries.join(index, "list")
    node = lambda level, size, from_, q: F.size(F.filter(F.slice(level, from_ + 1, size), lambda x: x <= q))
    # every level narrows the search to one run of FANOUT values
    heights = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.struct(F.size("data").alias("n"), F.array().cast("array<int>").alias("sizes")), lambda s, _: F.when(s["n"] > FANOUT, F.struct(F.ceil(s["n"] / FANOUT).cast("int").alias("n"), F.concat(F.array(F.ceil(s["n"] / FANOUT).cast("int")), s["sizes"]).alias("sizes"))).otherwise(s))["sizes"]
    both = both.withColumn("sizes", heights)

    def down(state: Column, size: Column) -> Column:
        width = (F.ceil(size / FANOUT) * FANOUT).cast("int")
        level = F.slice(F.col("internal"), state["at"] + 1, width)
        child = state["run"] * FANOUT + F.greatest(node(level, F.lit(FANOUT), state["run"] * FANOUT, F.col("q")) - 1, F.lit(0))
        return F.struct((state["at"] + width).cast("int").alias("at"), child.cast("int").alias("run"))

    run = F.aggregate("sizes", F.struct(F.lit(0).alias("at"), F.lit(0).alias("run")), down)["run"]
    leaf = F.slice("data", F.col("run") * FANOUT + 1, F.lit(FANOUT))
    below = (F.col("run") * FANOUT + F.size(F.filter(leaf, lambda x: x < F.col("q")))).cast("bigint")
    out = both.withColumn("run", run)
    return out.select("list", "q", F.exists(leaf, lambda x: x == F.col("q")).alias("found"), below.alias("place"))
