"""Reports over benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def break_even(points: DataFrame, threshold: str = "threshold") -> DataFrame:
    """run, density: where the linear interpolation of time between neighbouring densities first reaches the run's threshold."""
    w = Window.partitionBy("run").orderBy("density")
    pairs = points.select("run", "density", "time", F.col(threshold).alias("t"), F.lead("density").over(w).alias("d1"), F.lead("time").over(w).alias("t1"))
    hit = pairs.filter((F.col("time") <= F.col("t")) & (F.col("t") <= F.col("t1")))
    at = F.col("density") + (F.col("t") - F.col("time")) / (F.col("t1") - F.col("time")) * (F.col("d1") - F.col("density"))
    return hit.groupBy("run").agg(F.min_by(F.when(F.col("t1") > F.col("time"), at).otherwise(F.col("density")), "density").alias("density"))


def grid(df: DataFrame, row: str, column: str, value: Column, columns: list) -> DataFrame:
    """One row per ``row``, one column per given value of ``column``."""
    return df.groupBy(row).pivot(column, columns).agg(value)


def best_speedup(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the greatest of the given columns and its name."""
    best = F.greatest(*columns)
    name = F.coalesce(*(F.when(F.col(c) == best, F.lit(c)) for c in columns))
    return df.withColumn("best", best).withColumn("best_name", name)


def markdown(df: DataFrame, bold: str = "best_name") -> str:
    """A table as Markdown (for small reports), the best column of each row in bold."""
    names = [c for c in df.columns if c not in ("best", bold)]
    rows = [f"| {' | '.join(names)} |", f"|{'---|' * len(names)}"]
    for r in df.collect():
        rows.append("| " + " | ".join(f"**{r[c]}**" if bold in df.columns and r[bold] == c else str(r[c]) for c in names) + " |")
    return "\n".join(rows)


def index_overhead(n: Column, fanout: int = 16, levels: int = 12) -> Column:
    """Internal entries of a static search tree over n sorted entries, by levels of nodes of ``fanout`` keys."""
    def level(state, _):
        more = state["nodes"] > 1
        above = F.ceil(state["nodes"] / fanout).cast("bigint")
        return F.struct((state["total"] + F.when(more, above * fanout).otherwise(0)).alias("total"), F.when(more, above).otherwise(state["nodes"]).alias("nodes"))

    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.ceil(n / fanout).cast("bigint").alias("nodes"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, level)["total"]


def overhead_percent(n: Column, fanout: int = 16, levels: int = 12) -> Column:
    """Internal entries per hundred data entries."""
    return F.when(n > 0, 100.0 * index_overhead(n, fanout, levels) / n)
