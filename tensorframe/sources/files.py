"""Text sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tensor import Tensor


def load_edges(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Edges of a text file, two integers a line, blank lines skipped; the number of nodes is the greatest id plus one."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter("trim(value) <> ''")
    edges = lines.select(words[0].cast("bigint").alias("src"), words[1].cast("bigint").alias("dst"))
    top = edges.agg(F.max(F.greatest("src", "dst")).alias("top")).first().top
    return (0 if top is None else top + 1), edges


def save_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst")).write.text(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def builder(cells: DataFrame, shape: tuple[int, ...]) -> Tensor:
    """A sink for cells that may hold zeros: they are skipped."""
    return Tensor(cells.filter("v <> 0"), shape)


def csv_lines(spark: SparkSession, path: str, first_field: str) -> DataFrame:
    """Lines (line) of mixed text that belong to a table: the header, which starts with ``first_field`` and a comma, and lines whose first field is an integer."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.filter(F.col("line").startswith(first_field + ",") | F.col("line").rlike(r"^[0-9]+,"))
