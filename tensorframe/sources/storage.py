"""Tables written to storage that driver and executors share: lineage stays short and lost executors cost little.

Everything is written below one folder of the application, which goes when the application
ends; ``discard`` removes a table as soon as nothing reads it any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_home: dict[str, str] = {}


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path object of ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset a temporary folder is used in local mode (one machine);
    on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tensorframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    found = found if "://" in found or found.startswith("file:") else "file://" + found
    home = f"{found.rstrip('/')}/tensorframe-{spark.sparkContext.applicationId}"
    if home not in _home:
        fs, at = _files(spark, home)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _home[home] = home
    return home


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(spark: SparkSession) -> int:
    """Files for a table that is small beside the input."""
    return max(4, partitions(spark) // 6)


def written(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def written_small(df: DataFrame, name: str = "table") -> DataFrame:
    """written() for the result of a shuffle that is small: in few files."""
    return written(df.coalesce(few(df.sparkSession)), name)


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Written tables of one schema read as one."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*(t._written_to for t in tables))


def files_of(table: DataFrame) -> list[str]:
    """The committed files of a written table, in order of their names: a file never changes, so a row is known by file and place."""
    spark = table.sparkSession
    fs, at = _files(spark, table._written_to)
    found = (s.getPath().toString() for s in fs.listStatus(at))
    return sorted(p for p in found if p.endswith(".parquet"))


def bytes_of(table: DataFrame) -> int:
    """Bytes that a written table takes on storage."""
    fs, at = _files(table.sparkSession, table._written_to)
    return fs.getContentSummary(at).getLength()


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Removes written tables, or folders of this application, that nothing reads any more."""
    for t in tables:
        fs, at = _files(spark, t if isinstance(t, str) else t._written_to)
        fs.delete(at, True)
