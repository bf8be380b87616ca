"""A training-data pipeline over ``documents``: quality, near copies, repeated passages, personal data, packing.

Each stage works on all rows its predecessor kept; run() writes its result as
Parquet to the shared folder and the next stage reads that. All stages but the last
return the columns of ``documents``; extra columns are carried along. Each stage says what becomes of null
doc_ids, null and empty texts and repeated rows. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorframe.llm import near_dedup, packing, pii, quality_gam, substring
from tensorframe.llm.common import written
from tensorframe.llm.queries import vocabulary


def _measured(docs: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, n_chars brought up to date."""
    if "n_chars" in names:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*names)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on the labelled ones) accepts.

    Every row is scored by its own text, so repeated rows fare alike; null and empty texts have the score of a
    text without features, and a row's doc_id, null or not, plays no part.
    """
    model = quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_gam.score(docs, model)
    return scored.filter(scored[scored.columns[-1]] >= 0.5).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: of least (doc_id, hash of the text); of repeated rows of it, the first as JSON.

    Rows that share a doc_id but not their text are documents of their own. Null, empty and blank texts
    are no copies of others; rows of one doc_id that are equal in this count as repeated. Rows with a
    null doc_id all stay.
    """
    h, n = _free("h", docs.columns), _free("n", docs.columns)
    found = near_dedup.near_duplicates(docs).filter("kept and doc_id is not null")
    stay = written(found.groupBy("doc_id", F.col("text_hash").alias(h)).agg(F.count(F.lit(1)).alias(n)), "stay")
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    once = keyed.join(stay.filter(F.col(n) == 1), ["doc_id", h], "left_semi").select(*docs.columns)
    row = F.struct(*docs.columns)
    more = keyed.join(stay.filter(F.col(n) > 1), ["doc_id", h], "left_semi").groupBy("doc_id", h).agg(F.min_by(row, F.to_json(row)).alias(n)).select(f"{n}.*")
    return once.unionByName(more).unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of passages that occur earlier; documents of which nothing is left go.

    Of equal passages the one of the least doc_id stays, then of the earlier row of the written table; null doc_ids
    come last. Texts that lose nothing, null and empty ones among them, stay as they are, to the byte.
    """
    found = substring.drop_repeats(docs)
    n_words, n_removed, kept = found.columns[-3:]
    found = found.filter(~((F.col(n_removed) > 0) & (F.col(n_removed) == F.col(n_words))))
    text = F.when(F.col(n_removed) > 0, F.decode(kept, "UTF-8")).otherwise(F.col("text"))
    return _measured(found.withColumn("text", text), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, row by row; null texts stay null, no row goes."""
    return _measured(pii.mask(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens: null and empty texts are an end token, repeated rows are packed one by one, null doc_ids are kept."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, keep_codes=False)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", pack),
]

#: SQL cannot express the first stage; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
