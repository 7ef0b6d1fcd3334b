"""The corpus pipeline: clean, deduplicate, mix and pack ``documents``.

Each stage takes what its predecessor kept and returns it with the columns of ``documents``; the
last one returns the pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import jaccard, lines, mixing, packing, toxicity
from sheaf.llm.common import read
from sheaf.session import BATCH_BYTES, BATCH_KEY, written


def modest(spark: SparkSession) -> None:
    """For the whole job, few texts go to a Python worker at a time: a batch is held in it and in its executor."""
    spark.conf.set(BATCH_KEY, BATCH_BYTES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression does not reject; fitted on the labelled ones among them."""
    modest(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.rate(docs, model).where("not toxic").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many documents share; n_chars follows the text. Null texts stay null."""
    modest(spark)
    kept = lines.dedup_lines(docs)
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return kept.select(*columns, text.alias("text"), n_chars.alias("n_chars")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the smallest id."""
    modest(spark)
    return jaccard.one_of_each_group(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources reach their target weights."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, one row per piece of each copy of a document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Trained, hashed and tokenized stages are beyond SQL; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
