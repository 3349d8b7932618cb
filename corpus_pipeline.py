"""A training corpus from raw documents: five stages, each by one operator.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next one's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, mixing, secrets, simhash
from tidemark.session import keep_table

#: The language model is trained and passages are random, so SQL cannot express the rows.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language stays in doubt."""
    return language.keep_identified(docs, language.fit_dictionaries(docs.filter(~language.held_out())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: five-word shingles, similarity 0.8, by
    SimHash links that are checked on the sets and a prefix join for similar sets that they leave apart."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays."""
    cleaned = secrets.redact_secrets(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix_sources(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify),
    ("simhash", drop_near_copies),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("mix", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
