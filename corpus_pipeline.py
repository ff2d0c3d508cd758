"""From raw documents to packed training sequences, in five stages.

Each stage gets what the one before has written; all but the last return the columns of
``documents``. Stages take any table with those columns: extra columns go along (except
where a stage's result is not documents), nulls and empty tables are handled as the
operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corridorwatch.llm import language, mixing, neardup, packing, secrets
from corridorwatch.session import new_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; the model learns from the labelled rows of ``docs``.

    Where no row is labelled there is no language to tell apart, and only texts without a letter go.
    """
    return language.recognised(docs, language.fit_language(docs, ~language.held_out()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies one row stays, that with the smallest id; rows without a word all stay."""
    return neardup.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows."""
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: The model fit, the dual and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
