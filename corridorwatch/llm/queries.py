"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corridorwatch.llm import chat, chunks, filters, language, lexical, mixing, neardup, neighbours, packing, pages, quality, secrets, substrings
from corridorwatch.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op4_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(documents(spark, sf_dir))


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).drop("spans")


def op9_small_world_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_line_rules": op2_line_rules,
    "op3_chunk_dedup": op3_chunk_dedup,
    "op4_sequence_packing": op4_sequence_packing,
    "op5_repeated_substrings": op5_repeated_substrings,
    "op6_chat_format": chat.op6_chat_format,
    "op7_secret_scan": op7_secret_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_small_world_search": op9_small_world_search,
    "op10_source_mix": op10_source_mix,
    "op11_main_text": op11_main_text,
    "op12_ranked_search": op12_ranked_search,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE: dict[str, str] = {
    "op2_line_rules": quality.SQL,
    "op6_chat_format": chat.SQL,
    "op12_ranked_search": lexical.SQL,
    "op13_filter_audit": filters.SQL,
}
