"""Ingestion rules of the risk panel: types, bounds, invalid events, grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.functions.columns import clip, coerce_numeric, coerce_timestamp
from corridorwatch.functions.ranking import carried_lag

def typed_panel(text: DataFrame) -> DataFrame:
    """Text cells to typed columns; bad numbers are NULL, bad times drop the row."""
    df = coerce_timestamp(coerce_numeric(text, V.PANEL_NUMERIC), "bin5")
    integers = ["direction_code", "accident_label", "accident_level"]
    return df.withColumns({c: F.col(c).cast("int") for c in integers}).withColumn(
        "source_row", F.col("source_row").try_cast("long")
    )


def invalid_event() -> Column:
    """A labelled row whose accident id is no real id."""
    label = F.coalesce(F.col("accident_label"), F.lit(0))
    normal = F.lower(F.trim(F.coalesce(F.col("accident_id"), F.lit(""))))
    return (label > 0) & normal.isin(V.INVALID_EVENT_IDS)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=V.PANEL_REQUIRED)


def demote_invalid_events(df: DataFrame) -> DataFrame:
    bad = invalid_event()
    level = F.coalesce(F.col("accident_level"), F.lit(0))
    label = F.coalesce(F.col("accident_label"), F.lit(0))
    return df.withColumns(
        {
            "accident_level": F.when(bad, 0).otherwise(level).cast("int"),
            "accident_label": F.when(bad, 0).otherwise(label).cast("int"),
            "accident_id": F.coalesce(F.col("accident_id"), F.lit("")),
        }
    )


def clean_panel(df: DataFrame) -> DataFrame:
    """Complete rows, risk in [0, 1], integer codes, only valid events labelled."""
    df = demote_invalid_events(drop_incomplete(df))
    return df.withColumns(
        {V.RISK: clip(F.col(V.RISK), 0.0, 1.0), "direction_code": F.col("direction_code").cast("int")}
    )


def off_month() -> Column:
    """The row's time lies outside the month its file is named after."""
    return F.date_format("bin5", "yyyy-MM") != F.col("source_month")


def in_month(df: DataFrame) -> DataFrame:
    """Without the rows whose time lies outside their file's month; rows that name no month stay."""
    return df.where(~F.coalesce(off_month(), F.lit(False)))


def off_month_split(df: DataFrame) -> DataFrame:
    """Rows per source month: kept and excluded."""
    return df.groupBy("source_month").agg(
        F.count_if(~off_month()).alias("kept_rows"), F.count_if(off_month()).alias("off_month_rows")
    )


def panel_dedup(df: DataFrame, tie_breakers: tuple[str, ...] = ("source_row",)) -> DataFrame:
    """One row per (segment, bin): the highest risk, ties by the largest tie breakers.

    An aggregate, not a window: copies of one key are reduced before the shuffle.
    """
    keys = ["segment_id", "bin5"]
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(V.RISK, *tie_breakers)).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def grain_duplicates(df: DataFrame) -> DataFrame:
    """Surplus rows per (segment, bin), counted."""
    per_key = df.groupBy("segment_id", "bin5").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicated_keys"),
    )


#: Ingest chunks whose order one task looks at.
CHUNKS_PER_RANGE = 1024


def out_of_order_chunks(df: DataFrame, chunk: Column, keys: list[str] | None = None) -> DataFrame:
    """Ingest chunks whose first time is before the previous chunk's last time, per ``keys``.

    ``chunk`` is a number that rises in reading order; ranges of it are looked at apart.
    """
    keys = keys or []
    spans = df.groupBy(*keys, chunk.alias("chunk_id")).agg(
        F.min("bin5").alias("chunk_min"), F.max("bin5").alias("chunk_max"), F.count(F.lit(1)).alias("chunk_rows")
    )
    ordered = carried_lag(spans, keys, F.floor(F.col("chunk_id") / CHUNKS_PER_RANGE), ["chunk_id"], "chunk_max", "__previous")
    return ordered.withColumn("out_of_order", F.coalesce(F.col("chunk_min") < F.col("__previous"), F.lit(False))).drop("__previous")
