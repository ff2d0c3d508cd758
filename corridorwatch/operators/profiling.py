"""Counts that describe a build: per table, per month, per pipeline stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.functions.rows import with_row
from corridorwatch.operators.cleaning import invalid_event, off_month, out_of_order_chunks

NULL_RATE_COLUMNS = [V.RISK, "upstream_mean_300m", "downstream_mean_300m", "risk_lag_30m", "target_event_30m"]


def month_facts(candidates: DataFrame) -> DataFrame:
    """Counts per source month and segment: rows, positives, surplus rows of a grain, missing cells.

    Written once per month these are all that summaries of a month or of a year need: counts add up, and distinct
    segments are the keys themselves, so nothing is scanned again and no rows are multiplied.
    """
    nulls = [f"null_{c}" for c in NULL_RATE_COLUMNS]
    grain = candidates.groupBy("source_month", "segment_id", "bin5").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("target_event_30m").alias("positives"),
        *[F.count_if(F.col(c).isNull()).alias(n) for c, n in zip(NULL_RATE_COLUMNS, nulls)],
    )
    return grain.groupBy("source_month", "segment_id").agg(
        *[F.sum(c).alias(c) for c in ("rows", "positives", *nulls)], F.sum(F.col("rows") - 1).alias("duplicates")
    )


def month_events(candidates: DataFrame) -> DataFrame:
    """(source_month, event_id): the target events of a month, once each."""
    positives = candidates.where((F.col("target_event_30m") == 1) & F.col("target_event_id").isNotNull())
    return positives.select("source_month", F.col("target_event_id").alias("event_id")).distinct()


def panel_profile(facts: DataFrame, events: DataFrame) -> DataFrame:
    """Rows, positives, events, segments, duplicates and null rates in one row, from ``month_facts`` and ``month_events``."""
    rows = F.sum("rows")
    totals = facts.agg(
        rows.alias("candidate_rows"),
        F.sum("positives").alias("candidate_positive_rows"),
        (F.sum("positives") / rows).alias("candidate_positive_rate"),
        *[(F.sum(f"null_{c}") / rows).alias(f"null_rate_{c}") for c in NULL_RATE_COLUMNS],
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("candidate_grain_duplicates"),
    )
    counted = with_row(totals, facts.select("segment_id").distinct().agg(F.count(F.lit(1)).alias("segment_count")))
    return with_row(counted, events.select("event_id").distinct().agg(F.count(F.lit(1)).alias("target_event_count")))


def month_summary(raw: DataFrame, facts: DataFrame, events: DataFrame, chunk: Column) -> DataFrame:
    """Per source month: rows read, excluded and kept, days, duplicates, chunks out of order, candidates and events.

    ``chunk`` numbers the pieces of a month's file in reading order.
    """
    read = raw.groupBy("source_month").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(off_month()).alias("off_month_rows_excluded"),
        F.count_if(~off_month() & invalid_event()).alias("invalid_event_labels_excluded"),
        F.count_distinct(F.when(~off_month(), F.to_date("bin5"))).alias("processed_days"),
    )
    spans = out_of_order_chunks(raw, chunk, ["source_month"])
    disorder = spans.groupBy("source_month").agg(F.count_if("out_of_order").alias("monotonic_chunk_violations"))
    kept = facts.groupBy("source_month").agg(
        F.sum("rows").alias("candidate_rows"),
        F.sum("positives").alias("positive_candidate_rows"),
        F.count(F.lit(1)).alias("segment_count"),
        F.sum("duplicates").alias("grain_duplicate_rows_in_candidates"),
    )
    found = events.where(~off_month()).groupBy("source_month").agg(F.count_distinct("accident_id").alias("event_count"))
    joined = read
    for part in (disorder, kept, found):
        joined = joined.join(part, "source_month", "left")
    return joined.na.fill(0)


def funnel(stages: dict[str, DataFrame], scope: str) -> DataFrame:
    """Records per stage, share of the first stage and a bar width on a log scale."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("records")).select(
            F.lit(i).alias("position"), F.lit(name).alias("stage"), F.lit(scope).alias("scope"), "records"
        )
        for i, (name, df) in enumerate(stages.items())
    ]
    table = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("scope").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.log10(F.max("records").over(w) + 1.0)
    width = F.greatest(F.lit(1.0), F.log10(F.col("records") + 1.0) / top * 100.0)
    return table.withColumns(
        {
            "retained_fraction_vs_raw": F.col("records") / F.first("records").over(w),
            "bar_width": width,
        }
    )
