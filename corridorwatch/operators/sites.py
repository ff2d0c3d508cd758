"""Site windows: candidates aggregated to 10 minutes by 500 metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch.config import DispatchConfig
from corridorwatch.functions.ranking import running_ids
from corridorwatch.functions.rows import with_row

DEFAULT = DispatchConfig()
KEYS = ["decision_window", "road_code", "direction_code", "spatial_zone"]
BLOCK_M = 100_000


def candidate_min_score(df: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    best = F.greatest("score_stage1_risk", "score_distilled_student")
    return df.where(best >= config.candidate_score_minimum)


def site_keys(df: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    """Floor the time to the update window and the stake to the zone."""
    zone = F.floor(F.col("stake") / config.zone_m) * config.zone_m
    return df.withColumns(
        {
            "decision_window": F.window("bin5", f"{config.window_minutes} minutes").start,
            "spatial_zone": zone.cast("int"),
        }
    )


def real_event_id(c: Column) -> Column:
    """The id, or NULL for missing, blank and ``0``."""
    return F.when(~F.trim(c).isin("", "0"), c)


def aggregate_sites(df: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    """One row per site window; rows without a complete key are dropped."""
    keyed = site_keys(candidate_min_score(df, config), config).dropna(subset=KEYS)
    return keyed.groupBy(*KEYS).agg(
        F.count_distinct("segment_id").alias("segment_count"),
        F.min_by("segment_id", F.struct("bin5", "stake", "segment_id")).alias("representative_segment"),
        F.avg("stake").alias("stake_m"),
        F.max("score_stage1_risk").alias("stage1_score"),
        F.max("score_distilled_student").alias("student_score"),
        F.max("target_event_30m").alias("actual_positive"),
        F.array_sort(F.collect_set(real_event_id(F.col("target_event_id")))).alias("event_ids"),
        F.max("lead_time_min").alias("maximum_lead_time_min"),
    )


def add_site_ids(sites: DataFrame) -> DataFrame:
    """``SITE_000001`` ... in key order, numbered range by range."""
    block = F.floor(F.col("spatial_zone") / BLOCK_M).alias("block")
    stretch = F.struct("road_code", "direction_code", block)
    numbered = running_ids(
        sites.withColumn("__stretch", stretch), ["decision_window", "__stretch"], [F.col("spatial_zone")], "__id"
    )
    # Zero padded to six digits; longer numbers keep all their digits.
    text = F.col("__id").cast("string")
    padded = F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)
    return numbered.withColumn("site_id", F.concat(F.lit("SITE_"), padded)).drop("__stretch", "__id")


def add_robust_probability(sites: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    shifted = F.col("calibrated_probability") - config.robust_radius
    return sites.withColumn("robust_probability", F.least(F.greatest(shifted, F.lit(0.0)), F.lit(1.0)))


def event_id_text(sites: DataFrame) -> DataFrame:
    """The event ids of a site as sorted text."""
    return sites.withColumn("event_ids_text", F.array_join("event_ids", "|"))


def site_events(sites: DataFrame) -> DataFrame:
    """(site_id, event_id), one row per event of a site."""
    return sites.select("site_id", F.explode("event_ids").alias("event_id"))


def calibration_summary(sites: DataFrame) -> DataFrame:
    y = F.col("actual_positive")
    return sites.agg(
        F.count(F.lit(1)).alias("site_count"),
        F.sum(y).alias("positive_sites"),
        F.avg(y).alias("positive_rate"),
        F.avg("student_score").alias("raw_score_mean"),
        F.avg("calibrated_probability").alias("calibrated_probability_mean"),
        F.avg((F.col("student_score") - y) ** 2).alias("raw_brier"),
        F.avg((F.col("calibrated_probability") - y) ** 2).alias("calibrated_brier"),
    )


def optimization_summary(sites: DataFrame) -> DataFrame:
    events = sites.where("actual_positive = 1").select(F.explode("event_ids").alias("event_id"))
    totals = sites.agg(
        F.count(F.lit(1)).alias("watchlist_site_count"),
        F.count_distinct("decision_window").alias("decision_window_count"),
    )
    return with_row(totals, events.agg(F.count_distinct("event_id").alias("formal_event_count")))
