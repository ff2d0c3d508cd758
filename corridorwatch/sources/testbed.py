"""Maps the generic test tables to road-risk tables of the same schema.

Time is folded (five source days make one panel day, six source hours one
5-minute bin) so that neighbouring cells and accidents meet; see FIXTURES.md.
Stand-in scores are rounded so that ties and thresholds are the same in every
engine.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.config import BuildConfig
from corridorwatch.functions.columns import clip, logit
from corridorwatch.operators import cleaning

SPLITS = BuildConfig(
    train_end="2025-08-31 23:59:59",
    validation_end="2025-09-01 23:59:59",
    test_end="2025-09-03 23:59:59",
)
SMALL_SAMPLE = replace(SPLITS, hard_per_day=50, uncertain_per_day=20, random_per_day=20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows with the folded time and the number in their JSON property."""
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    minutes = 5 * ((day % 5) * 4 + F.floor(F.hour("ts") / 6))
    start = F.date_add(F.lit("2025-08-29").cast("date"), F.floor(day / 5).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.timestamp_add("MINUTE", minutes.cast("int"), start.cast("timestamp_ntz")).alias("bin5"),
    )


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed panel before cleaning: risk is not clipped, event ids may be invalid."""
    risk = F.col("value") / 150.0
    event = (F.col("event_type") == "error") & (F.col("k") % 10 == 0)
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("segment_id"),
        "bin5",
        F.when(F.col("event_id") % 17 == 0, "2025-07").otherwise(F.date_format("bin5", "yyyy-MM")).alias("source_month"),
        (F.floor(F.col("user_id") / 2) % 2).cast("int").alias("direction_code"),
        F.when(F.col("user_id") % 2 == 0, "G9411").otherwise("S5").alias("road_code"),
        F.when(F.floor(F.col("user_id") / 2) % 2 == 1, "上行").otherwise("下行").alias("road_direction"),
        (F.floor(F.col("user_id") / 4) * 100.0).alias("stake"),
        event.cast("int").alias("accident_label"),
        (1 + F.col("k") % 3).cast("int").alias("accident_level"),
        F.when(F.col("k") == 0, "0").otherwise(F.concat(F.lit("E"), F.col("event_id").cast("string"))).alias("accident_id"),
        (risk * 0.9).alias("current_risk_probability"),
        (risk * 0.8).alias("collision_risk_value"),
        (risk * 1.1).alias("v4_main_dynamic_probability"),
        (risk * 0.5).alias("v4_static_collision_probability"),
        (risk * 0.7).alias("v4_main_adaptive_dynamic_weight"),
        risk.alias(V.RISK),
        F.col("event_id").alias("source_row"),
    )


def panel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw panel as text with some malformed cells, for the ingestion operators."""
    k = F.col("source_row") % 50
    df = raw_panel(spark, sf_dir)
    text = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    return text.withColumns(
        {
            V.RISK: F.when(k == 3, "n/a").when(k == 7, "NaN").when(k == 11, "").otherwise(F.col(V.RISK)),
            "stake": F.when(k == 13, "abc").otherwise(F.col("stake")),
            "bin5": F.when(k == 17, "2025/08/29").when(k == 19, "").otherwise(F.col("bin5")),
            "accident_level": F.when(k == 23, "none").otherwise(F.col("accident_level")),
        }
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_panel(raw_panel(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.panel_dedup(cleaning.in_month(clean(spark, sf_dir)))



def with_scores(df: DataFrame) -> DataFrame:
    """Deterministic stand-in scores on a featured panel."""
    student = (
        0.6 * F.col(V.RISK)
        + 0.24 * F.coalesce("risk_mean_past_30m", F.lit(0.0))
        + 0.16 * F.col("neighborhood_max_500m")
    )
    df = df.withColumns(
        {
            "score_stage1_risk": F.round(V.RISK, 6),
            "score_distilled_student": F.round(clip(student, 0.0, 1.0), 6),
        }
    )
    return df.withColumn(
        "calibrated_probability_distilled_student", stand_in_probability(F.col("score_distilled_student"))
    )


def stand_in_probability(score):
    return F.round(1.0 / (1.0 + F.exp(3.0 - 1.2 * logit(score))), 6)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accident registry from the error events."""
    k, eid = F.col("k"), F.col("event_id")
    types = F.array(*[F.lit(t) for t in ("碰撞", "追尾", "刮擦", "翻车", "失火", "其他")])
    guess = (k + (eid % 3 == 0).cast("int")) % 6
    return events(spark, sf_dir).where("event_type = 'error'").select(
        eid.alias("registry_id"),
        F.col("bin5").alias("occurred_at"),
        (F.floor(F.col("user_id") / 2) % 2).cast("int").alias("direction_code"),
        F.col("user_id").cast("string").alias("segment_id"),
        (F.floor(F.col("user_id") / 4) / 10.0).alias("stake_km"),
        F.element_at(types, (k % 6 + 1).cast("int")).alias("accident_type"),
        F.element_at(types, (guess + 1).cast("int")).alias("predicted_type"),
        F.when(k < 95, V.SEVERITY_MINOR).when(k < 99, V.SEVERITY_GENERAL).otherwise(V.SEVERITY_MAJOR).alias("severity"),
        F.when(k % 4 == 0, "Clear").when(k % 4 == 1, "小雨").when(k % 4 == 2, "大雾").alias("weather"),
        (1000.0 + 10.0 * F.col("value")).alias("traffic"),
        (20.0 + k).alias("median_speed"),
        F.col("value").alias("upstream_traffic"),
        k.cast("double").alias("downstream_traffic"),
        F.when(k % 25 == 0, V.KEY_VEHICLE).alias("key_vehicle"),
        (k % 50 == 1).cast("int").alias("serious_injured"),
        (k == 99).cast("int").alias("deaths"),
    )


def audit_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator entries from conversation turns; every fifth action is invalid."""
    actions = F.array(*[F.lit(a) for a in (*V.AUDIT_ACTIONS, "无效")])
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("AUD"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"),
        F.date_format(F.timestamp_add("MINUTE", (F.col("conv_id") * 10 + F.col("turn")).cast("int"), F.lit("2025-09-01").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.when(F.col("turn") > 0, F.concat(F.lit("  "), F.col("role"))).alias("operator"),
        F.element_at(actions, (F.col("turn") % 5 + 1).cast("int")).alias("action"),
        F.concat(F.lit(" conv "), F.col("conv_id").cast("string")).alias("target"),
        F.col("text").alias("note"),
        F.when(F.col("turn") % 2 == 0, F.col("role")).alias("source"),
    )
