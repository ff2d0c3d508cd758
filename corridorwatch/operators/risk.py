"""Scoring request tables: defaults, range checks, levels, evidence, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.functions.columns import clip, to_double
from corridorwatch.functions.rows import with_row


def risk_level(score: Column, high: float = 0.8, mid: float = 0.6) -> Column:
    return F.when(score >= high, V.LEVEL_HIGH).when(score >= mid, V.LEVEL_MID).otherwise(V.LEVEL_LOW)


def display_band(score: Column) -> Column:
    """Map colour band: the dashboard adds a band from 0.35."""
    return F.when(score >= 0.8, "high").when(score >= 0.6, "mid").when(score >= 0.35, "elevated").otherwise("low")


def default_features(featured: DataFrame, segment_id: str, time: str) -> DataFrame:
    """The student inputs of one row, used as defaults of requests."""
    at = (F.col("segment_id") == segment_id) & (F.col("bin5") == F.lit(time).cast("timestamp_ntz"))
    return featured.where(at).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in V.STUDENT])


def normalize_features(payload: DataFrame, defaults: DataFrame) -> DataFrame:
    """Payload over defaults, and the names of the features outside their range.

    ``defaults`` is a single row of the student inputs; none or several stop the job.
    """
    base = defaults.agg(F.count("*").alias("__defaults"), *[F.first(c).alias(f"__d_{c}") for c in V.STUDENT])
    df = with_row(payload, base)
    values = {
        c: F.coalesce(to_double(c) if c in payload.columns else F.lit(None).cast("double"), F.col(f"__d_{c}"))
        for c in V.STUDENT
    }
    df = df.withColumns(values).drop(*[f"__d_{c}" for c in V.STUDENT])
    checks = [
        F.when(F.col(c).isNull() | ~F.col(c).between(low, high), F.lit(c))
        for (low, high), names in V.FEATURE_RANGES.items()
        for c in names
    ]
    wrong = F.raise_error(F.concat(F.lit("default features: expected one row, found "), F.col("__defaults")))
    violations = F.when(F.col("__defaults") == 1, F.array_compact(F.array(*checks))).otherwise(wrong)
    return df.withColumn("violations", violations).drop("__defaults")


def evidence_items() -> Column:
    """Evidence by absolute value, largest first, equal values in listed order, missing ones last."""
    items = F.array(
        *[
            F.struct(
                F.col(c).isNull().alias("missing"),
                (-F.abs(F.col(c))).alias("o"),
                F.lit(i).alias("i"),
                F.lit(key).alias("key"),
                F.col(c).alias("value"),
                F.lit(note).alias("note"),
            )
            for i, (key, c, note) in enumerate(V.EVIDENCE_ITEMS)
        ]
    )
    return F.transform(F.array_sort(items), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), x["note"].alias("note")))


def degradation_flags() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("risk_mean_past_30m") == 0, V.FLAG_NO_TEMPORAL),
            F.when(F.col("neighborhood_max_500m") == 0, V.FLAG_NO_SPATIAL),
        )
    )


def risk_evaluate(
    requests: DataFrame, score: str, threshold: float = 0.6, probability: str | None = None, defaults: DataFrame | None = None
) -> DataFrame:
    """Alert, level, evidence and degradation flags of every scored request row.

    With ``defaults`` (one row of the student inputs) requests are normalised first:
    what they leave open is filled, and rows with a feature outside its range get the
    names as ``violations`` and no judgement. ``probability`` names the calibrated probability, if there is one.
    """
    rows = requests.withColumn("violations", F.array().cast("array<string>")) if defaults is None else normalize_features(requests, defaults)
    valid = F.size("violations") == 0
    value = clip(F.col(score), 0.0, 1.0)
    judged = {
        "score": value,
        "calibrated_probability": F.lit(None).cast("double") if probability is None else F.col(probability),
        "threshold": F.lit(threshold),
        "alert": value >= threshold,
        "risk_level": risk_level(value, mid=threshold),
        "features": F.struct(*[F.col(c).cast("double").alias(c) for c in V.STUDENT]),
        "evidence": evidence_items(),
        "degradation_flags": degradation_flags(),
        "semantics": F.lit(V.SCORE_SEMANTICS),
    }
    return rows.withColumns({name: F.when(valid, c) for name, c in judged.items()})
