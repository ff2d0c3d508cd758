"""Directed spatial, temporal and calendar context of the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.functions.columns import clip, cyclic, minute_of_day, to_double
from corridorwatch.functions.positional import positional_window

REACH = 5
CORRIDOR = ["road_code", "direction_code"]


def add_travel_stake(df: DataFrame) -> DataFrame:
    """Position along the direction of travel; direction 0 runs against the stakes."""
    return df.withColumn(
        "travel_stake", F.when(F.col("direction_code") == 1, F.col("stake")).otherwise(-F.col("stake"))
    )


def _spatial_columns(w: WindowSpec) -> dict:
    risk = F.col(V.RISK)
    up, down, around = w.rowsBetween(-3, -1), w.rowsBetween(1, 3), w.rowsBetween(-REACH, REACH)
    cells = {f"upstream_risk_{100 * k}m": F.lag(risk, k).over(w) for k in range(1, REACH + 1)}
    cells |= {f"downstream_risk_{100 * k}m": F.lead(risk, k).over(w) for k in range(1, REACH + 1)}
    return cells | {
        "upstream_mean_300m": F.avg(risk).over(up),
        "upstream_max_300m": F.max(risk).over(up),
        "downstream_mean_300m": F.avg(risk).over(down),
        "downstream_max_300m": F.max(risk).over(down),
        "neighborhood_mean_500m": F.avg(risk).over(around),
        "neighborhood_max_500m": F.max(risk).over(around),
        "neighborhood_std_500m": F.coalesce(F.stddev_samp(risk).over(around), F.lit(0.0)),
        "high_risk_cells_500m": F.count_if(risk >= 0.6).over(around).cast("int"),
    }


def add_spatial_features(df: DataFrame, chunk_m: float = 1_000_000.0) -> DataFrame:
    """Risk of the cells ahead and behind at the same time, by position in the corridor."""
    df = add_travel_stake(df)
    df = positional_window(
        df,
        group=["bin5", *CORRIDOR],
        order=["travel_stake", "segment_id"],
        chunk=F.floor(F.col("travel_stake") / chunk_m),
        reach=REACH,
        build=_spatial_columns,
    )
    up, down = F.col("upstream_mean_300m"), F.col("downstream_mean_300m")
    sides = F.when(up.isNull(), down).when(down.isNull(), up).otherwise((up + down) / 2.0)
    coherence = 1.0 - F.col("neighborhood_std_500m") / (F.abs("neighborhood_mean_500m") + 1e-6)
    return df.withColumns(
        {
            "spatial_gradient_600m": down - up,
            "center_neighbor_contrast": F.col(V.RISK) - sides,
            "spatial_coherence_500m": clip(coherence, -2.0, 1.0),
        }
    )


def add_temporal_features(df: DataFrame, day: str | None = None) -> DataFrame:
    """Lags and the last six rows of the same segment on the same day.

    ``day`` names a column with the date of ``bin5``; a table in ranges of that column and the
    segment needs no further shuffle.
    """
    risk = F.col(V.RISK)
    w = Window.partitionBy(F.to_date("bin5") if day is None else F.col(day), "segment_id").orderBy("bin5")
    past = w.rowsBetween(-5, 0)
    enough = F.count(risk).over(past) >= 2
    df = df.withColumns(
        {f"risk_lag_{5 * k}m": F.lag(risk, k).over(w) for k in (1, 2, 4, 6)}
        | {
            "risk_mean_past_30m": F.when(enough, F.avg(risk).over(past)),
            "risk_max_past_30m": F.when(enough, F.max(risk).over(past)),
            "risk_std_past_30m": F.coalesce(F.stddev_samp(risk).over(past), F.lit(0.0)),
        }
    )
    lag5, lag10 = F.col("risk_lag_5m"), F.col("risk_lag_10m")
    return df.withColumns(
        {
            "risk_change_5m": risk - lag5,
            "risk_change_30m": risk - F.col("risk_lag_30m"),
            "risk_acceleration": (risk - lag5) - (lag5 - lag10),
        }
    )


def add_context_features(df: DataFrame) -> DataFrame:
    """Time of day, weekday (Monday = 0), road flag and scaled position."""
    hour_sin, hour_cos = cyclic(minute_of_day("bin5"), 1440.0)
    weekday_sin, weekday_cos = cyclic(F.weekday("bin5"), 7.0)
    return df.withColumns(
        {
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "weekday_sin": weekday_sin,
            "weekday_cos": weekday_cos,
            "road_is_s5": (F.upper("road_code") == "S5").cast("int"),
            "stake_scaled": to_double("stake") / 100_000.0,
        }
    )


def feature_sets(columns: list[str]) -> dict[str, list[str]]:
    """Ordered, distinct feature lists per model, as far as the table has them."""
    lists = {
        "temporal_only": V.COMPONENTS + V.TEMPORAL + V.CONTEXT,
        "spatial_only": V.COMPONENTS + V.SPATIAL + V.CONTEXT,
        "no_spatial": V.COMPONENTS + V.TEMPORAL + V.CONTEXT,
        "no_temporal": V.COMPONENTS + V.SPATIAL + V.CONTEXT,
        "full_teacher": V.COMPONENTS + V.TEMPORAL + V.SPATIAL + V.CONTEXT,
        "student": V.STUDENT,
        "student_no_spatial": V.COMPONENTS + V.TEMPORAL + V.CONTEXT,
        "student_no_temporal": V.COMPONENTS + V.SPATIAL_SUMMARY + V.CONTEXT,
    }
    have = set(columns)
    return {name: [f for f in dict.fromkeys(items) if f in have] for name, items in lists.items()}
