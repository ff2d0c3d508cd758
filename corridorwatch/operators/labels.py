"""Accident events and the range join that labels panel rows with them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridorwatch.config import BuildConfig
from corridorwatch.functions.columns import minute_of_day, minutes_between

DEFAULT = BuildConfig()


def accident_events(panel: DataFrame, per: str | None = "day") -> DataFrame:
    """First row of every accident: per day, per month or over all time."""
    periods = {"day": F.to_date("bin5"), "month": F.date_trunc("MONTH", "bin5").cast("date")}
    keys = ["accident_id"] + ([] if per is None else ["period"])
    df = panel.where("accident_label > 0")
    df = df if per is None else df.withColumn("period", periods[per])
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("bin5", "segment_id")).alias("r")
    return df.groupBy(*keys).agg(first).select("accident_id", *[f"r.{c}" for c in rest])


def _buckets(config: BuildConfig) -> dict[str, Column]:
    return {
        "__day": F.to_date("bin5"),
        "__cell": F.floor(F.col("stake") / config.radius_m).cast("long"),
        "__slot": F.floor(minute_of_day("bin5") / config.horizon_minutes).cast("int"),
    }


def event_points(panel: DataFrame, config: BuildConfig = DEFAULT) -> DataFrame:
    """Per bucket of (corridor, day, radius, horizon): the event points around it.

    Events at the same place and time differ in their id only and the smallest
    id wins ties, so one per point is enough. On the 100 m and 5 min grid a
    bucket sees at most 9 * 3 * 6 points, however many events or rows it holds.
    """
    point = ["road_code", "direction_code", "stake", "bin5"]
    points = (
        accident_events(panel)
        .groupBy(*point)
        .agg(F.min(F.struct("accident_id", "accident_level")).alias("e"))
        .withColumns(_buckets(config))
    )
    near = F.array(*[F.struct(F.lit(i).alias("dc"), F.lit(j).alias("ds")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return (
        points.withColumn("n", F.explode(near))
        .groupBy(
            "road_code",
            "direction_code",
            "__day",
            (F.col("__cell") + F.col("n.dc")).alias("__cell"),
            (F.col("__slot") + F.col("n.ds")).alias("__slot"),
        )
        .agg(
            F.collect_list(
                F.struct(
                    F.col("bin5").alias("at"),
                    F.col("stake").alias("place"),
                    F.col("e.accident_id").alias("id"),
                    F.col("e.accident_level").alias("level"),
                )
            ).alias("__points")
        )
    )


def label_future_events(
    panel: DataFrame, config: BuildConfig = DEFAULT, points: DataFrame | None = None
) -> DataFrame:
    """Nearest accident in (t, t + horizon] within the radius, and the guard flag.

    Same road, direction and calendar day. Every panel row has exactly one
    bucket, so the join neither multiplies rows nor needs a second pass over
    the panel, and a hot bucket can be split freely. ``points`` is the written
    result of ``event_points`` with the same settings: Spark then knows its size
    and broadcasts it below the threshold, or else shuffles both sides.
    """
    keys = ["road_code", "direction_code", "__day", "__cell", "__slot"]
    rows = panel.withColumns(_buckets(config))
    joined = rows.join(event_points(panel, config) if points is None else points, keys, "left")
    horizon = float(config.horizon_minutes)

    def lead(p: Column) -> Column:
        return minutes_between(F.col("bin5"), p["at"])

    close = F.filter(
        F.coalesce(F.col("__points"), F.array().cast("array<struct<at:timestamp_ntz,place:double,id:string,level:int>>")),
        lambda p: (F.abs(p["place"] - F.col("stake")) <= config.radius_m) & (F.abs(lead(p)) <= horizon),
    )
    future = F.filter(F.col("__close"), lambda p: lead(p) > 0)
    nearest = F.array_min(
        F.transform(future, lambda p: F.struct(lead(p).alias("lead"), p["id"].alias("id"), p["level"].alias("level")))
    )
    hit = F.col("__hit").isNotNull()
    return (
        joined.withColumn("__close", close)
        .withColumn("__hit", nearest)
        .withColumns(
            {
                "target_event_30m": hit.cast("int"),
                "target_event_id": F.when(hit, F.col("__hit.id")).otherwise(""),
                "target_event_level": F.when(hit, F.col("__hit.level")).otherwise(0),
                "lead_time_min": F.col("__hit.lead"),
                "event_guard": (F.size("__close") > 0).cast("int"),
            }
        )
        .drop("__day", "__cell", "__slot", "__points", "__close", "__hit")
    )


def nearest_context(
    queries: DataFrame,
    registry: DataFrame,
    direction: str = "nearest",
    slot_minutes: int = 24 * 60,
) -> DataFrame:
    """As-of join: per query row the registry row of its direction closest in time.

    ``queries`` has (query_id, at, direction_code), ``registry`` (registry_id, at,
    direction_code, ...). ``nearest`` looks both ways, ``backward`` only into the
    past. Rows of both sides are ordered inside (direction, time slot); what lies
    beyond a slot comes from the carried edge rows of the other slots, so no
    window holds a whole direction. Ties go to the earlier, then smaller id.
    """
    other = [c for c in registry.columns if c != "direction_code"]
    slot = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at")) / (60 * slot_minutes))
    context = registry.select("direction_code", F.col("at"), F.struct("at", "registry_id", *[c for c in other if c not in ("at", "registry_id")]).alias("ctx"))
    # One row per (direction, time) is enough: the smallest id represents a time.
    context = context.groupBy("direction_code", "at").agg(F.min_by("ctx", F.col("ctx.registry_id")).alias("ctx"))
    context = context.withColumn("slot", slot)
    edges = context.groupBy("direction_code", "slot").agg(
        F.max_by("ctx", "at").alias("last"), F.min_by("ctx", "at").alias("first")
    )
    # Equal questions are answered once.
    asked = queries.select("direction_code", "at").distinct().withColumn("slot", slot)
    # Edge table: one row per direction and slot (a day by default), queries' slots included.
    slots = edges.unionByName(asked.select("direction_code", "slot").distinct(), allowMissingColumns=True)
    slots = slots.groupBy("direction_code", "slot").agg(
        F.first("last", ignorenulls=True).alias("last"), F.first("first", ignorenulls=True).alias("first")
    )
    by_slot = Window.partitionBy("direction_code").orderBy("slot")
    slots = slots.select(
        "direction_code",
        "slot",
        F.last("last", ignorenulls=True).over(by_slot.rowsBetween(Window.unboundedPreceding, -1)).alias("carry_past"),
        F.first("first", ignorenulls=True).over(by_slot.rowsBetween(1, Window.unboundedFollowing)).alias("carry_next"),
    )
    both = context.unionByName(asked, allowMissingColumns=True)
    # At equal times the registry row comes first, so a query sees it as its past.
    in_slot = Window.partitionBy("direction_code", "slot").orderBy("at", F.col("ctx").isNull())
    placed = both.withColumns(
        {
            "past": F.last("ctx", ignorenulls=True).over(in_slot.rowsBetween(Window.unboundedPreceding, 0)),
            "next": F.first("ctx", ignorenulls=True).over(in_slot.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).where(F.col("ctx").isNull())
    placed = placed.join(slots, ["direction_code", "slot"], "left").withColumns(
        {
            "past": F.coalesce("past", "carry_past"),
            "next": F.coalesce("next", "carry_next"),
        }
    )
    gap_past = minutes_between(F.col("past.at"), F.col("at"))
    gap_next = minutes_between(F.col("at"), F.col("next.at"))
    use_next = F.lit(False) if direction == "backward" else (
        F.col("past").isNull() | (F.coalesce(gap_next, F.lit(math.inf)) < gap_past)
    )
    picked = F.when(use_next, F.col("next")).otherwise(F.col("past"))
    answers = (
        placed.withColumn("picked", picked)
        .select("direction_code", "at", F.col("picked.at").alias("context_at"), *[F.col(f"picked.{c}").alias(c) for c in other if c != "at"])
        .withColumn("time_distance_min", F.abs(minutes_between(F.col("at"), F.col("context_at"))))
    )
    return queries.join(answers, ["direction_code", "at"], "left")
