"""Watchlists, cases, route series and the figures of the overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.functions.columns import finite_or
from corridorwatch.functions.ranking import running_totals, top_n_per_group
from corridorwatch.operators.risk import risk_level

TOP = 60
ORDER = ["score", "segment_id"]


def watchlist_projection(df: DataFrame) -> DataFrame:
    """Rounded scores, level, review state and defaults of the watchlist row."""
    score = finite_or("score_distilled_student")
    return df.select(
        "segment_id",
        F.date_format("bin5", "yyyy-MM-dd HH:mm:ss").alias("time"),
        "road_code",
        "direction_code",
        finite_or("stake").alias("stake_m"),
        F.bround(finite_or("stake") / 1000.0, 3).alias("stake_km"),
        F.bround(score, 6).alias("score"),
        F.bround(finite_or("score_stage1_risk"), 6).alias("stage1_score"),
        F.bround(finite_or("calibrated_probability_distilled_student"), 6).alias("calibrated_probability"),
        risk_level(score).alias("risk_level"),
        "candidate_source",
        F.when(score >= 0.6, V.STATE_PENDING).otherwise(V.STATE_WATCH).alias("review_status"),
        finite_or("lead_time_min", -1.0).alias("lead_time_min"),
        F.coalesce("target_event_id", F.lit("")).alias("target_event_id"),
    )


def watchlist_topk(rows: DataFrame, n: int = TOP) -> DataFrame:
    """The n highest scores of every snapshot time."""
    return top_n_per_group(rows, ["time"], [F.col("score").desc(), F.col("segment_id")], n, ["segment_id"])


def watchlist_at(rows: DataFrame, time: str, n: int = TOP) -> DataFrame:
    """The n highest scores of one snapshot."""
    return rows.where(F.col("time") == time).orderBy(F.col("score").desc(), "segment_id").limit(n)


def watchlist_filter(
    rows: DataFrame, road: str = "all", direction: str = "all", level: str = "all", query: str = ""
) -> DataFrame:
    """Road, direction, level and a case-insensitive search in "segment road km"."""
    if road != "all":
        rows = rows.where(F.col("road_code") == road)
    if direction != "all":
        rows = rows.where(F.col("direction_code").cast("string") == direction)
    if level != "all":
        rows = rows.where(F.col("risk_level") == level)
    needle = query.strip().lower()
    if needle:
        text = F.concat_ws(" ", "segment_id", "road_code", F.format_string("%.3f", "stake_km"))
        rows = rows.where(F.contains(F.lower(text), F.lit(needle)))
    return rows


def best_replay_row(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per event the detected positive row of the highest score, then longest lead.

    An aggregate with one row per event as its state.
    """
    score = F.col("score_distilled_student")
    hits = df.where((F.col("target_event_30m") == 1) & (score >= threshold))
    rest = [c for c in df.columns if c != "target_event_id"]
    order = F.struct(-score, -F.col("lead_time_min"), F.col("bin5"), F.col("segment_id"))
    best = F.min_by(F.struct(*rest), order).alias("r")
    return hits.groupBy("target_event_id").agg(best).select("target_event_id", *[f"r.{c}" for c in rest])


def best_replay_case(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The single best row over all events."""
    rows = best_replay_row(df, threshold)
    return rows.orderBy(F.col("score_distilled_student").desc(), F.col("lead_time_min").desc(), "bin5", "segment_id").limit(1)


def event_lookup(rows: DataFrame, events: DataFrame) -> DataFrame:
    """The accident each row is labelled with."""
    found = events.select(
        F.col("accident_id").cast("string").alias("target_event_id"),
        F.col("bin5").alias("event_time"),
        F.col("direction_code").alias("event_direction"),
        F.col("segment_id").alias("event_segment"),
    )
    return rows.join(found, "target_event_id")


def case_lookup(cases: DataFrame, event_id: str | None = None) -> DataFrame:
    """The case of an event, or the default case (highest score)."""
    if event_id:
        return cases.where(F.col("event_id") == event_id)
    return cases.orderBy(F.col("supervisory_score").desc(), "event_id").limit(1)


def case_match(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Watchlist rows with the case of their event: hypothesis, traffic, actions."""
    known = cases.select(F.col("event_id").alias("target_event_id"), "type_hypothesis", "traffic_volume", "management_actions")
    # most rows have no event: they stay out of the join, whose key they would share
    has_event = F.coalesce(F.col("target_event_id") != "", F.lit(False))
    joined = rows.where(has_event).join(known, "target_event_id", "left").unionByName(rows.where(~has_event), allowMissingColumns=True)
    urgent = F.array(F.lit("VMS_WARNING"), F.lit("VERIFY"), F.lit("LOW_SPEED_WARNING"))
    default = F.when(F.col("score") >= 0.8, urgent).otherwise(F.slice(urgent, 1, 2))
    return joined.withColumns(
        {
            "matches_case": F.col("type_hypothesis").isNotNull(),
            "type_hypothesis": F.coalesce(F.concat("type_hypothesis", F.lit("（假设）")), F.lit(V.STATE_PENDING)),
            "action_codes": F.slice(F.coalesce(F.split("management_actions", ","), default), 1, 4),
            "score_delta": F.col("score") - F.col("stage1_score"),
        }
    ).drop("management_actions")


def top3_types(probabilities: Column, labels: Column) -> Column:
    """The three likeliest classes as (type, probability), ties by label."""
    pairs = F.arrays_zip(probabilities.alias("p"), labels.alias("l"))
    keyed = F.transform(pairs, lambda x: F.struct((-x["p"]).alias("o"), x["l"].alias("type"), x["p"].alias("probability")))
    return F.transform(
        F.slice(F.array_sort(keyed), 1, 3), lambda x: F.struct(x["type"].alias("type"), x["probability"].alias("probability"))
    )


def route_points(snapshot: DataFrame, keys: list[str], most: int | None = None, block_m: float = 100_000.0) -> DataFrame:
    """Corridor points in stake order: all, or with ``most`` every (n // most)th one where n > most.

    ``snapshot`` has (keys, road_code, direction_code, segment_id, stake_m,
    stage1_score). Positions are counted range by range of the stake.
    """
    corridor = [*keys, "road_code", "direction_code"]
    placed = running_totals(
        snapshot.withColumns({"__block": F.floor(F.col("stake_m") / block_m), "__one": F.lit(1)}),
        corridor,
        ["__block"],
        [F.col("stake_m"), F.col("segment_id")],
        {"__one": "position"},
    ).drop("__block", "__one")
    if most is not None:
        sizes = snapshot.groupBy(*corridor).agg(F.count(F.lit(1)).alias("n"))
        step = F.when(F.col("n") > most, F.greatest(F.lit(1), F.floor(F.col("n") / most))).otherwise(1)
        placed = placed.join(sizes, corridor).where((F.col("position") - 1) % step == 0)
    return placed.select(
        *corridor,
        "position",
        "segment_id",
        F.bround(F.col("stake_m") / 1000.0, 3).alias("stake_km"),
        F.bround("stage1_score", 5).alias("score"),
    )


def route_series(snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """One row per corridor with its ordered points."""
    points = route_points(snapshot, keys)
    item = F.struct("position", "segment_id", "stake_km", "score")
    return points.groupBy(*keys, "road_code", "direction_code").agg(F.array_sort(F.collect_list(item)).alias("points"))


def dashboard_kpis(watchlist: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates, high and alert rows per snapshot, and plotted points."""
    counts = watchlist.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(F.col("score") >= 0.8).alias("high_risk_count"),
        F.count_if(F.col("score") >= 0.6).alias("alert_count"),
    )
    shown = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("point_count"))
    return counts.join(shown, keys, "full").na.fill(0)


def model_metric_row(metrics: DataFrame, model: str = "distilled_student") -> DataFrame:
    return metrics.where(F.col("model") == model)


def successful_models(models: DataFrame) -> DataFrame:
    """Benchmark rows that returned cases, with finite numbers."""
    return models.where(F.coalesce("cases_returned", F.lit(0)) > 0).select(
        "model",
        finite_or("composite_score").alias("composite_score"),
        finite_or("mean_seconds_per_case").alias("seconds_per_case"),
        finite_or("schema_validity").alias("schema_validity"),
        finite_or("unsupported_action_rate").alias("unsupported_action_rate"),
        F.coalesce("parameter_size", F.lit("")).alias("parameter_size"),
    )


def benchmark_rank(models: DataFrame) -> DataFrame:
    return models.orderBy(F.col("composite_score").desc(), "model")


def history_long(histories: DataFrame) -> DataFrame:
    """(model, history: map<dataset, map<metric, array>>) to one row per value."""
    datasets = histories.select("model", F.explode("history").alias("dataset", "metrics"))
    metrics = datasets.select("model", "dataset", F.explode("metrics").alias("metric", "values"))
    return metrics.select("model", "dataset", "metric", F.posexplode("values").alias("i", "value")).select(
        "model", "dataset", "metric", (F.col("i") + 1).alias("iteration"), "value"
    )
