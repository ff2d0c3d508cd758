"""Stratified candidate selection and the temporal split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.config import BuildConfig
from corridorwatch.functions.ranking import top_n_per_group

DEFAULT = BuildConfig()


def eligible_negative() -> Column:
    return (F.col("target_event_30m") == 0) & (F.col("event_guard") == 0) & (F.col("accident_label") == 0)


def candidate_source(config: BuildConfig = DEFAULT) -> Column:
    return (
        F.when(F.col("target_event_30m") == 1, "future_event")
        .when(F.col(V.RISK) >= config.hard_threshold, "hard_negative")
        .when(F.col(V.RISK) >= config.uncertain_threshold, "uncertain_negative")
        .otherwise("random_negative")
    )


def draw_key(config: BuildConfig) -> Column:
    """Pseudo-random order of a row inside its day, the same in every engine."""
    return F.md5(
        F.concat_ws("|", F.lit(str(config.seed)), F.col("segment_id"), F.date_format("bin5", "yyyy-MM-dd HH:mm:ss"))
    )


def stratified_sample(labelled: DataFrame, config: BuildConfig = DEFAULT) -> DataFrame:
    """All positives, and per day a fixed number of hard, uncertain and random negatives.

    The last draw of every day and class is found over the few columns it needs; only the rows up
    to it are then ranked at full width.
    """
    df = labelled.withColumn("candidate_source", candidate_source(config))
    positives = df.where("target_event_30m = 1")
    quota = {
        "hard_negative": config.hard_per_day,
        "uncertain_negative": config.uncertain_per_day,
        "random_negative": config.random_per_day,
    }
    negatives = df.where(eligible_negative()).withColumns({"__date": F.to_date("bin5"), "__draw": draw_key(config)})
    limit = F.element_at(F.create_map(*[F.lit(x) for p in quota.items() for x in p]), F.col("candidate_source"))
    keys = ["__date", "candidate_source"]

    def first(rows: DataFrame) -> DataFrame:
        order = [F.col("__draw"), F.col("segment_id")]
        return top_n_per_group(rows, keys, order, max(quota.values()), ["segment_id", "bin5"], rank="__rank").where(F.col("__rank") <= limit)

    draw = F.struct("__draw", "segment_id")
    last = first(negatives.select(*keys, "__draw", "segment_id", "bin5")).groupBy(*keys).agg(F.max(draw).alias("__last"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"l.{k}"))
    # One row per day and class.
    near = negatives.alias("n").join(F.broadcast(last.alias("l")), same).where(F.struct("n.__draw", "n.segment_id") <= F.col("l.__last")).select("n.*")
    drawn = first(near).drop("__date", "__draw", "__rank")
    return positives.unionByName(drawn)


def split_name(config: BuildConfig = DEFAULT, time: str = "bin5") -> Column:
    """train / validation / test by cut-offs, right-closed; later rows get NULL."""
    t = F.col(time)
    end = {n: F.lit(v).cast("timestamp_ntz") for n, v in (("train", config.train_end), ("validation", config.validation_end), ("test", config.test_end))}
    return (
        F.when(t <= end["train"], "train").when(t <= end["validation"], "validation").when(t <= end["test"], "test")
    )


def registry_split(config: BuildConfig = DEFAULT, time: str = "occurred_at") -> Column:
    """The registry's test part has no end."""
    return F.when(F.col(time).isNotNull(), F.coalesce(split_name(config, time), F.lit("test")))


def negative_sample(candidates: DataFrame, n: int | None = None, config: BuildConfig = DEFAULT) -> DataFrame:
    """The hard and uncertain negatives, or ``n`` of them drawn over the whole table."""
    pool = candidates.where(
        (F.col("target_event_30m") == 0) & F.col("candidate_source").isin("hard_negative", "uncertain_negative")
    )
    if n is None:
        return pool
    return pool.withColumn("__draw", draw_key(config)).orderBy("__draw", "segment_id").limit(n).drop("__draw")
