"""Evaluation of scores against labels.

Inputs are long tables with ``keys`` (for example the model name), a 0/1 label
``y`` and a ``score``. All metrics come from counts per distinct score, so equal
scores are one step, and the running counts are prefixed by score range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridorwatch.functions.columns import clip
from corridorwatch.functions.ranking import running_totals
from corridorwatch.functions.rows import with_row

COARSE, FINE = 2**15, 2**30


def long_scores(df: DataFrame, scores: dict[str, str], keep: list[str]) -> DataFrame:
    """Wide score columns (column -> model name) to (keep, model, score)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for c, m in scores.items()])
    return df.select(*keep, F.explode(pairs).alias("s")).select(*keep, "s.model", "s.score")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def threshold_metrics(df: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """Precision, recall, F1 (0 when undefined), Brier, alert rate and counts."""
    score = clip(F.col("score"), 0.0, 1.0)
    alert, hit = score >= threshold, F.col("y") == 1
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("y").alias("positive_rows"),
        F.count_if(alert & hit).alias("true_positive_count"),
        F.count_if(alert & ~hit).alias("false_positive_count"),
        F.avg((score - F.col("y")) ** 2).alias("brier"),
        F.avg(alert.cast("double")).alias("alert_rate"),
    )
    tp, fp, pos = F.col("true_positive_count"), F.col("false_positive_count"), F.col("positive_rows")
    return counts.withColumns(
        {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, pos), "f1": _ratio(2 * tp, tp + fp + pos)}
    )


def score_counts(df: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Positives and negatives per distinct score (reduced before the shuffle)."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*keys, clip(F.col("score"), 0.0, 1.0).alias("score")).agg(
        F.sum(w * F.col("y")).alias("pos"), F.sum(w * (1 - F.col("y"))).alias("neg")
    )


def running_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """True and false positives at every distinct score, from the highest down."""
    ranged = counts.withColumns(
        {
            "__coarse": F.floor(F.col("score") * COARSE),
            "__fine": F.floor(F.col("score") * FINE),
        }
    )
    return running_totals(
        ranged, keys, ["__coarse", "__fine"], [F.col("score").desc()], {"pos": "tp", "neg": "fp"}, descending=True
    ).drop("__coarse", "__fine")


def areas_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Tie-aware ROC area and average precision (step sum) from counts per score."""
    steps = running_counts(counts.where("pos + neg > 0"), keys)
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    sums = steps.groupBy(*(keys or [F.lit(0).alias("__all")])).agg(
        F.sum(pos).alias("p"),
        F.sum(neg).alias("q"),
        F.sum(neg * (tp - pos / 2.0)).alias("area"),
        F.sum(F.when(pos > 0, pos * tp / (tp + fp)).otherwise(0.0)).alias("steps"),
    )
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return sums.select(
        *keys,
        F.when(both, F.col("area") / (F.col("p") * F.col("q"))).alias("roc_auc"),
        F.when(both, F.col("steps") / F.col("p")).alias("pr_auc"),
    )


def areas(df: DataFrame, keys: list[str]) -> DataFrame:
    return areas_from_counts(score_counts(df, keys), keys)


def binary_metrics(df: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """Threshold metrics and both areas per key; areas are NULL for one class."""
    return threshold_metrics(df, keys, threshold).join(areas(df, keys), keys)


def brier(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((clip(F.col("score"), 0.0, 1.0) - F.col("y")) ** 2).alias("brier"))


def threshold_grid(minimum: float = 0.6, maximum: float = 0.95, steps: int = 71) -> list[float]:
    return [round(minimum + (maximum - minimum) * i / (steps - 1), 3) for i in range(steps)]


def threshold_curve(df: DataFrame, keys: list[str], minimum: float = 0.6) -> DataFrame:
    """F1 at every threshold of the grid, in one pass over the scores.

    A score counts for all thresholds up to the highest one it reaches, so
    counts per step and a running sum over the grid (71 rows) are enough.
    """
    grid = threshold_grid(minimum)
    values = F.array(*[F.lit(v) for v in grid])
    step = (grid[-1] - grid[0]) / (len(grid) - 1)
    score = F.col("score")
    # Arithmetic guess of the step, corrected by exact comparison with the grid.
    guess = F.least(F.greatest(F.floor((score - grid[0]) / step), F.lit(-1)), F.lit(len(grid) - 1)).cast("int")
    above = F.coalesce(F.get(values, guess + 1) <= score, F.lit(False))
    reached = F.coalesce(F.get(values, guess) <= score, F.lit(False))
    index = F.when(above, guess + 1).when(reached | (guess < 0), guess).otherwise(guess - 1)
    counted = (
        df.select(*keys, "y", index.alias("step"))
        .groupBy(*keys, "step")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    )
    per_key = counted.groupBy(*(keys or [F.lit(0).alias("__all")])).agg(
        F.sum("pos").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("step", F.struct("pos", "neg")))).alias("m"),
    )
    points = per_key.select(*keys, "total", "m", F.posexplode(values).alias("step", "threshold"))

    def reach(name: str) -> Column:
        steps = F.filter(F.map_entries("m"), lambda x: x["key"] >= F.col("step"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x["value"][name])

    tp, fp = F.col("tp"), F.col("fp")
    return points.withColumns({"tp": reach("pos"), "fp": reach("neg")}).select(
        *keys, "threshold", "tp", "fp", _ratio(2 * tp, tp + fp + F.col("total")).alias("f1")
    )


def choose_threshold(df: DataFrame, keys: list[str], minimum: float = 0.6) -> DataFrame:
    """Threshold of the best F1, the lowest one on ties."""
    best = F.min_by(F.struct("threshold", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b")
    return threshold_curve(df, keys, minimum).groupBy(*(keys or [F.lit(0).alias("__all")])).agg(best).select(*keys, "b.*")


def fixed_threshold(model: Column) -> Column:
    """Models that alert at the fixed threshold; the others tune it on validation."""
    return (model == "stage1_risk") | model.startswith("distilled_student") | model.startswith("student_")


def event_level_metrics(df: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """Share of events with a positive row above the threshold, and their lead time.

    ``df`` has (keys, y, score, event_id, lead_time_min).
    """
    alert = F.col("score") >= threshold
    events = (
        df.where("y = 1")
        .groupBy(*keys, "event_id")
        .agg(F.max("score").alias("peak"), F.max(F.when(alert, F.col("lead_time_min"))).alias("lead"), F.max(alert).alias("found"))
    )
    found = F.col("found")
    result = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(found).alias("detected_event_count"),
        F.percentile(F.when(found, F.col("lead")), F.lit(0.5)).alias("median_lead_time_min"),
        F.avg(F.when(found, F.col("lead"))).alias("mean_lead_time_min"),
    )
    return result.withColumn("event_recall", F.col("detected_event_count") / F.greatest("event_count", F.lit(1)))


def detected_event_rows(df: DataFrame, threshold: float) -> DataFrame:
    """Positive rows over the threshold; their events are the detected ones."""
    positives = df.where("y = 1")
    detected = positives.groupBy("event_id").agg(F.max("score").alias("peak")).where(F.col("peak") >= threshold)
    return positives.where(F.col("score") >= threshold).join(detected.select("event_id"), "event_id", "left_semi")


def false_alarm_reduction(metrics: DataFrame, baseline: str = "stage1_risk") -> DataFrame:
    """Fewer false positives than the baseline model, as a share of the baseline's."""
    base = metrics.where(F.col("model") == baseline).agg(F.max("false_positive_count").alias("__base"))
    saved = (F.col("__base") - F.col("false_positive_count")) / F.greatest(F.col("__base"), F.lit(1))
    return with_row(metrics, base).withColumn("false_alarm_reduction_vs_stage1", saved).drop("__base")


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, positives, events and time range per split."""
    event = F.when(F.col("target_event_30m") == 1, F.col("target_event_id"))
    return df.where("split IS NOT NULL").groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("target_event_30m").alias("positive_rows"),
        F.avg("target_event_30m").alias("positive_rate"),
        F.count_distinct(event).alias("event_count"),
        F.min("bin5").alias("date_min"),
        F.max("bin5").alias("date_max"),
    )


# --- day bootstrap ------------------------------------------------------------------


def day_draws(days: DataFrame, iterations: int, seed: int) -> DataFrame:
    """How often every iteration drew every day, with replacement.

    ``days`` has (date) rows; a draw is a hash of (seed, iteration, position), so
    the same draws appear in every engine. Sizes: days of the test period (a few
    hundred) times iterations.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    numbered = days.withColumn("day", F.row_number().over(w) - 1)
    total = numbered.agg(F.count(F.lit(1)).alias("n"))
    slots = with_row(numbered.select(F.col("day").alias("draw")), total)
    draws = slots.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("iteration").cast("string"), F.col("draw").cast("string"))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    drawn = draws.select("iteration", (number % F.col("n")).cast("int").alias("day"))
    weights = drawn.groupBy("iteration", "day").agg(F.count(F.lit(1)).alias("weight"))
    return weights.join(numbered, "day").select("iteration", "date", "weight")


def positive_steps(daily: DataFrame) -> DataFrame:
    """Counts per day and *step*: one step per distinct score of a positive.

    Both areas change only where positives are, so all negatives between two such
    scores may be added up per day. ``tie`` are the negatives at the step's own
    score, ``above`` those between it and the next higher step. The last step has
    no positives and holds the negatives below all of them.
    """
    scores = daily.groupBy("score").agg((F.sum("pos") > 0).cast("long").alias("marked"))
    ranged = scores.withColumns(
        {"__coarse": F.floor(F.col("score") * COARSE), "__fine": F.floor(F.col("score") * FINE)}
    )
    stepped = running_totals(
        ranged, [], ["__coarse", "__fine"], [F.col("score").desc()], {"marked": "seen"}, descending=True
    ).select("score", "marked", (F.col("seen") + 1 - F.col("marked")).alias("step"))
    at_step = F.col("marked") == 1
    return (
        daily.join(stepped, "score")
        .groupBy("date", "step")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum(F.when(at_step, F.col("neg")).otherwise(0)).alias("tie"),
            F.sum(F.when(at_step, 0).otherwise(F.col("neg"))).alias("above"),
        )
    )


#: Steps that one row of arrays holds.
STEPS_PER_RANGE = 64


def draw_weights(days: DataFrame, iterations: int, seed: int) -> DataFrame:
    """One row: ``dates`` in order, and per date an array with its weight in every iteration."""
    drawn = day_draws(days, iterations, seed).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("iteration", "weight"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(iterations - 1))
    weights = F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    rows = days.join(drawn, "date", "left").select(F.struct("date", weights.alias("w")).alias("r"))
    ordered = rows.agg(F.array_sort(F.collect_list("r")).alias("r"))
    return ordered.select(F.transform("r", lambda r: r["date"]).alias("dates"), F.transform("r", lambda r: r["w"]).alias("weights"))


def _weighted_ranges(daily: DataFrame, weights: DataFrame, iterations: int) -> DataFrame:
    """(range, steps): the steps of a range in order, each with arrays ``pos``, ``tie`` and ``neg`` over the iterations."""
    every = F.sequence(F.lit(0), F.lit(iterations - 1))
    counted = positive_steps(daily).withColumn("neg", F.col("tie") + F.col("above"))
    cells = counted.groupBy("step").agg(F.collect_list(F.struct("date", "pos", "tie", "neg")).alias("cells"))
    placed = with_row(cells, weights).withColumn(
        "cells", F.transform("cells", lambda c: F.struct(F.array_position("dates", c["date"]).cast("int").alias("d"), c["pos"].alias("pos"), c["tie"].alias("tie"), c["neg"].alias("neg")))
    )

    def total(name: str) -> Column:
        zero = F.lit(0).cast("long")
        return F.transform(every, lambda i: F.aggregate("cells", zero, lambda s, c: s + c[name] * F.get(F.element_at("weights", c["d"]), i)))

    step = F.struct("step", *[total(n).alias(n) for n in ("pos", "tie", "neg")])
    ranged = placed.select(F.floor(F.col("step") / STEPS_PER_RANGE).alias("range"), step.alias("s"))
    return ranged.groupBy("range").agg(F.array_sort(F.collect_list("s")).alias("steps"))


def bootstrap_samples(df: DataFrame, threshold: float, iterations: int, seed: int) -> DataFrame:
    """PR area, ROC area and F1 of every resample of whole days; one-class draws drop out.

    ``df`` has (date, y, score). Rows are first reduced to counts per day and
    score, then to the steps of the positives. The draws are one weight array per day (days of the
    test period times iterations), so a step's sums over all resamples are arrays too: what
    is shuffled are ranges of steps, and one number per range and resample, never rows per draw.
    """
    daily = score_counts(df, ["date"])
    weights = draw_weights(df.select("date").distinct(), iterations, seed)
    every, zero = F.sequence(F.lit(0), F.lit(iterations - 1)), F.lit(0).cast("long")
    ranges = _weighted_ranges(daily, weights, iterations)

    def total(name: str) -> Column:
        return F.transform(every, lambda i: F.aggregate("steps", zero, lambda s, x: s + F.get(x[name], i))).alias(name)

    totals = ranges.select("range", total("pos"), total("neg")).select("range", F.posexplode(F.arrays_zip("pos", "neg")).alias("iteration", "t"))
    earlier = Window.partitionBy("iteration").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range", "iteration", *[F.coalesce(F.sum(f"t.{n}").over(earlier), F.lit(0)).alias(n) for n in ("pos", "neg")])
    starts = starts.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("iteration", "pos", "neg"))).alias("starts"))

    def walk(i: Column) -> Column:
        at = F.get("starts", i)
        begin = F.struct(at["pos"].alias("tp"), at["neg"].alias("fp"), zero.alias("p"), zero.alias("q"), F.lit(0.0).alias("lost"), F.lit(0.0).alias("steps"))

        def step(s: Column, x: Column) -> Column:
            pos, tie, neg = (F.get(x[n], i) for n in ("pos", "tie", "neg"))
            tp, fp = s["tp"] + pos, s["fp"] + neg
            gained = F.when(pos > 0, pos * tp / (tp + fp)).otherwise(F.lit(0.0))
            return F.struct(
                tp.alias("tp"), fp.alias("fp"), (s["p"] + pos).alias("p"), (s["q"] + neg).alias("q"),
                (s["lost"] + pos * (fp - tie / 2.0)).alias("lost"), (s["steps"] + gained).alias("steps"),
            )

        return F.aggregate("steps", begin, step)

    walked = ranges.join(starts, "range").select(F.posexplode(F.transform(every, walk)).alias("iteration", "s"))
    areas = walked.groupBy("iteration").agg(*[F.sum(f"s.{n}").alias(n) for n in ("p", "q", "lost", "steps")])
    alert = F.col("score") >= threshold
    marks = daily.groupBy("date").agg(
        F.sum("pos").alias("p"),
        F.sum(F.when(alert, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(alert, F.col("neg")).otherwise(0)).alias("fp"),
    )
    by_date = weights.select(F.inline(F.arrays_zip("dates", "weights"))).select(F.col("dates").alias("date"), F.posexplode("weights").alias("iteration", "weight"))
    drawn = marks.join(by_date, "date").groupBy("iteration").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("p", "tp", "fp")])
    f1 = _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p"))
    return (
        areas.where("p > 0 AND q > 0")
        .select(
            "iteration",
            (1.0 - F.col("lost") / (F.col("p") * F.col("q"))).alias("roc_auc"),
            (F.col("steps") / F.col("p")).alias("pr_auc"),
        )
        .join(drawn.select("iteration", f1.alias("f1")), "iteration")
    )


def bootstrap_ci(df: DataFrame, threshold: float = 0.6, iterations: int = 200, seed: int = 20260730) -> DataFrame:
    """2.5 and 97.5 percent quantiles (linear) of the resampled metrics."""
    samples = bootstrap_samples(df, threshold, iterations, seed)
    names = ("pr_auc", "roc_auc", "f1")
    metric = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names]))
    return (
        samples.select(metric.alias("m"))
        .groupBy("m.metric")
        .agg(
            F.percentile("m.v", F.lit(0.025)).alias("low"),
            F.percentile("m.v", F.lit(0.975)).alias("high"),
            F.count(F.lit(1)).alias("samples"),
        )
    )
