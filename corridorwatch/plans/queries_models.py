"""Queries: model fits (rows only) and streaming jobs."""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.functions.ranking import top_n_per_group
from corridorwatch.operators import boosting, costs, metrics, models, sites
from corridorwatch.plans import staging, training
from corridorwatch.plans.registry import query
from corridorwatch.session import new_path
from corridorwatch.sources import files, testbed
from corridorwatch.streaming import jobs

_STUDIES: dict[tuple[str, str], training.Study] = {}


def _study(spark, sf) -> training.Study:
    """All nine models on the staged candidates at their full rounds and depth, fitted once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STUDIES:
        _STUDIES[key] = training.train_study(staging.candidates(spark, sf), new_path(spark, "study"))
    return _STUDIES[key]


def _evaluated(spark, sf, name: str) -> DataFrame:
    """Metrics of one model on the validation and test candidates, at the alert threshold."""
    held = staging.candidates(spark, sf).where("split <> 'train'")
    scored = _study(spark, sf).fitted[name].score(held, "score")
    long = scored.select(F.lit(name).alias("model"), "split", F.col("target_event_30m").alias("y"), "score")
    return metrics.binary_metrics(long, ["model", "split"], F.lit(0.6))


@query("fit_teacher")
def fit_teacher(spark, sf):
    return _evaluated(spark, sf, "full_teacher")


@query("importance_rank")
def importance_rank(spark, sf):
    """Gain, splits and share of gain of every feature of the full teacher."""
    return boosting.tree_importance(_study(spark, sf).fitted["full_teacher"], spark)


@query("fit_student")
def fit_student(spark, sf):
    return _evaluated(spark, sf, "distilled_student")


@query("training_history")
def training_history(spark, sf):
    """Losses of all nine models after every leg, on the training and the validation rows."""
    df = staging.candidates(spark, sf)
    parts = {s: df.where(F.col("split") == s) for s in ("train", "validation")}
    curves = [boosting.leg_history(model, parts, "target_event_30m", name) for name, model in _study(spark, sf).fitted.items()]
    return reduce(DataFrame.unionByName, curves)


@query("score_models")
def score_models(spark, sf):
    """All nine models and the panel's own risk over the candidates, thresholds tuned and tested."""
    held = staging.candidates(spark, sf).where("split <> 'train'")
    scores = training.score_study(_study(spark, sf), held, V.RISK)
    path = new_path(spark, "scores")
    scores.write.partitionBy("model").parquet(path)
    return training.evaluate_study(spark.read.parquet(path), testbed.SPLITS)


def _newton(rows: str, score: str, label: str, strength: float) -> str:
    """The calibration line in SQL: Newton steps of the penalised logistic loss over plain rows."""
    return f"""(WITH RECURSIVE given AS (
          SELECT ln(p / (1 - p)) AS x, y FROM (SELECT least(greatest({score}, 1e-6), 1 - 1e-6) AS p, {label} AS y FROM ({rows}))
        ), steps(k, a, b) AS (
          SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
          UNION ALL
          SELECT k + 1, a + (hab * gb - hbb * ga) / (haa * hbb - hab * hab), b + (hab * ga - haa * gb) / (haa * hbb - hab * hab)
          FROM (SELECT k, a, b, sum(p - y) AS ga, sum((p - y) * x) + b / {strength} AS gb, sum(p * (1 - p)) AS haa, sum(p * (1 - p) * x) AS hab,
                       sum(p * (1 - p) * x * x) + CAST(1 AS DOUBLE) / {strength} AS hbb
                FROM (SELECT k, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM steps, given) GROUP BY k, a, b)
          WHERE k < 20)
        SELECT a, b FROM steps WHERE k = 20)"""


_LINE = _newton("SELECT * FROM sites WHERE decision_window < TIMESTAMP '2025-09-02'", "student_score", "actual_positive", 10)
_FITTED = f"""SELECT s.*, 1 / (1 + exp(-(a + b * ln(least(greatest(student_score, 1e-6), 1 - 1e-6) / (1 - least(greatest(student_score, 1e-6), 1 - 1e-6)))))) AS fitted
              FROM sites s, {_LINE}"""


@query(
    "platt",
    f"""SELECT count(*) AS site_count, sum(actual_positive) AS positive_sites, avg(actual_positive) AS positive_rate, avg(student_score) AS raw_score_mean,
               avg(fitted) AS calibrated_probability_mean, avg((student_score - actual_positive) ** 2) AS raw_brier, avg((fitted - actual_positive) ** 2) AS calibrated_brier
        FROM ({_FITTED}) WHERE decision_window >= TIMESTAMP '2025-09-02'""",
    doubles="positive_rate raw_score_mean calibrated_probability_mean raw_brier calibrated_brier",
    integers="positive_sites",
)
def platt(spark, sf):
    """Site calibration fitted before September 2, summed up on the rest."""
    return sites.calibration_summary(staging.fitted_sites(spark, sf).where(~staging.calibration_part()))


@query(
    "site_probability_fitted",
    f"""SELECT site_id, fitted AS calibrated_probability, least(greatest(fitted - CAST(0.03 AS DOUBLE), 0.0), 1.0) AS robust_probability FROM ({_FITTED})""",
    doubles="calibrated_probability robust_probability",
)
def site_probability_fitted(spark, sf):
    return staging.fitted_sites(spark, sf).select("site_id", "calibrated_probability", "robust_probability")


@query(
    "dispatch_ranking_fitted",
    f"""SELECT site_id, warning_cost FROM (
          SELECT site_id, decision_window, 1.0 + (1 - fitted) * 0.5 - fitted * 5000 * 0.1 AS warning_cost FROM ({_FITTED}))
        WHERE warning_cost < 0
        QUALIFY row_number() OVER (PARTITION BY decision_window ORDER BY round(warning_cost, 9), site_id) <= 8""",
    doubles="warning_cost",
)
def dispatch_ranking_fitted(spark, sf):
    """Warnings of every window that the fitted probability pays for, at the middle scenario."""
    priced = costs.incremental_cost(staging.fitted_sites(spark, sf)).where("scenario = 'loss_cost_ratio_5000' AND warning_cost < 0")
    best = top_n_per_group(priced, ["decision_window"], [F.round("warning_cost", 9), F.col("site_id")], 8, ["site_id"])
    return best.select("site_id", "warning_cost")


@query(
    "platt_rows",
    f"""SELECT split, count(*) AS rows, avg(student) AS raw_score_mean, avg(p) AS calibrated_probability_mean,
               avg((student - target_event_30m) ** 2) AS raw_brier, avg((p - target_event_30m) ** 2) AS calibrated_brier
        FROM (SELECT c.*, 1 / (1 + exp(-(a + b * ln(least(greatest(student, 1e-6), 1 - 1e-6) / (1 - least(greatest(student, 1e-6), 1 - 1e-6)))))) AS p
              FROM context c, {_newton("SELECT * FROM context WHERE split = 'validation'", "student", "target_event_30m", 100)})
        WHERE split IN ('validation', 'test') GROUP BY split""",
    doubles="raw_score_mean calibrated_probability_mean raw_brier calibrated_brier",
)
def platt_rows(spark, sf):
    """Row-level calibration fitted on the validation rows."""
    df = staging.context(spark, sf)
    model = models.fit_platt(df.where("split = 'validation'"), "score_distilled_student", "target_event_30m", staging.ROW_STRENGTH)
    y, s, p = F.col("target_event_30m"), F.col("score_distilled_student"), F.col("p")
    scored = models.apply_platt(model, df.where("split <> 'train'"), "score_distilled_student", "p")
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(s).alias("raw_score_mean"), F.avg(p).alias("calibrated_probability_mean"),
        F.avg((s - y) ** 2).alias("raw_brier"), F.avg((p - y) ** 2).alias("calibrated_brier"),
    )


@query("fit_type")
def fit_type(spark, sf):
    """Type model on the registry; predictions of the test part with their confidence."""
    df = files.registry_cyclic(testbed.registry(spark, sf).drop("predicted_type"))
    from corridorwatch.operators.candidates import registry_split

    df = df.withColumn("split", registry_split(testbed.SPLITS))
    numeric = ["stake_km", "traffic", "median_speed", "upstream_traffic", "downstream_traffic", "hour_sin", "hour_cos"]
    categorical = ["direction_code", "weather", "key_vehicle"]
    model, stats = models.fit_type(df.where("split <> 'test'"), numeric, categorical, trees=20)
    scored = models.score_type(model, stats, df.where("split = 'test'"), numeric, categorical)
    return scored.select("registry_id", "model_type", "predicted_type", "prediction_confidence")


# --- streaming ------------------------------------------------------------------------------


_CLOSED = "(SELECT max(bin5) FROM context) - INTERVAL 10 MINUTE"


def _context_stream(spark, sf):
    df = staging.context(spark, sf)
    return jobs.panel_stream(spark, staging.written_path(spark, sf, "context"), df.schema)


def _raw_stream(spark, sf):
    staging.staged(spark, sf, "clean_panel", lambda: testbed.clean(spark, sf))
    path = staging.written_path(spark, sf, "clean_panel")
    return jobs.panel_stream(spark, path, spark.read.parquet(path).schema)


def _run(spark, df: DataFrame, name: str) -> DataFrame:
    path = new_path(spark, name)
    jobs.start(df, path, new_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.parquet(path)


#: Parts in which the panel arrives at the stateful streams, and how late a row may be.
PARTS, LATE_MINUTES = 3, 10


def _arriving(spark, sf, run, columns: list[str]) -> None:
    """Calls ``run(panel stream)`` after each part of the panel's ``columns`` has arrived; state is carried from run to run.

    Rows arrive up to LATE_MINUTES after their bin, the last bins of a part thus after the first
    ones of the next. At the end a row of the next day, without a segment, lets the watermark pass all bins.
    """
    df = staging.context(spark, sf).select(*columns)
    minutes = F.pmod(F.xxhash64("segment_id", "bin5"), F.lit(LATE_MINUTES + 1)).cast("int")
    arrival = F.col("bin5") + F.make_dt_interval(mins=minutes)
    first, last = df.agg(F.min("bin5"), F.max("bin5")).first()
    path = new_path(spark, "arrivals")
    if first is None:
        return
    width = (last - first) / PARTS
    late = dt.timedelta(minutes=LATE_MINUTES + 1)
    borders = [first + k * width for k in range(PARTS)] + [last + late]
    for low, high in zip(borders, borders[1:]):
        df.where((arrival >= F.lit(low)) & (arrival < F.lit(high))).write.mode("append").parquet(path)
        run(jobs.panel_stream(spark, path, df.schema))
    empty = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    empty.withColumns({"segment_id": F.lit(""), "bin5": F.lit(last + dt.timedelta(days=1))}).write.mode("append").parquet(path)
    run(jobs.panel_stream(spark, path, df.schema))


@contextmanager
def _rocksdb(spark):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


@query(
    "stream_sites",
    f"""SELECT decision_window, road_code, direction_code, spatial_zone, segment_count, representative_segment, stake_m, stage1_score,
               student_score, actual_positive, event_ids, maximum_lead_time_min
        FROM site_base WHERE decision_window + INTERVAL 10 MINUTE <= {_CLOSED}""",
    doubles="stake_m stage1_score student_score maximum_lead_time_min",
    integers="direction_code spatial_zone segment_count actual_positive",
)
def stream_sites(spark, sf):
    df = _run(spark, jobs.stream_sites(_context_stream(spark, sf)), "stream-sites")
    return df.withColumn("event_ids", F.array_join("event_ids", "|"))


@query("stream_dedup", "SELECT DISTINCT segment_id, bin5 FROM clean")
def stream_dedup(spark, sf):
    return _run(spark, jobs.stream_dedup(_raw_stream(spark, sf)), "stream-dedup").select("segment_id", "bin5")


@query("stream_best_row", f"SELECT segment_id, bin5, max(risk) AS risk FROM clean WHERE bin5 + INTERVAL 5 MINUTE <= {_CLOSED.replace('context', 'clean')} GROUP BY ALL", doubles="risk")
def stream_best_row(spark, sf):
    df = _run(spark, jobs.stream_best_row(_raw_stream(spark, sf)), "stream-best")
    return df.select("segment_id", "bin5", F.col(V.RISK).alias("risk"))


@query(
    "stream_memory",
    "SELECT segment_id, bin5, risk, lag5, lag30, past_mean, change30 FROM context",
    doubles="risk lag5 lag30 past_mean change30",
)
def stream_memory(spark, sf):
    """The panel arrives in parts, rows of one segment in any order within the delay."""
    path, checkpoint = new_path(spark, "stream-memory"), new_path(spark, "stream-memory-checkpoint")
    with _rocksdb(spark):
        _arriving(spark, sf, lambda stream: jobs.start(jobs.stream_memory(stream), path, checkpoint).awaitTermination(), ["segment_id", "bin5", V.RISK])
    df = spark.read.schema(jobs.MEMORY_SCHEMA).parquet(path)
    names = {V.RISK: "risk", "risk_lag_5m": "lag5", "risk_lag_30m": "lag30", "risk_mean_past_30m": "past_mean", "risk_change_30m": "change30"}
    return df.select("segment_id", "bin5", *[F.when(~F.isnan(c), F.col(c)).alias(a) for c, a in names.items()])


#: What the watchlist's projection reads.
_WATCHED = [
    "segment_id", "bin5", "road_code", "direction_code", "stake", "score_stage1_risk", "score_distilled_student",
    "calibrated_probability_distilled_student", "candidate_source", "lead_time_min", "target_event_id",
]


@query(
    "stream_watchlist",
    "SELECT time, segment_id, score, row_number() OVER (PARTITION BY time ORDER BY score DESC, segment_id) AS rank FROM watchlist QUALIFY rank <= 60",
    doubles="score",
)
def stream_watchlist(spark, sf):
    """Snapshots split over several runs of the stream give one ranking each."""
    from corridorwatch.operators.watchlist import watchlist_projection

    path, checkpoint = new_path(spark, "stream-watchlist"), new_path(spark, "stream-watchlist-checkpoint")
    with _rocksdb(spark):
        _arriving(spark, sf, lambda stream: jobs.stream_watchlist(watchlist_projection(stream), path, checkpoint).awaitTermination(), _WATCHED)
    df = spark.read.parquet(f"{path}/watchlist")
    return df.select("time", "segment_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("stream_audit", "SELECT count(*) AS records, count(DISTINCT conv_id) AS conversations FROM conversations WHERE turn % 5 <> 4")
def stream_audit(spark, sf):
    source = new_path(spark, "audit-payloads")
    payloads = testbed.audit_input(spark, sf)
    payloads.write.parquet(source)
    df = _run(spark, jobs.stream_audit(jobs.panel_stream(spark, source, payloads.schema)), "stream-audit")
    return df.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("target").alias("conversations"))
