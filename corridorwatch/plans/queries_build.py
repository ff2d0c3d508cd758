"""Queries: scans, ingestion, context features, labels, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch import schemas
from corridorwatch import vocabulary as V
from corridorwatch.functions import columns as C
from corridorwatch.operators import candidates, cleaning, features, labels, profiling, topology
from corridorwatch.plans import build, oracle, staging
from corridorwatch.plans.registry import query
from corridorwatch.session import new_path
from corridorwatch.sources import files, sinks, testbed

KEY = ["segment_id", "bin5"]


def _risk():
    return F.col(V.RISK).alias("risk")


# --- scans ---------------------------------------------------------------------------


@query(
    "scan_panel_months",
    "SELECT segment_id, bin5, risk, source_row FROM raw WHERE month(bin5) = 8",
    doubles="risk",
)
def scan_panel_months(spark, sf):
    def make() -> DataFrame:
        return build.month_files(testbed.raw_panel(spark, sf))

    staging.staged(spark, sf, "panel_by_month", make, by="month")
    path = staging.written_path(spark, sf, "panel_by_month")
    return files.scan_panel_months(spark, path, [8]).select(*KEY, _risk(), "source_row")


@query(
    "scan_panel_csv",
    """SELECT source_row, segment_id, bin5, road_code, CASE WHEN source_row % 50 = 13 THEN NULL ELSE stake END AS stake,
              CASE WHEN source_row % 50 IN (3, 7, 11) THEN NULL ELSE risk END AS risk, accident_label
       FROM raw WHERE month(bin5) = 9 AND source_row % 50 NOT IN (17, 19)""",
    doubles="stake risk",
    integers="accident_label",
)
def scan_panel_csv(spark, sf):
    """One month of a CSV panel whose cells may be malformed."""
    path = new_path(spark, "panel-csv")
    text = testbed.panel_text(spark, sf).withColumn("month", F.coalesce(F.substring("bin5", 6, 2).try_cast("int"), F.lit(9)))
    text.select(*schemas.PANEL_TEXT.names, "month").write.partitionBy("month").option("header", True).csv(path)
    df = cleaning.typed_panel(files.scan_panel_months(spark, path, [9], "csv"))
    return df.select("source_row", "segment_id", "bin5", "road_code", "stake", _risk(), "accident_label")


@query(
    "scan_registry",
    """SELECT row_number() OVER (ORDER BY occurred_at, registry_id) - 1 AS registry_row, registry_id, occurred_at, direction_code,
              stake_km * 1000 AS accident_stake_m, accident_type, severity, weather, traffic, deaths
       FROM registry""",
    doubles="accident_stake_m traffic",
    integers="registry_row direction_code deaths",
)
def scan_registry(spark, sf):
    path = new_path(spark, "registry-csv")
    source = testbed.registry(spark, sf).withColumn("direction", F.when(F.col("direction_code") == 1, "上行").otherwise("下行"))
    text = {h: c for h, c in V.REGISTRY_HEADERS.items()}
    time = F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss")
    columns = [
        (time if c == "occurred_at" else F.col(c).cast("string") if c in source.columns else F.lit(None).cast("string")).alias(h)
        for h, c in text.items()
    ]
    source.select(*columns).write.option("header", True).csv(path)
    return files.scan_registry(spark, path, 2025).select(
        "registry_row", "registry_id", "occurred_at", "direction_code", "accident_stake_m", "accident_type", "severity", "weather", "traffic", "deaths",
    )


@query(
    "scan_snapshot",
    """SELECT segment_id, road_code, direction_code, CASE WHEN source_row % 50 = 13 THEN 0 ELSE stake END AS stake_m,
              CASE WHEN source_row % 50 IN (3, 7, 11) THEN 0 ELSE risk END AS stage1_score
       FROM raw""",
    doubles="stake_m stage1_score",
    integers="direction_code",
)
def scan_snapshot(spark, sf):
    path = new_path(spark, "snapshot-csv")
    text = testbed.panel_text(spark, sf)
    text.select("segment_id", "road_code", "direction_code", "stake", V.RISK).write.option("header", True).csv(path)
    return files.scan_snapshot(spark, path)


def _bad_time() -> str:
    return "source_row % 50 NOT IN (17, 19)"


# --- casts and cleaning ----------------------------------------------------------------


@query(
    "coerce_numeric",
    """SELECT source_row, CASE WHEN source_row % 50 IN (3, 7, 11) THEN NULL ELSE risk END AS risk,
              CASE WHEN source_row % 50 = 13 THEN NULL ELSE stake END AS stake,
              CASE WHEN source_row % 50 = 23 THEN NULL ELSE accident_level END AS accident_level FROM raw""",
    doubles="risk stake accident_level",
)
def coerce_numeric(spark, sf):
    df = C.coerce_numeric(testbed.panel_text(spark, sf), ["stake", "accident_level", V.RISK, "no_such_column"])
    return df.select(F.col("source_row").cast("long").alias("source_row"), _risk(), "stake", "accident_level")


@query("coerce_timestamp", f"SELECT source_row, bin5 FROM raw WHERE {_bad_time()}")
def coerce_timestamp(spark, sf):
    df = C.coerce_timestamp(testbed.panel_text(spark, sf), "bin5")
    return df.select(F.col("source_row").cast("long").alias("source_row"), "bin5")


@query(
    "finite_or_default",
    "SELECT source_row, CASE WHEN source_row % 50 IN (3, 7, 11) THEN -1 ELSE risk END AS risk FROM raw",
    doubles="risk",
)
def finite_or_default(spark, sf):
    return testbed.panel_text(spark, sf).select(
        F.col("source_row").cast("long").alias("source_row"), C.finite_or(V.RISK, -1.0).alias("risk")
    )


@query(
    "nan_to_null",
    """SELECT source_row, CASE WHEN source_row % 7 IN (0, 1) THEN NULL ELSE risk END AS plain,
              CASE WHEN source_row % 7 IN (0, 1) THEN NULL ELSE risk END AS nested,
              CASE WHEN source_row % 7 IN (0, 1) THEN 1 ELSE 2 END AS listed FROM raw""",
    doubles="plain nested",
    integers="listed",
)
def nan_to_null(spark, sf):
    third = F.col("source_row") % 7
    value = F.when(third == 0, F.lit(float("nan"))).when(third == 1, F.lit(float("inf"))).otherwise(F.col(V.RISK))
    df = testbed.raw_panel(spark, sf).select(
        "source_row", value.alias("plain"), F.struct(value.alias("v")).alias("s"), F.array(F.lit(1.0), value).alias("a")
    )
    return C.nan_to_null(df).select(
        "source_row", "plain", F.col("s.v").alias("nested"), F.size(F.array_compact("a")).alias("listed")
    )


@query(
    "clean_panel",
    "SELECT source_row, segment_id, bin5, risk, direction_code, accident_label, accident_level, accident_id FROM clean",
    doubles="risk",
    integers="direction_code accident_label accident_level",
)
def clean_panel(spark, sf):
    return testbed.clean(spark, sf).select(
        "source_row", *KEY, _risk(), "direction_code", "accident_label", "accident_level", "accident_id"
    )


@query("drop_incomplete", f"SELECT source_row FROM raw WHERE {_bad_time()} AND source_row % 50 NOT IN (3, 7, 11, 13)")
def drop_incomplete(spark, sf):
    return cleaning.drop_incomplete(cleaning.typed_panel(testbed.panel_text(spark, sf))).select("source_row")


@query(
    "off_month_filter",
    """SELECT source_month, count(*) FILTER (WHERE strftime(bin5, '%Y-%m') = source_month) AS kept_rows,
              count(*) FILTER (WHERE strftime(bin5, '%Y-%m') <> source_month) AS off_month_rows FROM raw GROUP BY source_month""",
)
def off_month_filter(spark, sf):
    return cleaning.off_month_split(testbed.raw_panel(spark, sf))


@query(
    "invalid_event_filter",
    """SELECT count(*) FILTER (WHERE accident_label > 0 AND accident_id = '0') AS invalid_event_labels_excluded,
              count(*) FILTER (WHERE accident_label > 0 AND accident_id <> '0') AS valid_event_labels FROM raw""",
)
def invalid_event_filter(spark, sf):
    bad = cleaning.invalid_event()
    return testbed.raw_panel(spark, sf).agg(
        F.count_if(bad).alias("invalid_event_labels_excluded"),
        F.count_if(~bad & (F.col("accident_label") > 0)).alias("valid_event_labels"),
    )


@query("panel_dedup", "SELECT segment_id, bin5, source_row, risk FROM panel", doubles="risk")
def panel_dedup(spark, sf):
    return testbed.panel(spark, sf).select(*KEY, "source_row", _risk())


@query(
    "grain_duplicates",
    """SELECT sum(n - 1) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicated_keys
       FROM (SELECT count(*) AS n FROM clean GROUP BY segment_id, bin5)""",
    integers="duplicate_rows",
)
def grain_duplicates(spark, sf):
    return cleaning.grain_duplicates(testbed.clean(spark, sf))


@query(
    "out_of_order_chunks",
    """SELECT *, coalesce(chunk_min < lag(chunk_max) OVER (ORDER BY chunk_id), false) AS out_of_order
       FROM (SELECT source_row // 1000 AS chunk_id, min(bin5) AS chunk_min, max(bin5) AS chunk_max, count(*) AS chunk_rows
             FROM raw GROUP BY 1)""",
)
def out_of_order_chunks(spark, sf):
    chunk = F.floor(F.col("source_row") / 1000).cast("long")
    return cleaning.out_of_order_chunks(testbed.raw_panel(spark, sf), chunk)


# --- context features --------------------------------------------------------------------


@query("travel_stake", "SELECT segment_id, bin5, travel_stake FROM panel", doubles="travel_stake")
def travel_stake(spark, sf):
    return features.add_travel_stake(staging.panel(spark, sf)).select(*KEY, "travel_stake")


_CELLS = ["up_100", "up_200", "up_300", "up_400", "up_500", "down_100", "down_200", "down_300", "down_400", "down_500"]


@query("spatial_shift", f"SELECT segment_id, bin5, {', '.join(_CELLS)} FROM spatial", doubles=" ".join(_CELLS))
def spatial_shift(spark, sf):
    df = features.add_spatial_features(staging.panel(spark, sf))
    return df.select(*KEY, *[F.col(c).alias(a) for c, a in zip(V.NEIGHBOUR_CELLS, _CELLS)])


_SPATIAL = "upstream_mean_300m upstream_max_300m downstream_mean_300m downstream_max_300m neighborhood_mean_500m neighborhood_max_500m neighborhood_std_500m spatial_gradient_600m center_neighbor_contrast spatial_coherence_500m"


@query(
    "spatial_context",
    """SELECT segment_id, bin5, up3 AS upstream_mean_300m, up3_max AS upstream_max_300m, down3 AS downstream_mean_300m,
              down3_max AS downstream_max_300m, nb_mean AS neighborhood_mean_500m, nb_max AS neighborhood_max_500m,
              nb_std AS neighborhood_std_500m, nb_high AS high_risk_cells_500m, gradient AS spatial_gradient_600m,
              contrast AS center_neighbor_contrast, coherence AS spatial_coherence_500m FROM spatial""",
    doubles=_SPATIAL,
    integers="high_risk_cells_500m",
)
def spatial_context(spark, sf):
    return features.add_spatial_features(staging.panel(spark, sf)).select(*KEY, *V.SPATIAL_SUMMARY)


@query(
    "temporal_lags",
    "SELECT segment_id, bin5, lag5 AS risk_lag_5m, lag10 AS risk_lag_10m, lag20 AS risk_lag_20m, lag30 AS risk_lag_30m FROM temporal",
    doubles="risk_lag_5m risk_lag_10m risk_lag_20m risk_lag_30m",
)
def temporal_lags(spark, sf):
    return features.add_temporal_features(staging.panel(spark, sf)).select(*KEY, *V.TEMPORAL[:4])


@query(
    "temporal_rolling",
    "SELECT segment_id, bin5, past_mean AS risk_mean_past_30m, past_max AS risk_max_past_30m, past_std AS risk_std_past_30m FROM temporal",
    doubles="risk_mean_past_30m risk_max_past_30m risk_std_past_30m",
)
def temporal_rolling(spark, sf):
    return features.add_temporal_features(staging.panel(spark, sf)).select(*KEY, *V.TEMPORAL[4:7])


@query(
    "temporal_change",
    "SELECT segment_id, bin5, change5 AS risk_change_5m, change30 AS risk_change_30m, acceleration AS risk_acceleration FROM temporal",
    doubles="risk_change_5m risk_change_30m risk_acceleration",
)
def temporal_change(spark, sf):
    return features.add_temporal_features(staging.panel(spark, sf)).select(*KEY, *V.TEMPORAL[7:])


@query(
    "context_features",
    """SELECT segment_id, bin5, sin(2 * pi() * m / 1440) AS hour_sin, cos(2 * pi() * m / 1440) AS hour_cos,
              sin(2 * pi() * wd / 7) AS weekday_sin, cos(2 * pi() * wd / 7) AS weekday_cos,
              CASE WHEN upper(road_code) = 'S5' THEN 1 ELSE 0 END AS road_is_s5, stake / 100000 AS stake_scaled
       FROM (SELECT *, hour(bin5) * 60 + minute(bin5) AS m, isodow(bin5) - 1 AS wd FROM panel)""",
    doubles="hour_sin hour_cos weekday_sin weekday_cos stake_scaled",
    integers="road_is_s5",
)
def context_features(spark, sf):
    df = features.add_context_features(staging.panel(spark, sf))
    return df.select(*KEY, "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "road_is_s5", "stake_scaled")


# Where the SQL keeps each feature; those that cannot be missing count every row.
_KEPT = {
    **dict.fromkeys(V.COMPONENTS, "risk"),
    **dict(zip(V.TEMPORAL, ["lag5", "lag10", "lag20", "lag30", "past_mean", "past_max", "past_std", "change5", "change30", "acceleration"])),
    **dict(zip(V.NEIGHBOUR_CELLS, _CELLS)),
    **dict(zip(V.SPATIAL_SUMMARY, ["up3", "up3_max", "down3", "down3_max", "nb_mean", "nb_max", "nb_std", "nb_high", "gradient", "contrast", "coherence"])),
    **dict.fromkeys(V.CONTEXT, "segment_id"),
}
_LISTS = {
    "temporal_only": [V.COMPONENTS, V.TEMPORAL, V.CONTEXT],
    "spatial_only": [V.COMPONENTS, V.NEIGHBOUR_CELLS, V.SPATIAL_SUMMARY, V.CONTEXT],
    "no_spatial": [V.COMPONENTS, V.TEMPORAL, V.CONTEXT],
    "no_temporal": [V.COMPONENTS, V.NEIGHBOUR_CELLS, V.SPATIAL_SUMMARY, V.CONTEXT],
    "full_teacher": [V.COMPONENTS, V.TEMPORAL, V.NEIGHBOUR_CELLS, V.SPATIAL_SUMMARY, V.CONTEXT],
    "student": [V.STUDENT],
    "student_no_spatial": [V.COMPONENTS, V.TEMPORAL, V.CONTEXT],
    "student_no_temporal": [V.COMPONENTS, V.SPATIAL_SUMMARY, V.CONTEXT],
}
_MEMBERS = ", ".join(f"('{model}', {i}, '{f}')" for model, parts in _LISTS.items() for i, f in enumerate(f for part in parts for f in part))


@query(
    "feature_sets",
    f"""SELECT m.model, m.position, m.feature, c.n, (SELECT count(*) FROM context) AS rows
        FROM (VALUES {_MEMBERS}) AS m(model, position, feature)
        JOIN (SELECT unnest([{", ".join(f"'{f}'" for f in _KEPT)}]) AS feature, unnest([{", ".join(f"count({c})" for c in _KEPT.values())}]) AS n FROM context) c USING (feature)""",
    integers="position",
)
def feature_sets(spark, sf):
    """Feature lists per model, with how often each feature is present in the panel."""
    df = staging.context(spark, sf)
    sets = features.feature_sets(df.columns)
    used = list(dict.fromkeys(f for fs in sets.values() for f in fs))
    present = F.array(*[F.struct(F.lit(f).alias("feature"), F.count(F.col(f)).alias("n")) for f in used])
    counts = df.agg(present.alias("c")).select(F.inline("c"))
    member = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("position"), F.lit(f).alias("feature")) for m, fs in sets.items() for i, f in enumerate(fs)])
    return counts.join(df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(member)), "feature")


@query(
    "topology",
    """SELECT segment_id, road_code, direction_code, road_direction, stake, travel_stake FROM panel
       QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY bin5, road_code, direction_code, travel_stake) = 1""",
    doubles="stake travel_stake",
    integers="direction_code",
)
def topology_query(spark, sf):
    return topology.topology(staging.panel(spark, sf))


@query(
    "segment_adjacency",
    """SELECT segment_id, lag(segment_id) OVER w AS upstream_segment_id, lead(segment_id) OVER w AS downstream_segment_id,
              lag(stake) OVER w AS upstream_stake, lead(stake) OVER w AS downstream_stake
       FROM (SELECT DISTINCT segment_id, road_code, direction_code, stake, travel_stake FROM panel)
       WINDOW w AS (PARTITION BY road_code, direction_code ORDER BY travel_stake, segment_id)""",
    doubles="upstream_stake downstream_stake",
)
def segment_adjacency(spark, sf):
    return topology.segment_adjacency(topology.topology(staging.panel(spark, sf))).select(
        "segment_id", "upstream_segment_id", "downstream_segment_id", "upstream_stake", "downstream_stake"
    )


# --- labels and candidates -----------------------------------------------------------------


def _labelled(spark, sf):
    return labels.label_future_events(staging.panel(spark, sf), testbed.SPLITS, staging.points(spark, sf))


@query(
    "event_dedup",
    "SELECT accident_id, bin5, segment_id, stake, accident_level FROM accidents",
    doubles="stake",
    integers="accident_level",
)
def event_dedup(spark, sf):
    return labels.accident_events(staging.panel(spark, sf)).select("accident_id", "bin5", "segment_id", "stake", "accident_level")


@query(
    "label_future_events",
    "SELECT segment_id, bin5, target_event_30m, target_event_id, target_event_level, lead_time_min FROM labelled",
    doubles="lead_time_min",
    integers="target_event_30m target_event_level",
)
def label_future_events(spark, sf):
    df = _labelled(spark, sf)
    return df.select(*KEY, "target_event_30m", "target_event_id", "target_event_level", "lead_time_min")


@query("event_guard", "SELECT segment_id, bin5 FROM labelled WHERE event_guard = 1")
def event_guard(spark, sf):
    return _labelled(spark, sf).where("event_guard = 1").select(*KEY)


@query(
    "eligible_negatives",
    "SELECT segment_id, bin5, risk FROM labelled WHERE target_event_30m = 0 AND event_guard = 0 AND accident_label = 0",
    doubles="risk",
)
def eligible_negatives(spark, sf):
    df = _labelled(spark, sf)
    return df.where(candidates.eligible_negative()).select(*KEY, _risk())


@query("candidate_source", "SELECT segment_id, bin5, candidate_source FROM context")
def candidate_source(spark, sf):
    df = _labelled(spark, sf)
    return df.select(*KEY, candidates.candidate_source().alias("candidate_source"))


_SAMPLE = """
SELECT segment_id, bin5, candidate_source FROM context WHERE target_event_30m = 1
UNION ALL
SELECT segment_id, bin5, candidate_source FROM (
  SELECT *, row_number() OVER (PARTITION BY CAST(bin5 AS DATE), candidate_source
         ORDER BY md5('20260730|' || segment_id || '|' || strftime(bin5, '%Y-%m-%d %H:%M:%S')), segment_id) AS rn
  FROM context WHERE target_event_30m = 0 AND event_guard = 0 AND accident_label = 0)
WHERE rn <= CASE candidate_source WHEN 'hard_negative' THEN {0} ELSE {1} END"""


oracle.CTES["drawn_candidates"] = f"SELECT c.* FROM context c JOIN ({_SAMPLE.format(600, 200)}) s ON c.segment_id = s.segment_id AND c.bin5 = s.bin5"


@query("stratified_sample", _SAMPLE.format(600, 200))
def stratified_sample(spark, sf):
    df = _labelled(spark, sf)
    return candidates.stratified_sample(df).select(*KEY, "candidate_source")


@query("stratified_sample_small", _SAMPLE.format(50, 20))
def stratified_sample_small(spark, sf):
    """The same with quotas that bind in every stratum."""
    df = _labelled(spark, sf)
    return candidates.stratified_sample(df, testbed.SMALL_SAMPLE).select(*KEY, "candidate_source")


@query(
    "candidate_build",
    f"""SELECT c.segment_id, c.bin5, c.candidate_source, c.split, c.up3 AS upstream_mean_300m, c.past_mean AS risk_mean_past_30m,
               c.lead_time_min, c.coherence AS spatial_coherence_500m
        FROM context c JOIN ({_SAMPLE.format(50, 20)}) s ON c.segment_id = s.segment_id AND c.bin5 = s.bin5""",
    doubles="upstream_mean_300m risk_mean_past_30m lead_time_min spatial_coherence_500m",
)
def candidate_build(spark, sf):
    """The whole build in one plan, from raw rows to candidates with their split."""
    df = build.build_candidates(testbed.raw_panel(spark, sf), testbed.SMALL_SAMPLE)
    return df.select(
        *KEY, "candidate_source", "split", "upstream_mean_300m", "risk_mean_past_30m", "lead_time_min", "spatial_coherence_500m"
    )


@query(
    "negative_sample",
    """SELECT segment_id, bin5, candidate_source FROM context
       WHERE target_event_30m = 0 AND candidate_source IN ('hard_negative', 'uncertain_negative')
       ORDER BY md5('20260730|' || segment_id || '|' || strftime(bin5, '%Y-%m-%d %H:%M:%S')), segment_id LIMIT 1000""",
)
def negative_sample(spark, sf):
    return candidates.negative_sample(staging.context(spark, sf), 1000).select(*KEY, "candidate_source")


@query("temporal_split", "SELECT segment_id, bin5, split FROM context")
def temporal_split(spark, sf):
    df = staging.panel(spark, sf)
    return df.select(*KEY, candidates.split_name(testbed.SPLITS).alias("split"))


@query(
    "registry_cyclic",
    """SELECT registry_id, sin(2 * pi() * m / 1440) AS hour_sin, cos(2 * pi() * m / 1440) AS hour_cos,
              CASE WHEN t = '翻车,碰撞' THEN '翻车' ELSE t END AS model_type,
              CASE WHEN occurred_at <= TIMESTAMP '2025-08-31 23:59:59' THEN 'train'
                   WHEN occurred_at <= TIMESTAMP '2025-09-01 23:59:59' THEN 'validation' ELSE 'test' END AS split
       FROM (SELECT *, hour(occurred_at) * 60 + minute(occurred_at) AS m,
                    CASE WHEN registry_id % 9 = 0 AND accident_type = '翻车' THEN '翻车,碰撞' ELSE accident_type END AS t FROM registry)""",
    doubles="hour_sin hour_cos",
)
def registry_cyclic(spark, sf):
    rolled = (F.col("registry_id") % 9 == 0) & (F.col("accident_type") == "翻车")
    df = testbed.registry(spark, sf).withColumn("accident_type", F.when(rolled, V.TYPE_COMBINED).otherwise(F.col("accident_type")))
    df = files.registry_cyclic(df).withColumn("split", candidates.registry_split(testbed.SPLITS))
    return df.select("registry_id", "hour_sin", "hour_cos", "model_type", "split")


@query(
    "nearest_context",
    """SELECT accident_id, gap AS time_distance_min FROM (
         SELECT accident_id, min(gap) AS gap FROM asof_pairs GROUP BY accident_id)""",
    doubles="time_distance_min",
)
def nearest_context(spark, sf):
    return _as_of(spark, sf, "nearest").select("accident_id", "time_distance_min")


@query(
    "nearest_context_backward",
    """SELECT a.accident_id, min(p.gap) AS time_distance_min FROM accidents a
       LEFT JOIN asof_pairs p ON a.accident_id = p.accident_id AND p.occurred_at <= p.at GROUP BY a.accident_id""",
    doubles="time_distance_min",
)
def nearest_context_backward(spark, sf):
    return _as_of(spark, sf, "backward").select("accident_id", "time_distance_min")


def _as_of(spark, sf, direction):
    asked = labels.accident_events(staging.panel(spark, sf)).select("accident_id", F.col("bin5").alias("at"), "direction_code")
    known = testbed.registry(spark, sf).withColumnRenamed("occurred_at", "at")
    return labels.nearest_context(asked, known, direction)


@query(
    "split_summary",
    """SELECT split, count(*) AS "rows", sum(target_event_30m) AS positive_rows, avg(target_event_30m) AS positive_rate,
              count(DISTINCT CASE WHEN target_event_30m = 1 THEN target_event_id END) AS event_count,
              min(bin5) AS date_min, max(bin5) AS date_max FROM context WHERE split IS NOT NULL GROUP BY split""",
    doubles="positive_rate",
    integers="positive_rows",
)
def split_summary(spark, sf):
    from corridorwatch.operators import metrics

    return metrics.split_summary(staging.context(spark, sf))


_NULLS = [("risk", V.RISK), ("up3", "upstream_mean_300m"), ("down3", "downstream_mean_300m"), ("lag30", "risk_lag_30m"), ("target_event_30m", "target_event_30m")]


@query(
    "panel_profile",
    f"""SELECT count(*) AS candidate_rows, sum(target_event_30m) AS candidate_positive_rows, avg(target_event_30m) AS candidate_positive_rate,
               count(DISTINCT CASE WHEN target_event_30m = 1 THEN target_event_id END) AS target_event_count,
               count(DISTINCT segment_id) AS segment_count,
               {", ".join(f"avg(CASE WHEN {a} IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate_{c}" for a, c in _NULLS)},
               count(*) - count(DISTINCT (segment_id, bin5)) AS candidate_grain_duplicates FROM context""",
    doubles="candidate_positive_rate " + " ".join(f"null_rate_{c}" for _, c in _NULLS),
    integers="candidate_positive_rows",
)
def panel_profile(spark, sf):
    return profiling.panel_profile(*staging.panel_facts(spark, sf))


@query(
    "month_summary",
    """SELECT r.*, coalesce(c.candidate_rows, 0) AS candidate_rows, coalesce(c.positive_candidate_rows, 0) AS positive_candidate_rows,
              coalesce(c.segment_count, 0) AS segment_count, coalesce(e.event_count, 0) AS event_count,
              coalesce(c.duplicates, 0) AS grain_duplicate_rows_in_candidates, coalesce(o.disorder, 0) AS monotonic_chunk_violations
       FROM (SELECT source_month, count(*) AS raw_rows, count(*) FILTER (WHERE off) AS off_month_rows_excluded,
                    count(*) FILTER (WHERE NOT off AND accident_label > 0 AND accident_id = '0') AS invalid_event_labels_excluded,
                    count(DISTINCT CASE WHEN NOT off THEN CAST(bin5 AS DATE) END) AS processed_days
             FROM (SELECT *, strftime(bin5, '%Y-%m') <> source_month AS off FROM raw) GROUP BY source_month) r
       LEFT JOIN (SELECT source_month, count(*) AS candidate_rows, sum(target_event_30m) AS positive_candidate_rows,
                         count(DISTINCT segment_id) AS segment_count, count(*) - count(DISTINCT (segment_id, bin5)) AS duplicates
                  FROM drawn_candidates GROUP BY source_month) c USING (source_month)
       LEFT JOIN (SELECT source_month, count(*) FILTER (WHERE first_bin < before) AS disorder FROM (
                    SELECT source_month, first_bin, lag(last_bin) OVER (PARTITION BY source_month ORDER BY chunk_id) AS before FROM (
                      SELECT source_month, source_row // 100 AS chunk_id, min(bin5) AS first_bin, max(bin5) AS last_bin FROM raw GROUP BY ALL))
                  GROUP BY source_month) o USING (source_month)
       LEFT JOIN (SELECT source_month, count(DISTINCT accident_id) AS event_count FROM accidents GROUP BY source_month) e USING (source_month)""",
    integers="positive_candidate_rows",
)
def month_summary(spark, sf):
    events = labels.accident_events(staging.panel(spark, sf))
    facts, _ = staging.month_facts(spark, sf)
    return profiling.month_summary(testbed.raw_panel(spark, sf), facts, events, F.floor(F.col("source_row") / 100))


@query("distinct_rows", "SELECT DISTINCT road_code, direction_code FROM panel", integers="direction_code")
def distinct_rows(spark, sf):
    return staging.panel(spark, sf).select("road_code", "direction_code").dropDuplicates(["road_code", "direction_code"])


@query(
    "union_parts",
    """SELECT candidate_source, segment_id, bin5 FROM context WHERE candidate_source IN ('hard_negative', 'uncertain_negative', 'random_negative')
       UNION ALL SELECT candidate_source, segment_id, bin5 FROM context WHERE candidate_source = 'future_event'""",
)
def union_parts(spark, sf):
    df = staging.context(spark, sf).select("candidate_source", *KEY)
    parts = [df.where(F.col("candidate_source") == s) for s in ("hard_negative", "uncertain_negative", "random_negative", "future_event")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- sinks -----------------------------------------------------------------------------------


@query(
    "sink_tables",
    f"""SELECT 'candidates' AS "table", month(bin5) AS month, count(*) AS "rows" FROM ({_SAMPLE.format(600, 200)}) GROUP BY ALL
        UNION ALL SELECT 'events', month(bin5), count(*) FROM accidents GROUP BY ALL
        UNION ALL SELECT 'topology', NULL, count(DISTINCT segment_id) FROM panel
        UNION ALL SELECT 'adjacency', NULL, count(DISTINCT segment_id) FROM panel""",
    integers="month",
)
def sink_tables(spark, sf):
    """Rows read back per written table and month."""
    panel = staging.panel(spark, sf)
    labelled = _labelled(spark, sf)
    segments = topology.topology(panel)
    tables = {
        "candidates": candidates.stratified_sample(labelled, testbed.SPLITS),
        "events": labels.accident_events(panel, per=None),
        "topology": segments,
        "adjacency": topology.segment_adjacency(segments),
    }
    written = sinks.write_month_tables(tables, new_path(spark, "month-tables"))
    counts = []
    for name, path in written.items():
        df = spark.read.parquet(path)
        month = F.col("month") if "month" in df.columns else F.lit(None).cast("int")
        counts.append(df.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name)))
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total


@query(
    "sink_summary_json",
    """SELECT count(*) AS candidate_rows, avg(target_event_30m) AS candidate_positive_rate,
              count(DISTINCT CASE WHEN target_event_30m = 1 THEN target_event_id END) AS target_event_count FROM context""",
    doubles="candidate_positive_rate",
)
def sink_summary_json(spark, sf):
    path = sinks.write_summary_json(profiling.panel_profile(*staging.panel_facts(spark, sf)), new_path(spark, "summary"))
    return spark.read.schema("candidate_rows long, candidate_positive_rate double, target_event_count long").json(path)
