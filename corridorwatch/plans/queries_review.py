"""Queries: policy review, packets, risk requests, watchlists, audit, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.functions.rows import with_row
from corridorwatch.operators import candidates, labels, packets, policy, risk, watchlist
from corridorwatch.plans import replay, staging
from corridorwatch.plans.registry import query
from corridorwatch.session import new_path
from corridorwatch.sources import audit as audit_log
from corridorwatch.sources import files, sinks, testbed

KEY = ["segment_id", "bin5"]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_q(v) for v in values)


# --- flagship ------------------------------------------------------------------------------


@query(
    "top_risk_evidence",
    """SELECT time, rank, segment_id, road_code, direction_code, risk, upstream_mean_300m, downstream_mean_300m, neighborhood_max_500m,
              high_risk_cells_500m, risk_mean_past_30m, risk_change_30m FROM (
         SELECT bin5 AS time, row_number() OVER (PARTITION BY bin5 ORDER BY risk DESC, segment_id) AS rank, segment_id, road_code, direction_code,
                risk, up3 AS upstream_mean_300m, down3 AS downstream_mean_300m, nb_max AS neighborhood_max_500m, nb_high AS high_risk_cells_500m,
                past_mean AS risk_mean_past_30m, change30 AS risk_change_30m FROM temporal) WHERE rank <= 60""",
    doubles="risk upstream_mean_300m downstream_mean_300m neighborhood_max_500m risk_mean_past_30m risk_change_30m",
    integers="direction_code high_risk_cells_500m",
)
def top_risk_evidence(spark, sf):
    """The 60 riskiest segments of every bin, with spatial and temporal evidence."""
    from corridorwatch.functions.ranking import top_n_per_group
    from corridorwatch.operators import features

    df = features.add_temporal_features(features.add_spatial_features(testbed.panel(spark, sf)))
    top = top_n_per_group(df, ["bin5"], [F.col(V.RISK).desc(), F.col("segment_id")], 60, ["segment_id"])
    return top.select(
        F.col("bin5").alias("time"), F.col("rank").cast("bigint").alias("rank"), "segment_id", "road_code", "direction_code", F.col(V.RISK).alias("risk"),
        "upstream_mean_300m", "downstream_mean_300m", "neighborhood_max_500m", "high_risk_cells_500m", "risk_mean_past_30m", "risk_change_30m",
    )


# --- policy ----------------------------------------------------------------------------------


_MEASURES = f"""list_distinct_ordered(
  list_concat([{_list(V.BASE_MEASURES)}],
    CASE WHEN regexp_matches(coalesce(weather, '未知'), '[雨雾雪沙]') THEN [{_list(V.WEATHER_MEASURES)}] ELSE [] END,
    CASE WHEN accident_type IN ('追尾', '碰撞', '刮擦') THEN [{_list(V.LANE_MEASURES)}] ELSE [] END,
    CASE WHEN contains(accident_type, '翻车') THEN [{_list(V.ROLLOVER_MEASURES)}] ELSE [] END,
    CASE WHEN contains(accident_type, '失火') THEN [{_list(V.FIRE_MEASURES)}] ELSE [] END,
    CASE WHEN traffic >= 1800 THEN [{_q(V.TRAFFIC_MEASURE)}] ELSE [] END,
    CASE WHEN upstream_traffic > greatest(downstream_traffic * 1.25, downstream_traffic + 30) THEN [{_q(V.QUEUE_MEASURE)}] ELSE [] END,
    CASE WHEN median_speed < 40 THEN [{_q(V.SPEED_MEASURE)}] ELSE [] END))""".replace("list_distinct_ordered", "")


@query("policy_rules", f"SELECT registry_id, array_to_string({_MEASURES}, '|') AS measures FROM registry")
def policy_rules(spark, sf):
    df = policy.registry_measures(testbed.registry(spark, sf))
    return df.select("registry_id", F.array_join("management_measures", "|").alias("measures"))


@query(
    "policy_library",
    f"""SELECT accident_type, registry_id, array_to_string({_MEASURES}, '|') AS measures FROM registry
        QUALIFY row_number() OVER (PARTITION BY accident_type ORDER BY occurred_at, registry_id) = 1""",
)
def policy_library(spark, sf):
    df = policy.policy_library(testbed.registry(spark, sf))
    return df.select("accident_type", "registry_id", F.array_join("management_measures", "|").alias("measures"))


@query(
    "severity_gate",
    f"""SELECT registry_id, flags AS serious_flags, CASE WHEN flags = '' THEN {_q(V.BAND_LOW)} ELSE {_q(V.BAND_HIGH)} END AS predicted_severity_band,
               true AS human_review_required, {_q(V.SEVERITY_REASON)} AS reason FROM (
          SELECT registry_id, concat_ws('|', CASE WHEN accident_type IN ('翻车', '失火') THEN {_q(V.FLAG_TYPE)} END,
                 CASE WHEN serious_injured > 0 THEN {_q(V.FLAG_INJURY)} END, CASE WHEN deaths > 0 THEN {_q(V.FLAG_FATAL)} END,
                 CASE WHEN key_vehicle = '属于' THEN {_q(V.FLAG_VEHICLE)} END) AS flags FROM registry)""",
)
def severity_gate(spark, sf):
    df = policy.severity_gate(testbed.registry(spark, sf))
    return df.select("registry_id", F.array_join("serious_flags", "|").alias("serious_flags"), "predicted_severity_band", "human_review_required", "reason")


def _packets(spark, sf):
    context = staging.context(spark, sf).select("segment_id", F.col("bin5").alias("occurred_at"), F.col("score_distilled_student").alias("score"))
    registry = testbed.registry(spark, sf)
    return registry.join(context, ["segment_id", "occurred_at"], "left").select(
        "registry_id",
        "score",
        F.col("median_speed").alias("median_speed_km_h"),
        "upstream_traffic",
        "downstream_traffic",
        "weather",
        F.col("predicted_type").alias("type_hypothesis"),
    )


@query(
    "policy_review",
    """SELECT registry_id, '依据冻结政策库和安全门生成；未调用外部模型。' AS engine_note, '1.0' AS policy_version,
              CASE WHEN score >= 0.6 THEN '进入人工复核' ELSE '保留观察' END AS operational_state, kind AS type_hypothesis, codes AS action_codes,
              true AS human_review_required, CASE WHEN speed < 40 THEN 1 ELSE 0 END + CASE WHEN gap >= 25 THEN 1 ELSE 0 END
              + CASE WHEN weather NOT IN ('Clear', '晴', '未知', '') THEN 1 ELSE 0 END + 1 AS reasons,
              CASE WHEN speed < 40 THEN '；中位速度 ' || printf('%.1f', speed) || ' km/h，存在低速冲击波迹象' ELSE '' END AS speed_reason FROM reviewed""",
    integers="reasons",
)
def policy_review(spark, sf):
    df = policy.policy_review(_packets(spark, sf))
    body = F.regexp_replace("reasoning", "。$", "")
    return df.select(
        "registry_id",
        "engine_note",
        "policy_version",
        "operational_state",
        "type_hypothesis",
        F.array_join(F.transform("actions", lambda a: a["code"]), ",").alias("action_codes"),
        "human_review_required",
        F.size(F.split(body, "；")).alias("reasons"),
        F.regexp_extract("reasoning", "(；中位速度 [0-9.]+ km/h，存在低速冲击波迹象)", 1).alias("speed_reason"),
    )


def _answers(reviews: DataFrame) -> DataFrame:
    """Model answers of four kinds: valid objects, one valid and one foreign text, none valid, malformed."""
    kind = F.col("registry_id") % 4
    label = F.col("actions")[0]["label"]
    objects = F.to_json(F.struct(F.lit("state A").alias("operational_state"), F.array(F.struct(label.alias("label"))).alias("actions")))
    mixed = F.to_json(F.struct(F.lit("because").alias("reasoning"), F.array(label, F.lit("关闭隧道")).alias("actions")))
    none = F.to_json(F.struct(F.array(F.lit("关闭隧道"), F.lit("")).alias("actions")))
    return reviews.withColumn("answer", F.when(kind == 0, objects).when(kind == 1, mixed).when(kind == 2, none).otherwise("{oops"))


@query(
    "review_output_validate",
    """SELECT registry_id, CASE registry_id % 4 WHEN 3 THEN 'policy-safety-fallback' ELSE 'external-review' END AS engine,
              CASE WHEN registry_id % 4 IN (0, 1) THEN split_part(codes, ',', 1) ELSE codes END AS action_codes,
              CASE WHEN registry_id % 4 IN (1, 2) THEN '关闭隧道' ELSE '' END AS unsupported_actions,
              CASE WHEN registry_id % 4 = 0 THEN 'state A' WHEN score >= 0.6 THEN '进入人工复核' ELSE '保留观察' END AS operational_state,
              registry_id % 4 = 1 AS own_reasoning FROM reviewed""",
)
def review_output_validate(spark, sf):
    df = policy.review_output_validate(_answers(policy.policy_review(_packets(spark, sf))))
    return df.select(
        "registry_id",
        "engine",
        F.array_join(F.transform("actions", lambda a: a["code"]), ",").alias("action_codes"),
        F.array_join("unsupported_actions", ",").alias("unsupported_actions"),
        "operational_state",
        (F.col("reasoning") == "because").alias("own_reasoning"),
    )


# --- packets -----------------------------------------------------------------------------------


@query(
    "memory_packet",
    """SELECT segment_id, bin5, risk AS current_risk, lag5, past_mean, up3_max, nb_high FROM context""",
    doubles="current_risk lag5 past_mean up3_max",
    integers="nb_high",
)
def memory_packet(spark, sf):
    """Read back from the JSON text, whose size is checked against its characters."""
    df = packets.memory_packet(staging.context(spark, sf))
    ok = F.col("memory_packet_bytes_utf8") >= F.length("memory_json")

    def number(path: str):
        return F.get_json_object("memory_json", path).try_cast("double")

    return df.where(ok).select(
        *KEY,
        number("$.current_stage1_probability").alias("current_risk"),
        number("$.past_30min.lag_5min").alias("lag5"),
        number("$.past_30min.mean").alias("past_mean"),
        number("$.directed_spatial_context.upstream_max_300m").alias("up3_max"),
        number("$.directed_spatial_context.high_risk_cells_500m").cast("int").alias("nb_high"),
    )


@query(
    "teacher_packets",
    f"""SELECT registry_id AS row_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS decision_time, stake_km, weather, accident_type, severity,
              severity <> '轻微事故' AS human_review_required, len({_MEASURES}) AS measures FROM registry""",
    doubles="stake_km",
)
def teacher_packets(spark, sf):
    df = packets.teacher_packets(testbed.registry(spark, sf))

    def text(path: str):
        return F.get_json_object("record", path)

    return df.select(
        text("$.provenance.row_id").cast("bigint").alias("row_id"),
        text("$.input.decision_time").alias("decision_time"),
        text("$.input.location.stake_km").cast("double").alias("stake_km"),
        text("$.input.weather.condition").alias("weather"),
        text("$.output.accident_type").alias("accident_type"),
        text("$.output.severity").alias("severity"),
        text("$.output.human_review_required").cast("boolean").alias("human_review_required"),
        F.size(F.from_json(text("$.output.management_measures"), "array<string>")).cast("bigint").alias("measures"),
    )


_NEGATIVES = """
SELECT * FROM context WHERE target_event_30m = 0 AND candidate_source IN ('hard_negative', 'uncertain_negative')"""


@query(
    "negative_packets",
    f"""SELECT strftime(bin5, '%Y-%m-%d %H:%M:%S') AS decision_time, segment_id, road_code, stake AS stake_m, risk AS stage1_probability,
               change30 AS risk_change_30m, coherence AS spatial_coherence_500m, 'continue_monitoring' AS recommended_state FROM ({_NEGATIVES})""",
    doubles="stake_m stage1_probability risk_change_30m spatial_coherence_500m",
)
def negative_packets(spark, sf):
    df = packets.negative_packets(candidates.negative_sample(staging.context(spark, sf)))

    def text(path: str):
        return F.get_json_object("record", path)

    return df.select(
        text("$.input.decision_time").alias("decision_time"),
        text("$.input.segment_id").alias("segment_id"),
        text("$.input.road_code").alias("road_code"),
        text("$.input.stake_m").cast("double").alias("stake_m"),
        text("$.input.stage1_probability").cast("double").alias("stage1_probability"),
        text("$.input.risk_change_30m").cast("double").alias("risk_change_30m"),
        text("$.input.spatial_coherence_500m").cast("double").alias("spatial_coherence_500m"),
        text("$.output.recommended_state").alias("recommended_state"),
    )


@query(
    "sink_jsonl_teacher",
    f"""SELECT 'confirm' AS kind, count(*) AS records FROM registry
        UNION ALL SELECT 'monitor', count(*) FROM ({_NEGATIVES})""",
)
def sink_jsonl_teacher(spark, sf):
    teacher = packets.teacher_packets(testbed.registry(spark, sf))
    negative = packets.negative_packets(candidates.negative_sample(staging.context(spark, sf)))
    path = sinks.write_jsonl(teacher.unionByName(negative), new_path(spark, "teacher-jsonl"))
    back = spark.read.schema("instruction string, output struct<event_confirmation: string>").json(path)
    kind = F.when(F.col("output.event_confirmation") == "confirmed_historical_event", "confirm").otherwise("monitor")
    return back.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("records"))


@query(
    "replay_packet",
    f"""SELECT target_event_id, segment_id, strftime(bin5, '%Y-%m-%d %H:%M:%S') AS decision_time, student AS score, lead_time_min, gap AS context_distance,
               array_to_string(flags, '|') AS serious_flags, array_to_string({_MEASURES}, '|') AS measures, up3 AS upstream_mean_300m
        FROM (SELECT b.*, p.gap, r.predicted_type AS accident_type, r.weather, r.traffic, r.median_speed, r.upstream_traffic, r.downstream_traffic,
                     list_filter([CASE WHEN r.predicted_type IN ('翻车', '失火') THEN {_q(V.FLAG_TYPE)} END, CASE WHEN serious_injured > 0 THEN {_q(V.FLAG_INJURY)} END,
                                  CASE WHEN deaths > 0 THEN {_q(V.FLAG_FATAL)} END, CASE WHEN key_vehicle = '属于' THEN {_q(V.FLAG_VEHICLE)} END], lambda x: x IS NOT NULL) AS flags
              FROM best_case b
              JOIN (SELECT * FROM asof_pairs QUALIFY row_number() OVER (PARTITION BY accident_id ORDER BY gap, occurred_at, registry_id) = 1) p
                ON p.accident_id = b.target_event_id
              JOIN registry r ON r.registry_id = p.registry_id)""",
    doubles="score lead_time_min context_distance upstream_mean_300m",
)
def replay_packet(spark, sf):
    events = labels.accident_events(staging.panel(spark, sf), per=None)
    df = replay.replay(staging.context(spark, sf), events, testbed.registry(spark, sf))

    def text(path: str):
        return F.get_json_object("packet", path)

    def listed(path: str):
        return F.array_join(F.from_json(text(path), "array<string>"), "|")

    return df.select(
        "target_event_id",
        text("$.location.segment_id").alias("segment_id"),
        text("$.decision.decision_time").alias("decision_time"),
        text("$.decision.supervisory_score").cast("double").alias("score"),
        text("$.decision.lead_time_to_recorded_event_min").cast("double").alias("lead_time_min"),
        text("$.audit.historical_context_time_distance_min").cast("double").alias("context_distance"),
        listed("$.severity_gate.serious_flags").alias("serious_flags"),
        listed("$.management_measures").alias("measures"),
        text("$.compressed_long_term_memory.directed_spatial_context.upstream_mean_300m").cast("double").alias("upstream_mean_300m"),
    )


@query(
    "policy_document",
    f"""SELECT '1.0' AS policy_version, {len(V.POLICY_PRINCIPLES)} AS principles, count(DISTINCT accident_type) AS example_types, {len(V.SEVERITY_REVIEW)} AS severity_levels FROM registry""",
    integers="principles severity_levels",
)
def policy_document(spark, sf):
    doc = policy.policy_document(testbed.registry(spark, sf))
    sizes = {"principles": "principles", "example_types": "type_specific_examples", "severity_levels": "severity_gate"}
    return doc.select("policy_version", *[F.size(c).alias(a) for a, c in sizes.items()])


# --- risk requests ---------------------------------------------------------------------------------


_FEATURES = {
    V.RISK: "risk",
    "current_risk_probability": "current_risk",
    "collision_risk_value": "collision_risk",
    "risk_lag_5m": "lag5",
    "risk_lag_30m": "lag30",
    "risk_mean_past_30m": "past_mean",
    "risk_change_5m": "change5",
    "risk_change_30m": "change30",
    "upstream_mean_300m": "up3",
    "upstream_max_300m": "up3_max",
    "downstream_mean_300m": "down3",
    "downstream_max_300m": "down3_max",
    "neighborhood_mean_500m": "nb_mean",
    "neighborhood_max_500m": "nb_max",
    "neighborhood_std_500m": "nb_std",
    "high_risk_cells_500m": "nb_high",
    "spatial_gradient_600m": "gradient",
    "center_neighbor_contrast": "contrast",
}
CASE_SEGMENT, CASE_TIME = "8", "2025-08-29 00:00:00"


@query(
    "default_features",
    f"""SELECT {", ".join(f"coalesce(CAST({a} AS DOUBLE), 0) AS {c}" for c, a in _FEATURES.items())}, direction_code,
               CASE WHEN road_code = 'S5' THEN 1 ELSE 0 END AS road_is_s5, sin(2 * pi() * (hour(bin5) * 60 + minute(bin5)) / 1440) AS hour_sin,
               cos(2 * pi() * (hour(bin5) * 60 + minute(bin5)) / 1440) AS hour_cos
        FROM context WHERE segment_id = '{CASE_SEGMENT}' AND bin5 = TIMESTAMP '{CASE_TIME}'""",
    doubles=" ".join(_FEATURES) + " direction_code road_is_s5 hour_sin hour_cos",
)
def default_features(spark, sf):
    return risk.default_features(staging.context(spark, sf), CASE_SEGMENT, CASE_TIME)


def _neutral(spark, sf):
    """Defaults for missing inputs: the mean of every input over the panel."""
    df = staging.context(spark, sf)
    return df.agg(*[F.coalesce(F.round(F.avg(F.col(c).cast("double")), 6), F.lit(0.0)).alias(c) for c in V.STUDENT])


def _filled(a: str) -> str:
    return f"coalesce({a}, (SELECT round(avg({a}), 6) FROM context))"


_CHECKED = ", ".join(f"CASE WHEN {a} NOT BETWEEN 0 AND 1 THEN {_q(c)} END" for c, a in (("current_risk_probability", "current_risk"), ("collision_risk_value", "collision_risk")))


@query(
    "normalize_features",
    f"""SELECT segment_id, bin5, {_filled("lag5")} AS risk_lag_5m, {_filled("past_mean")} AS risk_mean_past_30m, {_filled("up3")} AS upstream_mean_300m,
               concat_ws(',', {_CHECKED}) AS violations FROM context""",
    doubles="risk_lag_5m risk_mean_past_30m upstream_mean_300m",
)
def normalize_features(spark, sf):
    df = risk.normalize_features(staging.context(spark, sf), _neutral(spark, sf))
    return df.select(*KEY, "risk_lag_5m", "risk_mean_past_30m", "upstream_mean_300m", F.array_join("violations", ",").alias("violations"))


_RANKED = f"""
SELECT segment_id, bin5, string_agg(key, '|' ORDER BY abs(v) DESC, i) AS evidence_order, any_value(student) AS student, any_value(past_mean) AS past_mean, any_value(nb_max) AS nb_max
FROM (SELECT segment_id, bin5, student, past_mean, nb_max, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest(['当前风险', '30分钟均值', '风险变化', '上游300米', '下游300米', '邻域峰值']) AS key,
             unnest([current_risk, past_mean, change30, up3, down3, nb_max]) AS v
      FROM (SELECT segment_id, bin5, student, round(current_risk, 9) AS current_risk, round(coalesce(past_mean, 0), 9) AS past_mean, round(coalesce(change30, 0), 9) AS change30,
                   round(coalesce(up3, 0), 9) AS up3, round(coalesce(down3, 0), 9) AS down3, round(nb_max, 9) AS nb_max FROM context))
GROUP BY segment_id, bin5"""


def _requests(spark, sf):
    """Panel rows as requests; missing context is 0 and noise below 1e-9 is cut, so ties are ties."""
    df = staging.context(spark, sf)
    return df.withColumns({c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 9) for c in V.STUDENT})


@query("evidence_sort", f"SELECT segment_id, bin5, evidence_order FROM ({_RANKED})")
def evidence_sort(spark, sf):
    df = _requests(spark, sf).withColumn("evidence", risk.evidence_items())
    return df.select(*KEY, F.array_join(F.transform("evidence", lambda e: e["key"]), "|").alias("evidence_order"))


_FLAGS = f"concat_ws('|', CASE WHEN past_mean = 0 THEN {_q(V.FLAG_NO_TEMPORAL)} END, CASE WHEN nb_max = 0 THEN {_q(V.FLAG_NO_SPATIAL)} END)"


@query("degradation_flags", f"SELECT segment_id, bin5, {_FLAGS} AS flags FROM ({_RANKED})")
def degradation_flags(spark, sf):
    df = _requests(spark, sf)
    return df.select(*KEY, F.array_join(risk.degradation_flags(), "|").alias("flags"))


@query(
    "risk_evaluate",
    f"""SELECT segment_id, bin5, violations, CASE WHEN ok THEN student END AS score, CASE WHEN ok THEN student >= 0.6 END AS alert,
               CASE WHEN NOT ok THEN NULL WHEN student >= 0.8 THEN '高' WHEN student >= 0.6 THEN '中' ELSE '低' END AS risk_level,
               CASE WHEN ok THEN evidence_order END AS evidence_order, CASE WHEN ok THEN {_FLAGS} END AS flags,
               CASE WHEN ok THEN past_mean END AS memory, CASE WHEN ok THEN student END AS calibrated_probability, CASE WHEN ok THEN {_q(V.SCORE_SEMANTICS)} END AS semantics
        FROM (SELECT r.*, violations, violations = '' AS ok
              FROM ({_RANKED}) r JOIN (SELECT segment_id, bin5, concat_ws(',', {_CHECKED}) AS violations FROM context) c USING (segment_id, bin5))""",
    doubles="score memory calibrated_probability",
)
def risk_evaluate(spark, sf):
    """Requests over neutral defaults; the panel has no fitted calibration here, so the score stands for it."""
    requests = _requests(spark, sf).withColumn("probability", F.col("score_distilled_student"))
    df = risk.risk_evaluate(requests, "score_distilled_student", probability="probability", defaults=_neutral(spark, sf))
    return df.select(
        *KEY, "score", "alert", "risk_level", F.col("features.risk_mean_past_30m").alias("memory"), "calibrated_probability", "semantics",
        F.array_join("violations", ",").alias("violations"),
        F.array_join(F.transform("evidence", lambda e: e["key"]), "|").alias("evidence_order"),
        F.array_join("degradation_flags", "|").alias("flags"),
    )


@query(
    "risk_level",
    """SELECT segment_id, bin5, CASE WHEN student >= 0.8 THEN '高' WHEN student >= 0.6 THEN '中' ELSE '低' END AS risk_level,
              CASE WHEN student >= 0.8 THEN 'high' WHEN student >= 0.6 THEN 'mid' WHEN student >= 0.35 THEN 'elevated' ELSE 'low' END AS display_band FROM context""",
)
def risk_level(spark, sf):
    score = F.col("score_distilled_student")
    return staging.context(spark, sf).select(*KEY, risk.risk_level(score).alias("risk_level"), risk.display_band(score).alias("display_band"))


# --- watchlist ----------------------------------------------------------------------------------------


def _watch(spark, sf):
    return watchlist.watchlist_projection(staging.context(spark, sf))


_WATCH_DOUBLES = "stake_m stake_km score stage1_score calibrated_probability lead_time_min"


@query("watchlist_projection", "SELECT * FROM watchlist", doubles=_WATCH_DOUBLES)
def watchlist_projection(spark, sf):
    return _watch(spark, sf)


@query(
    "watchlist_topk",
    "SELECT time, segment_id, score, row_number() OVER (PARTITION BY time ORDER BY score DESC, segment_id) AS rank FROM watchlist QUALIFY rank <= 60",
    doubles="score",
)
def watchlist_topk(spark, sf):
    return watchlist.watchlist_topk(_watch(spark, sf)).select("time", "segment_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "watchlist_filter",
    """SELECT segment_id, time, score FROM watchlist WHERE road_code = 'G9411' AND CAST(direction_code AS VARCHAR) = '1' AND risk_level = '高'
       AND contains(lower(segment_id || ' ' || road_code || ' ' || printf('%.3f', stake_km)), 'g9411 1')""",
    doubles="score",
)
def watchlist_filter(spark, sf):
    return watchlist.watchlist_filter(_watch(spark, sf), "G9411", "1", "高", " G9411 1 ").select("segment_id", "time", "score")


_BEST = "target_event_id, segment_id, bin5, student AS score, lead_time_min"


@query("best_replay_row", f"SELECT {_BEST} FROM best_case", doubles="score lead_time_min")
def best_replay_row(spark, sf):
    df = watchlist.best_replay_row(staging.context(spark, sf))
    return df.select("target_event_id", *KEY, F.col("score_distilled_student").alias("score"), "lead_time_min")


@query(
    "best_replay_case",
    f"SELECT {_BEST} FROM best_case ORDER BY student DESC, lead_time_min DESC, bin5, segment_id LIMIT 1",
    doubles="score lead_time_min",
)
def best_replay_case(spark, sf):
    df = watchlist.best_replay_case(staging.context(spark, sf))
    return df.select("target_event_id", *KEY, F.col("score_distilled_student").alias("score"), "lead_time_min")


@query(
    "event_lookup",
    """SELECT b.target_event_id, b.segment_id, a.bin5 AS event_time, a.direction_code AS event_direction, a.segment_id AS event_segment
       FROM best_case b JOIN accidents a ON a.accident_id = b.target_event_id""",
    integers="event_direction",
)
def event_lookup(spark, sf):
    rows = watchlist.best_replay_row(staging.context(spark, sf)).select("target_event_id", "segment_id")
    return watchlist.event_lookup(rows, labels.accident_events(staging.panel(spark, sf), per=None))


def _cases(spark, sf):
    """One case per detected event: best row and the context of the event's own registry entry."""
    best = watchlist.best_replay_row(staging.context(spark, sf))
    registry = testbed.registry(spark, sf).withColumn("event_id", F.concat(F.lit("E"), F.col("registry_id").cast("string")))
    return best.withColumnRenamed("target_event_id", "event_id").join(
        registry.select("event_id", F.col("predicted_type").alias("type_hypothesis"), F.col("traffic").alias("traffic_volume"), F.lit("VMS_WARNING,VERIFY,LANE_CONTROL").alias("management_actions")),
        "event_id",
    ).withColumnRenamed("score_distilled_student", "supervisory_score")


_CASES = """SELECT b.target_event_id AS event_id, b.student AS supervisory_score, r.predicted_type AS type_hypothesis, r.traffic AS traffic_volume
            FROM best_case b JOIN registry r ON b.target_event_id = 'E' || CAST(r.registry_id AS VARCHAR)"""


@query("case_lookup", f"{_CASES} ORDER BY supervisory_score DESC, event_id LIMIT 1", doubles="supervisory_score traffic_volume")
def case_lookup(spark, sf):
    return watchlist.case_lookup(_cases(spark, sf)).select("event_id", "supervisory_score", "type_hypothesis", "traffic_volume")


@query(
    "case_match",
    f"""SELECT w.segment_id, w.time, c.event_id IS NOT NULL AS matches_case, coalesce(c.type_hypothesis || '（假设）', '待复核') AS type_hypothesis,
               CASE WHEN c.event_id IS NOT NULL THEN 'VMS_WARNING,VERIFY,LANE_CONTROL' WHEN w.score >= 0.8 THEN 'VMS_WARNING,VERIFY,LOW_SPEED_WARNING'
                    ELSE 'VMS_WARNING,VERIFY' END AS action_codes, w.score - w.stage1_score AS score_delta
        FROM watchlist w LEFT JOIN ({_CASES}) c ON c.event_id = w.target_event_id""",
    doubles="score_delta",
)
def case_match(spark, sf):
    df = watchlist.case_match(_watch(spark, sf), _cases(spark, sf))
    return df.select("segment_id", "time", "matches_case", "type_hypothesis", F.array_join("action_codes", ",").alias("action_codes"), "score_delta")


@query(
    "top3_types",
    """SELECT segment_id, bin5, string_agg(l, '|' ORDER BY p DESC, l) AS top3 FROM (
         SELECT segment_id, bin5, l, p FROM (SELECT segment_id, bin5, unnest(['a', 'b', 'c', 'd']) AS l,
           unnest([stage1, student, calibrated, round(1 - risk, 6)]) AS p FROM context)
         QUALIFY row_number() OVER (PARTITION BY segment_id, bin5 ORDER BY p DESC, l) <= 3) GROUP BY ALL""",
)
def top3_types(spark, sf):
    df = staging.context(spark, sf)
    p = F.array("score_stage1_risk", "score_distilled_student", "calibrated_probability_distilled_student", F.round(1 - F.col(V.RISK), 6))
    label = F.array(*[F.lit(x) for x in "abcd"])
    return df.select(*KEY, F.array_join(F.transform(watchlist.top3_types(p, label), lambda x: x["type"]), "|").alias("top3"))


_POINTS = """
SELECT time, road_code, direction_code, position, segment_id, round_even(stake_m / 1000, 3) AS stake_km, round_even(stage1_score, 5) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY time, road_code, direction_code ORDER BY stake_m, segment_id) AS position,
         count(*) OVER (PARTITION BY time, road_code, direction_code) AS n FROM watchlist)
WHERE (position - 1) % CASE WHEN n > {0} THEN greatest(1, n // {0}) ELSE 1 END = 0"""


#: No corridor has as many points: none is left out.
_ALL_POINTS = _POINTS.format(10**12)


@query("route_series", _ALL_POINTS, doubles="stake_km", integers="direction_code")
def route_series(spark, sf):
    """Points of every corridor and time, from the nested series."""
    series = watchlist.route_series(_watch(spark, sf), ["time"])
    return series.select("time", "road_code", "direction_code", F.inline("points"))


@query("route_series_thinned", _POINTS.format(5), doubles="stake_km", integers="direction_code")
def route_series_thinned(spark, sf):
    return watchlist.route_points(_watch(spark, sf), ["time"], most=5, block_m=1000.0)


@query(
    "dashboard_kpis",
    f"""SELECT w.time, count(*) AS candidate_count, count(*) FILTER (WHERE w.score >= 0.8) AS high_risk_count, count(*) FILTER (WHERE w.score >= 0.6) AS alert_count,
               any_value(p.n) AS point_count FROM watchlist w JOIN (SELECT time, count(*) AS n FROM ({_ALL_POINTS}) GROUP BY time) p ON p.time = w.time GROUP BY w.time""",
)
def dashboard_kpis(spark, sf):
    rows = _watch(spark, sf)
    return watchlist.dashboard_kpis(rows, watchlist.route_points(rows, ["time"]), ["time"])


@query(
    "model_metric_row",
    """SELECT model, count(*) FILTER (WHERE score >= 0.6 AND y = 1) AS true_positive_count, avg((score - y) ** 2) AS brier
       FROM test_scores WHERE model = 'distilled_student' GROUP BY model""",
    doubles="brier",
)
def model_metric_row(spark, sf):
    from corridorwatch.operators import metrics
    from corridorwatch.plans.queries_metrics import _long

    table = metrics.threshold_metrics(_long(spark, sf, "test"), ["model"], F.lit(0.6))
    return watchlist.model_metric_row(table).select("model", "true_positive_count", "brier")


# --- benchmark rows and training history -------------------------------------------------------------------


def _models(spark, sf):
    return testbed.events(spark, sf).groupBy(F.col("event_type").alias("model")).agg(
        F.round(F.avg("value") / 100.0, 6).alias("composite_score"),
        F.round(F.avg(F.col("k").cast("double")), 6).alias("mean_seconds_per_case"),
        F.avg((F.col("k") > 10).cast("double")).alias("schema_validity"),
        F.avg((F.col("k") > 90).cast("double")).alias("unsupported_action_rate"),
        F.max(F.lit(None).cast("string")).alias("parameter_size"),
        F.count_if((F.col("event_type") != "view") & (F.col("k") > 50)).cast("int").alias("cases_returned"),
    )


_MODELS = """
SELECT event_type AS model, round(avg(value) / 100.0, 6) AS composite_score, round(avg(CAST(k AS DOUBLE)), 6) AS seconds_per_case,
       avg(CASE WHEN k > 10 THEN 1.0 ELSE 0.0 END) AS schema_validity, avg(CASE WHEN k > 90 THEN 1.0 ELSE 0.0 END) AS unsupported_action_rate, '' AS parameter_size
FROM ev0 WHERE event_type <> 'view' GROUP BY event_type"""


@query("successful_models", _MODELS, doubles="composite_score seconds_per_case schema_validity unsupported_action_rate")
def successful_models(spark, sf):
    return watchlist.successful_models(_models(spark, sf))


@query("benchmark_rank", f"SELECT model, composite_score, row_number() OVER (ORDER BY composite_score DESC, model) AS place FROM ({_MODELS})", doubles="composite_score")
def benchmark_rank(spark, sf):
    """The order itself is checked through the place of every model (a handful of rows)."""
    ranked = watchlist.benchmark_rank(watchlist.successful_models(_models(spark, sf)))
    listed = ranked.agg(F.array_sort(F.collect_list(F.struct((-F.col("composite_score")).alias("k"), "model", "composite_score"))).alias("m"))
    return listed.select(F.posexplode("m").alias("i", "m")).select("m.model", "m.composite_score", (F.col("i") + 1).cast("bigint").alias("place"))


@query(
    "history_long",
    """SELECT road_code AS model, 'direction_' || CAST(direction_code AS VARCHAR) AS dataset, metric, row_number() OVER (PARTITION BY road_code, direction_code, metric ORDER BY d) AS iteration, value
       FROM (SELECT road_code, direction_code, CAST(bin5 AS DATE) AS d, 'mean' AS metric, avg(risk) AS value FROM panel GROUP BY ALL
             UNION ALL SELECT road_code, direction_code, CAST(bin5 AS DATE), 'max', max(risk) FROM panel GROUP BY ALL)""",
    doubles="value",
)
def history_long(spark, sf):
    """Daily curves per corridor, nested like a training history and flattened again."""
    daily = staging.panel(spark, sf).groupBy("road_code", "direction_code", F.to_date("bin5").alias("d")).agg(F.avg(V.RISK).alias("mean"), F.max(V.RISK).alias("max"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "mean", "max")))
    curves = daily.groupBy("road_code", "direction_code").agg(ordered.alias("c")).select(
        "road_code",
        F.concat(F.lit("direction_"), F.col("direction_code").cast("string")).alias("dataset"),
        F.create_map(F.lit("mean"), F.transform("c", lambda x: x["mean"]), F.lit("max"), F.transform("c", lambda x: x["max"])).alias("metrics"),
    )
    nested = curves.groupBy(F.col("road_code").alias("model")).agg(F.map_from_entries(F.collect_list(F.struct("dataset", "metrics"))).alias("history"))
    return watchlist.history_long(nested)


# --- document ------------------------------------------------------------------------------------------------


def _document(spark, sf) -> str:
    """Writes one JSON document: the newest snapshot's top 60, the funnel, models and policies."""
    rows = _watch(spark, sf)
    newest = rows.agg(F.max("time").alias("time"))
    top = watchlist.watchlist_topk(rows.join(F.broadcast(newest), "time")).drop("rank")
    listed = top.agg(F.collect_list(F.struct(*top.columns)).alias("watchlist"), F.max("time").alias("time"))
    models = _models(spark, sf).agg(F.collect_list(F.struct("model", "composite_score", "mean_seconds_per_case", "schema_validity", "unsupported_action_rate", "parameter_size", "cases_returned")).alias("models"))
    examples = policy.policy_library(testbed.registry(spark, sf))
    library = examples.agg(F.map_from_entries(F.collect_list(F.struct("accident_type", "management_measures"))).alias("examples"))
    counts = testbed.raw_panel(spark, sf).agg(F.count(F.lit(1)).alias("records"))
    registry = testbed.registry(spark, sf)
    case = F.struct(F.col("registry_id").cast("string").alias("event_id"), "accident_type", F.when(F.col("registry_id") % 2 == 0, F.col("weather")).alias("weather"), "deaths")
    first = registry.groupBy("accident_type").agg(F.min_by(case, "registry_id").alias("case")).where(F.col("accident_type").isNotNull())
    cases = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("accident_type", "case"))), lambda x: x["case"]).alias("cases"))
    metrics = registry.agg(F.struct(F.count(F.lit(1)).alias("registry_rows"), F.lit("replay").alias("mode"), F.array(F.sum("deaths")).alias("deaths")).alias("metrics"))
    listed = with_row(with_row(listed, cases), metrics)
    doc = with_row(with_row(with_row(listed, models), library), counts).select(
        "cases",
        "metrics",
        F.element_at("cases", 1).alias("selected_case"),
        F.struct(F.lit(0.25).alias("risk_lag_5m"), F.lit(1).alias("road_is_s5")).alias("default_features"),
        F.struct(F.struct(F.size("cases").alias("cases"), F.lit(True).alias("passed")).alias("contract")).alias("validation"),
        F.struct(F.lit("road risk").alias("name"), F.lit("1").alias("version"), F.lit("replay").alias("mode")).alias("system"),
        F.struct("time", F.lit(10).alias("update_minutes"), F.lit(30).alias("prediction_horizon_minutes")).alias("snapshot"),
        F.array(F.struct(F.lit("raw_5min_100m_rows").alias("stage"), F.lit("whole_panel").alias("scope"), "records")).alias("pipeline"),
        "watchlist",
        F.struct("models").alias("benchmarks"),
        F.struct(F.lit("1.0").alias("policy_version"), F.col("examples").alias("type_specific_examples")).alias("policy_library"),
        F.array(F.lit("scores are for review")).alias("boundaries"),
    )
    path = new_path(spark, "document")
    doc.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


@query(
    "scan_document",
    """SELECT time, segment_id, score, (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(DISTINCT event_type) FROM ev0) AS models,
              (SELECT count(DISTINCT accident_type) FROM registry) AS policies
       FROM watchlist WHERE time = (SELECT max(time) FROM watchlist) ORDER BY score DESC, segment_id LIMIT 60""",
    doubles="score",
)
def scan_document(spark, sf):
    tables = files.scan_document(spark, _document(spark, sf))
    facts = with_row(
        tables["pipeline"].agg(F.max("records").alias("raw_rows")), tables["models"].agg(F.count(F.lit(1)).alias("models"))
    )
    facts = with_row(facts, tables["policies"].agg(F.count(F.lit(1)).alias("policies")))
    return with_row(tables["watchlist"].select("time", "segment_id", "score"), facts)


_CASES = """SELECT row_number() OVER (ORDER BY accident_type) - 1 AS item, * FROM (
              SELECT accident_type, min(registry_id) AS registry_id, arg_min(coalesce(weather, '?'), registry_id) AS weather, arg_min(coalesce(deaths, -1), registry_id) AS deaths
              FROM registry WHERE accident_type IS NOT NULL GROUP BY accident_type)"""
_CASE_FIELDS = """SELECT item, unnest(['event_id', 'accident_type', 'weather', 'deaths']) AS field,
                         unnest([CAST(registry_id AS VARCHAR), accident_type, CASE WHEN registry_id % 2 = 0 AND weather <> '?' THEN weather END,
                                 CASE WHEN deaths >= 0 THEN CAST(deaths AS VARCHAR) END]) AS value FROM cases"""


@query(
    "document_sections",
    f"""WITH cases AS ({_CASES}), fields AS ({_CASE_FIELDS})
        SELECT 'cases' AS section, * FROM fields WHERE value IS NOT NULL
        UNION ALL SELECT 'selected_case', 0, field, value FROM fields WHERE item = 0 AND value IS NOT NULL
        UNION ALL SELECT 'metrics', 0, unnest(['registry_rows', 'mode', 'deaths']),
                         unnest([(SELECT CAST(count(*) AS VARCHAR) FROM registry), 'replay', (SELECT '[' || CAST(sum(deaths) AS BIGINT) || ']' FROM registry)])
        UNION ALL SELECT 'default_features', 0, unnest(['risk_lag_5m', 'road_is_s5']), unnest(['0.25', '1'])
        UNION ALL SELECT 'validation', 0, 'contract', (SELECT '{{"cases":' || count(*) || ',"passed":true}}' FROM cases)""",
    integers="item",
)
def document_sections(spark, sf):
    """The sections of the document whose keys vary, one long table each."""
    tables = files.document_sections(spark, _document(spark, sf))
    return reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("section"), "*") for name, t in tables.items()])


# --- audit ------------------------------------------------------------------------------------------------------


_TIME = "strftime(TIMESTAMP '2025-09-01 00:00:00' + to_minutes(conv_id * 10 + turn), '%Y-%m-%d %H:%M:%S')"
_ID = "'AUD-' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '-' || lpad(CAST(turn AS VARCHAR), 4, '0')"
_AUDIT = f"""
SELECT {_ID} AS id, {_TIME} AS time, CASE WHEN turn > 0 THEN role ELSE '值班员' END AS operator,
       ['确认', '驳回', '转人工复核', '备注'][turn % 5 + 1] AS action, 'conv ' || CAST(conv_id AS VARCHAR) AS target,
       substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 500) AS note, CASE WHEN turn % 2 = 0 THEN role ELSE '平台操作' END AS source
FROM conversations WHERE turn % 5 <> 4"""


@query("audit_append", _AUDIT)
def audit_append(spark, sf):
    path = new_path(spark, "audit")
    audit_log.audit_append(testbed.audit_input(spark, sf), path)
    return audit_log.scan_audit(spark, path)


@query("audit_rejected", f"SELECT {_ID} AS id FROM conversations WHERE turn % 5 = 4")
def audit_rejected(spark, sf):
    return audit_log.audit_records(testbed.audit_input(spark, sf))[1].select("id")


@query("audit_list", f"SELECT id, time, action FROM ({_AUDIT}) ORDER BY time DESC, id DESC LIMIT 100")
def audit_list(spark, sf):
    path = new_path(spark, "audit")
    audit_log.audit_append(testbed.audit_input(spark, sf), path)
    return audit_log.audit_list(audit_log.scan_audit(spark, path)).select("id", "time", "action")


@query(
    "soft_target",
    """SELECT segment_id, bin5, 0.72 * target_event_30m + 0.28 * student AS soft_target,
              CASE WHEN target_event_30m = 1 THEN least(20.0, (SELECT count(*) FILTER (WHERE target_event_30m = 0) / count(*) FILTER (WHERE target_event_30m = 1) FROM context WHERE split = 'train'))
                   ELSE 1.0 END AS sample_weight FROM context WHERE split = 'train'""",
    doubles="soft_target sample_weight",
    digits=9,
)
def soft_target(spark, sf):
    """With the stand-in score in place of the teacher's."""
    from corridorwatch.operators import models

    train = staging.context(spark, sf).where("split = 'train'")
    return models.soft_target(train, "score_distilled_student").select(*KEY, "soft_target", "sample_weight")

