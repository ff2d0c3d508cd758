"""Policy, audit and request operators on hand-worked rows."""

import json

from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.operators import dispatch, packets, policy, risk, watchlist
from corridorwatch.sources import audit, files, sinks
from corridorwatch.session import new_path

PACKET = "score double, median_speed_km_h double, upstream_traffic double, downstream_traffic double, weather string, type_hypothesis string"


def test_review_of_the_known_packet(spark):
    df = spark.createDataFrame([(0.91, 23.8, 142.0, 101.0, "Overcast", "翻车")], PACKET)
    out = policy.policy_review(df).first()
    assert [a.code for a in out.actions] == [
        "VMS_WARNING", "VERIFY", "HEAVY_RESCUE", "LANE_ISOLATION", "LOW_SPEED_WARNING", "QUEUE_PROPAGATION", "WEATHER_SPEED_CONTROL",
    ]
    assert out.human_review_required and all(a.authorized and a.label for a in out.actions)
    assert out.reasoning == "监督分数 0.910；中位速度 23.8 km/h，存在低速冲击波迹象；上下游交通量差 41，需关注排队传播；天气为Overcast。"


def test_low_score_only_verifies_and_missing_values_are_neutral(spark):
    out = policy.policy_review(spark.createDataFrame([(0.59, None, None, None, None, None)], PACKET)).first()
    assert [a.code for a in out.actions] == ["VERIFY"]
    assert out.operational_state == V.STATE_KEEP and out.reasoning == "监督分数 0.590。"


def test_missing_numbers_fail_their_rule(spark):
    df = spark.createDataFrame([("碰撞", None, None, None, 90.0, None)], "accident_type string, weather string, traffic double, median_speed double, upstream_traffic double, downstream_traffic double")
    assert policy.registry_measures(df).first().management_measures == V.BASE_MEASURES + V.LANE_MEASURES


def test_answers_are_limited_to_authorised_actions(spark):
    base = policy.policy_review(spark.createDataFrame([(0.9, 80.0, 0.0, 0.0, "晴", "失火")], PACKET))
    labels = [a.label for a in base.first().actions]
    cases = {
        json.dumps({"actions": [{"label": labels[1]}, labels[0], "x", {"no": 1}], "reasoning": "r"}): ([labels[1], labels[0]], ["x"]),
        json.dumps({"actions": ["x"]}): (labels, ["x"]),
        json.dumps({"actions": 3}): (labels, []),
        "[": (labels, []),
    }
    for answer, (kept, foreign) in cases.items():
        out = policy.review_output_validate(base.withColumn("answer", F.lit(answer))).first()
        assert [a.label for a in out.actions] == kept and out.unsupported_actions == foreign
        assert out.human_review_required


def test_audit_round_trip_and_limits(spark):
    rows = [
        ("1", "2025-01-01 00:00:01", "  ", " 确认 ", "t" * 150, " n ", None),
        ("2", "2025-01-01 00:00:02", "o" * 40, "备注", None, None, "s" * 60),
        ("3", "2025-01-01 00:00:03", "op", "删除", "t", "n", "s"),
    ]
    path = new_path(spark, "audit-test")
    rejected = audit.audit_append(spark.createDataFrame(rows, "id string, time string, operator string, action string, target string, note string, source string"), path)
    assert [r.id for r in rejected.collect()] == ["3"]
    second, first = audit.audit_list(audit.scan_audit(spark, path)).collect()
    assert (first.operator, first.action, len(first.target), first.note, first.source) == (V.AUDIT_OPERATOR, "确认", 100, "n", V.AUDIT_SOURCE)
    assert (len(second.operator), second.target, len(second.source)) == (30, V.AUDIT_TARGET, 50)


def test_capacity_ranges(spark):
    df = spark.createDataFrame([("8", "3", "1", "1000"), ("21", "x", "-1", "10001"), (None, None, None, None)], "warning_capacity string, patrol_capacity string, emergency_capacity string, minimum_patrol_separation_m string")
    got = [len(r.violations) for r in dispatch.capacity_violations(df).collect()]
    assert got == [0, 4, 0]


def test_out_of_range_requests_are_named(spark):
    defaults = spark.range(1).select(*[F.lit(0.5).alias(c) for c in V.STUDENT])
    payload = spark.createDataFrame([(1.2, 0.3, "x"), (0.2, float("nan"), "2")], f"{V.RISK} double, risk_lag_5m double, hour_sin string")
    out = risk.normalize_features(payload, defaults).collect()
    assert out[0].violations == [V.RISK] and out[0].hour_sin == 0.5
    assert out[1].violations == ["hour_sin"] and out[1].risk_lag_5m == 0.5


def test_evidence_order_is_stable(spark):
    values = {"current_risk_probability": 0.2, "risk_mean_past_30m": 0.2, "risk_change_30m": -0.9, "upstream_mean_300m": 0.0, "downstream_mean_300m": 0.0, "neighborhood_max_500m": 0.9}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{c} double" for c in values))
    items = df.select(risk.evidence_items().alias("e")).first().e
    assert [i.key for i in items] == ["风险变化", "邻域峰值", "当前风险", "30分钟均值", "上游300米", "下游300米"]


def test_severity_flags(spark):
    df = spark.createDataFrame([("翻车", 1, 1, "属于"), ("追尾", None, 0, None)], "accident_type string, serious_injured int, deaths int, key_vehicle string")
    hot, calm = policy.severity_gate(df).collect()
    assert len(hot.serious_flags) == 4 and hot.predicted_severity_band == V.BAND_HIGH
    assert calm.serious_flags == [] and calm.predicted_severity_band == V.BAND_LOW


def test_packets_keep_nulls_and_text(spark):
    df = spark.createDataFrame([(7, "翻车", "重大事故", None)], "registry_id long, accident_type string, severity string, weather string")
    df = df.withColumns({"occurred_at": F.lit("2025-01-02 03:04:05").cast("timestamp_ntz"), **{c: F.lit(None).cast("double") for c in ("traffic", "median_speed", "upstream_traffic", "downstream_traffic")}})
    path = sinks.write_jsonl(packets.teacher_packets(df), new_path(spark, "jsonl-test"))
    record = json.loads(spark.read.text(path).first().value)
    assert record["input"]["weather"]["condition"] is None
    assert record["output"]["accident_type"] == "翻车" and record["output"]["human_review_required"] is True
    assert record["input"]["decision_time"] == "2025-01-02 03:04:05"


def test_watchlist_search_ignores_case(spark):
    df = spark.createDataFrame([("Seg1", "G9411", 1, 12.5, "高"), ("Seg2", "S5", 0, 3.0, "中")], "segment_id string, road_code string, direction_code int, stake_km double, risk_level string")
    assert watchlist.watchlist_filter(df, query=" SEG1 g9411 12.500 ").count() == 1
    assert [r.segment_id for r in watchlist.watchlist_filter(df, road="S5", direction="0", level="中").collect()] == ["Seg2"]


def test_registry_headers_and_year(spark):
    header = dict.fromkeys(V.REGISTRY_HEADERS, None) | {"序号": "5", "事故发生时间": "2025-02-03 04:05:00", "路线方向": "上行", "匹配桩号值(km)": "12.5"}
    old = header | {"事故发生时间": "2024-12-31 23:59:00"}
    raw = spark.createDataFrame([tuple(header.values()), tuple(old.values())], ", ".join(f"`{h}` string" for h in header))
    out = files.registry_columns(raw, 2025).collect()
    assert len(out) == 1 and out[0].direction_code == 1 and out[0].accident_stake_m == 12500.0 and out[0].registry_row == 0
