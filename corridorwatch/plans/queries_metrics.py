"""Queries: score metrics, thresholds, bootstrap, classification reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.operators import metrics, multiclass, profiling
from corridorwatch.plans import staging
from corridorwatch.plans.registry import query
from corridorwatch.sources import testbed

SCORES = {
    "score_stage1_risk": "stage1_risk",
    "score_distilled_student": "distilled_student",
    "calibrated_probability_distilled_student": "calibrated",
}


def _long(spark, sf, split=None):
    df = staging.context(spark, sf)
    if split:
        df = df.where(F.col("split") == split)
    keep = ["segment_id", "bin5", "split", "target_event_30m", "target_event_id", "lead_time_min"]
    return metrics.long_scores(df, SCORES, keep).withColumnsRenamed({"target_event_30m": "y", "target_event_id": "event_id"})


_COUNTS = """
SELECT model, count(*) AS "rows", sum(y) AS positive_rows, sum(CASE WHEN score >= 0.6 AND y = 1 THEN 1 ELSE 0 END) AS true_positive_count,
       sum(CASE WHEN score >= 0.6 AND y = 0 THEN 1 ELSE 0 END) AS false_positive_count, avg((score - y) ** 2) AS brier,
       avg(CASE WHEN score >= 0.6 THEN 1.0 ELSE 0.0 END) AS alert_rate FROM test_scores GROUP BY model"""


@query(
    "binary_metrics",
    f"""SELECT c.*, CASE WHEN c.true_positive_count + c.false_positive_count = 0 THEN 0 ELSE c.true_positive_count / (c.true_positive_count + c.false_positive_count) END AS "precision",
               c.true_positive_count / c.positive_rows AS recall,
               2 * c.true_positive_count / (c.true_positive_count + c.false_positive_count + c.positive_rows) AS f1, a.roc_auc, a.pr_auc
        FROM ({_COUNTS}) c JOIN areas a ON a.model = c.model""",
    doubles="brier alert_rate recall f1 roc_auc pr_auc precision",
    integers="positive_rows true_positive_count false_positive_count",
)
def binary_metrics(spark, sf):
    return metrics.binary_metrics(_long(spark, sf, "test"), ["model"], F.lit(0.6))


@query("roc_auc", "SELECT model, roc_auc FROM areas", doubles="roc_auc")
def roc_auc(spark, sf):
    return metrics.areas(_long(spark, sf, "test"), ["model"]).select("model", "roc_auc")


@query("pr_auc", "SELECT model, pr_auc FROM areas", doubles="pr_auc")
def pr_auc(spark, sf):
    return metrics.areas(_long(spark, sf, "test"), ["model"]).select("model", "pr_auc")


@query("brier", "SELECT model, split, avg((score - y) ** 2) AS brier FROM long_scores WHERE split IS NOT NULL GROUP BY ALL", doubles="brier")
def brier(spark, sf):
    return metrics.brier(_long(spark, sf).where("split IS NOT NULL"), ["model", "split"])


_SWEEP = """
SELECT model, threshold, sum(CASE WHEN score >= threshold AND y = 1 THEN 1 ELSE 0 END) AS tp,
       sum(CASE WHEN score >= threshold AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(y) AS p
FROM (SELECT model, score, y FROM long_scores WHERE split = 'validation')
CROSS JOIN (SELECT round(0.6 + 0.35 * i / 70, 3) AS threshold FROM range(71) t(i)) GROUP BY ALL"""
_F1 = "CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / CAST(tp + fp + p AS DOUBLE) END"


@query("threshold_sweep", f"SELECT model, threshold, tp, fp, {_F1} AS f1 FROM ({_SWEEP})", doubles="threshold f1", integers="tp fp")
def threshold_sweep(spark, sf):
    return metrics.threshold_curve(_long(spark, sf, "validation"), ["model"])


@query(
    "choose_threshold",
    f"""SELECT model, threshold, f1 FROM (SELECT model, threshold, {_F1} AS f1 FROM ({_SWEEP}))
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) = 1""",
    doubles="threshold f1",
)
def choose_threshold(spark, sf):
    return metrics.choose_threshold(_long(spark, sf, "validation"), ["model"])


_EVENT = """
SELECT model, count(*) AS event_count, count(*) FILTER (WHERE peak >= 0.6) AS detected_event_count,
       median(lead) FILTER (WHERE peak >= 0.6) AS median_lead_time_min, avg(lead) FILTER (WHERE peak >= 0.6) AS mean_lead_time_min,
       count(*) FILTER (WHERE peak >= 0.6) / count(*) AS event_recall
FROM (SELECT model, event_id, max(score) AS peak, max(CASE WHEN score >= 0.6 THEN lead_time_min END) AS lead
      FROM test_scores WHERE y = 1 GROUP BY ALL) GROUP BY model"""


@query("event_level_metrics", _EVENT, doubles="median_lead_time_min mean_lead_time_min event_recall")
def event_level_metrics(spark, sf):
    return metrics.event_level_metrics(_long(spark, sf, "test"), ["model"], F.lit(0.6))


@query(
    "detected_event_rows",
    """SELECT segment_id, bin5, event_id FROM test_scores t WHERE model = 'distilled_student' AND y = 1 AND score >= 0.6
       AND event_id IN (SELECT event_id FROM test_scores WHERE model = 'distilled_student' AND y = 1 GROUP BY event_id HAVING max(score) >= 0.6)""",
)
def detected_event_rows(spark, sf):
    df = _long(spark, sf, "test").where("model = 'distilled_student'")
    return metrics.detected_event_rows(df, 0.6).select("segment_id", "bin5", "event_id")


@query(
    "false_alarm_reduction",
    f"""WITH c AS ({_COUNTS}) SELECT model, false_positive_count,
          (b.fp - false_positive_count) / greatest(b.fp, 1) AS false_alarm_reduction_vs_stage1
        FROM c CROSS JOIN (SELECT false_positive_count AS fp FROM c WHERE model = 'stage1_risk') b""",
    doubles="false_alarm_reduction_vs_stage1",
    integers="false_positive_count",
)
def false_alarm_reduction(spark, sf):
    table = metrics.threshold_metrics(_long(spark, sf, "test"), ["model"], F.lit(0.6))
    return metrics.false_alarm_reduction(table).select("model", "false_positive_count", "false_alarm_reduction_vs_stage1")


_ITERATIONS = 200


@query(
    "bootstrap_ci",
    f"""WITH s AS (SELECT CAST(bin5 AS DATE) AS date, y, score FROM test_scores WHERE model = 'distilled_student'),
        days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM s)),
        n AS (SELECT count(*) AS n FROM days),
        w AS (SELECT iteration, day, count(*) AS weight FROM (
               SELECT i AS iteration, CAST('0x' || substr(md5('20260730|' || CAST(i AS VARCHAR) || '|' || CAST(d.day AS VARCHAR)), 1, 8) AS BIGINT) % n.n AS day
               FROM range({_ITERATIONS}) t(i) CROSS JOIN days d CROSS JOIN n) GROUP BY ALL),
        c AS (SELECT iteration, score, sum(weight * y) AS pos, sum(weight * (1 - y)) AS neg
              FROM s JOIN days USING (date) JOIN w USING (day) GROUP BY ALL),
        st AS (SELECT *, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp, sum(pos) OVER (PARTITION BY iteration) AS p, sum(neg) OVER (PARTITION BY iteration) AS q
               FROM c WINDOW v AS (PARTITION BY iteration ORDER BY score DESC)),
        m AS (SELECT iteration, sum(neg * (tp - pos / 2)) / (max(p) * max(q)) AS roc_auc, sum(pos * tp / CAST(tp + fp AS DOUBLE)) / max(p) AS pr_auc,
                     2 * sum(CASE WHEN score >= 0.6 THEN pos ELSE 0 END) / CAST(sum(CASE WHEN score >= 0.6 THEN pos + neg ELSE 0 END) + max(p) AS DOUBLE) AS f1
              FROM st WHERE p > 0 AND q > 0 GROUP BY iteration)
        SELECT metric, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, count(*) AS samples
        FROM (SELECT 'pr_auc' AS metric, pr_auc AS v FROM m UNION ALL SELECT 'roc_auc', roc_auc FROM m UNION ALL SELECT 'f1', f1 FROM m) GROUP BY metric""",
    doubles="low high",
)
def bootstrap_ci(spark, sf):
    df = _long(spark, sf, "test").where("model = 'distilled_student'").withColumn("date", F.to_date("bin5"))
    return metrics.bootstrap_ci(df.select("date", "y", "score"), 0.6, _ITERATIONS)


# --- classes ---------------------------------------------------------------------------------


@query("response_family", "SELECT registry_id, true_family AS true_response_family, predicted_family AS predicted_response_family FROM family")
def response_family(spark, sf):
    return multiclass.add_families(testbed.registry(spark, sf)).select("registry_id", "true_response_family", "predicted_response_family")


_ACTIONS_SQL = " ".join(f"WHEN '{f}' THEN ['" + "', '".join(a) + "']" for f, a in V.FAMILY_ACTIONS.items())
_SETS = f"SELECT registry_id, true_family, predicted_family, CASE predicted_family {_ACTIONS_SQL} END AS l, CASE true_family {_ACTIONS_SQL} END AS r FROM family"


@query(
    "set_f1",
    f"""SELECT registry_id, CASE WHEN o = 0 THEN 0 ELSE 2 * (o / l) * (o / r) / (o / l + o / r) END AS policy_action_f1
        FROM (SELECT registry_id, len(list_intersect(l, r)) AS o, len(l) AS l, len(r) AS r FROM ({_SETS}))""",
    doubles="policy_action_f1",
)
def set_f1(spark, sf):
    return multiclass.add_families(testbed.registry(spark, sf)).select("registry_id", "policy_action_f1")


@query("set_intersect", f"SELECT registry_id, array_to_string(list_sort(list_intersect(l, r)), '|') AS shared_actions FROM ({_SETS})")
def set_intersect(spark, sf):
    df = multiclass.add_families(testbed.registry(spark, sf))
    left, right = (multiclass.family_actions(F.col(c)) for c in ("predicted_response_family", "true_response_family"))
    return df.select("registry_id", F.array_join(multiclass.set_intersect(left, right), "|").alias("shared_actions"))


_PIVOT = ", ".join(f"""count(*) FILTER (WHERE predicted_family = '{x}') AS "{x}\"""" for x in V.FAMILY_LABELS)
_POSITION = "CASE l " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(V.FAMILY_LABELS)) + " END"


@query(
    "confusion_matrix",
    f"""SELECT {_POSITION} AS position, l AS truth, {_PIVOT}
        FROM (SELECT unnest(['Lane-conflict', 'Rollover', 'Fire', 'Other']) AS l) LEFT JOIN family ON true_family = l GROUP BY l""",
    integers="position",
)
def confusion_matrix(spark, sf):
    df = multiclass.add_families(testbed.registry(spark, sf))
    return multiclass.confusion_matrix(df, "true_response_family", "predicted_response_family", V.FAMILY_LABELS)


_REPORT = """
SELECT label, hits, support, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS prec,
       CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall, 2 * hits / (predicted + support) AS f1
FROM (SELECT label, count(*) FILTER (WHERE accident_type = label AND predicted_type = label) AS hits,
             count(*) FILTER (WHERE predicted_type = label) AS predicted, count(*) FILTER (WHERE accident_type = label) AS support
      FROM registry CROSS JOIN (SELECT unnest(['碰撞', '追尾', '刮擦', '翻车', '失火', '其他']) AS label) GROUP BY label)"""


@query("class_report", _REPORT, doubles="prec recall f1")
def class_report(spark, sf):
    return multiclass.class_report(testbed.registry(spark, sf), "accident_type", "predicted_type").withColumnRenamed("precision", "prec")


@query(
    "multiclass_metrics",
    f"""SELECT sum(support) AS "rows", sum(hits) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy,
               avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM ({_REPORT})""",
    doubles="accuracy balanced_accuracy macro_f1 weighted_f1",
    integers='"rows"',
)
def multiclass_metrics(spark, sf):
    return multiclass.multiclass_metrics(testbed.registry(spark, sf), "accident_type", "predicted_type")


@query(
    "family_summary",
    f"""WITH r AS (SELECT label, hits, support, hits / support AS recall, 2 * hits / (predicted + support) AS f1 FROM (
             SELECT label, count(*) FILTER (WHERE true_family = label AND predicted_family = label) AS hits,
                    count(*) FILTER (WHERE predicted_family = label) AS predicted, count(*) FILTER (WHERE true_family = label) AS support
             FROM family CROSS JOIN (SELECT unnest(['Lane-conflict', 'Rollover', 'Fire', 'Other']) AS label) GROUP BY label))
        SELECT (SELECT count(*) FROM family) AS test_events,
               (SELECT avg(CASE WHEN accident_type = predicted_type THEN 1.0 ELSE 0.0 END) FROM family) AS six_class_type_accuracy,
               sum(hits) / sum(support) AS operational_family_accuracy, avg(recall) AS operational_family_balanced_accuracy,
               avg(f1) AS operational_family_macro_f1,
               (SELECT avg(CASE WHEN o = 0 THEN 0 ELSE 2 * (o / l) * (o / r) / (o / l + o / r) END)
                FROM (SELECT len(list_intersect(l, r)) AS o, len(l) AS l, len(r) AS r FROM ({_SETS}))) AS mean_policy_action_f1
        FROM r""",
    doubles="six_class_type_accuracy operational_family_accuracy operational_family_balanced_accuracy operational_family_macro_f1 mean_policy_action_f1",
)
def family_summary(spark, sf):
    return multiclass.family_summary(testbed.registry(spark, sf))


@query(
    "value_counts",
    """SELECT 'accident_type' AS name, accident_type AS value, count(*) AS "count" FROM registry WHERE accident_type IS NOT NULL GROUP BY ALL
       UNION ALL SELECT 'severity', severity, count(*) FROM registry WHERE severity IS NOT NULL GROUP BY ALL
       UNION ALL SELECT 'weather', weather, count(*) FROM registry WHERE weather IS NOT NULL GROUP BY ALL""",
)
def value_counts(spark, sf):
    df = testbed.registry(spark, sf)
    parts = [
        multiclass.value_counts(df, n).select(F.lit(n).alias("name"), F.col(n).alias("value"), "count")
        for n in ("accident_type", "severity", "weather")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "dictionary_join",
    """SELECT registry_id, CASE WHEN weather = '小雨' THEN 'rain' WHEN weather = '大雾' THEN 'fog' END AS weather_code,
              true_family AS family, accident_type AS label FROM family""",
)
def dictionary_join(spark, sf):
    """Code lookups: unknown keys give NULL, or the key itself where a default is asked for."""
    from corridorwatch.functions.columns import lookup

    return testbed.registry(spark, sf).select(
        "registry_id",
        lookup({"小雨": "rain", "大雾": "fog"}, F.col("weather")).alias("weather_code"),
        multiclass.response_family(F.col("accident_type")).alias("family"),
        multiclass.label_of({"no such type": "-"}, F.col("accident_type")).alias("label"),
    )


@query(
    "funnel",
    """WITH s AS (SELECT 0 AS position, 'raw_5min_100m_rows' AS stage, (SELECT count(*) FROM raw) AS records
                  UNION ALL SELECT 1, 'candidates', (SELECT count(*) FROM context WHERE greatest(stage1, student) >= 0.4)
                  UNION ALL SELECT 2, 'watchlist_sites', (SELECT count(*) FROM sites))
       SELECT position, stage, 'whole_panel' AS scope, records, records / max(CASE WHEN position = 0 THEN records END) OVER () AS retained_fraction_vs_raw,
              greatest(1.0, log10(records + 1) / log10(max(records) OVER () + 1) * 100) AS bar_width FROM s""",
    doubles="retained_fraction_vs_raw bar_width",
    integers="position",
)
def funnel(spark, sf):
    from corridorwatch.operators.sites import candidate_min_score

    stages = {
        "raw_5min_100m_rows": testbed.raw_panel(spark, sf),
        "candidates": candidate_min_score(staging.context(spark, sf)),
        "watchlist_sites": staging.site_table(spark, sf),
    }
    return profiling.funnel(stages, "whole_panel")
