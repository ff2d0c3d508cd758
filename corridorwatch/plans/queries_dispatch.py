"""Queries: sites, costs, dispatch policies and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridorwatch.config import DispatchConfig
from corridorwatch.functions.rows import with_row
from corridorwatch.operators import costs, dispatch, sites
from corridorwatch.operators import dispatch_evaluation as evaluation
from corridorwatch.plans import staging
from corridorwatch.plans.registry import query
from corridorwatch.sources import testbed

CONFIG = DispatchConfig()
SITE = ["decision_window", "road_code", "direction_code", "spatial_zone"]

# --- sites -------------------------------------------------------------------------------


@query("candidate_min_score", "SELECT segment_id, bin5 FROM context WHERE greatest(stage1, student) >= 0.4")
def candidate_min_score(spark, sf):
    return sites.candidate_min_score(staging.context(spark, sf)).select("segment_id", "bin5")


@query(
    "site_keys",
    """SELECT segment_id, bin5, time_bucket(INTERVAL 10 MINUTE, bin5) AS decision_window, floor(stake / 500) * 500 AS spatial_zone FROM panel""",
    integers="spatial_zone",
)
def site_keys(spark, sf):
    return sites.site_keys(staging.panel(spark, sf)).select("segment_id", "bin5", "decision_window", "spatial_zone")


_SITE_COLUMNS = "decision_window, road_code, direction_code, spatial_zone, segment_count, representative_segment, stake_m, stage1_score, student_score, actual_positive, maximum_lead_time_min, event_ids"


@query(
    "aggregate_sites",
    f"SELECT {_SITE_COLUMNS} FROM site_base",
    doubles="stake_m stage1_score student_score maximum_lead_time_min",
    integers="direction_code spatial_zone segment_count actual_positive",
)
def aggregate_sites(spark, sf):
    df = sites.event_id_text(sites.aggregate_sites(staging.context(spark, sf)))
    return df.drop("event_ids").withColumnRenamed("event_ids_text", "event_ids")


@query(
    "event_id_union",
    """SELECT event_ids, count(*) AS site_count, CASE WHEN event_ids = '' THEN 0 ELSE len(string_split(event_ids, '|')) END AS ids,
              (SELECT count(DISTINCT event_id) FROM site_event) AS total_events FROM sites GROUP BY event_ids""",
    integers="ids",
)
def event_id_union(spark, sf):
    table = staging.site_table(spark, sf)
    total = sites.site_events(table).agg(F.count_distinct("event_id").alias("total_events"))
    counts = (
        sites.event_id_text(table)
        .groupBy(F.col("event_ids_text").alias("event_ids"))
        .agg(F.count(F.lit(1)).alias("site_count"), F.max(F.size("event_ids")).alias("ids"))
    )
    return with_row(counts, total)


@query("site_ids", "SELECT site_id, decision_window, road_code, direction_code, spatial_zone FROM sites", integers="direction_code spatial_zone")
def site_ids(spark, sf):
    return sites.add_site_ids(sites.aggregate_sites(staging.context(spark, sf))).select("site_id", *SITE)


@query("robust_probability", "SELECT site_id, calibrated_probability, robust_probability FROM sites", doubles="calibrated_probability robust_probability")
def robust_probability(spark, sf):
    df = staging.site_table(spark, sf).drop("robust_probability")
    return sites.add_robust_probability(df).select("site_id", "calibrated_probability", "robust_probability")


@query(
    "logit",
    "SELECT site_id, ln(least(greatest(student_score, 1e-6), 1 - 1e-6) / (1 - least(greatest(student_score, 1e-6), 1 - 1e-6))) AS log_odds FROM sites",
    doubles="log_odds",
)
def logit(spark, sf):
    from corridorwatch.functions.columns import logit as log_odds

    return staging.site_table(spark, sf).select("site_id", log_odds(F.col("student_score")).alias("log_odds"))


@query(
    "calibration_summary",
    """SELECT count(*) AS site_count, sum(actual_positive) AS positive_sites, avg(actual_positive) AS positive_rate, avg(student_score) AS raw_score_mean,
              avg(calibrated_probability) AS calibrated_probability_mean, avg((student_score - actual_positive) ** 2) AS raw_brier,
              avg((calibrated_probability - actual_positive) ** 2) AS calibrated_brier FROM sites""",
    doubles="positive_rate raw_score_mean calibrated_probability_mean raw_brier calibrated_brier",
    integers="positive_sites",
)
def calibration_summary(spark, sf):
    return sites.calibration_summary(staging.site_table(spark, sf))


@query(
    "optimization_summary",
    """SELECT count(*) AS watchlist_site_count, count(DISTINCT decision_window) AS decision_window_count,
              (SELECT count(DISTINCT event_id) FROM site_event WHERE actual_positive = 1) AS formal_event_count FROM sites""",
)
def optimization_summary(spark, sf):
    return sites.optimization_summary(staging.site_table(spark, sf))


# --- costs and policies ---------------------------------------------------------------------


@query(
    "incremental_cost",
    "SELECT site_id, scenario, warning_cost, patrol_cost, emergency_cost FROM site_costs",
    doubles="warning_cost patrol_cost emergency_cost",
    digits=8,
)
def incremental_cost(spark, sf):
    return costs.incremental_cost(staging.site_table(spark, sf)).select("site_id", "scenario", "warning_cost", "patrol_cost", "emergency_cost")


@query("scenario_strategy_cross", "SELECT site_id, scenario, strategy FROM sites CROSS JOIN scenarios CROSS JOIN strategies")
def scenario_strategy_cross(spark, sf):
    return costs.scenario_strategy_cross(staging.site_table(spark, sf))


_PICK_INTS = "warning patrol emergency"


@query("dispatch_none", "SELECT site_id, scenario, 'no_action' AS strategy, 0 AS warning, 0 AS patrol, 0 AS emergency FROM sites CROSS JOIN scenarios", integers=_PICK_INTS)
def dispatch_none(spark, sf):
    return dispatch.dispatch_none(staging.site_table(spark, sf))


@query(
    "dispatch_ranking",
    """SELECT site_id, scenario, 'stage1_priority' AS strategy, warning, patrol, emergency FROM stage1_picks
       UNION ALL SELECT site_id, scenario, 'student_priority', warning, patrol, emergency FROM student_picks""",
    integers=_PICK_INTS,
)
def dispatch_ranking(spark, sf):
    table = staging.site_table(spark, sf)
    first = dispatch.dispatch_ranking(table, "stage1_score", "stage1_priority")
    return first.unionByName(dispatch.dispatch_ranking(table, "student_score", "student_priority"))


@query("dispatch_greedy", "SELECT site_id, scenario, 'greedy_expected_utility' AS strategy, warning, patrol, emergency FROM greedy_picks", integers=_PICK_INTS)
def dispatch_greedy(spark, sf):
    return dispatch.dispatch_greedy(staging.site_table(spark, sf))


@query("dispatch_exact", "SELECT site_id, scenario, 'binary_program_expected_utility' AS strategy, warning, patrol, emergency FROM exact_picks", integers=_PICK_INTS)
def dispatch_exact(spark, sf):
    return dispatch.dispatch_exact(staging.site_table(spark, sf))


@query("dispatch_exact_robust", "SELECT site_id, scenario, 'robust_binary_program' AS strategy, warning, patrol, emergency FROM robust_picks", integers=_PICK_INTS)
def dispatch_exact_robust(spark, sf):
    return dispatch.dispatch_exact(staging.site_table(spark, sf), CONFIG, "robust_probability", "robust_binary_program")


@query(
    "dispatch_exact_cost",
    "SELECT scenario, decision_window, round(cost, 9) AS cost, n AS patrols FROM exact_best",
    doubles="cost",
    integers="patrols",
    digits=8,
)
def dispatch_exact_cost(spark, sf):
    return dispatch.solve_exact(staging.site_table(spark, sf)).select("scenario", "decision_window", "cost", "patrols")


@query(
    "patrol_subset_join",
    """SELECT decision_window, scenario, patrol_count, site_ids FROM (
         SELECT decision_window, scenario, n AS patrol_count, array_to_string(ids, '|') AS site_ids, rs, ids FROM exact_subsets WHERE n > 0)
       WHERE (SELECT bool_and(k.site_id IS NOT NULL) FROM (SELECT unnest(ids) AS s) u LEFT JOIN needed k
              ON k.site_id = u.s)""".replace("needed", """(SELECT site_id FROM (
           SELECT decision_window, site_id, road_rank, dense_rank() OVER (PARTITION BY decision_window ORDER BY top_p DESC, top_site) AS road_place FROM (
             SELECT *, first_value(site_id) OVER (PARTITION BY decision_window, road_code ORDER BY calibrated_probability DESC, site_id) AS top_site,
                    max(calibrated_probability) OVER (PARTITION BY decision_window, road_code) AS top_p,
                    row_number() OVER (PARTITION BY decision_window, road_code ORDER BY calibrated_probability DESC, site_id) AS road_rank FROM sites))
         WHERE road_rank <= 4 AND road_place <= 3)"""),
    integers="patrol_count",
)
def patrol_subset_join(spark, sf):
    return dispatch.patrol_subset_join(staging.site_table(spark, sf))


@query(
    "dispatch_snapshot_capacity",
    """SELECT time, segment_id, kind, CASE kind WHEN 'warning' THEN '发布上游预警' ELSE '预备应急资源' END AS label, '待确认' AS status FROM (
         SELECT time, segment_id, 'warning' AS kind, row_number() OVER (PARTITION BY time ORDER BY score DESC, segment_id) AS rn, 8 AS cap FROM watchlist
         UNION ALL
         SELECT time, segment_id, 'emergency', row_number() OVER (PARTITION BY time ORDER BY score DESC, segment_id), 1 FROM watchlist WHERE score >= 0.8)
       WHERE rn <= cap""",
)
def dispatch_snapshot_capacity(spark, sf):
    """Warnings and emergencies of the snapshot allocation."""
    actions = dispatch.dispatch_snapshot(_watch_rows(spark, sf), ["time"])
    return actions.where("kind <> 'patrol'").select("time", "segment_id", "kind", "label", "status")


# Third greedy pick by position: picks one and two are found first, then the best row apart from both.
_PATROL_SQL = """
SELECT time, segment_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY time ORDER BY score DESC, segment_id) AS place FROM (
    SELECT time, p1.segment_id, p1.score FROM pick1 p1
    UNION ALL SELECT time, segment_id, score FROM pick2
    UNION ALL SELECT time, segment_id, score FROM pick3)) WHERE place <= 3"""
_PICKS = {
    "pick1": "SELECT * FROM watchlist WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY time, road_code, direction_code ORDER BY score DESC, segment_id) = 1",
    "pick2": """SELECT w.* FROM watchlist w JOIN pick1 a ON w.time = a.time AND w.road_code = a.road_code AND w.direction_code = a.direction_code
                WHERE w.score >= 0.6 AND abs(w.stake_m - a.stake_m) >= 1000
                QUALIFY row_number() OVER (PARTITION BY w.time, w.road_code, w.direction_code ORDER BY w.score DESC, w.segment_id) = 1""",
    "pick3": """SELECT w.* FROM watchlist w JOIN pick1 a ON w.time = a.time AND w.road_code = a.road_code AND w.direction_code = a.direction_code
                JOIN pick2 b ON w.time = b.time AND w.road_code = b.road_code AND w.direction_code = b.direction_code
                WHERE w.score >= 0.6 AND abs(w.stake_m - a.stake_m) >= 1000 AND abs(w.stake_m - b.stake_m) >= 1000
                QUALIFY row_number() OVER (PARTITION BY w.time, w.road_code, w.direction_code ORDER BY w.score DESC, w.segment_id) = 1""",
}


def _with_picks(body: str) -> str:
    from corridorwatch.plans import oracle

    oracle.CTES.update(_PICKS)
    return body


@query("dispatch_snapshot", _with_picks(_PATROL_SQL), doubles="score")
def dispatch_snapshot(spark, sf):
    """Patrols of the snapshot allocation at every snapshot time."""
    actions = dispatch.dispatch_snapshot(_watch_rows(spark, sf), ["time"])
    return actions.where("kind = 'patrol'").select("time", "segment_id", "score")


@query(
    "dispatch_snapshot_counts",
    """SELECT w.time, count(*) AS candidate_count, least(count(*), 8) AS warning_count,
              (SELECT count(*) FROM (""" + _PATROL_SQL + """) p WHERE p.time = w.time) AS patrol_count,
              CASE WHEN max(score) >= 0.8 THEN 1 ELSE 0 END AS emergency_count FROM watchlist w GROUP BY w.time""",
    integers="warning_count emergency_count",
)
def dispatch_snapshot_counts(spark, sf):
    rows = _watch_rows(spark, sf)
    return dispatch.snapshot_counts(rows, dispatch.dispatch_snapshot(rows, ["time"]), ["time"])


def _watch_rows(spark, sf):
    from corridorwatch.operators import watchlist

    return watchlist.watchlist_projection(staging.context(spark, sf))


@query(
    "capacity_check",
    """SELECT event_id, concat_ws(',', CASE WHEN k > 20 THEN 'warning_capacity' END, CASE WHEN k % 10 = 3 THEN 'patrol_capacity' END,
              CASE WHEN k - 5 < 0 THEN 'emergency_capacity' WHEN k - 5 > 20 THEN 'emergency_capacity' END,
              CASE WHEN k * 200 > 10000 THEN 'minimum_patrol_separation_m' END) AS violations FROM ev0""",
)
def capacity_check(spark, sf):
    k = F.col("k")
    configs = testbed.events(spark, sf).select(
        "event_id",
        k.cast("string").alias("warning_capacity"),
        F.when(k % 10 == 3, "two").when(k % 10 != 4, "3").alias("patrol_capacity"),
        (k - 5).alias("emergency_capacity"),
        (k * 200).alias("minimum_patrol_separation_m"),
    )
    checked = dispatch.capacity_violations(configs)
    return checked.select("event_id", F.array_join("violations", ",").alias("violations"))


# Two requests for every snapshot: one leaves all settings open, one names them, at times badly.
_PICKS.update(
    {
        "requests": """SELECT time, time || '#' || r AS request_id, r, k, CASE WHEN r = 1 AND k % 7 = 3 THEN 'two' WHEN r = 1 THEN CAST(k % 4 AS VARCHAR) END AS patrol_text,
                              CASE WHEN r = 0 THEN 8 ELSE k % 21 END AS warning_n, CASE WHEN r = 0 THEN 3 ELSE k % 4 END AS patrol_n,
                              CASE WHEN r = 0 THEN 1 ELSE k % 3 END AS emergency_n, CASE WHEN r = 0 THEN 1000 ELSE (k % 5) * 500 END AS apart
                       FROM (SELECT DISTINCT time, CAST(floor(epoch(strptime(time, '%Y-%m-%d %H:%M:%S')) / 300) AS BIGINT) AS k FROM watchlist), (SELECT unnest([0, 1]) AS r)""",
        "asked": "SELECT w.*, q.* EXCLUDE (time) FROM watchlist w JOIN requests q USING (time) WHERE patrol_text IS NULL OR patrol_text <> 'two'",
        "asked1": """SELECT * FROM asked WHERE score >= 0.6 AND patrol_n >= 1
                     QUALIFY row_number() OVER (PARTITION BY request_id, road_code, direction_code ORDER BY score DESC, segment_id) = 1""",
        "asked2": """SELECT w.* FROM asked w JOIN asked1 a USING (request_id, road_code, direction_code)
                     WHERE w.score >= 0.6 AND w.patrol_n >= 2 AND abs(w.stake_m - a.stake_m) >= w.apart AND w.segment_id <> a.segment_id
                     QUALIFY row_number() OVER (PARTITION BY w.request_id, w.road_code, w.direction_code ORDER BY w.score DESC, w.segment_id) = 1""",
        "asked3": """SELECT w.* FROM asked w JOIN asked1 a USING (request_id, road_code, direction_code) JOIN asked2 b USING (request_id, road_code, direction_code)
                     WHERE w.score >= 0.6 AND w.patrol_n >= 3 AND abs(w.stake_m - a.stake_m) >= w.apart AND w.segment_id <> a.segment_id
                       AND abs(w.stake_m - b.stake_m) >= w.apart AND w.segment_id <> b.segment_id
                     QUALIFY row_number() OVER (PARTITION BY w.request_id, w.road_code, w.direction_code ORDER BY w.score DESC, w.segment_id) = 1""",
    }
)


def _requests(spark, sf):
    times = _watch_rows(spark, sf).select("time").distinct()
    k = F.floor(F.unix_timestamp(F.to_timestamp("time")) / 300)
    named = F.col("r") == 1
    return times.select("time", F.explode(F.array(F.lit(0), F.lit(1))).alias("r"), k.alias("k")).select(
        F.concat_ws("#", "time", "r").alias("request_id"),
        "time",
        F.lit(None).cast("string").alias("scenario"),
        F.when(named, F.col("k") % 21).alias("warning_capacity"),
        F.when(named & (F.col("k") % 7 == 3), "two").when(named, (F.col("k") % 4).cast("string")).alias("patrol_capacity"),
        F.when(named, F.col("k") % 3).alias("emergency_capacity"),
        F.when(named, F.col("k") % 5 * 500).alias("minimum_patrol_separation_m"),
    )


@query(
    "dispatch_requests",
    _with_picks("""SELECT request_id, time, 'loss_cost_ratio_5000' AS scenario, kind, segment_id, score, stake_km FROM (
         SELECT *, 'warning' AS kind, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, segment_id) AS place, warning_n AS n FROM asked
         UNION ALL
         SELECT *, 'emergency' AS kind, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, segment_id) AS place, emergency_n AS n FROM asked WHERE score >= 0.8
         UNION ALL
         SELECT *, 'patrol' AS kind, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, segment_id) AS place, patrol_n AS n
         FROM (SELECT * FROM asked1 UNION ALL SELECT * FROM asked2 UNION ALL SELECT * FROM asked3))
       WHERE place <= n"""),
    doubles="score stake_km",
)
def dispatch_requests(spark, sf):
    """Allocations with capacities and separation from a table, two per snapshot."""
    actions, _ = dispatch.dispatch_requests(_watch_rows(spark, sf), _requests(spark, sf), ["time"])
    return actions.select("request_id", "time", "scenario", "kind", "segment_id", "score", "stake_km")


@query("dispatch_requests_rejected", "SELECT request_id, 'patrol_capacity' AS violations FROM requests WHERE patrol_text = 'two'")
def dispatch_requests_rejected(spark, sf):
    _, rejected = dispatch.dispatch_requests(_watch_rows(spark, sf), _requests(spark, sf), ["time"])
    return rejected.select("request_id", F.array_join("violations", ",").alias("violations"))


# --- decisions and evaluation --------------------------------------------------------------------


@query(
    "dispatch_decisions",
    "SELECT site_id, scenario, strategy, warning, patrol, emergency FROM decided",
    integers=_PICK_INTS,
)
def dispatch_decisions(spark, sf):
    return staging.decision_table(spark, sf)


@query(
    "sites_decisions",
    """SELECT d.site_id, scenario, strategy, patrol, d.actual_positive, d.student_score, 0 AS duplicate_keys FROM decided d""",
    doubles="student_score",
    integers="patrol actual_positive duplicate_keys",
)
def sites_decisions(spark, sf):
    decided = staging.decision_table(spark, sf)
    merged = evaluation.sites_decisions(staging.site_table(spark, sf), decided)
    duplicates = evaluation.duplicate_decisions(decided).agg(F.count(F.lit(1)).alias("duplicate_keys"))
    columns = ["site_id", "scenario", "strategy", "patrol", "actual_positive", "student_score"]
    return with_row(merged.select(*columns), duplicates)


@query(
    "dispatch_evaluate",
    """SELECT b.scenario, b.strategy, b.site_count, t.event_count, coalesce(x.n, 0) AS detected_event_count,
              coalesce(x.n, 0) / greatest(t.event_count, 1) AS event_recall, b.tp / greatest(b.tp + b.fp, 1) AS patrol_precision,
              b.warning_actions, b.patrol_actions, b.emergency_actions, b.fp AS false_patrol_actions, b.tp AS true_patrol_actions,
              b.patrol_actions / t.days AS patrol_actions_per_day, l.lead AS mean_maximum_lead_time_min
       FROM (SELECT scenario, strategy, count(*) AS site_count, sum(warning) AS warning_actions, sum(patrol) AS patrol_actions,
                    sum(emergency) AS emergency_actions, sum(patrol * actual_positive) AS tp, sum(patrol * (1 - actual_positive)) AS fp
             FROM decided GROUP BY ALL) b
       CROSS JOIN (SELECT (SELECT count(DISTINCT event_id) FROM site_event WHERE actual_positive = 1) AS event_count,
                          (SELECT count(DISTINCT CAST(decision_window AS DATE)) FROM sites) AS days) t
       LEFT JOIN (SELECT scenario, strategy, count(DISTINCT v.event_id) AS n FROM decided d JOIN site_event v USING (site_id)
                  WHERE patrol = 1 AND d.actual_positive = 1 GROUP BY ALL) x ON x.scenario = b.scenario AND x.strategy = b.strategy
       LEFT JOIN (SELECT scenario, strategy, avg(m) AS lead FROM (SELECT scenario, strategy, event_ids, max(maximum_lead_time_min) AS m
                  FROM decided WHERE patrol = 1 AND actual_positive = 1 GROUP BY ALL) GROUP BY ALL) l ON l.scenario = b.scenario AND l.strategy = b.strategy""",
    doubles="event_recall patrol_precision patrol_actions_per_day mean_maximum_lead_time_min",
    integers="site_count event_count detected_event_count warning_actions patrol_actions emergency_actions false_patrol_actions true_patrol_actions",
)
def dispatch_evaluate(spark, sf):
    return evaluation.dispatch_evaluate(staging.pick_table(spark, sf), staging.site_table(spark, sf))


@query("realized_cost", "SELECT * FROM realized", doubles="realized_normalized_event_cost")
def realized_cost(spark, sf):
    return staging.cost_table(spark, sf)


@query(
    "cost_reduction",
    """SELECT *, (max(CASE WHEN strategy = 'no_action' THEN realized_normalized_event_cost END) OVER w - realized_normalized_event_cost)
              / greatest(max(CASE WHEN strategy = 'no_action' THEN realized_normalized_event_cost END) OVER w, 1) AS event_cost_reduction_vs_no_action
       FROM realized WINDOW w AS (PARTITION BY scenario)""",
    doubles="realized_normalized_event_cost event_cost_reduction_vs_no_action",
)
def cost_reduction(spark, sf):
    return evaluation.cost_reduction(staging.cost_table(spark, sf))


@query(
    "best_by_scenario",
    """SELECT scenario, strategy, realized_normalized_event_cost FROM realized
       QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY round(realized_normalized_event_cost, 6), strategy) = 1""",
    doubles="realized_normalized_event_cost",
)
def best_by_scenario(spark, sf):
    return evaluation.best_by_scenario(staging.cost_table(spark, sf))
