"""Reference SQL for DuckDB: the shared table expressions and their assembly.

Written independently of the DataFrame code: plain range joins, plain windows.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["ev0"] = """
SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       TIMESTAMP '2025-08-29 00:00:00' + to_days(CAST(d // 5 AS INTEGER))
         + to_minutes(CAST(5 * ((d % 5) * 4 + hour(ts) // 6) AS BIGINT)) AS bin5
FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events)"""

CTES["raw"] = """
SELECT CAST(user_id AS VARCHAR) AS segment_id, bin5,
       CASE WHEN event_id % 17 = 0 THEN '2025-07' ELSE strftime(bin5, '%Y-%m') END AS source_month,
       CAST((user_id // 2) % 2 AS INTEGER) AS direction_code,
       CASE WHEN user_id % 2 = 0 THEN 'G9411' ELSE 'S5' END AS road_code,
       CASE WHEN (user_id // 2) % 2 = 1 THEN '上行' ELSE '下行' END AS road_direction,
       (user_id // 4) * CAST(100.0 AS DOUBLE) AS stake,
       CASE WHEN event_type = 'error' AND k % 10 = 0 THEN 1 ELSE 0 END AS accident_label,
       1 + k % 3 AS accident_level,
       CASE WHEN k = 0 THEN '0' ELSE 'E' || CAST(event_id AS VARCHAR) END AS accident_id,
       value / CAST(150.0 AS DOUBLE) AS risk,
       value / CAST(150.0 AS DOUBLE) * CAST(0.9 AS DOUBLE) AS current_risk,
       value / CAST(150.0 AS DOUBLE) * CAST(0.8 AS DOUBLE) AS collision_risk,
       event_id AS source_row
FROM ev0"""

CTES["clean"] = """
SELECT * REPLACE (least(greatest(risk, 0.0), 1.0) AS risk,
                  CASE WHEN accident_label > 0 AND accident_id = '0' THEN 0 ELSE accident_level END AS accident_level,
                  CASE WHEN accident_label > 0 AND accident_id = '0' THEN 0 ELSE accident_label END AS accident_label)
FROM raw WHERE risk IS NOT NULL AND stake IS NOT NULL"""

CTES["panel"] = """
SELECT * EXCLUDE (rn), CASE WHEN direction_code = 1 THEN stake ELSE -stake END AS travel_stake
FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, bin5 ORDER BY risk DESC, source_row DESC) AS rn FROM clean
      WHERE strftime(bin5, '%Y-%m') = source_month)
WHERE rn = 1"""

CTES["accidents"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY CAST(bin5 AS DATE), accident_id ORDER BY bin5, segment_id) AS rn
  FROM panel WHERE accident_label > 0) WHERE rn = 1"""

CTES["near_pairs"] = """
SELECT p.segment_id, p.bin5, e.accident_id, e.accident_level, date_diff('second', p.bin5, e.bin5) / 60.0 AS lead
FROM panel p JOIN accidents e
  ON p.road_code = e.road_code AND p.direction_code = e.direction_code AND CAST(p.bin5 AS DATE) = CAST(e.bin5 AS DATE)
 AND abs(p.stake - e.stake) <= 300
 AND e.bin5 BETWEEN p.bin5 - INTERVAL 30 MINUTE AND p.bin5 + INTERVAL 30 MINUTE"""

CTES["labelled"] = """
SELECT p.*, CASE WHEN n.lead IS NULL THEN 0 ELSE 1 END AS target_event_30m, coalesce(n.accident_id, '') AS target_event_id,
       coalesce(n.accident_level, 0) AS target_event_level, n.lead AS lead_time_min,
       CASE WHEN g.segment_id IS NULL THEN 0 ELSE 1 END AS event_guard
FROM panel p
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, bin5 ORDER BY lead, accident_id) AS rn
                          FROM near_pairs WHERE lead > 0) WHERE rn = 1) n
  ON p.segment_id = n.segment_id AND p.bin5 = n.bin5
LEFT JOIN (SELECT DISTINCT segment_id, bin5 FROM near_pairs) g ON p.segment_id = g.segment_id AND p.bin5 = g.bin5"""

CTES["spatial"] = """
SELECT *, down3 - up3 AS gradient,
       risk - CASE WHEN up3 IS NULL THEN down3 WHEN down3 IS NULL THEN up3 ELSE (up3 + down3) / 2 END AS contrast,
       least(greatest(1.0 - nb_std / (abs(nb_mean) + 1e-6), -2.0), 1.0) AS coherence
FROM (
  SELECT *,
    lag(risk, 1) OVER w AS up_100, lag(risk, 2) OVER w AS up_200, lag(risk, 3) OVER w AS up_300,
    lag(risk, 4) OVER w AS up_400, lag(risk, 5) OVER w AS up_500,
    lead(risk, 1) OVER w AS down_100, lead(risk, 2) OVER w AS down_200, lead(risk, 3) OVER w AS down_300,
    lead(risk, 4) OVER w AS down_400, lead(risk, 5) OVER w AS down_500,
    avg(risk) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS up3,
    max(risk) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS up3_max,
    avg(risk) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS down3,
    max(risk) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS down3_max,
    avg(risk) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS nb_mean,
    max(risk) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS nb_max,
    coalesce(stddev_samp(risk) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 0.0) AS nb_std,
    sum(CASE WHEN risk >= 0.6 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS nb_high
  FROM labelled
  WINDOW w AS (PARTITION BY bin5, road_code, direction_code ORDER BY travel_stake, segment_id))"""

CTES["temporal"] = """
SELECT *, risk - lag5 AS change5, risk - lag30 AS change30, (risk - lag5) - (lag5 - lag10) AS acceleration
FROM (
  SELECT *,
    lag(risk, 1) OVER w AS lag5, lag(risk, 2) OVER w AS lag10, lag(risk, 4) OVER w AS lag20, lag(risk, 6) OVER w AS lag30,
    CASE WHEN count(*) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 2
         THEN avg(risk) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS past_mean,
    CASE WHEN count(*) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 2
         THEN max(risk) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS past_max,
    coalesce(stddev_samp(risk) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0.0) AS past_std
  FROM spatial
  WINDOW w AS (PARTITION BY segment_id, CAST(bin5 AS DATE) ORDER BY bin5))"""

CTES["context"] = """
SELECT *, CASE WHEN target_event_30m = 1 THEN 'future_event' WHEN risk >= 0.6 THEN 'hard_negative'
               WHEN risk >= 0.4 THEN 'uncertain_negative' ELSE 'random_negative' END AS candidate_source,
  CASE WHEN bin5 <= TIMESTAMP '2025-08-31 23:59:59' THEN 'train' WHEN bin5 <= TIMESTAMP '2025-09-01 23:59:59' THEN 'validation'
       WHEN bin5 <= TIMESTAMP '2025-09-03 23:59:59' THEN 'test' END AS split,
  round(1.0 / (1.0 + exp(3.0 - 1.2 * ln(least(greatest(student, 1e-6), 1 - 1e-6) / (1 - least(greatest(student, 1e-6), 1 - 1e-6))))), 6) AS calibrated
FROM (
  SELECT *, round(risk, 6) AS stage1,
    round(least(greatest(CAST(0.6 AS DOUBLE) * risk + CAST(0.24 AS DOUBLE) * coalesce(past_mean, 0.0)
                         + CAST(0.16 AS DOUBLE) * nb_max, 0.0), 1.0), 6) AS student
  FROM temporal)"""

CTES["site_base"] = """
SELECT decision_window, road_code, direction_code, spatial_zone,
       count(DISTINCT segment_id) AS segment_count,
       arg_min(segment_id, (epoch_us(bin5), stake, segment_id)) AS representative_segment,
       avg(stake) AS stake_m, max(stage1) AS stage1_score, max(student) AS student_score,
       max(target_event_30m) AS actual_positive, max(lead_time_min) AS maximum_lead_time_min,
       coalesce(string_agg(DISTINCT target_event_id, '|' ORDER BY target_event_id)
                FILTER (WHERE trim(target_event_id) NOT IN ('', '0')), '') AS event_ids
FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, bin5) AS decision_window,
             CAST(floor(stake / 500) * 500 AS INTEGER) AS spatial_zone
      FROM context WHERE greatest(stage1, student) >= 0.4)
GROUP BY ALL"""

CTES["sites"] = """
SELECT *, least(greatest(calibrated_probability - CAST(0.03 AS DOUBLE), 0.0), 1.0) AS robust_probability FROM (
SELECT *, 'SITE_' || lpad(CAST(row_number() OVER (ORDER BY decision_window, road_code, direction_code, spatial_zone) AS VARCHAR), 6, '0') AS site_id,
       round(1.0 / (1.0 + exp(3.0 - 1.2 * ln(least(greatest(student_score, 1e-6), 1 - 1e-6) / (1 - least(greatest(student_score, 1e-6), 1 - 1e-6))))), 6) AS calibrated_probability
FROM site_base)"""

CTES["site_event"] = """
SELECT site_id, decision_window, actual_positive, unnest(string_split(event_ids, '|')) AS event_id FROM sites WHERE event_ids <> ''"""

CTES["scenarios"] = """
SELECT * FROM (VALUES ('loss_cost_ratio_2000', CAST(2000 AS DOUBLE)), ('loss_cost_ratio_5000', CAST(5000 AS DOUBLE)),
                      ('loss_cost_ratio_10000', CAST(10000 AS DOUBLE))) AS t(scenario, loss)"""

CTES["strategies"] = """
SELECT unnest(['no_action', 'stage1_priority', 'student_priority', 'greedy_expected_utility',
               'binary_program_expected_utility', 'robust_binary_program']) AS strategy"""

CTES["site_costs"] = """
SELECT s.*, c.scenario, c.loss,
  CAST(1.0 AS DOUBLE) + (1 - calibrated_probability) * CAST(0.5 AS DOUBLE) - calibrated_probability * loss * CAST(0.1 AS DOUBLE) AS warning_cost,
  CAST(5.0 AS DOUBLE) + (1 - calibrated_probability) * CAST(3.0 AS DOUBLE) - calibrated_probability * loss * CAST(0.45 AS DOUBLE) AS patrol_cost,
  CAST(15.0 AS DOUBLE) + (1 - calibrated_probability) * CAST(10.0 AS DOUBLE) - calibrated_probability * loss * CAST(0.3 AS DOUBLE) AS emergency_cost
FROM sites s CROSS JOIN scenarios c"""

CTES["registry"] = """
SELECT event_id AS registry_id, bin5 AS occurred_at, CAST((user_id // 2) % 2 AS INTEGER) AS direction_code,
       CAST(user_id AS VARCHAR) AS segment_id, (user_id // 4) / CAST(10.0 AS DOUBLE) AS stake_km,
       ['碰撞', '追尾', '刮擦', '翻车', '失火', '其他'][k % 6 + 1] AS accident_type,
       ['碰撞', '追尾', '刮擦', '翻车', '失火', '其他'][(k + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) % 6 + 1] AS predicted_type,
       CASE WHEN k < 95 THEN '轻微事故' WHEN k < 99 THEN '一般事故' ELSE '重大事故' END AS severity,
       CASE k % 4 WHEN 0 THEN 'Clear' WHEN 1 THEN '小雨' WHEN 2 THEN '大雾' END AS weather,
       CAST(1000.0 AS DOUBLE) + CAST(10.0 AS DOUBLE) * value AS traffic, CAST(20.0 AS DOUBLE) + k AS median_speed,
       value AS upstream_traffic, CAST(k AS DOUBLE) AS downstream_traffic,
       CASE WHEN k % 25 = 0 THEN '属于' END AS key_vehicle,
       CASE WHEN k % 50 = 1 THEN 1 ELSE 0 END AS serious_injured, CASE WHEN k = 99 THEN 1 ELSE 0 END AS deaths
FROM ev0 WHERE event_type = 'error'"""

CTES["family"] = """
SELECT *, t[1] AS true_family, t[2] AS predicted_family FROM (
  SELECT *, list_value(CASE WHEN accident_type IN ('碰撞', '追尾', '刮擦') THEN 'Lane-conflict' WHEN accident_type = '翻车' THEN 'Rollover'
                  WHEN accident_type = '失火' THEN 'Fire' WHEN accident_type = '其他' THEN 'Other' END,
             CASE WHEN predicted_type IN ('碰撞', '追尾', '刮擦') THEN 'Lane-conflict' WHEN predicted_type = '翻车' THEN 'Rollover'
                  WHEN predicted_type = '失火' THEN 'Fire' WHEN predicted_type = '其他' THEN 'Other' END) AS t
  FROM registry)"""

CTES["watchlist"] = """
SELECT segment_id, strftime(bin5, '%Y-%m-%d %H:%M:%S') AS time, road_code, CAST(direction_code AS BIGINT) AS direction_code,
       stake AS stake_m, round_even(stake / 1000, 3) AS stake_km, round_even(student, 6) AS score, round_even(stage1, 6) AS stage1_score,
       round_even(calibrated, 6) AS calibrated_probability,
       CASE WHEN student >= 0.8 THEN '高' WHEN student >= 0.6 THEN '中' ELSE '低' END AS risk_level, candidate_source,
       CASE WHEN student >= 0.6 THEN '待复核' ELSE '观察' END AS review_status, coalesce(lead_time_min, -1) AS lead_time_min, target_event_id
FROM context"""

# Long scores: two models on the validation and test days.
CTES["long_scores"] = """
SELECT segment_id, bin5, split, 'stage1_risk' AS model, stage1 AS score, target_event_30m AS y, target_event_id AS event_id, lead_time_min FROM context
UNION ALL
SELECT segment_id, bin5, split, 'distilled_student', student, target_event_30m, target_event_id, lead_time_min FROM context
UNION ALL
SELECT segment_id, bin5, split, 'calibrated', calibrated, target_event_30m, target_event_id, lead_time_min FROM context"""

CTES["test_scores"] = "SELECT * FROM long_scores WHERE split = 'test'"

CTES["score_steps"] = """
SELECT model, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS q
FROM (SELECT model, score, sum(y) AS pos, sum(1 - y) AS neg FROM test_scores GROUP BY model, score)
WINDOW w AS (PARTITION BY model ORDER BY score DESC)"""

CTES["areas"] = """
SELECT model, sum(neg * (tp - pos / 2)) / (max(p) * max(q)) AS roc_auc,
       sum(pos * tp / CAST(tp + fp AS DOUBLE)) / max(p) AS pr_auc FROM score_steps GROUP BY model"""

# All feasible patrol subsets of a window, by rank in (probability desc, site id): brute force.
for _name, _p in (("exact", "calibrated_probability"), ("robust", "robust_probability")):
    CTES[f"{_name}_rank"] = f"""
SELECT scenario, decision_window, site_id, road_code, direction_code, spatial_zone, w, t, e,
       row_number() OVER (PARTITION BY scenario, decision_window ORDER BY p DESC, site_id) AS r
FROM (SELECT *, {_p} AS p,
        CAST(1.0 AS DOUBLE) + (1 - {_p}) * CAST(0.5 AS DOUBLE) - {_p} * loss * CAST(0.1 AS DOUBLE) AS w,
        CAST(5.0 AS DOUBLE) + (1 - {_p}) * CAST(3.0 AS DOUBLE) - {_p} * loss * CAST(0.45 AS DOUBLE) AS t,
        CAST(15.0 AS DOUBLE) + (1 - {_p}) * CAST(10.0 AS DOUBLE) - {_p} * loss * CAST(0.3 AS DOUBLE) AS e
      FROM site_costs)"""
    CTES[f"{_name}_can"] = f"SELECT * FROM {_name}_rank WHERE least(t, t + e) < 0"
    _apart = "NOT ({a}.road_code = {b}.road_code AND {a}.direction_code = {b}.direction_code AND abs({a}.spatial_zone - {b}.spatial_zone) < 1000)"
    CTES[f"{_name}_subsets"] = f"""
SELECT scenario, decision_window, 0 AS n, CAST([] AS BIGINT[]) AS rs, CAST([] AS VARCHAR[]) AS ids, CAST(0 AS DOUBLE) AS c, CAST(NULL AS DOUBLE) AS e_min
FROM {_name}_rank GROUP BY ALL
UNION ALL
SELECT scenario, decision_window, 1, [r], [site_id], w + t, e FROM {_name}_can
UNION ALL
SELECT a.scenario, a.decision_window, 2, [a.r, b.r], [a.site_id, b.site_id], a.w + a.t + b.w + b.t, least(a.e, b.e)
FROM {_name}_can a JOIN {_name}_can b ON a.scenario = b.scenario AND a.decision_window = b.decision_window AND a.r < b.r
 AND {_apart.format(a='a', b='b')}
UNION ALL
SELECT a.scenario, a.decision_window, 3, [a.r, b.r, c.r], [a.site_id, b.site_id, c.site_id],
       a.w + a.t + b.w + b.t + c.w + c.t, least(a.e, b.e, c.e)
FROM {_name}_can a JOIN {_name}_can b ON a.scenario = b.scenario AND a.decision_window = b.decision_window AND a.r < b.r
 JOIN {_name}_can c ON a.scenario = c.scenario AND a.decision_window = c.decision_window AND b.r < c.r
WHERE {_apart.format(a='a', b='b')} AND {_apart.format(a='a', b='c')} AND {_apart.format(a='b', b='c')}
  AND NOT (a.road_code = b.road_code AND b.road_code = c.road_code)"""
    # Cheapest negative warnings outside the subset: walk the window's first 11 ranks.
    CTES[f"{_name}_priced"] = f"""
SELECT s.scenario, s.decision_window, s.n, s.rs, s.ids, s.c + coalesce(least(s.e_min, 0), 0) + coalesce(x.w_sum, 0) AS cost, s.e_min, x.warn_ids
FROM {_name}_subsets s LEFT JOIN (
  SELECT scenario, decision_window, rs, sum(w) AS w_sum, list(site_id ORDER BY r) AS warn_ids FROM (
    SELECT s.scenario, s.decision_window, s.rs, s.n, r.w, r.r, r.site_id,
           row_number() OVER (PARTITION BY s.scenario, s.decision_window, s.rs ORDER BY r.r) AS i
    FROM {_name}_subsets s JOIN {_name}_rank r
      ON s.scenario = r.scenario AND s.decision_window = r.decision_window AND r.r <= 11 AND r.w < 0 AND NOT list_contains(s.rs, r.r))
  WHERE i <= 8 - n GROUP BY scenario, decision_window, rs) x
ON s.scenario = x.scenario AND s.decision_window = x.decision_window AND s.rs = x.rs"""
    CTES[f"{_name}_best"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, decision_window ORDER BY round(cost, 9), n, rs) AS k FROM {_name}_priced) WHERE k = 1"""
    CTES[f"{_name}_picks"] = f"""
SELECT b.scenario, b.decision_window, r.site_id, 1 AS warning, CASE WHEN list_contains(b.ids, r.site_id) THEN 1 ELSE 0 END AS patrol,
       CASE WHEN list_contains(b.ids, r.site_id) AND b.e_min < 0 AND
                 row_number() OVER (PARTITION BY b.scenario, b.decision_window, list_contains(b.ids, r.site_id) ORDER BY r.e, r.r) = 1 THEN 1 ELSE 0 END AS emergency
FROM {_name}_best b JOIN {_name}_rank r ON b.scenario = r.scenario AND b.decision_window = r.decision_window
 AND (list_contains(b.ids, r.site_id) OR list_contains(b.warn_ids, r.site_id))"""

for _name, _score in (("stage1", "stage1_score"), ("student", "student_score")):
    CTES[f"{_name}_warned"] = f"""
SELECT * FROM (SELECT site_id, decision_window, road_code, {_score} AS s, row_number() OVER (PARTITION BY decision_window ORDER BY {_score} DESC, site_id) AS rk
FROM sites WHERE {_score} >= 0.6) WHERE rk <= 8"""
    CTES[f"{_name}_picks"] = f"""
SELECT c.scenario, z.decision_window, z.site_id, 1 AS warning, CASE WHEN pr IS NULL THEN 0 ELSE 1 END AS patrol, CASE WHEN pr = 1 THEN 1 ELSE 0 END AS emergency
FROM {_name}_warned z LEFT JOIN (
  SELECT site_id, row_number() OVER (PARTITION BY decision_window ORDER BY rk) AS pr FROM (
    SELECT *, row_number() OVER (PARTITION BY decision_window, road_code ORDER BY rk) AS rr FROM {_name}_warned) WHERE rr <= 2
  QUALIFY pr <= 3) p USING (site_id) CROSS JOIN scenarios c"""

CTES["greedy_warned"] = """
SELECT * FROM site_costs WHERE warning_cost < 0
QUALIFY row_number() OVER (PARTITION BY scenario, decision_window ORDER BY warning_cost, site_id) <= 8"""
CTES["greedy_patrol"] = """
SELECT * FROM (SELECT * FROM greedy_warned WHERE patrol_cost < 0
  QUALIFY row_number() OVER (PARTITION BY scenario, decision_window, road_code ORDER BY patrol_cost, site_id) <= 2)
QUALIFY row_number() OVER (PARTITION BY scenario, decision_window ORDER BY patrol_cost, site_id) <= 3"""
CTES["greedy_emergency"] = """
SELECT scenario, site_id FROM greedy_patrol WHERE emergency_cost < 0
QUALIFY row_number() OVER (PARTITION BY scenario, decision_window ORDER BY emergency_cost, site_id) <= 1"""
CTES["greedy_picks"] = """
SELECT w.scenario, w.decision_window, w.site_id, 1 AS warning, CASE WHEN p.site_id IS NULL THEN 0 ELSE 1 END AS patrol,
       CASE WHEN e.site_id IS NULL THEN 0 ELSE 1 END AS emergency
FROM greedy_warned w LEFT JOIN greedy_patrol p ON w.scenario = p.scenario AND w.site_id = p.site_id
LEFT JOIN greedy_emergency e ON w.scenario = e.scenario AND w.site_id = e.site_id"""

CTES["picks"] = """
SELECT 'stage1_priority' AS strategy, scenario, site_id, warning, patrol, emergency FROM stage1_picks
UNION ALL SELECT 'student_priority', scenario, site_id, warning, patrol, emergency FROM student_picks
UNION ALL SELECT 'greedy_expected_utility', scenario, site_id, warning, patrol, emergency FROM greedy_picks
UNION ALL SELECT 'binary_program_expected_utility', scenario, site_id, warning, patrol, emergency FROM exact_picks
UNION ALL SELECT 'robust_binary_program', scenario, site_id, warning, patrol, emergency FROM robust_picks"""

CTES["decided"] = """
SELECT s.*, c.scenario, c.loss, g.strategy, coalesce(p.warning, 0) AS warning, coalesce(p.patrol, 0) AS patrol, coalesce(p.emergency, 0) AS emergency
FROM sites s CROSS JOIN scenarios c CROSS JOIN strategies g
LEFT JOIN picks p ON p.site_id = s.site_id AND p.scenario = c.scenario AND p.strategy = g.strategy"""

CTES["realized"] = """
SELECT a.scenario, a.strategy, a.acts + coalesce(e.residual, 0) AS realized_normalized_event_cost FROM (
  SELECT scenario, strategy, CAST(sum(warning * 1.0 + patrol * 5.0 + emergency * 15.0
      + (1 - actual_positive) * (warning * 0.5 + patrol * 3.0 + emergency * 10.0)) AS DOUBLE) AS acts
  FROM decided GROUP BY ALL) a
LEFT JOIN (SELECT scenario, strategy, sum(loss * (1 - best)) AS residual FROM (
    SELECT d.scenario, d.strategy, d.loss, v.event_id,
           max(d.warning * CAST(0.1 AS DOUBLE) + d.patrol * CAST(0.45 AS DOUBLE) + d.emergency * CAST(0.3 AS DOUBLE)) AS best
    FROM decided d JOIN site_event v USING (site_id) GROUP BY ALL) GROUP BY ALL) e
ON a.scenario = e.scenario AND a.strategy = e.strategy"""

CTES["reviewed"] = """
SELECT *, abs(upstream - downstream) AS gap,
  CASE WHEN score < 0.6 THEN 'VERIFY' ELSE concat_ws(',', 'VMS_WARNING', 'VERIFY',
    CASE WHEN kind = '翻车' THEN 'HEAVY_RESCUE,LANE_ISOLATION' WHEN kind = '失火' THEN 'FIRE_RESPONSE'
         WHEN kind IN ('碰撞', '追尾', '刮擦') THEN 'LANE_CONTROL' END,
    CASE WHEN speed < 40 THEN 'LOW_SPEED_WARNING' END,
    CASE WHEN abs(upstream - downstream) >= 25 THEN 'QUEUE_PROPAGATION' END,
    CASE WHEN weather NOT IN ('Clear', '晴', '未知', '') THEN 'WEATHER_SPEED_CONTROL' END) END AS codes
FROM (SELECT r.registry_id, coalesce(c.student, 0.0) AS score, r.median_speed AS speed, r.upstream_traffic AS upstream,
             r.downstream_traffic AS downstream, coalesce(r.weather, '未知') AS weather, r.predicted_type AS kind
      FROM registry r LEFT JOIN context c ON r.segment_id = c.segment_id AND r.occurred_at = c.bin5)"""

CTES["best_case"] = """
SELECT * FROM context WHERE target_event_30m = 1 AND student >= 0.6
QUALIFY row_number() OVER (PARTITION BY target_event_id ORDER BY student DESC, lead_time_min DESC, bin5, segment_id) = 1"""

CTES["asof_pairs"] = """
SELECT a.accident_id, a.bin5 AS at, a.direction_code, r.registry_id, r.occurred_at, abs(date_diff('second', a.bin5, r.occurred_at)) / 60.0 AS gap
FROM accidents a JOIN registry r ON a.direction_code = r.direction_code"""

_WORD = re.compile(r"[a-z_][a-z0-9_]*")


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in _WORD.findall(re.sub(r"'[^']*'", "", sql)):
        if name in CTES and name not in found:
            _needed(CTES[name], found)
            found[name] = None


def sql(body: str, doubles: str = "", integers: str = "", digits: int = 6) -> str:
    """A complete query: the expressions ``body`` needs, doubles rounded."""
    found: dict[str, None] = {}
    _needed(body, found)
    prelude = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in found)
    replaced = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles.split()]
    replaced += [f"CAST({c} AS BIGINT) AS {c}" for c in integers.split()]
    outer = f"SELECT * {'REPLACE (' + ', '.join(replaced) + ') ' if replaced else ''}FROM ({body.strip()})"
    return f"WITH {prelude}\n{outer}" if prelude else outer
