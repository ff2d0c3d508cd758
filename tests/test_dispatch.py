"""Dispatch policies against direct, sequential Python on small windows."""

import datetime as dt
import itertools
import random

import pytest

from corridorwatch.config import DispatchConfig
from corridorwatch.operators import dispatch, sites
from corridorwatch.functions.ranking import running_ids, top_n_per_group
from pyspark.sql import functions as F

CONFIG = DispatchConfig()
SCHEMA = "site_id string, decision_window timestamp_ntz, road_code string, direction_code int, spatial_zone int, calibrated_probability double, robust_probability double, stage1_score double, student_score double"


def make_windows(seed, windows=25, size=14, ties=False):
    rng = random.Random(seed)
    out, n = [], 0
    for w in range(windows):
        at = dt.datetime(2025, 9, 1) + dt.timedelta(minutes=10 * w)
        cells = set()
        while len(cells) < size:
            cells.add((rng.choice(["G1", "S5", "X9", "Y2"]), rng.randrange(2), 500 * rng.randrange(0, 8)))
        for road, direction, zone in sorted(cells):
            n += 1
            p = rng.choice([0.01, 0.05, 0.2]) if ties else round(rng.random() ** 3, 6)
            score = round(rng.random(), 3)
            out.append((f"SITE_{n:06d}", at, road, direction, zone, p, max(p - 0.03, 0.0), score, round(rng.random(), 2)))
    return out


def costs(p, scenario):
    values = []
    for cost, penalty, rate in ((1.0, 0.5, 0.1), (5.0, 3.0, 0.45), (15.0, 10.0, 0.3)):
        values.append(cost + (1 - p) * penalty - p * scenario.accident_loss * rate)
    return values


def brute_force(rows, scenario):
    """Cheapest cost of one window over all subsets."""
    c = {r[0]: costs(r[5], scenario) for r in rows}
    best = 0.0
    for n in range(4):
        for chosen in itertools.combinations(rows, n):
            roads = [r[2] for r in chosen]
            if any(roads.count(x) > 2 for x in roads):
                continue
            if any(a[2:4] == b[2:4] and abs(a[4] - b[4]) < 1000 for a, b in itertools.combinations(chosen, 2)):
                continue
            rest = sorted(c[r[0]][0] for r in rows if r not in chosen and c[r[0]][0] < 0)[: 8 - n]
            total = sum(sum(c[r[0]][:2]) for r in chosen) + sum(rest) + min([0.0] + [c[r[0]][2] for r in chosen])
            best = min(best, total)
    return best


@pytest.mark.parametrize("seed,ties", [(1, False), (2, False), (3, True)])
def test_exact_equals_brute_force(spark, seed, ties):
    rows = make_windows(seed, ties=ties)
    found = dispatch.solve_exact(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 25 * 3
    scenario = {s.name: s for s in CONFIG.scenarios}
    for r in found:
        window = [x for x in rows if x[1] == r.decision_window]
        assert r.cost == pytest.approx(brute_force(window, scenario[r.scenario]), abs=1e-6)


def check_limits(rows, picks, separation):
    by_id = {r[0]: r for r in rows}
    groups = {}
    for p in picks:
        groups.setdefault((p.scenario, by_id[p.site_id][1]), []).append(p)
    for group in groups.values():
        assert sum(p.warning for p in group) <= 8
        patrols = [by_id[p.site_id] for p in group if p.patrol]
        assert len(patrols) <= 3 and sum(p.emergency for p in group) <= 1
        assert all(p.warning >= p.patrol >= p.emergency for p in group)
        assert all(sum(x[2] == r[2] for x in patrols) <= 2 for r in patrols)
        if separation:
            for a, b in itertools.combinations(patrols, 2):
                assert a[2:4] != b[2:4] or abs(a[4] - b[4]) >= 1000


def test_limits_hold_for_every_policy(spark):
    rows = make_windows(4)
    table = spark.createDataFrame(rows, SCHEMA)
    check_limits(rows, dispatch.dispatch_exact(table).collect(), True)
    check_limits(rows, dispatch.dispatch_greedy(table).collect(), False)
    check_limits(rows, dispatch.dispatch_ranking(table, "student_score", "student_priority").collect(), False)


def sequential_ranking(rows):
    order = sorted((r for r in rows if r[8] >= 0.6), key=lambda r: (-r[8], r[0]))
    warned, patrols, roads = order[:8], [], {}
    for r in warned:
        if roads.get(r[2], 0) < 2 and len(patrols) < 3:
            patrols.append(r)
            roads[r[2]] = roads.get(r[2], 0) + 1
    return {r[0]: (1, int(r in patrols), int(r in patrols[:1])) for r in warned}


def sequential_greedy(rows, scenario):
    c = {r[0]: costs(r[5], scenario) for r in rows}
    by = lambda i: sorted(rows, key=lambda r: (c[r[0]][i], r[0]))
    warned = [r for r in by(0) if c[r[0]][0] < 0][:8]
    patrols, roads = [], {}
    for r in by(1):
        if c[r[0]][1] < 0 and r in warned and len(patrols) < 3 and roads.get(r[2], 0) < 2:
            patrols.append(r)
            roads[r[2]] = roads.get(r[2], 0) + 1
    helped = [r for r in by(2) if c[r[0]][2] < 0 and r in patrols][:1]
    return {r[0]: (1, int(r in patrols), int(r in helped)) for r in warned}


def test_ranking_and_greedy_equal_the_sequential_form(spark):
    rows = make_windows(5, ties=True)
    table = spark.createDataFrame(rows, SCHEMA)
    times = sorted({r[1] for r in rows})
    got = {}
    for p in dispatch.dispatch_ranking(table, "student_score", "s").collect():
        got[p.scenario, p.site_id] = (p.warning, p.patrol, p.emergency)
    want = {}
    for at in times:
        window = [r for r in rows if r[1] == at]
        for s in CONFIG.scenarios:
            want |= {(s.name, k): v for k, v in sequential_ranking(window).items()}
    assert got == want
    got = {(p.scenario, p.site_id): (p.warning, p.patrol, p.emergency) for p in dispatch.dispatch_greedy(table).collect()}
    want = {}
    for at in times:
        window = [r for r in rows if r[1] == at]
        for s in CONFIG.scenarios:
            want |= {(s.name, k): v for k, v in sequential_greedy(window, s).items()}
    assert got == want


@pytest.mark.parametrize("capacity", [0, 1, 4])
def test_snapshot_equals_the_sequential_form(spark, capacity):
    rng = random.Random(17)
    rows = []
    for t in range(12):
        for i in range(40):
            rows.append((f"t{t}", rng.choice(["G1", "S5"]), rng.randrange(2), f"s{i:02d}", 100.0 * rng.randrange(0, 60), round(rng.random(), 2)))
    schema = "time string, road_code string, direction_code int, segment_id string, stake_m double, score double"
    config = DispatchConfig(patrol_capacity=capacity, warning_capacity=4)
    actions = dispatch.dispatch_snapshot(spark.createDataFrame(rows, schema), ["time"], config).collect()
    for t in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == t), key=lambda r: (-r[5], r[3]))
        patrols = []
        for r in ranked:
            clear = all(q[1:3] != r[1:3] or abs(q[4] - r[4]) >= 1000 for q in patrols)
            if len(patrols) < capacity and r[5] >= 0.6 and clear:
                patrols.append(r)
        want = {("warning", r[3]) for r in ranked[:4]} | {("patrol", r[3]) for r in patrols}
        want |= {("emergency", r[3]) for r in [r for r in ranked if r[5] >= 0.8][:1]}
        assert {(a.kind, a.segment_id) for a in actions if a.time == t} == want


def test_requests_equal_the_sequential_form(spark):
    """Several requests for one snapshot, each with its own capacities and separation, some of them invalid."""
    rng = random.Random(23)
    rows = [(f"t{t}", rng.choice(["G1", "S5"]), rng.randrange(2), f"s{i:03d}", 50.0 * rng.randrange(0, 200), round(rng.random(), 2)) for t in range(4) for i in range(150)]
    asked = [(f"q{i}", f"t{i % 5}", None, *(rng.choice([None, "0", "2", "7", "20"]) for _ in range(3)), rng.choice([None, "0", "130", "700", "10000"])) for i in range(30)]
    bad = [("b0", "t0", None, "21", None, None, None), ("b1", "t1", None, None, "x", "-1", None), ("b2", "t2", None, None, None, None, "10001")]
    table = spark.createDataFrame(rows, "time string, road_code string, direction_code int, segment_id string, stake_m double, score double")
    schema = "request_id string, time string, scenario string, " + ", ".join(f"{n} string" for n in dispatch.SETTINGS)
    actions, rejected = dispatch.dispatch_requests(table, spark.createDataFrame(asked + bad, schema), ["time"])
    assert {r.request_id: list(r.violations) for r in rejected.collect()} == {
        "b0": ["warning_capacity"], "b1": ["patrol_capacity", "emergency_capacity"], "b2": ["minimum_patrol_separation_m"],
    }
    want = set()
    for name, time, _, *given in asked:
        warning, patrol, emergency, apart = (int(d if g is None else g) for g, d in zip(given, (8, 3, 1, 1000)))
        ranked = sorted((r for r in rows if r[0] == time), key=lambda r: (-r[5], r[3]))
        patrols = []
        for r in ranked:
            clear = all(q[1:3] != r[1:3] or abs(q[4] - r[4]) >= apart for q in patrols)
            if len(patrols) < patrol and r[5] >= 0.6 and clear:
                patrols.append(r)
        want |= {(name, "warning", r[3]) for r in ranked[:warning]} | {(name, "patrol", r[3]) for r in patrols}
        want |= {(name, "emergency", r[3]) for r in [r for r in ranked if r[5] >= 0.8][:emergency]}
    assert {(a.request_id, a.kind, a.segment_id) for a in actions.collect()} == want
    assert {a.scenario for a in actions.collect()} == {"loss_cost_ratio_5000"}


def test_requests_meet_few_rows_per_task(spark):
    """Warnings are cut to the best rows before they meet the requests; patrols meet them in slices of a snapshot."""
    table = spark.createDataFrame([("t", "G1", 1, "s", 0.0, 0.9)], "time string, road_code string, direction_code int, segment_id string, stake_m double, score double")
    asked = spark.createDataFrame([("q", "t", None, None, None, None, None)], "request_id string, time string, scenario string, " + ", ".join(f"{n} string" for n in dispatch.SETTINGS))
    actions, _ = dispatch.dispatch_requests(table, asked, ["time"])
    plan = actions._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "__slice" in "".join(line for line in plan.splitlines() if "Join" in line)
    assert {(a.kind, a.segment_id) for a in actions.collect()} == {("warning", "s"), ("patrol", "s"), ("emergency", "s")}


def test_separated_picks_need_no_join(spark):
    table = spark.createDataFrame([("t", "G1", 1, "s", 0.0, 0.9)], "time string, road_code string, direction_code int, segment_id string, stake_m double, score double")
    picks = dispatch.separated_picks(table, ["time"], F.lit(9), F.lit(1000.0))
    plan = picks._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_site_ids_follow_key_order_over_ranges(spark):
    rng = random.Random(19)
    keys = {(dt.datetime(2025, 9, 1, rng.randrange(3)), rng.choice("AB"), rng.randrange(2), 500 * rng.randrange(0, 900)) for _ in range(300)}
    df = spark.createDataFrame(list(keys), "decision_window timestamp_ntz, road_code string, direction_code int, spatial_zone int")
    got = [r.site_id for r in sites.add_site_ids(df).orderBy("decision_window", "road_code", "direction_code", "spatial_zone").collect()]
    assert got == [f"SITE_{i + 1:06d}" for i in range(len(keys))]


def test_top_n_survives_a_hot_group(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.xxhash64("id").alias("v"), "id")
    out = top_n_per_group(df, ["g"], [F.col("v"), F.col("id")], 7, ["id"], slices=4).collect()
    rows = df.collect()
    for g in (0, 1):
        want = sorted((r.v, r.id) for r in rows if r.g == g)[:7]
        assert sorted((r.v, r.id) for r in out if r.g == g) == want


def test_running_ids_are_dense(spark):
    df = spark.range(500).select((F.col("id") % 5).alias("a"), (F.col("id") % 35).alias("b"), "id")
    out = running_ids(df, ["a", "b"], [F.col("id")], "n").orderBy("a", "b", "id").collect()
    assert [r.n for r in out] == list(range(1, 501))
