"""Hand-made panels: day bounds, positions, chunks, causality, ties."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corridorwatch import schemas
from corridorwatch import vocabulary as V
from corridorwatch.config import BuildConfig
from corridorwatch.functions import ranking
from corridorwatch.operators import candidates, cleaning, features, labels, topology
from corridorwatch.plans import build
from corridorwatch.sources import files

T0 = dt.datetime(2025, 3, 10, 0, 0)


def row(segment, minute, risk, stake=0.0, direction=1, label=0, accident="", level=0, road="G1", source=0, day=0):
    at = T0 + dt.timedelta(days=day, minutes=minute)
    values = dict(
        segment_id=segment, bin5=at, source_month="2025-03", direction_code=direction, road_code=road,
        road_direction="", stake=float(stake), accident_label=label, accident_level=level, accident_id=accident,
        source_row=source,
    )
    values |= {c: float(risk) for c in V.COMPONENTS}
    return values


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.PANEL) for r in rows], schemas.PANEL)


def test_dedup_keeps_highest_risk_then_largest_row(spark):
    df = frame(spark, [row("a", 0, 0.2, source=1), row("a", 0, 0.7, source=2), row("a", 0, 0.7, source=3), row("b", 0, 0.1)])
    out = {r.segment_id: (r[V.RISK], r.source_row) for r in cleaning.panel_dedup(df).collect()}
    assert out == {"a": (0.7, 3), "b": (0.1, 0)}


def test_build_has_no_row_of_another_month(spark):
    rows = [row("a", 0, 0.7), row("b", 0, 0.7) | {"source_month": "2025-02"}, row("c", 0, 0.7) | {"source_month": None}]
    out = build.build_candidates(frame(spark, rows))
    assert sorted(r.segment_id for r in out.collect()) == ["a", "c"]


@pytest.mark.parametrize("bad", ["", "0", " 0.0 ", "NaN", "None", "NULL"])
def test_invalid_event_ids_are_demoted(spark, bad):
    out = cleaning.clean_panel(frame(spark, [row("a", 0, 1.7, label=1, accident=bad, level=3)])).first()
    assert (out.accident_label, out.accident_level, out[V.RISK]) == (0, 0, 1.0)


def test_lags_do_not_cross_midnight_and_are_positional(spark):
    rows = [row("a", 1430, 0.9), row("a", 0, 0.1, day=1), row("a", 10, 0.3, day=1), row("a", 40, 0.5, day=1)]
    out = features.add_temporal_features(frame(spark, rows)).orderBy("bin5").collect()
    assert [r.risk_lag_5m for r in out] == [None, None, 0.1, 0.3]
    assert [r.risk_mean_past_30m for r in out][:2] == [None, None]
    assert out[3].risk_mean_past_30m == pytest.approx(0.3)
    assert out[0].risk_std_past_30m == 0.0


def test_direction_zero_looks_against_the_stakes(spark):
    rows = [row(str(i), 0, i / 10, stake=100 * i, direction=0) for i in range(3)]
    out = {r.segment_id: r for r in features.add_spatial_features(frame(spark, rows)).collect()}
    assert out["1"].upstream_risk_100m == 0.2 and out["1"].downstream_risk_100m == 0.0
    assert out["2"].upstream_mean_300m is None
    assert out["2"].center_neighbor_contrast == pytest.approx(0.2 - 0.05)


@pytest.mark.parametrize("chunk_m", [100.0, 300.0, 700.0, 1300.0, 5000.0])
def test_chunked_spatial_windows_equal_whole_windows(spark, chunk_m):
    rng = random.Random(7)
    rows = []
    for direction in (0, 1):
        stakes = rng.sample(range(0, 120), 70)
        rows += [row(f"{direction}-{s}", 0, rng.random(), stake=100 * s, direction=direction) for s in stakes]
        rows += [row(f"{direction}-x{i}", 0, rng.random(), stake=5000, direction=direction) for i in range(25)]
    df = frame(spark, rows).cache()
    names = ["segment_id", *V.SPATIAL]

    def values(m):
        out = features.add_spatial_features(df, m).select([F.round(c, 9).alias(c) if c != "segment_id" else F.col(c) for c in names])
        return sorted(out.collect())

    assert values(chunk_m) == values(1e9)


def brute_force_labels(rows, horizon=30, radius=300.0):
    events = {}
    for r in sorted((r for r in rows if r["accident_label"] > 0), key=lambda r: (r["bin5"], r["segment_id"])):
        events.setdefault((r["bin5"].date(), r["accident_id"]), r)
    out = {}
    for r in rows:
        best, guard = None, 0
        for e in events.values():
            if (e["road_code"], e["direction_code"], e["bin5"].date()) != (r["road_code"], r["direction_code"], r["bin5"].date()):
                continue
            lead = (e["bin5"] - r["bin5"]).total_seconds() / 60
            if abs(e["stake"] - r["stake"]) > radius or abs(lead) > horizon:
                continue
            guard = 1
            if 0 < lead <= horizon and (best is None or (lead, e["accident_id"]) < best):
                best = (lead, e["accident_id"])
        out[r["segment_id"], r["bin5"]] = (*(best or (None, "")), guard)
    return out


def test_labels_equal_brute_force_with_a_hot_bucket(spark):
    rng = random.Random(3)
    rows = []
    for i in range(220):
        hot = i % 3 == 0
        rows.append(
            row(
                f"s{i}", 5 * rng.randrange(0, 60) if not hot else 5 * rng.randrange(10, 14), rng.random(),
                stake=100 * rng.randrange(0, 12) if not hot else 250, direction=rng.randrange(2),
                label=int(rng.random() < 0.25), accident=f"E{rng.randrange(40)}", level=2, road=rng.choice(["G1", "S5"]), day=rng.randrange(2),
            )
        )
    out = labels.label_future_events(frame(spark, rows)).collect()
    got = {(r.segment_id, r.bin5): (r.lead_time_min, r.target_event_id, r.event_guard) for r in out}
    assert got == brute_force_labels(rows)


def test_no_label_across_midnight(spark):
    rows = [row("a", 1430, 0.5), row("a", 10, 0.5, label=1, accident="E1", level=1, day=1)]
    out = labels.label_future_events(frame(spark, rows)).orderBy("bin5").collect()
    assert [r.target_event_30m for r in out] == [0, 0]
    assert [r.event_guard for r in out] == [0, 1]


def test_features_ignore_the_future(spark):
    rng = random.Random(5)
    rows = [row(f"s{s}", 5 * b, rng.random(), stake=100 * s) for s in range(6) for b in range(12)]
    cut = T0 + dt.timedelta(minutes=30)
    changed = [r | ({c: 0.99 for c in V.COMPONENTS} if r["bin5"] > cut else {}) for r in rows]
    names = ["segment_id", "bin5", *V.TEMPORAL, *V.SPATIAL]

    def past(data):
        df = features.add_temporal_features(features.add_spatial_features(frame(spark, data)))
        return sorted(map(str, df.where(F.col("bin5") <= F.lit(cut).cast("timestamp_ntz")).select(names).collect()))

    assert past(rows) == past(changed)


def test_context_laid_out_by_day(spark, tmp_path):
    """The same rows, dealt in ranges of the day by the last shuffle, which the write needs no other for."""
    rng = random.Random(29)
    rows = [row(f"s{s}", 5 * b, rng.random(), stake=100 * s, day=d, label=int(rng.random() < 0.1), accident=f"E{s}") for s in range(12) for b in range(8) for d in range(4)]
    df = frame(spark, rows)
    plain, dated = build.context_panel(df), build.context_panel(df, day="panel_date")
    names = plain.columns
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (plain, dated)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") and "rangepartitioning(panel_date" in plans[1]
    assert sorted(map(str, dated.select(names).collect())) == sorted(map(str, plain.collect()))
    assert dated.where(F.col("panel_date") != F.to_date("bin5")).isEmpty()


def test_sample_sizes_and_strata(spark):
    rng = random.Random(11)
    rows = [row(f"s{i}", 5 * (i % 20), rng.random(), stake=100 * i) for i in range(400)]
    config = BuildConfig(hard_per_day=30, uncertain_per_day=10, random_per_day=20)
    drawn = candidates.stratified_sample(labels.label_future_events(frame(spark, rows), config), config)
    counts = {r.candidate_source: r["count"] for r in drawn.groupBy("candidate_source").count().collect()}
    assert counts == {"hard_negative": 30, "uncertain_negative": 10, "random_negative": 20}


def test_sample_is_ranked_behind_the_last_draw(spark):
    """The smallest draws of every day and class, days and segments that are null included; only they are ranked at full width."""
    rng = random.Random(31)
    rows = [row(rng.choice([None, f"s{i}"]) if i % 50 == 0 else f"s{i}", 5 * (i % 20), rng.random(), day=i % 3) for i in range(600)]
    rows = [r | {"bin5": None} if i % 7 == 0 else r for i, r in enumerate(rows)]
    config = BuildConfig(hard_per_day=9, uncertain_per_day=4, random_per_day=70)
    facts = {"target_event_30m": F.lit(0), "event_guard": F.lit(0)}
    sample = candidates.stratified_sample(frame(spark, rows).withColumns(facts), config)
    assert "__last" in sample._jdf.queryExecution().optimizedPlan().toString()
    groups = {}
    for r in rows:
        source, most = ("hard_negative", 9) if r[V.RISK] >= 0.6 else ("uncertain_negative", 4) if r[V.RISK] >= 0.4 else ("random_negative", 70)
        at = None if r["bin5"] is None else f"{r['bin5']:%Y-%m-%d %H:%M:%S}"
        draw = hashlib.md5("|".join(x for x in (str(config.seed), r["segment_id"], at) if x is not None).encode()).hexdigest()
        groups.setdefault((at and at[:10], source, most), []).append((draw, r["segment_id"] or "", at))
    want = [(s or None, at) for (_, _, most), found in groups.items() for _, s, at in sorted(found, key=lambda x: x[:2])[:most]]
    got = [(r.segment_id, r.bin5 and f"{r.bin5:%Y-%m-%d %H:%M:%S}") for r in sample.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("direction", ["nearest", "backward"])
@pytest.mark.parametrize("slot_minutes", [30, 24 * 60])
def test_as_of_join_equals_brute_force(spark, direction, slot_minutes):
    rng = random.Random(13)
    known = [(i, T0 + dt.timedelta(minutes=rng.randrange(0, 4000)), rng.randrange(2)) for i in range(60)]
    asked = [(i, T0 + dt.timedelta(minutes=rng.randrange(-500, 4500)), rng.randrange(3)) for i in range(80)]
    registry = spark.createDataFrame(known, "registry_id long, at timestamp_ntz, direction_code int")
    queries = spark.createDataFrame(asked, "query_id long, at timestamp_ntz, direction_code int")
    got = {r.query_id: r.time_distance_min for r in labels.nearest_context(queries, registry, direction, slot_minutes).collect()}
    for i, at, d in asked:
        gaps = [abs((t - at).total_seconds()) / 60 for _, t, k in known if k == d and (direction == "nearest" or t <= at)]
        assert got[i] == (min(gaps) if gaps else None), (i, at, d)


@pytest.mark.parametrize("chunk_m", [100.0, 450.0])
def test_chunked_adjacency_equals_whole_adjacency(spark, chunk_m):
    rng = random.Random(23)
    rows = [row(f"{d}-{s}", 0, 0.5, stake=100 * s, direction=d) for d in (0, 1) for s in rng.sample(range(60), 30)]
    segments = topology.topology(frame(spark, rows))

    def table(m):
        return sorted(map(str, topology.segment_adjacency(segments, m).collect()))

    assert table(chunk_m) == table(1e9)


def test_lag_is_carried_over_ranges(spark):
    """A third of the rows in one range, empty ranges between others, and keys that are null."""
    rows = [(k, i, i * 7 % 11) for k in ("a", None) for i in [*range(300), 5000, 5001, 90_000]]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = ranking.carried_lag(df, ["k"], F.floor(F.col("i") / 100), ["i"], "v", "before").collect()
    want, last = {}, {}
    for k, i, v in rows:
        want[k, i], last[k] = last.get(k), v
    assert {(r.k, r.i): r.before for r in got} == want


def test_chunks_out_of_order_per_month(spark):
    at = lambda m: dt.datetime(2025, 9, 1) + dt.timedelta(minutes=m)
    rows = [("8", 0, at(0)), ("8", 0, at(10)), ("8", 1, at(5)), ("9", 1023, at(9)), ("9", 1024, at(3)), ("9", 3000, at(4))]
    df = spark.createDataFrame(rows, "source_month string, c long, bin5 timestamp_ntz")
    got = cleaning.out_of_order_chunks(df, F.col("c"), ["source_month"]).where("out_of_order").collect()
    assert {(r.source_month, r.chunk_id) for r in got} == {("8", 1), ("9", 1024)}


def test_registry_rows_of_one_crowded_day(spark, monkeypatch):
    """Numbers follow time and id, with a third of the rows at one time."""
    monkeypatch.setattr(files, "IDS_PER_RANGE", 50)
    times = ["2025-03-01 00:00:00"] * 300 + [f"2025-0{1 + i % 9}-11 0{i % 10}:00:00" for i in range(600)] + ["2024-01-01 00:00:00", "bad"]
    numbered = list(enumerate(times))
    heads = {c: h for h, c in V.REGISTRY_HEADERS.items()}
    df = spark.createDataFrame([(str(i * 37 % 902), t) for i, t in numbered], "i string, t string")
    raw = df.select(*[F.col("i").alias(h) if c == "registry_id" else F.col("t").alias(h) if c == "occurred_at" else F.lit(None).cast("string").alias(h) for c, h in heads.items()])
    got = {r.registry_id: r.registry_row for r in files.registry_columns(raw, 2025).collect()}
    order = sorted((t, i * 37 % 902) for i, t in numbered if t.startswith("2025"))
    assert got == {i: n for n, (_, i) in enumerate(order)}
