"""Streaming jobs over several micro-batches equal the batch operators."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.operators import features
from corridorwatch.operators.dispatch import dispatch_snapshot
from corridorwatch.operators.watchlist import watchlist_topk
from corridorwatch.session import new_path
from corridorwatch.streaming import jobs

T0 = dt.datetime(2025, 9, 1)
SCHEMA = f"segment_id string, bin5 timestamp_ntz, road_code string, direction_code int, stake double, source_row long, {V.RISK} double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rows(minutes, segments=("a", "b")):
    return [(s, T0 + dt.timedelta(minutes=m), "G1", 1, 0.0, m, (m % 35) / 35) for m in minutes for s in segments]


def write_parts(spark, parts, name):
    """One file per part, oldest first."""
    path = new_path(spark, name)
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        local = path.removeprefix("file://")
        for f in os.listdir(local):
            if f.endswith(".parquet") and f not in SEEN:
                SEEN.add(f)
                os.utime(f"{local}/{f}", (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
    return path


SEEN: set[str] = set()


def run(spark, df, name):
    out = new_path(spark, name)
    jobs.start(df, out, new_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.parquet(out)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


def stream(spark, path):
    return jobs.panel_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


NEXT_DAY = [("", T0 + dt.timedelta(days=9), "G1", 1, 0.0, 0, 0.5)]


def memories(df):
    names = ["risk_lag_5m", "risk_lag_30m", "risk_mean_past_30m", "risk_change_30m"]
    cells = [F.round(F.when(~F.isnan(c), F.col(c)), 9).alias(c) for c in names]
    return sorted(map(str, df.select("segment_id", "bin5", *cells).collect()))


def test_memory_carries_over_batches(spark, rocksdb):
    parts = [rows(range(0, 20, 5)), rows(range(20, 50, 5)), rows(range(1435, 1455, 5)), NEXT_DAY]
    path = write_parts(spark, parts, "memory-parts")
    got = run(spark, jobs.stream_memory(stream(spark, path)), "memory-out")
    batch = features.add_temporal_features(spark.read.parquet(path).where("segment_id <> ''"))
    assert memories(got) == memories(batch)


def test_memory_puts_rows_in_order_within_the_delay(spark, rocksdb):
    """Bins 10, 5, 15 and so on over several batches give the features of the batch."""
    parts = [rows([10, 0]), rows([5]), rows([15], ["b"]), rows([20, 15], ["a"]), rows([25, 35]), rows([30, 20], ["b"]), rows([30], ["a"]), NEXT_DAY]
    path = write_parts(spark, parts, "disorder-parts")
    got = run(spark, jobs.stream_memory(stream(spark, path), "20 minutes"), "disorder-out")
    batch = features.add_temporal_features(spark.read.parquet(path).where("segment_id <> ''"))
    assert memories(got) == memories(batch)


def test_memory_holds_open_rows_back(spark, rocksdb):
    """What the watermark hasn't passed may still be preceded; repeats of a bin count once, by the highest risk."""
    again = [("a", T0, "G1", 1, 0.0, 9, 0.9)]
    path = write_parts(spark, [rows([0, 5], ["a"]), again, rows([15, 20], ["a"])], "open-parts")
    got = run(spark, jobs.stream_memory(stream(spark, path)), "open-out").orderBy("bin5").collect()
    assert [(r.bin5, r[V.RISK]) for r in got] == [(T0, 0.9), (T0 + dt.timedelta(minutes=5), 5 / 35)]


def test_one_ranking_per_snapshot(spark, rocksdb):
    """A snapshot that arrives over several batches is ranked and dispatched once."""
    columns = "segment_id string, time string, road_code string, direction_code int, stake_m double, score double"
    at = lambda minutes: str(T0 + dt.timedelta(minutes=minutes))
    row = lambda i, m: (f"s{i:02d}", at(m), f"G{i % 3}", 1, 700.0 * i, round(0.4 + (i * 37 % 60) / 100, 6))
    parts = [[row(i, 0) for i in range(0, 40, 2)], [row(i, 5) for i in range(20)], [row(i, 0) for i in range(1, 40, 2)], [row(0, 60)]]
    path = new_path(spark, "snapshot-parts")
    out, checkpoint = new_path(spark, "snapshot-out"), new_path(spark, "snapshot-checkpoint")
    for part in parts:
        spark.createDataFrame(part, columns).write.mode("append").parquet(path)
        jobs.stream_watchlist(jobs.panel_stream(spark, path, spark.read.parquet(path).schema), out, checkpoint, n=7).awaitTermination()
    batch = spark.read.parquet(path).where(F.col("time") < at(60))
    top = watchlist_topk(batch, 7)
    names = ["time", "rank", "segment_id", "score"]
    assert sorted(map(tuple, spark.read.parquet(f"{out}/watchlist").select(*names).collect())) == sorted(map(tuple, top.select(*names).collect()))
    names = ["time", "kind", "segment_id"]
    actions = spark.read.parquet(f"{out}/actions").select(*names).collect()
    assert sorted(map(tuple, actions)) == sorted(map(tuple, dispatch_snapshot(top.drop("rank"), ["time"]).select(*names).collect()))
    assert {k: sum(r["kind"] == k and r["time"] == at(0) for r in actions) for k in ("warning", "patrol", "emergency")} == {"warning": 7, "patrol": 3, "emergency": 1}


def test_late_rows_do_not_reach_closed_sites(spark):
    scored = {"score_stage1_risk": F.lit(0.9), "score_distilled_student": F.lit(0.9), "target_event_30m": F.lit(0), "target_event_id": F.lit(""), "lead_time_min": F.lit(None).cast("double")}
    late = [("late", T0, "G1", 1, 0.0, 0, 0.5)]
    # A batch drops rows below the watermark its predecessor ran with.
    path = write_parts(spark, [rows([0, 5]), rows([40]), rows([60]), late, rows([80])], "site-parts")
    got = run(spark, jobs.stream_sites(stream(spark, path).withColumns(scored)), "site-out")
    found = {r.decision_window: r.segment_count for r in got.collect()}
    assert found[T0] == 2
    assert found[T0 + dt.timedelta(minutes=40)] == 2
    assert T0 + dt.timedelta(minutes=80) not in found


def test_dedup_drops_repeats_across_batches(spark):
    path = write_parts(spark, [rows([0, 5]), rows([5, 10])], "dedup-parts")
    got = run(spark, jobs.stream_dedup(stream(spark, path)), "dedup-out")
    assert got.count() == 6 == got.select("segment_id", "bin5").distinct().count()


def test_best_row_keeps_the_highest_risk(spark):
    low = [("a", T0, "G1", 1, 0.0, 1, 0.2), ("a", T0, "G1", 1, 0.0, 2, 0.8)]
    high = [("a", T0, "G1", 1, 0.0, 3, 0.8)]
    path = write_parts(spark, [low, high, rows([60])], "best-parts")
    got = run(spark, jobs.stream_best_row(stream(spark, path)), "best-out").collect()
    assert [(r.segment_id, r[V.RISK], r.source_row) for r in got] == [("a", 0.8, 3)]
