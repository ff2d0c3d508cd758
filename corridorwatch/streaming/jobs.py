"""Structured Streaming jobs over the panel; each equals its batch operator.

Event-time columns are zoned timestamps here (watermarks need them), so the
session time zone must be UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corridorwatch import schemas
from corridorwatch import vocabulary as V
from corridorwatch.config import DispatchConfig
from corridorwatch.operators.dispatch import dispatch_snapshot
from corridorwatch.operators.sites import real_event_id
from corridorwatch.operators.watchlist import TOP, watchlist_topk
from corridorwatch.sources.audit import audit_records

DEFAULT = DispatchConfig()


def panel_stream(spark: SparkSession, path: str, schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a panel folder as a stream."""
    reader = spark.readStream.schema(schema if schema is not None else schemas.PANEL)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _timed(df: DataFrame, delay: str) -> DataFrame:
    return df.withColumn("event_time", F.col("bin5").cast("timestamp")).withWatermark("event_time", delay)


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is available now to parquet files."""
    return (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_sites(scored: DataFrame, config: DispatchConfig = DEFAULT, delay: str = "10 minutes") -> DataFrame:
    """Site windows that the watermark has closed; later rows are dropped."""
    df = _timed(scored, delay)
    zone = (F.floor(F.col("stake") / config.zone_m) * config.zone_m).cast("int")
    best = F.greatest("score_stage1_risk", "score_distilled_student")
    return (
        df.where(best >= config.candidate_score_minimum)
        .groupBy(
            F.window("event_time", f"{config.window_minutes} minutes").alias("w"),
            "road_code",
            "direction_code",
            zone.alias("spatial_zone"),
        )
        .agg(
            F.size(F.collect_set("segment_id")).alias("segment_count"),
            F.min_by("segment_id", F.struct("bin5", "stake", "segment_id")).alias("representative_segment"),
            F.avg("stake").alias("stake_m"),
            F.max("score_stage1_risk").alias("stage1_score"),
            F.max("score_distilled_student").alias("student_score"),
            F.max("target_event_30m").alias("actual_positive"),
            F.array_sort(F.collect_set(real_event_id(F.col("target_event_id")))).alias("event_ids"),
            F.max("lead_time_min").alias("maximum_lead_time_min"),
        )
        .select(F.col("w.start").cast("timestamp_ntz").alias("decision_window"), "*")
        .drop("w")
    )


def stream_dedup(panel: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First arrival per (segment, bin); repeats inside the watermark are dropped."""
    return _timed(panel, delay).dropDuplicatesWithinWatermark(["segment_id", "event_time"]).drop("event_time")


def stream_best_row(panel: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The batch rule on a stream: highest risk per (segment, bin), once the bin is closed."""
    df = _timed(panel, delay)
    best = F.max_by(F.struct(V.RISK, "road_code", "direction_code", "stake", "source_row"), F.struct(V.RISK, "source_row"))
    return (
        df.groupBy(F.window("event_time", "5 minutes").alias("w"), "segment_id")
        .agg(best.alias("r"))
        .select("segment_id", F.col("w.start").cast("timestamp_ntz").alias("bin5"), "r.*")
    )


MEMORY_SCHEMA = (
    f"segment_id string, day string, bin5 timestamp_ntz, {V.RISK} double, risk_lag_5m double, "
    "risk_lag_30m double, risk_mean_past_30m double, risk_change_30m double"
)


def _millis(moments: pd.Series) -> pd.Series:
    """Milliseconds since 1970 in UTC of zoned or local timestamps."""
    plain = moments.dt.tz_convert("UTC").dt.tz_localize(None) if moments.dt.tz is not None else moments
    return plain.astype("datetime64[ms]").astype("int64")


def _packed(frame: pd.DataFrame) -> bytes:
    """A frame as one Arrow stream, so that state holds it as one value."""
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(value)).read_pandas()


class SegmentMemory(StatefulProcessor):
    """Lags, mean and change over the positions of each segment and day, in bin order whatever the order of arrival.

    A key is a slice of the segments on one day, so calls and state accesses grow with slices and
    days, and the rows of a slice are worked on column by column. Rows wait in state until the
    watermark has passed their bin: no row that belongs before them can come any more. A timer at
    the earliest waiting bin releases them. Of rows of one bin the highest risk counts, as in the
    batch. State holds the waiting rows, which the delay bounds, and the last six values of a
    segment; it goes when the day is over.
    """

    SIZE = 6

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [self._held()] if self.rows.exists() else []
        for batch in rows:
            fresh = {"segment": batch["segment_id"], "at": _millis(batch["bin5"]), "risk": batch[V.RISK].astype("float64"), "told": False}
            frames.append(pd.DataFrame(fresh))
        held = pd.concat(frames, ignore_index=True)
        # a missing risk comes as NaN and gives way to any number
        waiting = held[~held["told"]].sort_values("risk", na_position="first", kind="stable")
        waiting = waiting.drop_duplicates(["segment", "at"], keep="last")
        if len(waiting):
            self.rows.update((_packed(pd.concat([held[held["told"]], waiting], ignore_index=True)),))
            self._wake(int(waiting["at"].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.rows.exists():
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        left = held[~held["told"] & (held["at"] > watermark)]
        known = held[held["told"] | (held["at"] <= watermark)].sort_values(["told", "at"], ascending=[False, True], kind="stable")
        if not known["told"].all():
            yield self._memory(key, known)
        end = int((pd.Timestamp(key[1]) + pd.Timedelta(days=1)).timestamp() * 1000)
        if left.empty and watermark >= end:
            self.rows.clear()
            return
        recent = known.groupby("segment", sort=False, dropna=False).tail(self.SIZE).assign(told=True)
        self.rows.update((_packed(pd.concat([recent, left], ignore_index=True)),))
        self._wake(end if left.empty else int(left["at"].min()))

    def _held(self) -> pd.DataFrame:
        return _unpacked(self.rows.get()[0])

    def _wake(self, at: int) -> None:
        if at not in self.handle.listTimers():
            self.handle.registerTimer(at)

    def _memory(self, key, known: pd.DataFrame) -> pd.DataFrame:
        """The features of the rows not told yet; rows of a segment come in order, the told ones first."""
        risk = known.groupby("segment", sort=False, dropna=False)["risk"]
        past = pd.concat([risk.shift(k) for k in range(self.SIZE)], axis=1)
        out = pd.DataFrame(
            {
                "segment_id": known["segment"],
                "day": key[1],
                "bin5": pd.to_datetime(known["at"], unit="ms"),
                V.RISK: known["risk"],
                "risk_lag_5m": risk.shift(1),
                "risk_lag_30m": risk.shift(self.SIZE),
                "risk_mean_past_30m": past.mean(axis=1).where(past.count(axis=1) >= 2),
            }
        )
        out["risk_change_30m"] = out[V.RISK] - out["risk_lag_30m"]
        return out[~known["told"]].reset_index(drop=True)

    def close(self) -> None:
        pass


def stream_memory(panel: DataFrame, delay: str = "10 minutes", slices: int = 128) -> DataFrame:
    """30-minute memory per segment and day, carried across micro-batches.

    Rows may arrive in any order within ``delay``; each comes out once the watermark has
    passed its bin. Segments are kept in ``slices`` by their hash: one call serves a slice of a
    day, whose rows have to fit in a task. Needs the RocksDB state store provider.
    """
    df = _timed(panel.select("segment_id", "bin5", V.RISK), delay)
    part = F.pmod(F.xxhash64("segment_id"), F.lit(slices)).alias("slice")
    keyed = df.select(part, F.date_format("bin5", "yyyy-MM-dd").alias("day"), "segment_id", "bin5", V.RISK, "event_time")
    return keyed.groupBy("slice", "day").transformWithStateInPandas(
        statefulProcessor=SegmentMemory(),
        outputStructType=MEMORY_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


class SnapshotTop(StatefulProcessor):
    """The best rows of one slice of a snapshot, at most ``n`` in state, given out when the watermark closes the snapshot."""

    SCHEMA = "score double, segment_id string, payload string"

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", self.SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["score", "segment_id", "payload"]
        found = pd.DataFrame(list(self.best.get()) if self.best.exists() else [], columns=names)
        closing = None
        for batch in rows:
            closing = int(_millis(batch["event_time"]).iloc[0])
            found = self._top(pd.concat([found, self._top(batch[names])]) if len(found) else self._top(batch[names]))
        if len(found):
            self.best.put(list(found.itertuples(index=False, name=None)))
        if closing is not None and closing not in self.handle.listTimers():
            self.handle.registerTimer(closing)
        yield from ()

    def _top(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The ``n`` best rows; only those that reach the nth score are sorted."""
        if len(rows) > self.n:
            score = rows["score"].fillna(float("-inf"))
            rows = rows[score >= np.partition(score.to_numpy(), -self.n)[-self.n]]
        return rows.sort_values(["score", "segment_id"], ascending=[False, True]).head(self.n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = list(self.best.get()) if self.best.exists() else []
        self.best.clear()
        yield pd.DataFrame([r[2] for r in found], columns=["payload"], dtype=object)

    def close(self) -> None:
        pass


def closed_snapshots(watchlist: DataFrame, n: int = TOP, delay: str = "10 minutes", slices: int = 8) -> DataFrame:
    """The rows that can be among the top ``n`` of a snapshot, once the watermark has closed it.

    A snapshot may arrive over any number of micro-batches within ``delay``. It is kept in
    ``slices`` by a hash of the segment, so one large snapshot is spread over tasks; all
    slices of a snapshot close in the same micro-batch. Needs the RocksDB state store provider.
    """
    timed = watchlist.withColumn("event_time", F.to_timestamp("time")).withWatermark("event_time", delay)
    keyed = timed.select(
        "time", F.pmod(F.xxhash64("segment_id"), F.lit(slices)).alias("slice"), "event_time", "score",
        F.coalesce("segment_id", F.lit("")).alias("segment_id"), F.to_json(F.struct(*watchlist.columns)).alias("payload"),
    )
    best = keyed.groupBy("time", "slice").transformWithStateInPandas(
        statefulProcessor=SnapshotTop(n), outputStructType="payload string", outputMode="Append", timeMode="EventTime"
    )
    return best.select(F.from_json("payload", watchlist.schema).alias("row")).select("row.*")


def stream_watchlist(
    watchlist: DataFrame, path: str, checkpoint: str, n: int = TOP, delay: str = "10 minutes", config: DispatchConfig = DEFAULT
) -> StreamingQuery:
    """One ranking and one set of capacity-limited actions per snapshot, when the watermark closes it.

    Batches are written under their id, so a repeated batch replaces its output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        top = watchlist_topk(batch, n)
        ranked = f"{path}/watchlist/batch={batch_id}"
        top.write.mode("overwrite").parquet(ranked)
        # from the written rows: another look at the batch would run it again, state included
        top = batch.sparkSession.read.schema(top.schema).parquet(ranked)
        actions = dispatch_snapshot(top.drop("rank"), ["time"], config)
        actions.write.mode("overwrite").parquet(f"{path}/actions/batch={batch_id}")

    return (
        closed_snapshots(watchlist, n, delay)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_audit(payloads: DataFrame) -> DataFrame:
    """Valid audit records of a payload stream."""
    return audit_records(payloads)[0]
