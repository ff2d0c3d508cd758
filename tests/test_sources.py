"""Readers by header name, months written one at a time, and loud failures."""

import datetime

import pytest
from pyspark.sql import functions as F

from corridorwatch import schemas
from corridorwatch import vocabulary as V
from corridorwatch.operators import risk
from corridorwatch.sources import files, sinks


def test_csv_columns_go_by_name(spark, tmp_path):
    names = schemas.SNAPSHOT_TEXT.fieldNames()
    values = {n: f"{k}" for k, n in enumerate(names)} | {"segment_id": "SEG1", "road_code": "S5"}
    order = ["extra", *reversed(names)]
    (tmp_path / "a.csv").write_text("﻿" + ",".join(order) + "\n" + ",".join(values.get(n, "x") for n in order) + "\n", encoding="utf-8")
    row = files.scan_snapshot(spark, str(tmp_path)).first()
    assert (row["segment_id"], row["road_code"]) == ("SEG1", "S5")
    assert row["stake_m"] == float(values["stake"]) and row["stage1_score"] == float(values[V.RISK])


def test_csv_without_a_column_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("segment_id,road_code\n1,2\n")
    with pytest.raises(ValueError, match="columns missing"):
        files.scan_snapshot(spark, str(tmp_path))


def test_months_are_written_one_at_a_time(spark, tmp_path):
    month = lambda y, m: spark.createDataFrame([(f"{y}-{m}", datetime.datetime(y, m, 3))], "k string, bin5 timestamp_ntz")
    for df in (month(2025, 7), month(2025, 8), month(2026, 8), month(2025, 8)):
        sinks.write_month_tables({"t": df}, str(tmp_path))
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == ["2025-7", "2025-8", "2026-8"]


def test_default_features_must_be_one_row(spark):
    one = spark.range(1).select(*[F.lit(0.5).alias(c) for c in V.STUDENT])
    asked = spark.range(3).withColumn("k", F.lit(1))
    assert risk.normalize_features(asked, one).count() == 3
    for wrong in (one.limit(0), one.union(one)):
        with pytest.raises(Exception, match="expected one row"):
            risk.normalize_features(asked, wrong).collect()
