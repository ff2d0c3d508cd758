"""Queries over the whole labelled panel, not over the candidates drawn from it."""

import datetime as dt

import pytest

import __spark_entry__ as entry_module
from corridorwatch.session import new_path

DAY = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: More hard negatives on one day than the sample takes of them.
ROWS = 700


@pytest.fixture(scope="module")
def one_day(spark):
    folder = new_path(spark, "one-day")
    ids = [i for i in range(1, 2 * ROWS) if i % 17][:ROWS]  # the others lie outside their file's month
    rows = [(i, DAY, n, "view", 135.0, '{"k": 1}') for n, i in enumerate(ids)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{folder}/events.parquet")
    return folder


def test_negatives_come_from_the_whole_panel(spark, one_day):
    assert entry_module.queries()["negative_sample"](spark, one_day).count() == ROWS


@pytest.mark.parametrize("name", ["panel_profile", "sink_summary_json"])
def test_summaries_count_the_whole_panel(spark, one_day, name):
    assert entry_module.queries()[name](spark, one_day).first().candidate_rows == ROWS
