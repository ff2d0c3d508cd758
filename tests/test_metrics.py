"""Score metrics against direct definitions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from corridorwatch.functions import selection
from corridorwatch.operators import metrics, multiclass


def make_rows(seed, n=400, levels=60):
    rng = random.Random(seed)
    return [("m", int(rng.random() < 0.3), rng.randrange(levels) / levels + rng.choice([0, 1e-10, 3e-7])) for _ in range(n)]


def pairwise_auc(rows):
    pos = [s for _, y, s in rows if y]
    neg = [s for _, y, s in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def step_precision(rows):
    total, out, tp, seen = sum(y for _, y, _ in rows), 0.0, 0, 0
    for s in sorted({s for _, _, s in rows}, reverse=True):
        hits = [y for _, y, x in rows if x == s]
        tp, seen = tp + sum(hits), seen + len(hits)
        out += sum(hits) / total * tp / seen
    return out


@pytest.mark.parametrize("seed,levels", [(1, 60), (2, 7), (3, 10**6)])
def test_areas_equal_their_definitions(spark, seed, levels):
    rows = make_rows(seed, levels=levels)
    got = metrics.areas(spark.createDataFrame(rows, "model string, y int, score double"), ["model"]).first()
    assert got.roc_auc == pytest.approx(pairwise_auc(rows), abs=1e-12)
    assert got.pr_auc == pytest.approx(step_precision(rows), abs=1e-12)


def test_areas_ignore_monotone_maps(spark):
    df = spark.createDataFrame(make_rows(4, levels=50), "model string, y int, score double")
    a = metrics.areas(df, ["model"]).first()
    b = metrics.areas(df.withColumn("score", F.col("score") ** 3), ["model"]).first()
    assert (a.roc_auc, a.pr_auc) == pytest.approx((b.roc_auc, b.pr_auc), abs=1e-12)


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([("m", 0, 0.2), ("m", 0, 0.7)], "model string, y int, score double")
    got = metrics.binary_metrics(df, ["model"], F.lit(0.6)).first()
    assert got.roc_auc is None and got.pr_auc is None and got.precision == 0.0 and got.f1 == 0.0


def test_threshold_sweep_is_exact_on_grid_values(spark):
    grid = metrics.threshold_grid()
    rng = random.Random(6)
    rows = [("m", int(rng.random() < 0.4), rng.choice(grid) + rng.choice([0.0, 1e-16, -1e-16, 0.002])) for _ in range(600)]
    rows += [("m", 1, 0.1), ("m", 0, 0.99), ("m", 1, 1.0), ("m", 0, 0.0)]
    df = spark.createDataFrame(rows, "model string, y int, score double")
    curve = {r.threshold: (r.tp, r.fp) for r in metrics.threshold_curve(df, ["model"]).collect()}
    assert len(curve) == 71
    for t in grid:
        assert curve[t] == (sum(y for _, y, s in rows if s >= t), sum(1 - y for _, y, s in rows if s >= t))
    f1 = {t: 2 * a / (a + b + sum(y for _, y, _ in rows)) for t, (a, b) in curve.items()}
    assert metrics.choose_threshold(df, ["model"]).first().threshold == min(f1, key=lambda t: (-f1[t], t))


def test_bootstrap_of_one_repeated_day_equals_the_day(spark):
    rows = [(dt.date(2025, 9, 1), y, s) for _, y, s in make_rows(8)]
    df = spark.createDataFrame(rows, "date date, y int, score double")
    ci = {r.metric: (r.low, r.high, r.samples) for r in metrics.bootstrap_ci(df, 0.6, 5, 1).collect()}
    auc = pairwise_auc([(0, y, s) for _, y, s in rows])
    assert ci["roc_auc"] == pytest.approx((auc, auc, 5), abs=1e-12)


def test_bootstrap_equals_resampled_rows(spark):
    rng = random.Random(9)
    rows = [(dt.date(2025, 9, 1 + d), int(rng.random() < 0.3), rng.randrange(20) / 20) for d in range(4) for _ in range(30)]
    df = spark.createDataFrame(rows, "date date, y int, score double")
    draws = {}
    for r in metrics.day_draws(df.select("date").distinct(), 6, 42).collect():
        draws.setdefault(r.iteration, {})[r.date] = r.weight
    assert all(sum(d.values()) == 4 for d in draws.values())
    for r in metrics.bootstrap_samples(df, 0.6, 6, 42).collect():
        sample = [(0, y, s) for d, y, s in rows for _ in range(draws[r.iteration].get(d, 0))]
        assert r.roc_auc == pytest.approx(pairwise_auc(sample), abs=1e-12)
        assert r.pr_auc == pytest.approx(step_precision(sample), abs=1e-12)


def test_set_f1_of_disjoint_and_equal_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["c"]), (["a"], ["a"]), (["a", "b"], ["b", "c"])], "l array<string>, r array<string>")
    got = [r.f for r in df.select(multiclass.set_f1(F.col("l"), F.col("r")).alias("f")).collect()]
    assert got == pytest.approx([0.0, 1.0, 0.5])


def test_macro_f1_counts_absent_labels_as_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "t string, p string")
    assert multiclass.multiclass_metrics(df, "t", "p", ["a", "b", "c"]).first().macro_f1 == pytest.approx(2 / 3 / 3)
    assert math.isclose(multiclass.multiclass_metrics(df, "t", "p").first().macro_f1, 1 / 3)


def test_medians_and_modes_equal_the_aggregates(spark):
    """Shared values, wide and tiny ranges, even and odd numbers, one value, none, missing ones."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000))
    df = spark.range(3001).select(
        (h(1) / 7).alias("a"),
        F.when(h(2) < 6000, 5.0).otherwise(h(2) * 1.0).alias("b"),
        F.exp(h(3) / 14.2).alias("c"),
        F.when(F.col("id") < 10, h(4) * 1e-300).alias("d"),
        F.lit(3.5).alias("e"),
        F.lit(None).cast("double").alias("f"),
        F.when(h(5) % 2 == 0, 1e308).otherwise(-1e308).alias("g"),
        (h(6) % 5).cast("string").alias("x"),
        F.when(F.col("id") < 4, (F.col("id") % 2).cast("string")).alias("y"),
        F.lit(None).cast("string").alias("z"),
    )
    numeric, text = list("abcdefg"), list("xyz")
    for part in (df, df.where("c > 2"), df.limit(0)):
        want = part.agg(*[F.median(c).alias(c) for c in numeric], *[F.mode(c, True).alias(c) for c in text]).first()
        got = selection.exact_medians(part, numeric) | selection.exact_modes(part, text)
        assert got == {c: want[c] for c in [*numeric, *text]}
