"""Model fits: every variant runs, scores stay in range, calibration follows the score."""

import json
import math
import threading
from dataclasses import replace

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.functions.columns import logit
from corridorwatch.operators import boosting, labels, models
from corridorwatch.operators.candidates import registry_split
from corridorwatch.plans import queries_models, replay, staging, training
from corridorwatch.session import new_path
from corridorwatch.sources import files, testbed


@pytest.fixture(scope="module")
def context(spark, sf_dir):
    return staging.context(spark, sf_dir)


SMALL = {"rounds": 4, "leg_rounds": 2, "depth": 2}


def test_all_models_of_the_study(spark, sf_dir):
    table = staging.candidates(spark, sf_dir)
    study = training.train_study(table, new_path(spark, "study"), teacher=replace(boosting.TEACHER, **SMALL), student=replace(boosting.STUDENT, **SMALL))
    held = table.where("split <> 'train'")
    scores = training.score_study(study, held, V.RISK).cache()
    names = {r.model for r in scores.select("model").distinct().collect()}
    assert names == {
        "stage1_risk", "temporal_only", "spatial_only", "full_teacher", "no_data_distillation", "distilled_student",
        "student_no_spatial", "student_no_temporal", "student_no_teacher_kd", "student_no_hard_negative_distillation",
    }
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= low <= high <= 1.0
    found = {r.model: r for r in training.evaluate_study(scores, testbed.SPLITS).collect()}
    assert set(found) == names
    assert found["stage1_risk"].false_alarm_reduction_vs_stage1 == 0.0
    assert found["distilled_student"].threshold == 0.6
    rows = table.where("split = 'test'").count()
    assert all(r["rows"] == rows and 0.0 <= r.roc_auc <= 1.0 and 0.6 <= r.threshold <= 0.95 for r in found.values())
    share = boosting.tree_importance(study.fitted["full_teacher"], spark)
    assert share.count() == len(study.fitted["full_teacher"].features)
    gain, splits = share.agg(F.sum("gain_share"), F.sum("split_importance")).first()
    assert gain == pytest.approx(1.0) and 0 < splits <= 4 * 3


def test_models_of_the_study_are_fitted_side_by_side(spark, monkeypatch):
    """Four teachers meet before any of them is done; the results keep the order of their names."""
    together = threading.Barrier(4)

    def fit(train, features, label, weight, logistic, config, folder):
        if logistic:
            together.wait(60)
        return boosting.Boosted(features, logistic, 0.0, config, folder)

    monkeypatch.setattr(boosting, "boost", fit)
    row = "segment_id string, split string, target_event_30m int, candidate_source string"
    rows = spark.createDataFrame([("a", "train", 1, "future_event"), ("b", "train", 0, "random_negative")], row)
    study = training.train_study(rows, "unused")
    assert list(study.fitted) == [
        "temporal_only", "spatial_only", "full_teacher", "no_data_distillation", "distilled_student", "student_no_spatial",
        "student_no_temporal", "student_no_teacher_kd", "student_no_hard_negative_distillation",
    ]


#: Rounds and depth of every model of the study.
FULL = {
    **dict.fromkeys(["temporal_only", "spatial_only", "full_teacher", "no_data_distillation"], (360, 8)),
    **dict.fromkeys(
        ["distilled_student", "student_no_spatial", "student_no_temporal", "student_no_teacher_kd", "student_no_hard_negative_distillation"], (96, 5)
    ),
}


@pytest.fixture(scope="module")
def kept():
    """What was asked of the fits, and the studies: the queries under test share them."""
    return {}, {}


@pytest.fixture
def asked(kept, monkeypatch):
    """The rounds and depth that the registered queries ask of each model; the fits behind them are SMALL."""
    found, boost = kept[0], boosting.boost

    def small(train, features, label, weight, logistic, config, folder):
        found[folder.rsplit("/", 1)[-1]] = (config.rounds, config.depth)
        return boost(train, features, label, weight, logistic, replace(config, **SMALL), folder)

    monkeypatch.setattr(boosting, "boost", small)
    monkeypatch.setattr(queries_models, "_STUDIES", kept[1])
    return found


@pytest.mark.parametrize(
    "name, told",
    [
        ("fit_student", {"distilled_student"}),
        ("fit_teacher", {"full_teacher"}),
        ("importance_rank", {None}),
        ("score_models", {"stage1_risk", *FULL}),
        ("training_history", set(FULL)),
    ],
)
def test_registered_fits_have_all_rounds_and_levels(spark, sf_dir, asked, name, told):
    rows = getattr(queries_models, name)(spark, sf_dir).collect()
    assert asked == FULL
    assert {r.asDict().get("model") for r in rows} == told


def _boosting_rows(spark):
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    z = F.pmod(F.xxhash64(F.col("id") + 7), F.lit(1000)) / 1000
    df = spark.range(1500).select(x.alias("x"), F.when(z > 0.05, z).alias("z"), "id")
    chance = F.when(F.col("x") > 0.6, 0.8).otherwise(0.15)
    return df.withColumn("y", (F.pmod(F.xxhash64(F.col("id") + 99), F.lit(1000)) / 1000 < chance).cast("int")).withColumn("w", F.lit(1.0))


@pytest.mark.parametrize("logistic", [True, False])
def test_legs_lower_the_loss_and_resume(spark, logistic):
    """Each leg lowers the training loss; a fit that goes on equals one that never stopped."""
    df = _boosting_rows(spark)
    config = boosting.BoostConfig(rounds=9, depth=3, step=0.1, min_rows=10, leg_rounds=3)
    folder = new_path(spark, "legs")
    boosting.boost(df, ["x", "z"], "y", "w", logistic, replace(config, rounds=3), folder)
    resumed = boosting.boost(df, ["x", "z"], "y", "w", logistic, config, folder)
    whole = boosting.boost(df, ["x", "z"], "y", "w", logistic, config, new_path(spark, "legs"))
    assert [m.getNumTrees for m in resumed.legs] == [3, 3, 3] == config.legs()
    a, b = (m.score(df, "s").orderBy("id").select("s").toPandas()["s"] for m in (resumed, whole))
    assert a.tolist() == pytest.approx(b.tolist(), abs=1e-12)
    losses = [r.value for r in boosting.leg_history(whole, {"train": df}, "y", "m").orderBy("iteration").collect()]
    assert losses == sorted(losses, reverse=True) and losses[-1] < (0.53 if logistic else 0.175)
    # what the legs wrote is the score that the model gives
    written = spark.read.parquet(f"{whole.folder}/leg-002-3/rows").agg(F.sum("raw")).first()[0]
    scored, after = whole.raw(df)
    assert scored.agg(F.sum(after[-1])).first()[0] == pytest.approx(written)


def test_boosting_of_an_empty_table(spark):
    model = boosting.boost(_boosting_rows(spark).limit(0), ["x", "z"], "y", "w", True, boosting.STUDENT, new_path(spark, "legs"))
    assert model.legs == [] and model.score(_boosting_rows(spark).limit(3), "s").select("s").distinct().count() == 1


def test_calibration_rises_with_the_score(spark):
    rows = [(i / 200, int(i % 10 < i / 25)) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "score double, y int")
    out = models.apply_platt(models.fit_platt(df, "score", "y", 100.0), df, "score", "p").orderBy("score").collect()
    assert all(a.p < b.p for a, b in zip(out, out[1:]))
    assert sum(r.p for r in out) == pytest.approx(sum(r.y for r in out), rel=0.02)


@pytest.mark.parametrize("strength", [0.01, 10.0, 1e6])
def test_calibration_on_counts_equals_the_fit_on_rows(spark, strength):
    """The line that MLlib finds on all rows, with the same penalty."""
    score = F.pmod(F.xxhash64("id"), F.lit(97)) / 97
    df = spark.range(4000).select(score.alias("s"), (F.pmod(F.xxhash64(F.col("id") + 5), F.lit(1000)) / 1000 < F.pow(score, F.lit(1.7))).cast("int").alias("y"))
    data = df.select(logit(F.col("s")).alias("x"), F.col("y").cast("double").alias("y"))
    lr = LogisticRegression(featuresCol="f", labelCol="y", standardization=False, regParam=1.0 / (strength * 4000), maxIter=1000, tol=1e-13)
    want = lr.fit(VectorAssembler(inputCols=["x"], outputCol="f").transform(data))
    got = models.fit_platt(df, "s", "y", strength)
    assert (got.coefficient, got.intercept) == pytest.approx((want.coefficients[0], want.intercept), abs=1e-6)


def test_calibration_of_one_class_is_a_constant(spark):
    df = spark.createDataFrame([(0.2, 0), (0.9, 0), (None, 1), (0.4, None)], "s double, y int")
    assert models.fit_platt(df, "s", "y", 10.0) == models.Platt(0.0, pytest.approx(math.log(1 / 3)))
    assert models.fit_platt(df.limit(0), "s", "y", 10.0) == models.Platt(0.0, 0.0)


def test_calibration_of_separated_classes(spark):
    df = spark.createDataFrame([(0.01 * i, int(i > 50)) for i in range(1, 100)], "s double, y int")
    model = models.fit_platt(df, "s", "y", 100.0)
    assert model.coefficient > 3 and models.apply_platt(model, df, "s", "p").where("(p > 0.5) <> (y = 1)").count() <= 2


def test_type_model_feeds_the_replay(spark, sf_dir, context):
    registry = files.registry_cyclic(testbed.registry(spark, sf_dir).drop("predicted_type"))
    registry = registry.withColumn("split", registry_split(testbed.SPLITS))
    numeric, categorical = ["stake_km", "traffic", "median_speed", "hour_sin"], ["direction_code", "weather", "key_vehicle"]
    model, stats = models.fit_type(registry.where("split <> 'test'"), numeric, categorical, trees=5, depth=3)
    scored = models.score_type(model, stats, registry, numeric, categorical)
    assert scored.count() == registry.count()
    events = labels.accident_events(staging.panel(spark, sf_dir), per=None)
    packets = replay.replay(context, events, scored).collect()
    assert packets
    for p in packets:
        packet = json.loads(p.packet)
        kinds = packet["type_hypotheses"]
        assert len(kinds) == 3 and kinds[0]["probability"] >= kinds[1]["probability"] >= kinds[2]["probability"]
        assert packet["decision"]["alert"] and packet["audit"]["operator_confirmation_required"]
        text = json.dumps(packet["compressed_long_term_memory"], separators=(",", ":"), ensure_ascii=False)
        assert abs(packet["memory_packet_bytes_utf8"] - len(text.encode())) <= 40
