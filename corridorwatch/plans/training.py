"""Training study: teachers, students and ablations on the staged candidates, scored and evaluated."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridorwatch.config import BuildConfig
from corridorwatch.operators import boosting, features, metrics, models

TEACHERS = ("temporal_only", "spatial_only", "full_teacher")
CALM_SOURCES = ["future_event", "random_negative"]
KEEP = ["segment_id", "bin5", "split", "target_event_30m", "target_event_id", "lead_time_min"]
#: Fits that run side by side: most jobs of a round are too short to fill a cluster.
FITS_AT_ONCE = 5


@dataclass
class Study:
    """Fitted models by name."""

    fitted: dict[str, boosting.Boosted] = field(default_factory=dict)

    def scorers(self) -> dict:
        return {name: model.score for name, model in self.fitted.items()}


def train_study(
    candidates: DataFrame,
    folder: str,
    names: tuple[str, ...] | None = None,
    teacher: boosting.BoostConfig = boosting.TEACHER,
    student: boosting.BoostConfig = boosting.STUDENT,
) -> Study:
    """Fit the teachers, the student and its ablations (or those in ``names``) in legs below ``folder``.

    ``candidates`` needs the split column and must not change between runs on one folder: a
    study that stopped goes on where it was. Models that do not need each other are fitted side by
    side, FITS_AT_ONCE at a time; each leg is a distributed job over the training rows.
    """
    sets = features.feature_sets(candidates.columns)
    train = candidates.where("split = 'train'")
    study = Study()

    def wanted(name: str) -> bool:
        return names is None or name in names

    def fit_teacher(name: str, rows: DataFrame, inputs: list[str]) -> boosting.Boosted:
        weighted = models.add_weight(rows, 25.0)
        return boosting.boost(weighted, inputs, "target_event_30m", "__weight", True, teacher, f"{folder}/{name}")

    teachers = {name: (train, sets[name]) for name in TEACHERS if wanted(name) or name == "full_teacher"}
    if wanted("no_data_distillation"):
        teachers["no_data_distillation"] = (train.where(F.col("candidate_source").isin(CALM_SOURCES)), sets["full_teacher"])
    study.fitted |= _side_by_side(train.sparkSession, fit_teacher, teachers)

    teacher_score = study.scorers()["full_teacher"](train, "__teacher")
    softened = models.soft_target(teacher_score, "__teacher")
    hard = softened.withColumn("hard_target", F.col("target_event_30m").cast("double"))
    variants = {
        "distilled_student": (softened, sets["student"], "soft_target"),
        "student_no_spatial": (softened, sets["student_no_spatial"], "soft_target"),
        "student_no_temporal": (softened, sets["student_no_temporal"], "soft_target"),
        "student_no_teacher_kd": (hard, sets["student"], "hard_target"),
        "student_no_hard_negative_distillation": (
            softened.where("candidate_source <> 'hard_negative'"),
            sets["student"],
            "soft_target",
        ),
    }

    def fit_student(name: str, rows: DataFrame, inputs: list[str], target: str) -> boosting.Boosted:
        return boosting.boost(rows, inputs, target, "sample_weight", False, student, f"{folder}/{name}")

    study.fitted |= _side_by_side(train.sparkSession, fit_student, {name: given for name, given in variants.items() if wanted(name)})
    if names is not None and "full_teacher" not in names:
        del study.fitted["full_teacher"]
    return study


def _side_by_side(spark: SparkSession, fit: Callable[..., boosting.Boosted], given: dict[str, tuple]) -> dict[str, boosting.Boosted]:
    """``fit(name, *arguments)`` of every entry of ``given``, in its order."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(fit), name, *arguments) for name, arguments in given.items()}
        return {name: fitted.result() for name, fitted in running.items()}


def score_study(study: Study, rows: DataFrame, stage1: str) -> DataFrame:
    """Long scores of every model, the panel's own risk included as ``stage1_risk``."""
    with_stage1 = rows.withColumn("score_stage1_risk", F.col(stage1).cast("double"))
    scorers = {"stage1_risk": lambda df, column: df, **study.scorers()}
    scored = models.score_models(with_stage1, scorers, KEEP)
    return scored.withColumnsRenamed({"target_event_30m": "y", "target_event_id": "event_id"})


def evaluate_study(scores: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """Thresholds from validation, all metrics on the test split.

    Some models alert at the fixed threshold, the others at the one of the best
    validation F1.
    """
    tuned = metrics.choose_threshold(scores.where("split = 'validation'"), ["model"], config.alert_threshold)
    fixed = metrics.fixed_threshold(F.col("model"))
    thresholds = tuned.select(
        "model", F.when(fixed, config.hard_threshold).otherwise(F.col("threshold")).alias("threshold")
    )
    # One row per model.
    test = scores.where("split = 'test'").join(F.broadcast(thresholds), "model")
    keys = ["model", "threshold"]
    binary = metrics.threshold_metrics(test, keys, F.col("threshold"))
    events = metrics.event_level_metrics(test, keys, F.col("threshold"))
    counts = ["event_count", "detected_event_count"]
    joined = binary.join(metrics.areas(test, keys), keys).join(events, keys, "left").na.fill(0, counts)
    return metrics.false_alarm_reduction(joined)
