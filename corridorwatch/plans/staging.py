"""Stage boundaries: tables written once per session to the shared folder.

Later steps read the written parquet instead of computing the whole lineage
again; a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridorwatch.session import new_path
from corridorwatch.operators import dispatch, dispatch_evaluation, labels, models, profiling, sites
from corridorwatch.operators.candidates import stratified_sample
from corridorwatch.plans import build
from corridorwatch.sources import testbed

#: Inverse penalties of the calibration of sites and of rows.
SITE_STRENGTH, ROW_STRENGTH = 10.0, 100.0

_WRITTEN: dict[tuple[str, str, str], str] = {}


def staged(
    spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], by: str | None = None, rebalance: bool = True
) -> DataFrame:
    """The table ``name`` derived from ``sf_dir``, written on first use.

    With ``by`` the rows are rebalanced and laid out by that column, so later
    reads can prune; a large value is split over several files. Rows that already
    come in ranges of that column need not be rebalanced.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = new_path(spark, name)
        df = make()
        if by is None:
            df.write.parquet(path)
        else:
            (df.hint("rebalance", by) if rebalance else df).write.partitionBy(by).parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def written_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return _WRITTEN[(spark.sparkContext.applicationId, sf_dir, name)]


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("panel_date", F.date_format("bin5", "yyyy-MM-dd"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, deduplicated panel, laid out by day."""
    return staged(spark, sf_dir, "panel", lambda: _dated(testbed.panel(spark, sf_dir)), by="panel_date").drop("panel_date")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucketed event points; the panel scan behind it reads the accident rows only."""
    return staged(spark, sf_dir, "points", lambda: labels.event_points(panel(spark, sf_dir), testbed.SPLITS))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled panel with all features, stand-in scores, class and split."""

    def make() -> DataFrame:
        built = build.context_panel(panel(spark, sf_dir), testbed.SPLITS, points(spark, sf_dir), day="panel_date")
        return build.add_strata(testbed.with_scores(built), testbed.SPLITS)

    return staged(spark, sf_dir, "context", make, by="panel_date", rebalance=False).drop("panel_date")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn candidates: all positives and the strata of every day."""

    def make() -> DataFrame:
        return _dated(stratified_sample(context(spark, sf_dir).drop("candidate_source"), testbed.SPLITS))

    return staged(spark, sf_dir, "candidates", make, by="panel_date").drop("panel_date")


def month_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counts of the candidates per month and segment, and the target events per month."""
    facts = staged(spark, sf_dir, "month_facts", lambda: profiling.month_facts(candidates(spark, sf_dir)))
    return facts, staged(spark, sf_dir, "month_events", lambda: profiling.month_events(candidates(spark, sf_dir)))


def panel_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same counts over every row of the labelled panel."""
    facts = staged(spark, sf_dir, "panel_facts", lambda: profiling.month_facts(context(spark, sf_dir)))
    return facts, staged(spark, sf_dir, "panel_events", lambda: profiling.month_events(context(spark, sf_dir)))


def site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sites with calibrated and robust probability."""

    def make() -> DataFrame:
        numbered = sites.add_site_ids(sites.aggregate_sites(context(spark, sf_dir)))
        probability = testbed.stand_in_probability(F.col("student_score"))
        return sites.add_robust_probability(numbered.withColumn("calibrated_probability", probability))

    return staged(spark, sf_dir, "sites", make)


def fitted_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with the probability that a calibration fitted on the earlier windows gives them."""

    def make() -> DataFrame:
        table = site_table(spark, sf_dir).drop("calibrated_probability", "robust_probability")
        model = models.fit_platt(table.where(calibration_part()), "student_score", "actual_positive", SITE_STRENGTH)
        return sites.add_robust_probability(models.apply_platt(model, table, "student_score", "calibrated_probability"))

    return staged(spark, sf_dir, "fitted_sites", make)


def calibration_part() -> Column:
    """Site windows that the calibration is fitted on; it is served on the later ones."""
    return F.col("decision_window") < F.lit("2025-09-02").cast("timestamp_ntz")


def pick_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks of all acting strategies."""
    return staged(spark, sf_dir, "picks", lambda: dispatch.all_picks(site_table(spark, sf_dir)))


def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per site, scenario and strategy."""
    return dispatch.decisions(site_table(spark, sf_dir), pick_table(spark, sf_dir))


def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch_evaluation.realized_cost(pick_table(spark, sf_dir), site_table(spark, sf_dir))
