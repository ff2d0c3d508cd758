"""Candidate build: panel -> labels -> context -> stratified candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch.config import BuildConfig
from corridorwatch.operators import candidates, cleaning, features, labels

DEFAULT = BuildConfig()


def context_panel(
    panel: DataFrame, config: BuildConfig = DEFAULT, points: DataFrame | None = None, day: str | None = None
) -> DataFrame:
    """Labels and all context features on a clean, deduplicated panel.

    Labels come first, while rows are narrow. Two more shuffles follow: by
    (time, corridor, range) and by (segment, day). With ``day`` the date becomes a column of
    that name and the last shuffle deals the rows in ranges of date and segment, so that
    they can be written by day as they come.
    """
    labelled = labels.label_future_events(panel, config, points)
    spatial = features.add_spatial_features(labelled)
    if day is not None:
        spatial = spatial.withColumn(day, F.to_date("bin5")).repartitionByRange(day, "segment_id")
    return features.add_context_features(features.add_temporal_features(spatial, day))


def build_candidates(raw: DataFrame, config: BuildConfig = DEFAULT) -> DataFrame:
    """From the typed raw panel to the candidate table with its split."""
    panel = cleaning.panel_dedup(cleaning.in_month(cleaning.clean_panel(raw)))
    drawn = candidates.stratified_sample(context_panel(panel, config), config)
    return drawn.withColumn("split", candidates.split_name(config))


def add_strata(context: DataFrame, config: BuildConfig = DEFAULT) -> DataFrame:
    """Class and split of every panel row, without sampling."""
    return context.withColumns(
        {"candidate_source": candidates.candidate_source(config), "split": candidates.split_name(config)}
    )


def month_files(raw: DataFrame) -> DataFrame:
    return raw.withColumn("month", F.month("bin5"))
