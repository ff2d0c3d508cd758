"""Segments of the road network and their order along each corridor."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from corridorwatch.functions.positional import positional_window
from corridorwatch.operators.features import CORRIDOR, add_travel_stake

COLUMNS = ["road_code", "direction_code", "road_direction", "stake", "travel_stake"]


def topology(panel: DataFrame) -> DataFrame:
    """One row per segment, taken from its earliest bin."""
    panel = panel if "travel_stake" in panel.columns else add_travel_stake(panel)
    first = F.min_by(F.struct(*COLUMNS), F.struct("bin5", "road_code", "direction_code", "travel_stake")).alias("r")
    return panel.groupBy("segment_id").agg(first).select("segment_id", *[f"r.{c}" for c in COLUMNS])


def _neighbours(w: WindowSpec) -> dict:
    return {
        "upstream_segment_id": F.lag("segment_id").over(w),
        "downstream_segment_id": F.lead("segment_id").over(w),
        "upstream_stake": F.lag("stake").over(w),
        "downstream_stake": F.lead("stake").over(w),
    }


def segment_adjacency(segments: DataFrame, chunk_m: float = 1_000_000.0) -> DataFrame:
    """Previous and next segment along the direction of travel (one row per segment)."""
    return positional_window(
        segments,
        group=CORRIDOR,
        order=["travel_stake", "segment_id"],
        chunk=F.floor(F.col("travel_stake") / chunk_m),
        reach=1,
        build=_neighbours,
    )
