"""Historical replay: the best early warning of every event as a decision packet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch.operators import labels, packets, policy, watchlist


def replay_rows(scored: DataFrame, events: DataFrame, registry: DataFrame, direction: str = "nearest") -> DataFrame:
    """Best detected row per event with its nearest historical context and review.

    ``registry`` needs a ``predicted_type``; with ``class_probabilities`` and
    ``class_labels`` (as the type model returns them) the packet lists the three
    likeliest types. ``nearest`` may pick an entry later than the event,
    ``backward`` keeps to what was known.
    """
    best = watchlist.event_lookup(watchlist.best_replay_row(scored), events)
    asked = best.select("target_event_id", F.col("event_time").alias("at"), F.col("event_direction").alias("direction_code"))
    names = ["registry_id", "at", "direction_code", "predicted_type", "weather", "traffic", "median_speed"]
    names += ["upstream_traffic", "downstream_traffic", "serious_injured", "deaths", "key_vehicle"]
    ranked = {"class_probabilities", "class_labels"} <= set(registry.columns)
    if ranked:
        hypotheses = watchlist.top3_types(F.col("class_probabilities"), F.col("class_labels"))
    else:
        hypotheses = F.array(F.struct(F.col("predicted_type").alias("type")))
    known = registry.withColumnRenamed("occurred_at", "at").select(*names, hypotheses.alias("type_hypotheses"))
    context = labels.nearest_context(asked, known, direction).drop("at", "direction_code")
    # Measures and severity follow the predicted, not the recorded type.
    judged = policy.severity_gate(context.withColumnRenamed("predicted_type", "accident_type"))
    return best.join(policy.registry_measures(judged), "target_event_id")


def replay(scored: DataFrame, events: DataFrame, registry: DataFrame, direction: str = "nearest") -> DataFrame:
    """(target_event_id, packet) with the packet as JSON text."""
    return packets.replay_packet(replay_rows(scored, events, registry, direction))
