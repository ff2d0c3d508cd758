"""Nested evidence packets as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.functions.columns import text_array
from corridorwatch.operators.policy import registry_measures

KEEP_NULLS = {"ignoreNullFields": "false"}


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _time_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def memory_struct() -> Column:
    """Compact temporal and spatial memory of a featured row."""
    return _struct(
        current_stage1_probability=F.col(V.RISK),
        past_30min=_struct(
            lag_5min=F.col("risk_lag_5m"),
            lag_30min=F.col("risk_lag_30m"),
            mean=F.col("risk_mean_past_30m"),
            change=F.col("risk_change_30m"),
        ),
        directed_spatial_context=F.struct(*V.MEMORY_SPATIAL),
    )


def memory_packet(df: DataFrame) -> DataFrame:
    """JSON text of the memory and its UTF-8 size."""
    return df.withColumn("memory_json", F.to_json(memory_struct(), KEEP_NULLS)).withColumn(
        "memory_packet_bytes_utf8", F.octet_length("memory_json")
    )


def teacher_packets(registry: DataFrame, source: str = "registry") -> DataFrame:
    """Instruction, input, output and provenance of every registry row."""
    want = {
        "location": {"stake_km": "stake_km", "direction": "direction_code", "area": "area"},
        "traffic": {
            "volume_pcu_h": "traffic",
            "median_speed_km_h": "median_speed",
            "density": "traffic_density",
            "upstream_volume": "upstream_traffic",
            "downstream_volume": "downstream_traffic",
        },
        "weather": {
            "condition": "weather",
            "temperature_c": "temperature",
            "humidity_pct": "humidity",
            "visibility": "visibility",
            "wind_direction": "wind_direction",
            "wind_force": "wind_force",
        },
        "road": {"mqi": "mqi", "pci": "pci"},
    }
    have = set(registry.columns)

    def field(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    groups = {g: _struct(**{k: field(c) for k, c in members.items()}) for g, members in want.items()}
    df = registry_measures(registry)
    record = _struct(
        instruction=F.lit(V.CONFIRM_INSTRUCTION),
        input=_struct(decision_time=_time_text("occurred_at"), **groups),
        output=_struct(
            event_confirmation=F.lit("confirmed_historical_event"),
            accident_type=F.col("accident_type"),
            severity=F.col("severity"),
            confidence_policy=F.lit(V.CONFIDENCE_POLICY),
            evidence=text_array(V.EVIDENCE_SOURCES),
            management_measures=F.col("management_measures"),
            human_review_required=F.coalesce(F.col("severity") != V.SEVERITY_MINOR, F.lit(True)),
        ),
        provenance=_struct(
            source=F.lit(source), row_id=F.col("registry_id"), generation=F.lit(V.TEACHER_GENERATION)
        ),
    )
    return df.select(F.to_json(record, KEEP_NULLS).alias("record"))


def negative_packets(negatives: DataFrame, source: str = "candidates") -> DataFrame:
    """Continue-monitoring records of sampled hard and uncertain negatives."""
    names = [
        "risk_change_30m",
        "upstream_mean_300m",
        "downstream_mean_300m",
        "neighborhood_std_500m",
        "spatial_coherence_500m",
    ]
    record = _struct(
        instruction=F.lit(V.MONITOR_INSTRUCTION),
        input=_struct(
            decision_time=_time_text("bin5"),
            segment_id=F.col("segment_id"),
            road_code=F.col("road_code"),
            direction_code=F.col("direction_code"),
            stake_m=F.col("stake"),
            stage1_probability=F.col(V.RISK),
            **{n: F.col(n) for n in names},
        ),
        output=_struct(
            event_confirmation=F.lit("not_confirmed_in_30min_ground_truth"),
            recommended_state=F.lit("continue_monitoring"),
            management_measures=text_array(V.MONITOR_MEASURES),
            human_review_required=F.lit(False),
        ),
        provenance=_struct(source=F.lit(source), generation=F.lit(V.NEGATIVE_GENERATION)),
    )
    return negatives.select(F.to_json(record, KEEP_NULLS).alias("record"))


def replay_packet(rows: DataFrame) -> DataFrame:
    """One decision packet per replayed event.

    Rows are featured panel rows with the event's time, the nearest historical
    context (registry columns), its severity gate and measures; see ``plans.replay``.
    """
    packet = _struct(
        mode=F.lit("historical_causal_replay"),
        decision=_struct(
            decision_time=_time_text("bin5"),
            alert=F.col("score_distilled_student") >= 0.6,
            supervisory_score=F.col("score_distilled_student"),
            threshold=F.lit(0.6),
            predicted_horizon=F.lit("within 30 minutes"),
            lead_time_to_recorded_event_min=F.col("lead_time_min"),
        ),
        location=_struct(
            segment_id=F.col("segment_id"),
            road_code=F.col("road_code"),
            direction_code=F.col("direction_code"),
            stake_m=F.col("stake"),
        ),
        compressed_long_term_memory=memory_struct(),
        memory_packet_bytes_utf8=F.octet_length(F.to_json(memory_struct(), KEEP_NULLS)),
        type_hypotheses=F.col("type_hypotheses"),
        severity_gate=_struct(
            predicted_severity_band=F.col("predicted_severity_band"),
            serious_flags=F.col("serious_flags"),
            human_review_required=F.lit(True),
        ),
        management_measures=F.col("management_measures"),
        audit=_struct(
            target_event_id=F.col("target_event_id"),
            recorded_event_time=_time_text("event_time"),
            historical_context_time_distance_min=F.col("time_distance_min"),
            operator_confirmation_required=F.lit(True),
        ),
    )
    return rows.select("target_event_id", F.to_json(packet, KEEP_NULLS).alias("packet"))
