"""Explicit schemas of the files read; no inference anywhere."""

from __future__ import annotations

from pyspark.sql import types as T

from corridorwatch import vocabulary as V


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

# Typed panel: what the operators expect.
PANEL = _struct(
    segment_id=_S,
    bin5=T.TimestampNTZType(),
    source_month=_S,
    direction_code=_I,
    road_code=_S,
    road_direction=_S,
    stake=_D,
    accident_label=_I,
    accident_level=_I,
    accident_id=_S,
    **{c: _D for c in V.COMPONENTS[1:]},
    **{V.RISK: _D},
    source_row=_L,
)

# The same columns as text, for CSV files whose cells may be malformed.
PANEL_TEXT = T.StructType([T.StructField(f.name, _S, True) for f in PANEL.fields])

REGISTRY_TEXT = T.StructType([T.StructField(h, _S, True) for h in V.REGISTRY_HEADERS])

SNAPSHOT_TEXT = _struct(segment_id=_S, road_code=_S, direction_code=_S, stake=_S, **{V.RISK: _S})

AUDIT = _struct(id=_S, time=_S, operator=_S, action=_S, target=_S, note=_S, source=_S)

WATCHLIST_ROW = _struct(
    segment_id=_S,
    time=_S,
    road_code=_S,
    direction_code=_I,
    stake_m=_D,
    stake_km=_D,
    score=_D,
    stage1_score=_D,
    calibrated_probability=_D,
    risk_level=_S,
    candidate_source=_S,
    review_status=_S,
    lead_time_min=_D,
    target_event_id=_S,
)

MODEL_ROW = _struct(
    model=_S,
    composite_score=_D,
    mean_seconds_per_case=_D,
    schema_validity=_D,
    unsupported_action_rate=_D,
    parameter_size=_S,
    cases_returned=_I,
)

DOCUMENT = _struct(
    system=_struct(name=_S, version=_S, mode=_S),
    snapshot=_struct(time=_S, update_minutes=_I, prediction_horizon_minutes=_I),
    pipeline=T.ArrayType(_struct(stage=_S, scope=_S, records=_L)),
    watchlist=T.ArrayType(WATCHLIST_ROW),
    benchmarks=_struct(models=T.ArrayType(MODEL_ROW)),
    policy_library=_struct(policy_version=_S, type_specific_examples=T.MapType(_S, T.ArrayType(_S))),
    boundaries=T.ArrayType(_S),
)
