"""Rule-based review: measures, operator actions, severity, answer validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.functions.columns import literal_map, lookup, text_array


def _if(condition: Column, values) -> Column:
    """The values as an array when the condition holds, else an empty array."""
    return F.when(condition, text_array(values)).otherwise(text_array([]))


def policy_rules(
    accident_type: Column,
    weather: Column,
    traffic: Column,
    median_speed: Column,
    upstream: Column,
    downstream: Column,
) -> Column:
    """Ordered, distinct management measures; a missing number fails its rule."""
    kind = F.coalesce(accident_type, F.lit(V.TYPE_OTHER))
    sky = F.coalesce(weather, F.lit("未知"))
    rules = [
        text_array(V.BASE_MEASURES),
        _if(sky.rlike("[" + "".join(V.WEATHER_TOKENS) + "]"), V.WEATHER_MEASURES),
        _if(kind.isin(V.LANE_CONFLICT_TYPES), V.LANE_MEASURES),
        _if(kind.contains(V.TYPE_ROLLOVER), V.ROLLOVER_MEASURES),
        _if(kind.contains(V.TYPE_FIRE), V.FIRE_MEASURES),
        _if(traffic >= 1800, [V.TRAFFIC_MEASURE]),
        _if(
            upstream.isNotNull() & (upstream > F.greatest(downstream * 1.25, downstream + 30.0)),
            [V.QUEUE_MEASURE],
        ),
        _if(median_speed < 40, [V.SPEED_MEASURE]),
    ]
    return F.array_distinct(F.concat(*rules))


def registry_measures(registry: DataFrame) -> DataFrame:
    names = ["accident_type", "weather", "traffic", "median_speed", "upstream_traffic", "downstream_traffic"]
    return registry.withColumn("management_measures", policy_rules(*[F.col(n) for n in names]))


def policy_library(registry: DataFrame) -> DataFrame:
    """Measures of the earliest registry row of every accident type."""
    names = ["registry_id", "weather", "traffic", "median_speed", "upstream_traffic", "downstream_traffic"]
    first = F.min_by(F.struct(*names), F.struct("occurred_at", "registry_id")).alias("r")
    rows = registry.where("accident_type IS NOT NULL").groupBy("accident_type").agg(first)
    return registry_measures(rows.select("accident_type", "r.*"))


def policy_document(registry: DataFrame) -> DataFrame:
    """The policy library as one row: version, principles, examples per type, severity gate."""
    examples = policy_library(registry).agg(
        F.map_from_entries(F.collect_list(F.struct("accident_type", "management_measures"))).alias("type_specific_examples")
    )  # one entry per accident type
    return examples.select(
        F.lit(V.POLICY_VERSION).alias("policy_version"),
        text_array(V.POLICY_PRINCIPLES).alias("principles"),
        "type_specific_examples",
        literal_map(V.SEVERITY_REVIEW).alias("severity_gate"),
    )


def policy_review(packets: DataFrame) -> DataFrame:
    """Operational state, authorised actions and reasoning of every packet.

    Packets have score, median_speed_km_h, upstream_traffic, downstream_traffic,
    weather and type_hypothesis; missing values take the neutral default.
    """
    defaults = {
        "score": 0.0,
        "median_speed_km_h": 80.0,
        "upstream_traffic": 0.0,
        "downstream_traffic": 0.0,
        "weather": "未知",
        "type_hypothesis": V.TYPE_OTHER,
    }
    packets = packets.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in defaults.items()})
    score, speed, kind, weather = (
        F.col(n) for n in ("score", "median_speed_km_h", "type_hypothesis", "weather")
    )
    gap = F.abs(F.col("upstream_traffic") - F.col("downstream_traffic"))
    slow, queue, bad_weather = speed < 40, gap >= 25, ~weather.isin(V.CLEAR_WEATHER)
    codes = F.concat(
        text_array(["VMS_WARNING", "VERIFY"]),
        _if(kind == V.TYPE_ROLLOVER, ["HEAVY_RESCUE", "LANE_ISOLATION"]),
        _if(kind == V.TYPE_FIRE, ["FIRE_RESPONSE"]),
        _if(kind.isin(V.LANE_CONFLICT_TYPES), ["LANE_CONTROL"]),
        _if(slow, ["LOW_SPEED_WARNING"]),
        _if(queue, ["QUEUE_PROPAGATION"]),
        _if(bad_weather, ["WEATHER_SPEED_CONTROL"]),
    )
    codes = F.when(score < 0.6, text_array(["VERIFY"])).otherwise(F.array_distinct(codes))
    actions = F.transform(
        codes,
        lambda c: F.struct(c.alias("code"), lookup(V.CODE_LABELS, c).alias("label"), F.lit(True).alias("authorized")),
    )
    reasons = F.array_compact(
        F.array(
            F.format_string(V.REASON_SCORE, score),
            F.when(slow, F.format_string(V.REASON_SPEED, speed)),
            F.when(queue, F.format_string(V.REASON_QUEUE, gap)),
            F.when(bad_weather, F.format_string(V.REASON_WEATHER, weather)),
        )
    )
    return packets.withColumns(
        {
            "engine": F.lit(V.REVIEW_ENGINE),
            "engine_note": F.lit(V.REVIEW_NOTE),
            "operational_state": F.when(score >= 0.6, V.STATE_REVIEW).otherwise(V.STATE_KEEP),
            "type_is_hypothesis": F.lit(True),
            "severity": F.lit(V.SEVERITY_PENDING),
            "human_review_required": F.lit(True),
            "reasoning": F.concat(F.array_join(reasons, V.REASON_SEPARATOR), F.lit(V.REASON_END)),
            "actions": actions,
            "unsupported_actions": text_array([]),
            "policy_version": F.lit(V.POLICY_VERSION),
        }
    )


def review_output_validate(reviews: DataFrame, answer: str = "answer", engine: str = "external-review") -> DataFrame:
    """Check a model's JSON answers against the authorised actions of each review.

    Keeps authorised labels, lists the others, falls back to the rule result where
    nothing valid is left or the answer is no JSON object; human review stays on.
    """
    schema = "operational_state string, reasoning string, actions array<string>, __bad string"
    parsed = F.from_json(F.col(answer), schema, {"columnNameOfCorruptRecord": "__bad"})
    df = reviews.withColumn("__a", parsed)
    labels = F.transform(
        F.coalesce(F.col("__a.actions"), text_array([])),
        lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.label"), F.lit(""))).otherwise(x),
    )
    allowed = F.transform("actions", lambda a: a["label"])
    kept = F.flatten(
        F.transform("__labels", lambda x: F.filter(F.col("actions"), lambda a: a["label"] == x))
    )
    valid = F.col("__a").isNotNull() & F.col("__a.__bad").isNull()
    return (
        df.withColumn("__labels", labels)
        .withColumn("__allowed", allowed)
        .withColumn("__kept", kept)
        .withColumns(
            {
                "unsupported_actions": F.filter("__labels", lambda x: (x != "") & ~F.array_contains("__allowed", x)),
                "actions": F.when(F.size("__kept") > 0, F.col("__kept")).otherwise(F.col("actions")),
                "operational_state": F.coalesce("__a.operational_state", "operational_state"),
                "reasoning": F.coalesce("__a.reasoning", "reasoning"),
                "engine": F.when(valid, engine).otherwise(F.col("engine")),
                "human_review_required": F.lit(True),
            }
        )
        .drop("__a", "__labels", "__allowed", "__kept")
    )


def severity_gate(df: DataFrame, accident_type: str = "accident_type") -> DataFrame:
    """Serious flags and the severity band; always for human review."""
    kind = F.col(accident_type)
    flags = F.array_compact(
        F.array(
            F.when(kind.isin(V.TYPE_ROLLOVER, V.TYPE_FIRE), V.FLAG_TYPE),
            F.when(F.col("serious_injured") > 0, V.FLAG_INJURY),
            F.when(F.col("deaths") > 0, V.FLAG_FATAL),
            F.when(F.col("key_vehicle") == V.KEY_VEHICLE, V.FLAG_VEHICLE),
        )
    )
    return df.withColumn("serious_flags", flags).withColumns(
        {
            "predicted_severity_band": F.when(F.size("serious_flags") > 0, V.BAND_HIGH).otherwise(V.BAND_LOW),
            "human_review_required": F.lit(True),
            "reason": F.lit(V.SEVERITY_REASON),
        }
    )
