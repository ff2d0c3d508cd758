"""Incremental cost of every action at every site and scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch.config import STRATEGIES, DispatchConfig, Scenario

DEFAULT = DispatchConfig()
ACTIONS = ("warning", "patrol", "emergency")


def coefficient(p: Column, action: str, scenario: Column, config: DispatchConfig) -> Column:
    """cost + (1 - p) * penalty - p * loss * mitigation, of one action."""
    mitigation = getattr(config, f"mitigation_{action}")
    return (
        scenario[f"cost_{action}"]
        + (1.0 - p) * scenario[f"penalty_{action}"]
        - p * scenario["accident_loss"] * mitigation
    )


def scenario_array(config: DispatchConfig) -> Column:
    fields = Scenario.__dataclass_fields__
    return F.array(*[F.struct(*[F.lit(getattr(s, f)).alias(f) for f in fields]) for s in config.scenarios])


def with_scenarios(df: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    """Repeat every row per scenario, inside the row's own task."""
    return df.withColumn("__scenario", F.explode(scenario_array(config)))


def incremental_cost(
    sites: DataFrame, config: DispatchConfig = DEFAULT, probability: str = "calibrated_probability"
) -> DataFrame:
    """Sites by scenario with the three coefficients."""
    s = F.col("__scenario")
    return (
        with_scenarios(sites, config)
        .withColumns({f"{a}_cost": coefficient(F.col(probability), a, s, config) for a in ACTIONS})
        .withColumn("scenario", s["name"])
        .drop("__scenario")
    )


def scenario_strategy_cross(sites: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    """(site_id, scenario, strategy) for every site."""
    names = F.array(*[F.lit(s.name) for s in config.scenarios])
    strategies = F.array(*[F.lit(s) for s in STRATEGIES])
    return sites.select("site_id", F.explode(names).alias("scenario")).withColumn(
        "strategy", F.explode(strategies)
    )
