"""What the decisions would have achieved: events, precision, realised cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch.config import STRATEGIES, DispatchConfig
from corridorwatch.functions.rows import with_row
from corridorwatch.operators.costs import ACTIONS, scenario_array

DEFAULT = DispatchConfig()
STUDY = ["scenario", "strategy"]


def sites_decisions(sites: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with the attributes of their site (one row per decision)."""
    return decisions.join(sites, "site_id")


def duplicate_decisions(decisions: DataFrame) -> DataFrame:
    """Keys that break the one-to-one rule; empty when the merge is valid."""
    return decisions.groupBy("site_id", *STUDY).count().where("count > 1")


def _totals(sites: DataFrame) -> DataFrame:
    """One row: sites, days and distinct events of the study."""
    counts = sites.agg(
        F.count(F.lit(1)).alias("site_count"),
        F.count_distinct(F.to_date("decision_window")).alias("days"),
    )
    events = sites.where("actual_positive = 1").select(F.explode("event_ids").alias("event_id"))
    return with_row(counts, events.agg(F.count_distinct("event_id").alias("event_count")))


def _studies(spark, config: DispatchConfig) -> DataFrame:
    """Every scenario with every strategy; the decisions that no pick changes are zeros and add nothing."""
    strategy = F.explode(F.array(*[F.lit(s) for s in STRATEGIES])).alias("strategy")
    scenarios = spark.range(1).select(F.explode(scenario_array(config)).alias("__scenario"))
    return scenarios.select(F.col("__scenario.name").alias("scenario"), "__scenario", strategy)


def dispatch_evaluate(picks: DataFrame, sites: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    """Per scenario and strategy: recall of events, precision and number of actions.

    ``picks`` are the sites that a strategy acts on; all others have no action.
    """
    facts = sites.select("site_id", "actual_positive", "event_ids", "maximum_lead_time_min")
    merged = picks.join(facts, "site_id")
    patrol, hit = F.col("patrol") == 1, F.col("actual_positive") == 1
    counts = [f"{a}_actions" for a in ACTIONS] + ["false_patrol_actions", "true_patrol_actions"]
    base = merged.groupBy(*STUDY).agg(
        *[F.sum(a).alias(f"{a}_actions") for a in ACTIONS],
        F.count_if(patrol & ~hit).alias("false_patrol_actions"),
        F.count_if(patrol & hit).alias("true_patrol_actions"),
    )
    escalated = merged.where(patrol & hit)
    detected = (
        escalated.select(*STUDY, F.explode("event_ids").alias("event_id"))
        .groupBy(*STUDY)
        .agg(F.count_distinct("event_id").alias("detected_event_count"))
    )
    # The lead time is averaged over distinct *combinations* of events.
    leads = (
        escalated.groupBy(*STUDY, "event_ids")
        .agg(F.max("maximum_lead_time_min").alias("lead"))
        .groupBy(*STUDY)
        .agg(F.avg("lead").alias("mean_maximum_lead_time_min"))
    )
    studies = _studies(sites.sparkSession, config).drop("__scenario")
    found = studies.join(base, STUDY, "left").join(detected, STUDY, "left").join(leads, STUDY, "left")
    joined = with_row(found.na.fill(0, [*counts, "detected_event_count"]), _totals(sites))
    precise = F.col("true_patrol_actions") / F.greatest(F.col("true_patrol_actions") + F.col("false_patrol_actions"), F.lit(1))
    return joined.select(
        *STUDY,
        "site_count",
        "event_count",
        "detected_event_count",
        (F.col("detected_event_count") / F.greatest("event_count", F.lit(1))).alias("event_recall"),
        precise.alias("patrol_precision"),
        *counts,
        (F.col("patrol_actions") / F.greatest("days", F.lit(1))).alias("patrol_actions_per_day"),
        "mean_maximum_lead_time_min",
    )


def realized_cost(picks: DataFrame, sites: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    """Loss of every event once, at its best mitigation, plus actions and false alarms.

    Events that no picked site has lose everything, so only their number is needed.
    """
    rate = sum(F.col(a) * F.lit(getattr(config, f"mitigation_{a}")) for a in ACTIONS)
    facts = sites.select("site_id", "actual_positive", "event_ids")
    merged = picks.join(facts, "site_id").withColumn("mitigation", rate)
    sums = [*ACTIONS, *[f"false_{a}" for a in ACTIONS]]
    acts = merged.groupBy(*STUDY).agg(
        *[F.sum(a).alias(a) for a in ACTIONS],
        *[F.sum(F.col(a) * (1 - F.col("actual_positive"))).alias(f"false_{a}") for a in ACTIONS],
    )
    saved = (
        merged.select(*STUDY, "mitigation", F.explode("event_ids").alias("event_id"))
        .groupBy(*STUDY, "event_id")
        .agg(F.max("mitigation").alias("best"))
        .groupBy(*STUDY)
        .agg(F.sum("best").alias("saved"))
    )
    events = sites.select(F.explode("event_ids").alias("event_id")).agg(F.count_distinct("event_id").alias("events"))
    found = _studies(sites.sparkSession, config).join(acts, STUDY, "left").join(saved, STUDY, "left")
    joined = with_row(found.na.fill(0, [*sums, "saved"]), events)
    scenario = F.col("__scenario")
    cost = (F.col("events") - F.col("saved")) * scenario["accident_loss"]
    for a in ACTIONS:
        cost = cost + F.col(a) * scenario[f"cost_{a}"] + F.col(f"false_{a}") * scenario[f"penalty_{a}"]
    return joined.select(*STUDY, cost.alias("realized_normalized_event_cost"))


def cost_reduction(costs: DataFrame) -> DataFrame:
    """Saving against ``no_action`` of the same scenario."""
    base = costs.where("strategy = 'no_action'").select(
        "scenario", F.col("realized_normalized_event_cost").alias("__base")
    )
    saved = (F.col("__base") - F.col("realized_normalized_event_cost")) / F.greatest("__base", F.lit(1.0))
    return costs.join(base, "scenario").withColumn("event_cost_reduction_vs_no_action", saved).drop("__base")


def best_by_scenario(costs: DataFrame) -> DataFrame:
    """Cheapest strategy of every scenario, ties by name."""
    cost = F.round("realized_normalized_event_cost", 6)
    best = F.min_by(F.struct("strategy", "realized_normalized_event_cost"), F.struct(cost, F.col("strategy")))
    return costs.groupBy("scenario").agg(best.alias("b")).select("scenario", "b.*")
