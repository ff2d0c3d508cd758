"""Dispatch policies.

A policy returns *picks*: (site_id, scenario, strategy, warning, patrol,
emergency) for the sites it acts on, at most the warning capacity plus the
patrol capacity per window. ``decisions`` fills in the zeros for all other sites.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.config import DispatchConfig
from corridorwatch.functions.columns import lookup
from corridorwatch.functions.ranking import top_n_per_group
from corridorwatch.operators.costs import ACTIONS, coefficient, incremental_cost, scenario_array, scenario_strategy_cross

DEFAULT = DispatchConfig()
PICK = ["site_id", "scenario", "strategy", *ACTIONS]


def _every_scenario(picks: DataFrame, config: DispatchConfig) -> DataFrame:
    names = F.array(*[F.lit(s.name) for s in config.scenarios])
    return picks.withColumn("scenario", F.explode(names))


def _nested_picks(
    warned: DataFrame, keys: list[str], orders: dict[str, list[Column]], usable: dict[str, Column], config: DispatchConfig
) -> DataFrame:
    """Patrols among the warned (road cap, total cap), the emergency among the patrolled.

    ``warned`` has at most the warning capacity of rows per window.
    """
    road = Window.partitionBy(*keys, "__can_patrol", "road_code").orderBy(*orders["patrol"])
    df = warned.withColumn("__can_patrol", usable["patrol"])
    df = df.withColumn(
        "__can_patrol", F.col("__can_patrol") & (F.row_number().over(road) <= config.max_patrols_per_road)
    )
    patrol_rank = F.row_number().over(Window.partitionBy(*keys, "__can_patrol").orderBy(*orders["patrol"]))
    df = df.withColumn("__patrol", F.col("__can_patrol") & (patrol_rank <= config.patrol_capacity))
    df = df.withColumn("__can_help", F.col("__patrol") & usable["emergency"])
    help_rank = F.row_number().over(Window.partitionBy(*keys, "__can_help").orderBy(*orders["emergency"]))
    return df.withColumns(
        {
            "warning": F.lit(1),
            "patrol": F.col("__patrol").cast("int"),
            "emergency": (F.col("__can_help") & (help_rank <= config.emergency_capacity)).cast("int"),
        }
    )


def dispatch_ranking(sites: DataFrame, score: str, strategy: str, config: DispatchConfig = DEFAULT) -> DataFrame:
    """Highest scores at or above the alert threshold, nested capacities, road cap."""
    order = [F.col(score).desc(), F.col("site_id")]
    warned = top_n_per_group(
        sites.where(F.col(score) >= config.ranking_threshold).select("site_id", "decision_window", "road_code", score),
        ["decision_window"],
        order,
        config.warning_capacity,
        ["site_id"],
    )
    yes = F.lit(True)
    orders = {"patrol": order, "emergency": order}
    picks = _nested_picks(warned, ["decision_window"], orders, {"patrol": yes, "emergency": yes}, config)
    return _every_scenario(picks.withColumn("strategy", F.lit(strategy)), config).select(*PICK)


def dispatch_greedy(sites: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    """Cheapest negative costs first, action by action."""
    keys = ["scenario", "decision_window"]
    costs = incremental_cost(sites.select("site_id", "decision_window", "road_code", "calibrated_probability"), config)
    order = {a: [F.col(f"{a}_cost"), F.col("site_id")] for a in ACTIONS}
    warned = top_n_per_group(
        costs.where("warning_cost < 0"), keys, order["warning"], config.warning_capacity, ["site_id"]
    )
    usable = {a: F.col(f"{a}_cost") < 0 for a in ACTIONS}
    picks = _nested_picks(warned, keys, order, usable, config)
    return picks.withColumn("strategy", F.lit("greedy_expected_utility")).select(*PICK)


def dispatch_none(sites: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    """All sites, no action."""
    zero = {a: F.lit(0) for a in ACTIONS}
    base = sites.select("site_id").withColumn("strategy", F.lit("no_action")).withColumns(zero)
    return _every_scenario(base, config).select(*PICK)


# --- exact program ------------------------------------------------------------------


def exact_candidates(sites: DataFrame, probability: str, config: DispatchConfig = DEFAULT) -> DataFrame:
    """Per window the sites an optimal decision needs, as two bounded arrays.

    All three coefficients fall when the probability rises, so moving a patrol to
    a likelier site that is still allowed never costs more. A patrolled site is
    therefore outranked in its road only by sites its road-mates block (each
    blocks ``2 * ceil(separation / zone) - 1`` zones), and a road is used only if
    fewer than the patrol capacity of roads have a likelier best site. Likewise
    the cheapest warnings are the likeliest sites. With the default limits this
    keeps 3 roads of 4 sites for patrols and 11 sites for warnings, whatever the
    window holds.
    """
    zones = 2 * -(-int(config.patrol_separation_m) // config.zone_m) - 1
    per_road = (config.max_patrols_per_road - 1) * zones + 1
    order = [F.col(probability).desc(), F.col("site_id")]
    base = sites.select(
        "decision_window",
        F.col("road_code"),
        F.col("direction_code"),
        F.col("spatial_zone"),
        "site_id",
        F.col(probability).alias("p"),
    )
    order = [F.col("p").desc(), F.col("site_id")]
    in_road = top_n_per_group(base, ["decision_window", "road_code"], order, per_road, ["site_id"], rank="road_rank")
    best = Window.partitionBy("decision_window").orderBy(F.col("top.k"), F.col("top.site_id"))
    key = F.struct((-F.col("p")).alias("k"), F.col("site_id"))
    row = F.struct(key.alias("k"), "site_id", "p", "road_code", "direction_code", "spatial_zone")
    roads = (
        in_road.groupBy("decision_window", "road_code")
        .agg(F.min(key).alias("top"), F.array_sort(F.collect_list(row)).alias("rows"))
        .withColumn("road_rank", F.row_number().over(best))
        .where(F.col("road_rank") <= config.patrol_capacity)
        .groupBy("decision_window")
        .agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("patrol_rows"))
    )
    likely = (
        top_n_per_group(
            base, ["decision_window"], order, config.warning_capacity + config.patrol_capacity, ["site_id"]
        )
        .groupBy("decision_window")
        .agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), "site_id", "p"))).alias("warning_rows"))
    )
    return likely.join(roads, "decision_window", "left")


def _with_costs(rows: Column, config: DispatchConfig, keep: tuple[str, ...]) -> Column:
    """Sorted candidate structs with position and costs under the row's scenario."""
    s = F.col("__scenario")
    return F.transform(
        rows,
        lambda r, i: F.struct(
            i.alias("pos"),
            *[r[k].alias(k) for k in keep],
            coefficient(r["p"], "warning", s, config).alias("w"),
            coefficient(r["p"], "patrol", s, config).alias("t"),
            coefficient(r["p"], "emergency", s, config).alias("e"),
        ),
    )


def _compatible(a: Column, b: Column, config: DispatchConfig) -> Column:
    same = (a["road_code"] == b["road_code"]) & (a["direction_code"] == b["direction_code"])
    return ~(same & (F.abs(a["spatial_zone"] - b["spatial_zone"]) < config.patrol_separation_m))


def feasible_subsets(candidates: Column, config: DispatchConfig) -> Column:
    """All patrol subsets of one window that keep the road cap and the separation.

    ``candidates`` is the bounded array of ``exact_candidates``; subsets grow by
    one later position at a time.
    """
    singles = F.transform(candidates, lambda a: F.array(a))
    levels = [singles]
    for _ in range(1, min(config.patrol_capacity, config.warning_capacity)):

        def extend(chosen: Column) -> Column:
            last = F.element_at(chosen, -1)

            def allowed(x: Column) -> Column:
                mates = F.size(F.filter(chosen, lambda m: m["road_code"] == x["road_code"]))
                return (
                    (x["pos"] > last["pos"])
                    & (mates < config.max_patrols_per_road)
                    & F.forall(chosen, lambda m: _compatible(m, x, config))
                )

            return F.transform(F.filter(candidates, allowed), lambda x: F.concat(chosen, F.array(x)))

        levels.append(F.flatten(F.transform(levels[-1], extend)))
    return F.concat(*levels)


def patrol_subset_join(
    sites: DataFrame, config: DispatchConfig = DEFAULT, probability: str = "calibrated_probability"
) -> DataFrame:
    """Feasible patrol subsets per window and scenario, over the needed candidates."""
    rows = _exact_rows(sites, config, probability)
    subsets = rows.withColumn("subset", F.explode(feasible_subsets(F.col("patrols"), config)))
    return subsets.select(
        "decision_window",
        "scenario",
        F.size("subset").alias("patrol_count"),
        F.array_join(F.transform("subset", lambda x: x["site_id"]), "|").alias("site_ids"),
    )


def _exact_rows(sites: DataFrame, config: DispatchConfig, probability: str) -> DataFrame:
    windows = exact_candidates(sites, probability, config).withColumn(
        "__scenario", F.explode(scenario_array(config))
    )
    patrols = _with_costs(
        F.col("patrol_rows"), config, ("site_id", "road_code", "direction_code", "spatial_zone")
    )
    # A site whose patrol cannot pay off, with or without emergency, is never upgraded.
    patrols = F.filter(patrols, lambda r: F.least(r["t"], r["t"] + r["e"]) < 0)
    warnings = F.filter(_with_costs(F.col("warning_rows"), config, ("site_id",)), lambda r: r["w"] < 0)
    return windows.select(
        "decision_window",
        F.col("__scenario.name").alias("scenario"),
        patrols.alias("patrols"),
        warnings.alias("warnings"),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def solve_exact(
    sites: DataFrame, config: DispatchConfig = DEFAULT, probability: str = "calibrated_probability"
) -> DataFrame:
    """Cheapest decision per window and scenario: cost and the chosen sites.

    Costs are compared at 1e-9; ties go to fewer patrols, then likelier sites.
    """
    rows = _exact_rows(sites, config, probability)
    empty = F.filter("patrols", lambda r: F.lit(False))

    def option(chosen: Column) -> Column:
        ids = F.transform(chosen, lambda r: r["site_id"])
        others = F.slice(
            F.filter("warnings", lambda r: ~F.array_contains(ids, r["site_id"])),
            F.lit(1),
            F.lit(config.warning_capacity) - F.size(chosen),
        )
        helped = F.array_min(F.transform(chosen, lambda r: F.struct(r["e"], r["pos"], r["site_id"].alias("site_id"))))
        use = (helped["e"] < 0) if config.emergency_capacity > 0 else F.lit(False)
        cost = (
            _sum(F.transform(chosen, lambda r: r["w"] + r["t"]))
            + _sum(F.transform(others, lambda r: r["w"]))
            + F.when(use, helped["e"]).otherwise(0.0)
        )
        return F.struct(
            F.round(cost, 9).alias("cost"),
            F.size(chosen).alias("patrols"),
            F.transform(chosen, lambda r: r["pos"]).alias("positions"),
            ids.alias("patrol_sites"),
            F.transform(others, lambda r: r["site_id"]).alias("warning_sites"),
            F.when(use, helped["site_id"]).alias("emergency_site"),
        )

    subsets = F.concat(F.array(empty), feasible_subsets(F.col("patrols"), config))
    best = F.array_min(F.transform(F.coalesce(subsets, F.array(empty)), option))
    return rows.withColumn("best", best).select("decision_window", "scenario", "best.*")


def dispatch_exact(
    sites: DataFrame,
    config: DispatchConfig = DEFAULT,
    probability: str = "calibrated_probability",
    strategy: str = "binary_program_expected_utility",
) -> DataFrame:
    """Picks of the exact optimum; windows where acting never pays have none."""
    best = solve_exact(sites, config, probability)
    acted = F.concat("patrol_sites", "warning_sites")
    return best.select(
        "scenario", "patrol_sites", "emergency_site", F.explode(acted).alias("site_id")
    ).select(
        "site_id",
        "scenario",
        F.lit(strategy).alias("strategy"),
        F.lit(1).alias("warning"),
        F.array_contains("patrol_sites", F.col("site_id")).cast("int").alias("patrol"),
        F.coalesce(F.col("emergency_site") == F.col("site_id"), F.lit(False)).cast("int").alias("emergency"),
    )


def all_picks(sites: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    """Picks of the five acting strategies (``no_action`` has none)."""
    return reduce(
        DataFrame.unionByName,
        [
            dispatch_ranking(sites, "stage1_score", "stage1_priority", config),
            dispatch_ranking(sites, "student_score", "student_priority", config),
            dispatch_greedy(sites, config),
            dispatch_exact(sites, config),
            dispatch_exact(sites, config, "robust_probability", "robust_binary_program"),
        ],
    )


def decisions(sites: DataFrame, picks: DataFrame, config: DispatchConfig = DEFAULT) -> DataFrame:
    """Every site, scenario and strategy of ``picks`` and of the full cross, zero filled."""
    full = scenario_strategy_cross(sites, config)
    return fill_zero(full, picks)


def fill_zero(full: DataFrame, picks: DataFrame) -> DataFrame:
    keys = ["site_id", "scenario", "strategy"]
    joined = full.join(picks, keys, "left")
    return joined.select(*keys, *[F.coalesce(a, F.lit(0)).alias(a) for a in ACTIONS])


# --- snapshot allocation --------------------------------------------------------------


def separated_picks(rows: DataFrame, keys: list[str], capacity: Column, separation_m: Column, score: str = "score") -> DataFrame:
    """Per snapshot the best rows that keep their distance inside each corridor, in the order of the score.

    ``capacity`` and ``separation_m`` are constant inside a snapshot. A corridor is cut into
    cells as wide as its separation. A pick blocks rows of at most three cells, so with ``capacity``
    picks to make, the best row of one of the best 3 (capacity - 1) + 1 cells is always free:
    rows of other cells cannot be picked. Rows at one position block each other, so the
    best of them stands for all. What remains per corridor, the positions of a few cells,
    is walked through inside one row. Rows are (keys, road_code, direction_code, stake_m, segment_id, score).
    """
    corridor = [*keys, "road_code", "direction_code"]
    # without a separation nothing is blocked: each row is a position and a cell of its own
    own = F.when(F.col("__s") <= 0, F.col("segment_id"))
    item = F.struct((-F.col(score)).alias("k"), F.col("segment_id"), F.col("stake_m"), F.col(score).alias(score))
    limited = rows.withColumns({"__n": capacity.cast("int"), "__s": separation_m.cast("double")}).where(F.col("__n") > 0)
    placed = limited.withColumns(
        {
            "__spot": F.struct(F.when(F.col("__s") > 0, F.col("stake_m")).alias("at"), own.alias("own")),
            "__cell": F.struct(F.when(F.col("__s") > 0, F.floor(F.col("stake_m") / F.col("__s"))).alias("at"), own.alias("own")),
        }
    )
    spots = placed.groupBy(*corridor, "__n", "__s", "__cell", "__spot").agg(F.min(item).alias("item"))
    cells = spots.groupBy(*corridor, "__n", "__s", "__cell").agg(F.min("item").alias("best"), F.collect_list("item").alias("items"))
    enough = 3 * (F.col("__n") - 1) + 1
    near = top_n_per_group(cells, corridor, [F.col("best")], enough, ["__cell"])
    pools = near.groupBy(*corridor, "__n", "__s").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("pool"))
    none = F.filter("pool", lambda x: F.lit(False))

    def step(picked, x):
        free = F.forall(picked, lambda q: F.abs(q["stake_m"] - x["stake_m"]) >= F.col("__s"))
        return F.when((F.size(picked) < F.col("__n")) & free, F.concat(picked, F.array(x))).otherwise(picked)

    picked = pools.withColumn("p", F.explode(F.aggregate("pool", none, step)))
    flat = picked.select(*corridor, "__n", "p.segment_id", "p.stake_m", f"p.{score}")
    order = [F.col(score).desc(), F.col("segment_id")]
    return top_n_per_group(flat, keys, order, F.col("__n"), ["segment_id"]).drop("rank", "__n")


#: The largest value a request may ask for.
LIMITS = {"warning_capacity": 20, "patrol_capacity": 20, "emergency_capacity": 20, "minimum_patrol_separation_m": 10_000}
SETTINGS = list(LIMITS)
#: Parts of a snapshot that meet its requests in tasks of their own.
SLICES = 32


def dispatch_snapshot(rows: DataFrame, keys: list[str], config: DispatchConfig = DEFAULT) -> DataFrame:
    """Action rows of a capacity-limited allocation per snapshot of the watchlist.

    Warnings are the highest scores, patrols additionally reach the alert
    threshold and keep the separation, emergencies reach the high threshold.
    """
    settings = dict(zip(SETTINGS, (config.warning_capacity, config.patrol_capacity, config.emergency_capacity, config.patrol_separation_m)))
    return _allocate(rows, keys, {name: F.lit(value) for name, value in settings.items()}, config)


def dispatch_requests(
    rows: DataFrame, requests: DataFrame, keys: list[str], request: str = "request_id", config: DispatchConfig = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Allocations asked for by a table of requests, and the requests with invalid settings.

    A request names a snapshot (by ``keys``), the scenario, three capacities and the patrol separation;
    what it leaves open takes its default. Any number of requests may name one snapshot.
    Rejected requests come back with the names of the settings that are no integer in
    their allowed range.
    """
    checked = capacity_violations(requests)
    rejected = checked.where(F.size("violations") > 0)
    defaults = (config.warning_capacity, config.patrol_capacity, config.emergency_capacity, int(config.patrol_separation_m))
    number = {name: F.coalesce(F.col(name).cast("string").try_cast("int"), F.lit(d)) for name, d in zip(SETTINGS, defaults)}
    scenario = F.coalesce(F.col("scenario"), F.lit(V.DEFAULT_SCENARIO)).alias("scenario")
    valid = checked.where(F.size("violations") == 0).select(request, *keys, scenario, *[c.alias(f"__{n}") for n, c in number.items()])
    # no request takes more warnings or emergencies than a setting may be: the best rows of a snapshot serve all its requests
    most = max(LIMITS["warning_capacity"], LIMITS["emergency_capacity"], config.warning_capacity, config.emergency_capacity)
    top = top_n_per_group(rows, keys, [F.col("score").desc(), F.col("segment_id")], most, ["segment_id"]).drop("rank")
    # a snapshot's rows meet its requests in slices, so that a large one is spread over tasks
    sliced = rows.withColumn("__slice", F.pmod(F.xxhash64("segment_id"), F.lit(SLICES)).cast("int"))
    spread = valid.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    asked = sliced.join(spread, [*keys, "__slice"]).drop("__slice")
    settings = {name: F.col(f"__{name}") for name in SETTINGS}
    return _allocate(asked, [request, *keys, "scenario"], settings, config, top.join(valid, keys)), rejected


def _allocate(rows: DataFrame, keys: list[str], settings: dict[str, Column], config: DispatchConfig, top: DataFrame | None = None) -> DataFrame:
    """Action rows per ``keys``; ``top`` has the rows that warnings and emergencies can be among, where they are known."""
    order = [F.col("score").desc(), F.col("segment_id")]
    columns = [*keys, "road_code", "direction_code", "segment_id", "stake_m", "score"]
    chosen = [*columns, *[c.alias(f"__{name}") for name, c in settings.items()]]
    rows, top = rows.select(*chosen), (rows if top is None else top).select(*chosen)
    limit = {name: F.col(f"__{name}") for name in settings}

    def best(part: DataFrame, n: Column) -> DataFrame:
        return top_n_per_group(part, keys, order, n, ["segment_id"]).drop("rank")

    reached = rows.where(F.col("score") >= config.ranking_threshold)
    parts = {
        "warning": best(top, limit["warning_capacity"]),
        "patrol": separated_picks(reached, keys, limit["patrol_capacity"], limit["minimum_patrol_separation_m"]),
        "emergency": best(top.where(F.col("score") >= config.emergency_threshold), limit["emergency_capacity"]),
    }
    actions = reduce(
        DataFrame.unionByName,
        [part.select(*columns).withColumn("kind", F.lit(kind)) for kind, part in parts.items()],
    )
    return actions.withColumns(
        {
            "label": lookup(V.DISPATCH_LABELS, F.col("kind")),
            "stake_km": F.bround(F.col("stake_m") / 1000.0, 3),
            "status": F.lit(V.ACTION_PENDING),
        }
    )


def snapshot_counts(rows: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates and actions per snapshot."""
    counts = actions.groupBy(*keys).agg(*[F.count_if(F.col("kind") == a).alias(f"{a}_count") for a in ACTIONS])
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidate_count"))
    return total.join(counts, keys, "left").na.fill(0)


def capacity_violations(configs: DataFrame) -> DataFrame:
    """Names of the settings that are no integer in their allowed range."""
    checks = []
    for name, top in LIMITS.items():
        number = F.col(name).cast("string").try_cast("int")
        bad = number.isNull() | ~number.between(0, top)
        checks.append(F.when(F.col(name).isNotNull() & bad, F.lit(name)))
    return configs.withColumn("violations", F.array_compact(F.array(*checks)))
