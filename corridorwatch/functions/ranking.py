"""Exact top-n per group, and running totals, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int | Column,
    spread: list[str],
    slices: int = 32,
    rank: str = "rank",
) -> DataFrame:
    """First ``n`` rows per group in ``order`` (a total order), with their rank.

    ``n`` may be a column that is constant inside a group.
    A group may hold a large part of the table, so it is first cut into slices by
    a hash of ``spread``; the best n of every slice contain the best n of the
    group, and at most ``slices * n`` rows per group reach the second window.
    """
    slice_id = "__slice"
    sliced = df.withColumn(slice_id, F.pmod(F.xxhash64(*spread), F.lit(slices)))
    inner = Window.partitionBy(*keys, slice_id).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        sliced.withColumn(rank, F.row_number().over(inner))
        .where(F.col(rank) <= n)
        .drop(rank, slice_id)
        .withColumn(rank, F.row_number().over(outer))
        .where(F.col(rank) <= n)
    )


def running_totals(
    df: DataFrame,
    keys: list[str],
    levels: list[str],
    order: list[Column],
    measures: dict[str, str],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``measures`` (source -> output) along ``order``.

    ``levels`` are columns that cut each key group into nested ranges of that
    order, coarse to fine. Totals are summed per range, prefixed range by range
    inside the parent range, and added to the sums inside the finest range, so
    no window sees more than one range of rows. Ranges are columns of the data,
    hence stable when a lost task is computed again.

    A range is named by the struct of its keys and levels. A struct is never
    NULL, so joining on it adds no filters, rows with NULL keys stay, and the
    totals reuse the shuffle of the rows they are added to.
    """
    names = [*keys, *levels]
    rid = "__range"

    def named(source: str | None, depth: int) -> Column:
        parts = names[: len(keys) + depth]
        return F.struct(*[F.col(p if source is None else f"{source}.{p}").alias(p) for p in parts]) if parts else F.lit(0)

    ranged = df.withColumn(rid, named(None, len(levels)))
    sums = [F.sum(m).alias(m) for m in measures]
    tables = [ranged.groupBy(rid).agg(*sums)]
    for depth in range(len(levels) - 1, 0, -1):
        tables.append(tables[-1].groupBy(named(rid, depth).alias(rid)).agg(*sums))
    offsets = None
    for depth, table in enumerate(reversed(tables), start=1):
        table = table.withColumns(
            {"__parent": named(rid, depth - 1), "__level": F.col(f"{rid}.{levels[depth - 1]}")}
        )
        step = F.col("__level").desc() if descending else F.col("__level").asc()
        w = Window.partitionBy("__parent").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        table = table.select(
            rid, "__parent", *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(f"__before_{m}") for m in measures]
        )
        if offsets is not None:
            up = offsets.select(F.col(rid).alias("__parent"), *[F.col(f"__before_{m}").alias(f"__up_{m}") for m in measures])
            total = {m: (F.col(f"__before_{m}") + F.col(f"__up_{m}")).alias(f"__before_{m}") for m in measures}
            table = table.join(up, "__parent").select(rid, *total.values())
        offsets = table.select(rid, *[f"__before_{m}" for m in measures])
    leaf = Window.partitionBy(rid).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(offsets, rid)
        .withColumns({out: F.sum(m).over(leaf) + F.col(f"__before_{m}") for m, out in measures.items()})
        .drop(rid, *[f"__before_{m}" for m in measures])
    )


def carried_lag(df: DataFrame, keys: list[str], block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``value`` of the row before, in ``order``, without one task per key.

    ``block`` cuts a key's rows into ranges of that order. Inside a range the row before is a
    window's; the first row of a range gets the last value of the nearest earlier range
    that has rows, handed over in a table of one row per range.
    """
    cut = "__block"
    ranged = df.withColumn(cut, block)
    inner = Window.partitionBy(*keys, cut).orderBy(*order)
    lasts = ranged.groupBy(*keys, cut).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    lasts = lasts.withColumn("__carried", F.lag("__last").over(Window.partitionBy(*keys).orderBy(cut))).drop("__last")
    marked = ranged.withColumns({name: F.lag(value).over(inner), "__first": F.row_number().over(inner) == 1})
    match = F.lit(True)
    for k in [*keys, cut]:
        match = match & F.col(f"m.{k}").eqNullSafe(F.col(f"l.{k}"))
    carried = F.when(F.col("__first"), F.col("l.__carried")).otherwise(F.col(f"m.{name}"))
    return marked.alias("m").join(lasts.alias("l"), match).select(*[F.col(f"m.`{c}`") for c in df.columns], carried.alias(name))


def running_ids(df: DataFrame, levels: list[str], order: list[Column], name: str) -> DataFrame:
    """1, 2, 3 ... over the whole table in the order of ``levels`` and then ``order``."""
    one = "__one"
    return running_totals(df.withColumn(one, F.lit(1)), [], levels, order, {one: name}).drop(one)
