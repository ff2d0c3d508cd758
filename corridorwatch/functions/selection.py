"""Exact medians and modes without all values in one buffer."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that a pass cuts the remaining values of a column into.
RANGES = 256
#: Passes end where every rank is known; doubles are exhausted far earlier.
MOST_PASSES = 40


@dataclass
class _Rank:
    """The value of rank ``rank`` (from 0) among those of ``column`` between ``low`` and ``high``."""

    column: str
    rank: int
    low: float
    high: float


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) for every finite value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The median of each column as ``median`` gives it, of missing and infinite values none.

    Every pass counts the values of the ranges that still hold a wanted rank and keeps the range
    the rank falls into, with its true ends, until these meet. A pass brings back a row per
    range, whatever the table holds; a value that many rows share is a range of its own soon.
    """
    if not columns:
        return {}
    values = _long(df, columns)
    ends = values.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    wanted = {(r["column"], k): _Rank(r["column"], k, r["low"], r["high"]) for r in ends for k in {(r["n"] - 1) // 2, r["n"] // 2}}
    for step in range(MOST_PASSES + 1):
        open_ranks = {key: w for key, w in wanted.items() if w.low < w.high}
        if not open_ranks:
            break
        if step == MOST_PASSES:
            raise RuntimeError(f"some medians are not found after {MOST_PASSES} passes")
        found = _count_ranges(values, open_ranks)
        for key, w in open_ranks.items():
            before = 0
            for n, low, high in found[key]:
                if w.rank < before + n:
                    wanted[key] = _Rank(w.column, w.rank - before, low, high)
                    break
                before += n
    medians: dict[str, float | None] = dict.fromkeys(columns)
    for r in ends:
        lower, upper = (wanted[r["column"], k].low for k in ((r["n"] - 1) // 2, r["n"] // 2))
        medians[r["column"]] = 0.5 * lower + 0.5 * upper
    return medians


def _bucket(w: _Rank) -> Column:
    """The range of a value between ``low`` and ``high``: first by sign, then by magnitude, then of equal widths."""
    v = F.col("value")
    if w.low < 0 < w.high or w.low == 0 or w.high == 0:
        return F.signum(v).cast("int")
    near, far = sorted((abs(w.low), abs(w.high)))
    if far / near > 4:
        share = (F.ln(F.abs(v)) - math.log(near)) / (math.log(far) - math.log(near))
        share = share if w.low > 0 else 1.0 - share
    else:
        share = (v - w.low) / (w.high - w.low)
    return F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor(share * RANGES).cast("int")))


def _count_ranges(values: DataFrame, ranks: dict[tuple[str, int], _Rank]) -> dict[tuple[str, int], list[tuple[int, float, float]]]:
    """Per rank the ranges of its interval in order: rows, smallest and largest value."""
    parts = []
    for (column, k), w in ranks.items():
        inside = (F.col("column") == column) & F.col("value").between(w.low, w.high)
        parts.append(F.when(inside, F.struct(F.lit(column).alias("column"), F.lit(k).alias("k"), _bucket(w).alias("bucket"))))
    marked = values.select("value", F.explode(F.array_compact(F.array(*parts))).alias("m"))
    counts = marked.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    found: dict[tuple[str, int], list] = {key: [] for key in ranks}
    for r in sorted(counts.collect(), key=lambda r: r["m"]["bucket"]):
        found[r["m"]["column"], r["m"]["k"]].append((r["n"], r["low"], r["high"]))
    return found


def exact_modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The most frequent text of each column, of equally frequent ones the smallest; None if it has none."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(pairs).alias("p")).where("p.value IS NOT NULL").groupBy("p.column", "p.value").agg((-F.count(F.lit(1))).alias("less"))
    best = counts.groupBy("column").agg(F.min(F.struct("less", "value")).alias("best"))
    return dict.fromkeys(columns) | {r["column"]: r["best"]["value"] for r in best.collect()}
