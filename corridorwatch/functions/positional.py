"""Windows over row positions, for groups too long for one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def positional_window(
    df: DataFrame,
    group: list[str],
    order: list[str],
    chunk: Column,
    reach: int,
    build: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Add the window columns of ``build`` (frames of at most ``reach`` rows each way).

    ``chunk`` cuts every group into consecutive ranges of ``order``. Frames are
    computed per chunk; only rows whose frame leaves the chunk are computed again
    in a window over the whole group, which then holds at most ``4 * reach`` rows
    per chunk. Both parts share the same shuffle of the input.
    """
    cid, rn, n = "__chunk", "__position", "__size"
    by_chunk = df.withColumn(cid, chunk)
    inside = Window.partitionBy(*group, cid).orderBy(*order)
    whole = Window.partitionBy(*group, cid)
    placed = by_chunk.withColumns({rn: F.row_number().over(inside), n: F.count(F.lit(1)).over(whole)})
    near_edge = (F.col(rn) <= reach) | (F.col(rn) > F.col(n) - reach)
    around_edge = (F.col(rn) <= 2 * reach) | (F.col(rn) > F.col(n) - 2 * reach)
    core = placed.withColumns(build(inside)).where(~near_edge)
    across = Window.partitionBy(*group).orderBy(*order)
    edge = placed.where(around_edge).withColumns(build(across)).where(near_edge)
    return core.unionByName(edge).drop(cid, rn, n)
