"""Single-row tables next to larger ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Every row of ``df`` with the columns of ``row``, a table of exactly one row.

    ``row`` is a global aggregate or a parameter row, so its size is fixed and the
    broadcast cannot grow with the data.
    """
    return df.crossJoin(F.broadcast(row))
