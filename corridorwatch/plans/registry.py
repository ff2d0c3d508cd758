"""Collects the named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corridorwatch.plans import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output conventions: doubles rounded, integers as bigint, dates as text."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, doubles: str = "", integers: str = "", digits: int = 6):
    """Register a query; ``sql`` names its columns like the DataFrame does."""

    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(function(spark, sf_dir), digits)
        if sql is not None:
            ORACLE[name] = oracle.sql(sql, doubles, integers, digits)
        return function

    return register
