"""Append-only audit log of operator actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridorwatch import schemas
from corridorwatch import vocabulary as V


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def audit_records(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): valid actions with trimmed, truncated, defaulted fields."""
    action = _strip(F.coalesce("action", F.lit("")))
    valid = action.isin(V.AUDIT_ACTIONS)
    operator = F.substring(_strip(F.coalesce("operator", F.lit(V.AUDIT_OPERATOR))), 1, 30)
    accepted = payloads.where(valid).select(
        "id",
        "time",
        F.when(operator == "", V.AUDIT_OPERATOR).otherwise(operator).alias("operator"),
        action.alias("action"),
        F.substring(_strip(F.coalesce("target", F.lit(V.AUDIT_TARGET))), 1, 100).alias("target"),
        F.substring(_strip(F.coalesce("note", F.lit(""))), 1, 500).alias("note"),
        F.substring(F.coalesce("source", F.lit(V.AUDIT_SOURCE)), 1, 50).alias("source"),
    )
    return accepted, payloads.where(~valid)


def audit_append(payloads: DataFrame, path: str) -> DataFrame:
    """Append the valid records to the log; returns the rejected payloads."""
    accepted, rejected = audit_records(payloads)
    accepted.write.mode("append").json(path)
    return rejected


def scan_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUDIT).option("mode", "DROPMALFORMED").json(path)


def audit_list(log: DataFrame, limit: int = 100) -> DataFrame:
    """The newest records; the id orders records of one second."""
    return log.orderBy(F.col("time").desc(), F.col("id").desc()).limit(limit)
