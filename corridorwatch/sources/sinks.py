"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_month_tables(tables: dict[str, DataFrame], path: str, time: str = "bin5") -> dict[str, str]:
    """Every table below its own folder, one partition per year and month.

    Only the partitions that ``tables`` have rows for are replaced, so months can be written
    one at a time. Rows are rebalanced, so one large month is written by many tasks.
    """
    written = {}
    for name, df in tables.items():
        target = f"{path}/{name}"
        if time in df.columns:
            df = df.withColumns({"year": F.year(time), "month": F.month(time)}).hint("rebalance", "year", "month")
            writer = df.write.partitionBy("year", "month").option("partitionOverwriteMode", "dynamic")
        else:
            writer = df.write
        writer.mode("overwrite").parquet(target)
        written[name] = target
    return written


def write_jsonl(records: DataFrame, path: str) -> str:
    """One JSON text per line, UTF-8, from the ``record`` column."""
    records.select("record").write.mode("overwrite").text(path)
    return path


def write_summary_json(summary: DataFrame, path: str) -> str:
    """A one-row summary as JSON, NULL fields kept."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path
