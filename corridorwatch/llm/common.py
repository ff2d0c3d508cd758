"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corridorwatch.session import new_path

#: Words are separated by ASCII white space only; Java, Python and DuckDB all read this pattern alike.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: cuts the lineage.

    With ``free`` the driver collects its garbage, upon which Spark deletes the shuffle files
    of finished steps at once rather than at the next periodic collection.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    del df
    if free:
        spark.sparkContext._jvm.System.gc()
    return spark.read.parquet(path)


#: Rows and bytes that a Python task turns into Python values at a time (one row may have more bytes).
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most SLICE_ROWS rows and, but for single rows, SLICE_BYTES bytes."""
    if batch.num_rows <= 1 or batch.num_rows <= SLICE_ROWS and batch.nbytes <= SLICE_BYTES:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from sliced(batch.slice(0, half))
    yield from sliced(batch.slice(half))


def map_rows(df: DataFrame, make: Callable[[dict], dict], schema: str, keep: tuple[str, ...] = (), unread: tuple[str, ...] = ()) -> DataFrame:
    """``make`` gets the columns of a slice of rows as lists and returns columns as lists or arrays.

    ``keep`` names columns that come out as they went in, one row per row; those in ``unread``
    are not turned into Python values.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                own = {name: part.column(part.schema.get_field_index(name)) for name in keep}
                made = make(part.select([n for n in part.schema.names if n not in unread]).to_pydict())
                columns = [own[f.name].cast(f.type) if f.name in own else pa.array(made[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def ranked(rows: DataFrame, keys: list[str], size: str, spread: list[str], order: list[str], rank: str, per_range: int = 20_000) -> DataFrame:
    """Numbers 0, 1, 2 ... inside each group of ``keys``; ``size`` holds the rows of the group.

    A group is cut into hash ranges of about ``per_range`` rows. Ranges are counted, their
    starts are running sums of the counts, and only one range is sorted at a time. Null keys
    are a group.
    """
    part, inner = "__part", "__inner"
    cut = rows.withColumn(part, F.pmod(F.xxhash64(*spread), F.greatest(F.ceil(F.col(size) / per_range), F.lit(1))))
    counts = cut.groupBy(*keys, part).agg(F.count("*").alias("__m"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, part, F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*keys, part).orderBy(F.xxhash64(*spread), *order)) - 1
    return (
        cut.withColumn(inner, inside)
        .alias("a")
        .join(starts.alias("b"), same("a", "b", *keys, part))
        .select("a.*", (F.col(inner) + F.col("b.__start")).alias(rank))
        .drop(part, inner)
    )


def same(left: str, right: str, *names: str) -> Column:
    """Equality of the named columns of two aliases that holds between nulls."""
    match = F.lit(True)
    for n in names:
        match = match & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return match
