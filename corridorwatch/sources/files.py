"""Readers: monthly panel, accident registry, snapshot, snapshot document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corridorwatch import schemas
from corridorwatch import vocabulary as V
from corridorwatch.functions.columns import cyclic, finite_or, lookup, minute_of_day, to_double
from corridorwatch.functions.ranking import running_ids


def _partitioned(schema: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, T.IntegerType(), True) for n in names]])


def csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of CSV files as text, found by header name.

    Other columns may stand between them and a byte order mark before them. A missing
    column is an error, and so is a file whose header differs from the first one's.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).option("encoding", "UTF-8").csv(path)
    named = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
    absent = [c for c in columns if c not in named.columns]
    if absent:
        raise ValueError(f"columns missing in {path}: {', '.join(absent)}")
    return named.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns])


def scan_panel_months(
    spark: SparkSession, path: str, months: list[int] | None = None, fmt: str = "parquet", year: int | None = None
) -> DataFrame:
    """The panel below ``path``, partitioned by ``month``; only the months asked for are read.

    With ``year`` the folder is partitioned by year and month, as ``write_month_tables`` leaves
    it, and only that year is read; several years in a folder need it, or their months
    would mix. Parquet is read with the typed schema; CSV cells stay text for ``typed_panel``.
    """
    names = ["month"] if year is None else ["year", "month"]
    if fmt == "csv":
        df = csv_text(spark, path, [*schemas.PANEL_TEXT.fieldNames(), *names]).withColumns({n: F.col(n).cast("int") for n in names})
    else:
        df = spark.read.schema(_partitioned(schemas.PANEL, names)).format(fmt).load(path)
    if year is not None:
        df = df.where(F.col("year") == year)
    if months is not None:
        df = df.where(F.col("month").isin(months))
    return df


def scan_registry(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Accident registry CSV with its source headers: one year, typed, numbered in time order."""
    raw = csv_text(spark, path, schemas.REGISTRY_TEXT.fieldNames())
    return registry_columns(raw, year)


#: Registry numbers that one task brings into order.
IDS_PER_RANGE = 10_000


def registry_columns(raw: DataFrame, year: int) -> DataFrame:
    df = raw.select([F.col(f"`{h}`").alias(c) for h, c in V.REGISTRY_HEADERS.items()])
    numbers = [
        "stake_km", "temperature", "humidity", "visibility", "mqi", "pci", "traffic", "median_speed",
        "traffic_density", "lane_density", "upstream_traffic", "downstream_traffic", "segment_count",
    ]
    time = F.try_to_timestamp(F.col("occurred_at"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    df = df.withColumns(
        {c: to_double(c) for c in numbers}
        | {c: to_double(c).cast("int") for c in ("serious_injured", "deaths")}
        | {
            "registry_id": F.col("registry_id").try_cast("long"),
            "occurred_at": time,
            "direction_code": lookup(V.DIRECTION_TEXT, F.col("direction")),
        }
    ).withColumn("accident_stake_m", F.col("stake_km") * 1000.0)
    # ranges by day, by time and by number: a crowded day or minute is spread over tasks
    ranges = {"__day": F.to_date("occurred_at"), "__time": F.col("occurred_at"), "__ids": F.floor(F.col("registry_id") / IDS_PER_RANGE)}
    df = df.where(F.year("occurred_at") == year).withColumns(ranges)
    numbered = running_ids(df, list(ranges), [F.col("registry_id")], "registry_row")
    return numbered.drop(*ranges).withColumn("registry_row", F.col("registry_row") - 1)


def registry_cyclic(registry: DataFrame) -> DataFrame:
    """Time of day as sine and cosine, and the combined type folded into rollover."""
    hour_sin, hour_cos = cyclic(minute_of_day("occurred_at"), 1440.0)
    kind = F.when(F.col("accident_type") == V.TYPE_COMBINED, V.TYPE_ROLLOVER).otherwise(F.col("accident_type"))
    return registry.withColumns({"hour_sin": hour_sin, "hour_cos": hour_cos, "model_type": kind})


def scan_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot CSV with typed columns; malformed numbers become 0."""
    raw = csv_text(spark, path, schemas.SNAPSHOT_TEXT.fieldNames())
    return raw.select(
        "segment_id",
        "road_code",
        to_double("direction_code").cast("int").alias("direction_code"),
        finite_or("stake").alias("stake_m"),
        finite_or(V.RISK).alias("stage1_score"),
    )


#: Sections of the document whose keys vary; the first ones are lists of objects.
LISTED_SECTIONS, KEYED_SECTIONS = (
    ["cases", "route_series"],
    ["metrics", "selected_case", "default_features", "model", "benchmarks.noninferiority", "optimization", "validation", "evidence"],
)


def document_sections(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A table (item, field, value) for every section whose keys vary, read as VARIANT.

    ``item`` is the place in a list, 0 for a section that is one object; ``value`` is the JSON of the field, a
    text without its quotes. Sections that a document lacks have no rows.
    """
    doc = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("doc"))
    tables = {}
    for name in [*LISTED_SECTIONS, *KEYED_SECTIONS]:
        if name in LISTED_SECTIONS:
            items = doc.select(F.posexplode(F.variant_get("doc", f"$.{name}", "array<variant>")).alias("item", "object"))
            fields = items.select("item", F.explode(F.variant_get("object", "$", "map<string,variant>")).alias("field", "v"))
        else:
            fields = doc.select(F.lit(0).alias("item"), F.explode(F.variant_get("doc", f"$.{name}", "map<string,variant>")).alias("field", "v"))
        plain = F.when(F.schema_of_variant("v") == "STRING", F.variant_get("v", "$", "string")).otherwise(F.to_json("v"))
        tables[name] = fields.select("item", "field", plain.alias("value"))
    return tables


def scan_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The snapshot document as tables: overview, pipeline, watchlist, models, policies."""
    doc = spark.read.schema(schemas.DOCUMENT).option("multiLine", True).json(path)
    return {
        "overview": doc.select("system.*", "snapshot.*", F.size("watchlist").alias("watchlist_rows"), "boundaries"),
        "pipeline": doc.select(F.inline("pipeline")),
        "watchlist": doc.select(F.inline("watchlist")),
        "models": doc.select(F.inline("benchmarks.models")),
        "policies": doc.select(
            "policy_library.policy_version",
            F.explode("policy_library.type_specific_examples").alias("accident_type", "measures"),
        ),
    }
