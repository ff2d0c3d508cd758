"""Column helpers: coercion, clipping, rounding, time of day."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_double(c: Column | str) -> Column:
    """Text to double; malformed text and NaN become NULL (ANSI-safe)."""
    c = F.col(c) if isinstance(c, str) else c
    return null_if_nan(F.trim(c.cast("string")).try_cast("double"))


def finite_or(c: Column | str, default: float = 0.0) -> Column:
    """A finite number, else the default."""
    number = to_double(c)
    return F.coalesce(F.when(F.abs(number) != float("inf"), number), F.lit(float(default)))


def coerce_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """Turn the named columns into doubles; names the table lacks are ignored."""
    present = {n: to_double(n) for n in names if n in df.columns}
    return df.withColumns(present) if present else df


def coerce_timestamp(df: DataFrame, name: str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Exact-format parse; rows that do not parse are dropped."""
    parsed = F.try_to_timestamp(F.col(name).cast("string"), F.lit(fmt)).cast("timestamp_ntz")
    return df.withColumn(name, parsed).where(F.col(name).isNotNull())


def _null_non_finite(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _null_non_finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _null_non_finite(v, kind.valueType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_null_non_finite(c[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(c.isNotNull(), inner)
    return c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL at every nesting level."""
    return df.select([_null_non_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def clip(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL (``least`` and ``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1.0 - 1e-6)
    return F.ln(q / (1.0 - q))


def minute_of_day(c: Column | str) -> Column:
    return F.hour(c) * 60 + F.minute(c)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from start to end as a double."""
    return F.timestamp_diff("SECOND", start, end) / F.lit(60.0)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict, key: Column) -> Column:
    """Dictionary lookup; unknown keys give NULL."""
    return F.try_element_at(literal_map(mapping), key)


def text_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
