"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_days_between(later, earlier) -> Column:
    """Whole days of (later - earlier), floored (-12h -> -1), exact on timestamp_ntz.

    The subtraction yields a day-time interval; viewed as seconds with a
    microsecond fraction it is divided by 86400 and floored.
    """
    diff = (col_(later) - col_(earlier)).cast("interval second").cast("decimal(24,6)")
    return F.floor(diff / F.lit(86400)).cast("int")


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI-safe)."""
    return col_(num) / F.nullif(col_(den), F.lit(0))


def is_missing(c) -> Column:
    """pandas-style missing: NULL, or NaN for floating columns."""
    return col_(c).isNull() | F.isnan(col_(c))


def with_constant_key(df: DataFrame, keys: list[str], name: str = "_all"):
    """Grouping helpers accept no keys; give them a constant one."""
    if keys:
        return df, list(keys), False
    return df.withColumn(name, F.lit(0)), [name], True


def sized_broadcast(df: DataFrame, n_rows: int, max_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast ``df`` only when its counted rows, at the schema's default row size, stay within ``max_bytes``."""
    row = sum(64 if f.dataType.typeName() in ("string", "binary", "struct", "array", "map") else 16 for f in df.schema.fields) + 16
    return F.broadcast(df) if n_rows * row <= max_bytes else df
