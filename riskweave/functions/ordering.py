"""Order-preserving keys and ranks that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.quantiles import join_keys, materialise

MANTISSA = 1 << 52


def double_key(x: Column) -> Column:
    """The double's bit pattern as a long that sorts like the value (no NaN; -0.0 as 0.0).

    Plain arithmetic that stays in generated code: the exponent comes from a logarithm and is put right by one step where
    that was rounded, the scaling by powers of two is exact.  Negative values take the negated pattern."""
    a = F.abs(x.cast("double"))
    tiny = F.lit(2.0 ** -1022)
    guess = F.floor(F.log2(F.greatest(a, tiny)))
    exponent = F.least(F.greatest(guess, F.lit(-1022)), F.lit(1023))
    m = a / F.pow(F.lit(2.0), exponent)
    exponent = F.when(m < 1, exponent - 1).when(m >= 2, exponent + 1).otherwise(exponent)
    m = F.when(m < 1, m * 2).when(m >= 2, m / 2).otherwise(m)
    normal = (exponent + 1023) * F.lit(MANTISSA) + ((m - 1) * float(MANTISSA)).cast("long")
    subnormal = (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
    key = F.when(a == float("inf"), F.lit(2047 * MANTISSA)).when(a < tiny, subnormal).otherwise(normal)
    return F.when(x < 0, -key).otherwise(key)


def running_total(df: DataFrame, order_cols: list[str], amount: Column, out: str, group_cols: list[str] | None = None) -> DataFrame:
    """Add the total of ``amount`` over the rows before each row by ``order_cols`` (within ``group_cols``), without sorting a
    group in one task.

    Rows are range-partitioned on groups and order; a row's total is that of the group's ranges before plus that of the
    rows before it in its own.  The range numbers are materialised first, as a second evaluation could
    draw other ranges.  Give a unique last order column where ties matter."""
    groups = list(group_cols or [])
    placed = materialise(df.withColumn("_amount", amount.cast("long")).repartitionByRange(*groups, *order_cols).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and range
    sums = placed.groupBy(*groups, "_range").agg(F.sum("_amount").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = join_keys(placed, sums, [*groups, "_range"])
    inside = Window.partitionBy(*groups, "_range").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.coalesce(F.sum("_amount").over(inside), F.lit(0)) + F.col("_offset")).drop("_range", "_offset", "_amount")


def global_rank(df: DataFrame, order_cols: list[str], rank_col: str = "rank", group_cols: list[str] | None = None) -> DataFrame:
    """Add each row's 0-based rank by ``order_cols`` (within ``group_cols``); rows that tie in all of them get different ranks."""
    return running_total(df, order_cols, F.lit(1), rank_col, group_cols)
