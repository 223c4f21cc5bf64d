"""Sorting, limits, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seeded_sample(df: DataFrame, key_cols: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by md5(seed | key).

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: every task keeps
    its own top ``n`` and only those reach the final merge (no full sort).
    The choice does not depend on partitioning.
    """
    from riskweave.operators.splits import hash_hex
    return df.withColumn("_h", hash_hex(key_cols, seed)).orderBy("_h", *key_cols).limit(n).drop("_h")


def head(df: DataFrame, order_cols: list, n: int = 5) -> DataFrame:
    """L2: first ``n`` rows in a declared order (row order is otherwise undefined)."""
    return df.orderBy(*order_cols).limit(n)


def top_k(df: DataFrame, col: str, k: int = 10, largest: bool = True, tie_cols: list | None = None) -> DataFrame:
    """L3: ``nlargest`` / ``nsmallest``."""
    o = F.col(col).desc_nulls_last() if largest else F.col(col).asc_nulls_last()
    return df.orderBy(o, *(tie_cols or [])).limit(k)


def arg_max(df: DataFrame, col: str, tie_cols: list) -> DataFrame:
    """L4: the single best row, first tie-break column ascending."""
    return top_k(df, col, 1, True, tie_cols)


def head_per_group(df: DataFrame, group_cols: list[str], order_cols: list, n: int = 5) -> DataFrame:
    """First ``n`` rows of each group.

    The rank filter is pushed into the window (WindowGroupLimit), so each
    task keeps at most ``n`` rows per group before the shuffle output grows.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
