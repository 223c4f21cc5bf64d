"""Profiles that are merged instead of read again (D1, D8, D9, P14 beside the exact operators).

A part of the data (a file, a day) leaves one row per variable: counts, sums, extremes and Spark's own sketches of distinct
values and quantiles. States of parts, written once, are merged into the state of all of them without reading the parts'
rows; the state of a part that changed replaces its old row. Counts, means and deviations of merged states are exact up to
rounding. Distinct counts have a relative standard error of 1.04 / sqrt(2 ** lg_k) (0.8 % by default), quantiles a rank error of about
1.65 / k at ``quantile_k`` (under 0.5 %).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.profile import long_values

LG_K, QUANTILE_K = 14, 400


def profile_state(df: DataFrame, cols: list[str], part_cols: list[str], lg_k: int = LG_K, quantile_k: int = QUANTILE_K) -> DataFrame:
    """One row per part and variable of numeric columns; NULL and NaN are missing. One scan, map-side combined."""
    pieces = [F.struct(F.lit(c).alias("variable"), F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias("v")) for c in cols]
    rows = df.select(*part_cols, F.explode(F.array(*pieces)).alias("p")).select(*part_cols, "p.variable", "p.v")
    return rows.groupBy(*part_cols, "variable").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.coalesce(F.var_pop("v") * F.count("v"), F.lit(0.0)).alias("squares"),
        F.min("v").alias("least"), F.max("v").alias("most"), F.hll_sketch_agg(F.col("v").cast("string"), F.lit(lg_k)).alias("distinct"),
        F.kll_sketch_agg_double(F.col("v"), F.lit(quantile_k)).alias("ranks"))


def merge_state(state: DataFrame, part_cols: list[str] | None = None) -> DataFrame:
    """The states of several parts as one per variable (and ``part_cols`` that stay apart), itself a state that can be merged."""
    keys = [*(part_cols or []), "variable"]
    # squares about a common centre: each part's own plus those of its mean about the mean of all
    whole = state.groupBy(*keys).agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("_centre"))
    moved = state.join(whole, keys).withColumn("squares", F.col("squares") + F.col("n") * F.coalesce((F.col("mean") - F.col("_centre")) * (F.col("mean") - F.col("_centre")), F.lit(0.0)))
    return moved.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("_centre").alias("mean"), F.sum("squares").alias("squares"),
                                    F.min("least").alias("least"), F.max("most").alias("most"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"))


def read_state(state: DataFrame, quantiles: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """What a state says of each variable: count, missing, mean, std (of a sample, as ``describe``), min, max, distinct values and quantiles."""
    q = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(p))).alias(f"q{round(p * 100)}") for p in quantiles]
    keys = [c for c in state.columns if c not in ("n_rows", "n", "total", "mean", "squares", "least", "most", "distinct", "ranks")]
    return state.select(*keys, "n", (F.col("n_rows") - F.col("n")).alias("missing"), "mean", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).alias("std"),
                        F.col("least").alias("min"), F.col("most").alias("max"), F.hll_sketch_estimate("distinct").alias("n_distinct"), *q)
