"""Categorical profiling.

Everything starts from one ``(variable, value, n)`` table: string columns are
unpivoted and counted with map-side partial aggregation, shuffled on
``(variable, value)``, so even a column with billions of distinct values is
spread over all tasks.  Top-k per variable uses ``row_number() <= k`` which
Spark plans with a partial WindowGroupLimit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.exprs import safe_div
from riskweave.sources.schemas import columns_of_kind

# Diversity labels of the source report.
ENTROPY_LABELS = ("High diversity", "Moderate diversity", "Low diversity (concentrated)")


def _cat_cols(df, cols):
    return list(cols) if cols else columns_of_kind(df, "string")


def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(variable, value, n, pct)``; pct is of the non-null values, as
    ``value_counts(normalize=True)``."""
    cols = _cat_cols(df, cols)
    lv = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
          .unpivot([], cols, "variable", "value").where(F.col("value").isNotNull()))
    counts = lv.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("variable").agg(F.sum("n").alias("_tot"), F.count(F.lit(1)).alias("_k"))
    return (counts.join(F.broadcast(totals), "variable")
            .select("variable", "value", "n", (F.col("n") * 100.0 / F.col("_tot")).alias("pct"), "_k", "_tot"))


def ranked_counts(df: DataFrame, cols: list[str] | None, k: int) -> DataFrame:
    """Top ``k`` values per variable by count desc, value asc."""
    vc = value_counts(df, cols)
    w = Window.partitionBy("variable").orderBy(F.col("n").desc(), F.col("value"))
    return vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cardinality(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct values, total rows and their ratio; highest first."""
    cols = _cat_cols(df, cols)
    dist = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[dist(c).alias(f"_d{i}") for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(c).alias("variable"), F.col(f"_d{i}").alias("distinct")) for i, c in enumerate(cols)]
    return (wide.select("_rows", F.explode(F.array(*entries)).alias("e"))
            .select("e.variable", "e.distinct", F.col("_rows").alias("total"),
                    (F.col("e.distinct") / F.col("_rows")).alias("ratio"))
            .orderBy(F.col("distinct").desc(), "variable"))


def value_counts_top(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """Top ``k`` values with count, pct and how many more distinct values exist."""
    r = ranked_counts(df, cols, k)
    return r.select("variable", "rank", "value", "n", "pct",
                    F.greatest(F.col("_k") - k, F.lit(0)).alias("more_values"))


def categorical_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct, mode, mode count and %, missing and %, top-3 text."""
    cols = _cat_cols(df, cols)
    r = ranked_counts(df, cols, 3)
    text = F.format_string("%s(%.1f%%)", F.col("value"), F.round("pct", 1))
    top = r.groupBy("variable").agg(
        F.first("_k").alias("distinct"),
        F.min(F.when(F.col("rank") == 1, F.col("value"))).alias("mode"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("mode_count"),
        F.max(F.when(F.col("rank") == 1, F.col("pct"))).alias("mode_pct"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))),
                                 lambda s: s["t"]), ", ").alias("top3"))
    from riskweave.operators.quality import missing_counts
    miss = missing_counts(df, cols).select(F.col("column").alias("variable"), "missing", "missing_pct")
    return (miss.join(top, "variable", "left")
            .select("variable", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"),
                    F.coalesce("mode", F.lit("N/A")).alias("mode"),
                    F.coalesce("mode_count", F.lit(0)).cast("long").alias("mode_count"),
                    F.coalesce("mode_pct", F.lit(0.0)).alias("mode_pct"),
                    "missing", "missing_pct", F.coalesce("top3", F.lit("")).alias("top3")))


def entropy(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Shannon entropy (base 2) of each column's value distribution,
    its maximum log2(k), the normalised value and a diversity label."""
    vc = value_counts(df, cols)
    p = F.col("n") / F.col("_tot")
    e = vc.groupBy("variable").agg(F.sum(-p * F.log2(p)).alias("entropy"), F.first("_k").alias("k"))
    mx = F.when(F.col("k") > 1, F.log2(F.col("k").cast("double"))).otherwise(F.lit(0.0))
    out = e.select("variable", "entropy", mx.alias("max_entropy"))
    norm = F.when(F.col("max_entropy") > 0, F.col("entropy") / F.col("max_entropy")).otherwise(F.lit(0.0))
    out = out.withColumn("normalized_entropy", norm)
    label = (F.when(F.col("normalized_entropy") > 0.7, F.lit(ENTROPY_LABELS[0]))
             .when(F.col("normalized_entropy") > 0.4, F.lit(ENTROPY_LABELS[1]))
             .otherwise(F.lit(ENTROPY_LABELS[2])))
    return out.withColumn("label", label).orderBy(F.col("normalized_entropy").desc(), "variable")


def top_bars(df: DataFrame, cols: list[str] | None = None, k: int = 20) -> DataFrame:
    """Bar-chart data, top ``k`` values when there are more, else all."""
    r = ranked_counts(df, cols, k)
    return r.select("variable", "rank", "value", "n", "pct")


def category_share(df: DataFrame, cols: list[str] | None = None, max_categories: int = 15) -> DataFrame:
    """Value shares for the columns with at most ``max_categories`` values."""
    vc = value_counts(df, cols)
    return vc.where(F.col("_k") <= max_categories).select("variable", "value", "n", "pct")
