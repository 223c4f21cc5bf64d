"""Numeric profiling.

Declarative moments (count, mean, std, min, max, skewness, kurtosis) are one
wide aggregate: every task reduces its rows to one partial row per column, so
the shuffle is tiny whatever the table size.  Quantiles go through the
skew-safe helper on the unpivoted ``(variable, value)`` table.  Result tables
are long: one row per variable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.exprs import safe_div
from riskweave.functions.quantiles import column_quantiles, quantiles
from riskweave.sources.schemas import columns_of_kind

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def long_values(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Unpivot ``cols`` to ``(variable, value DOUBLE)`` (plus ``keep`` columns)."""
    keep = keep or []
    casted = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(keep, cols, "variable", "value")


def _numeric_cols(df: DataFrame, cols) -> list[str]:
    return list(cols) if cols else columns_of_kind(df, "numeric")


def moments(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per variable: n (non-null), mean, std/var (sample and population), min, max,
    skewness and excess kurtosis (population, as scipy's defaults)."""
    cols = _numeric_cols(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        aggs.append(F.struct(
            F.lit(c).alias("variable"),
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.var_samp(x).alias("var"),
            F.stddev_pop(x).alias("std_pop"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.skewness(x).alias("skewness"),
            F.kurtosis(x).alias("kurtosis"),
        ).alias(f"_m{i}"))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[f"_m{i}" for i in range(len(cols))])).alias("m")).select("m.*")


def variable_quantiles(df: DataFrame, cols: list[str] | None = None, probs=None,
                       approx_accuracy: int | None = None) -> DataFrame:
    cols = _numeric_cols(df, cols)
    if approx_accuracy:
        return quantiles(long_values(df, cols), ["variable"], "value", probs or QUARTILES, approx_accuracy=approx_accuracy)
    return column_quantiles(df, cols, probs or QUARTILES)


def _with_quantiles(df, cols, probs, approx_accuracy=None):
    m = moments(df, cols)
    q = variable_quantiles(df, cols, probs, approx_accuracy)
    # both sides hold one row per variable: the join is bounded by the schema width
    return m.join(F.broadcast(q), "variable", "left")


def describe(df: DataFrame, cols: list[str] | None = None, approx_accuracy: int | None = None) -> DataFrame:
    """Count, mean, std (sample), min, 25/50/75 %, max."""
    t = _with_quantiles(df, cols, QUARTILES, approx_accuracy)
    return t.select("variable", "count", "mean", "std", "min",
                    F.col("q25").alias("p25"), F.col("q50").alias("p50"),
                    F.col("q75").alias("p75"), "max")


def mode_per_variable(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent value per variable, smallest on ties.

    Counted per (variable, value) first - a distributed shuffle - then reduced
    with ``min(struct(-count, value))``, which partially aggregates map-side.
    """
    counts = long_values(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value")) \
        .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("variable").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v"))).alias("b"))
    return best.select("variable", F.col("b.v").alias("mode"), (-F.col("b.neg_n")).alias("mode_count"))


def central_tendency(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Mean, median, mode."""
    cols = _numeric_cols(df, cols)
    t = _with_quantiles(df, cols, {"median": 0.5})
    mo = mode_per_variable(df, cols)
    return t.join(F.broadcast(mo), "variable", "left").select("variable", "mean", "median", "mode")


def dispersion(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """D3: std, variance, min, max, range, IQR, Q1, Q3."""
    t = _with_quantiles(df, cols, {"q1": 0.25, "q3": 0.75})
    return t.select("variable", "std", "var", "min", "max",
                    (F.col("max") - F.col("min")).alias("range"),
                    (F.col("q3") - F.col("q1")).alias("iqr"), "q1", "q3")


# The interpretation labels of the source profiling report.
SKEW_LABELS = ("Approximately symmetric", "Moderately skewed", "Highly skewed")
KURTOSIS_LABELS = ("Light-tailed (platykurtic)", "Heavy-tailed (leptokurtic)",
                   "Normal-tailed (mesokurtic)")


def skew_label(c) -> F.Column:
    """|skew| < 0.5 symmetric, < 1 moderate, else (NULL included) high."""
    a = F.abs(F.col(c) if isinstance(c, str) else c)
    return (F.when(a < 0.5, F.lit(SKEW_LABELS[0])).when(a < 1, F.lit(SKEW_LABELS[1]))
            .otherwise(F.lit(SKEW_LABELS[2])))


def kurtosis_label(c) -> F.Column:
    """< -0.5 light, > 0.5 heavy, else (NULL included) normal."""
    k = F.col(c) if isinstance(c, str) else c
    return (F.when(k < -0.5, F.lit(KURTOSIS_LABELS[0])).when(k > 0.5, F.lit(KURTOSIS_LABELS[1]))
            .otherwise(F.lit(KURTOSIS_LABELS[2])))


def shape(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """D4 + D5: skewness, excess kurtosis and their labels."""
    m = moments(df, cols)
    return m.select("variable", "skewness", "kurtosis",
                    skew_label("skewness").alias("skew_label"),
                    kurtosis_label("kurtosis").alias("kurtosis_label"))


def coef_variation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Std / mean * 100, highest first (NULL when the mean is 0)."""
    m = moments(df, cols)
    return (m.select("variable", "mean", "std", (safe_div("std", "mean") * 100).alias("cv_pct"))
            .orderBy(F.col("cv_pct").desc_nulls_last(), "variable"))


def comprehensive_stats(df: DataFrame, cols: list[str] | None = None, digits: int = 2) -> DataFrame:
    """One table with count, mean, median, std, min, max, range, IQR, skew,
    kurtosis and CV, rounded to ``digits``."""
    t = _with_quantiles(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    out = t.select(
        "variable", "count", "mean", "median", "std", "min", "max",
        (F.col("max") - F.col("min")).alias("range"),
        (F.col("q3") - F.col("q1")).alias("iqr"), "skewness", "kurtosis",
        (safe_div("std", "mean") * 100).alias("cv_pct"))
    return out.select("variable", "count", *[F.round(c, digits).alias(c) for c in out.columns[2:]])


def time_span(df: DataFrame, ts_col: str) -> DataFrame:
    """First, last timestamp and whole days between them."""
    from riskweave.functions.exprs import floor_days_between
    t = df.agg(F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"))
    return t.withColumn("span_days", floor_days_between("last_ts", "first_ts"))


def counts_by_year(df: DataFrame, ts_col: str) -> DataFrame:
    """Rows per calendar year."""
    return df.groupBy(F.year(ts_col).alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy("year")


def counts_by_month(df: DataFrame, ts_col: str) -> DataFrame:
    """Rows per calendar month (``trunc`` keeps a DATE)."""
    return (df.groupBy(F.trunc(F.col(ts_col).cast("date"), "MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("month"))


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 50) -> DataFrame:
    """Equal-width bins per variable (last bin closed) with counts.

    Bounds come from a one-row-per-variable aggregate joined by broadcast;
    the bin index is arithmetic, so counting is a plain (variable, bin)
    aggregate with map-side combine.
    """
    cols = _numeric_cols(df, cols)
    lv = long_values(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    bounds = lv.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    idx = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.lit(bins), F.floor((F.col("value") - F.col("lo")) / width).cast("int") + 1))
    counted = (lv.join(F.broadcast(bounds), "variable")
               .groupBy("variable", idx.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n")))
    return counted.select(
        "variable", "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
        (F.col("lo") + F.col("bin") * width).alias("bin_hi"), "n")


def histogram_overlay(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """D30 companions: mean, median and skewness per variable."""
    t = _with_quantiles(df, cols, {"median": 0.5})
    return t.select("variable", "mean", "median", "skewness")


def box_stats(df: DataFrame, cols: list[str] | None = None, whisker: float = 1.5) -> DataFrame:
    """Q1, median, Q3, IQR, fences, outliers beyond the fences and their
    share of the non-null values."""
    from riskweave.operators.quality import iqr_bounds
    cols = _numeric_cols(df, cols)
    b = iqr_bounds(df, cols, whisker, extra={"median": 0.5})
    lv = long_values(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    flagged = lv.join(F.broadcast(b.select("variable", "lower", "upper")), "variable")
    out = flagged.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("n_outliers"))
    return (b.join(out, "variable", "left")
            .select("variable", "q1", "median", "q3", "iqr", "lower", "upper",
                    F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"),
                    (safe_div("n_outliers", "n") * 100).alias("pct_outliers")))
