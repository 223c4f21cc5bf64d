"""Numeric profiling queries on lineitem's measures and orders' dates."""

from riskweave.operators import profile as P
from pyspark.sql import functions as F

from riskweave.plans.derived import LINEITEM_MISSING_SQL, lineitem_with_missing
from riskweave.plans.catalog import register, rounded, table

L_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

LONG = """l AS (UNPIVOT (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, l_extendedprice, l_discount, l_tax
                      FROM lineitem)
       ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME variable VALUE value)"""

MOMENTS = LONG + """,
mu AS (SELECT variable, avg(value) AS mean FROM l GROUP BY variable),
m AS (SELECT l.variable, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std,
             var_samp(value) AS var, stddev_pop(value) AS std_pop, min(value) AS min, max(value) AS max,
             quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3,
             avg(power(value - mu.mean, 3)) / nullif(power(avg(power(value - mu.mean, 2)), 1.5), 0) AS skewness,
             avg(power(value - mu.mean, 4)) / nullif(power(avg(power(value - mu.mean, 2)), 2), 0) - 3 AS kurtosis
      FROM l JOIN mu USING (variable) GROUP BY l.variable)"""


def li(spark, sf):
    return table(spark, sf, "lineitem")


@register("describe", "WITH " + MOMENTS + """
SELECT variable, count, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min,
       round(q1, 4) AS p25, round(median, 4) AS p50, round(q3, 4) AS p75, round(max, 4) AS max FROM m""")
def q_describe(spark, sf):
    return rounded(P.describe(li(spark, sf), L_NUM), 4)


@register("central_tendency", "WITH " + MOMENTS + """,
vc AS (SELECT variable, value, count(*) AS n FROM l GROUP BY variable, value),
mo AS (SELECT variable, value AS mode FROM
        (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS rn FROM vc) WHERE rn = 1)
SELECT variable, round(mean, 4) AS mean, round(median, 4) AS median, round(mode, 4) AS mode
FROM m JOIN mo USING (variable)""")
def q_central(spark, sf):
    return rounded(P.central_tendency(li(spark, sf), L_NUM), 4)


@register("dispersion", "WITH " + MOMENTS + """
SELECT variable, round(std, 4) AS std, round(var, 4) AS var, round(min, 4) AS min, round(max, 4) AS max,
       round(max - min, 4) AS range, round(q3 - q1, 4) AS iqr, round(q1, 4) AS q1, round(q3, 4) AS q3 FROM m""")
def q_dispersion(spark, sf):
    return rounded(P.dispersion(li(spark, sf), L_NUM), 4)


SKEW_CASE = """CASE WHEN abs(skewness) < 0.5 THEN 'Approximately symmetric'
            WHEN abs(skewness) < 1 THEN 'Moderately skewed' ELSE 'Highly skewed' END"""
KURT_CASE = """CASE WHEN kurtosis < -0.5 THEN 'Light-tailed (platykurtic)'
            WHEN kurtosis > 0.5 THEN 'Heavy-tailed (leptokurtic)' ELSE 'Normal-tailed (mesokurtic)' END"""


@register("shape_labels", "WITH " + MOMENTS + f"""
SELECT variable, round(skewness, 4) AS skewness, round(kurtosis, 4) AS kurtosis,
       {SKEW_CASE} AS skew_label, {KURT_CASE} AS kurtosis_label FROM m""")
def q_shape(spark, sf):
    return rounded(P.shape(li(spark, sf), L_NUM), 4)


@register("coef_variation", "WITH " + MOMENTS + """
SELECT variable, round(mean, 4) AS mean, round(std, 4) AS std, round(std / nullif(mean, 0) * 100, 4) AS cv_pct
FROM m""")
def q_cv(spark, sf):
    return rounded(P.coef_variation(li(spark, sf), L_NUM), 4)


@register("comprehensive_stats", "WITH " + MOMENTS + """
SELECT variable, count, round(mean, 2) AS mean, round(median, 2) AS median, round(std, 2) AS std,
       round(min, 2) AS min, round(max, 2) AS max, round(max - min, 2) AS range, round(q3 - q1, 2) AS iqr,
       round(skewness, 2) AS skewness, round(kurtosis, 2) AS kurtosis,
       round(std / nullif(mean, 0) * 100, 2) AS cv_pct FROM m""")
def q_comprehensive(spark, sf):
    return P.comprehensive_stats(li(spark, sf), L_NUM, 2)


@register("time_span", """
SELECT min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts,
       CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000.0) AS INTEGER) AS span_days
FROM orders""")
def q_time_span(spark, sf):
    return P.time_span(table(spark, sf, "orders"), "o_orderdate")


@register("counts_by_year", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1""")
def q_by_year(spark, sf):
    return P.counts_by_year(table(spark, sf, "orders"), "o_orderdate")


@register("counts_by_month", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1""")
def q_by_month(spark, sf):
    return P.counts_by_month(table(spark, sf, "orders"), "o_orderdate")


@register("histogram50", "WITH " + LONG + """,
b AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM l GROUP BY variable),
x AS (SELECT l.variable, lo, hi, (hi - lo) / 50 AS w,
             CASE WHEN hi = lo THEN 1
                  ELSE least(50, CAST(floor((value - lo) / ((hi - lo) / 50)) AS INTEGER) + 1) END AS bin
      FROM l JOIN b USING (variable) WHERE value IS NOT NULL)
SELECT variable, bin, round(lo + (bin - 1) * w, 4) AS bin_lo, round(lo + bin * w, 4) AS bin_hi, count(*) AS n
FROM x GROUP BY variable, bin, lo, w""")
def q_histogram(spark, sf):
    return rounded(P.histogram(li(spark, sf), L_NUM, 50), 4)


@register("histogram_overlay", "WITH " + MOMENTS + """
SELECT variable, round(mean, 4) AS mean, round(median, 4) AS median, round(skewness, 4) AS skewness FROM m""")
def q_hist_overlay(spark, sf):
    return rounded(P.histogram_overlay(li(spark, sf), L_NUM), 4)


@register("box_stats", "WITH " + MOMENTS + """,
f AS (SELECT variable, q1, median, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower,
             q3 + 1.5 * (q3 - q1) AS upper FROM m),
o AS (SELECT variable, count(*) AS n, count(*) FILTER (WHERE value < lower OR value > upper) AS n_outliers
      FROM l JOIN f USING (variable) WHERE value IS NOT NULL GROUP BY variable)
SELECT variable, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(iqr, 4) AS iqr,
       round(lower, 4) AS lower, round(upper, 4) AS upper, n_outliers,
       round(n_outliers * 100.0 / n, 4) AS pct_outliers
FROM f JOIN o USING (variable)""")
def q_box(spark, sf):
    return rounded(P.box_stats(li(spark, sf), L_NUM), 4)


STATE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _state_sql():
    one = """SELECT '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max,
       true AS distinct_within_error, true AS quantiles_within_error FROM lineitem_m"""
    return f"WITH {LINEITEM_MISSING_SQL} " + " UNION ALL ".join(one.format(c=c) for c in STATE_COLS)


@register("profile_state_merged", _state_sql())
def q_profile_state(spark, sf):
    """lineitem profiled by line number, the states written, read again and merged; the sketches' estimates are held against
    the exact counts and ranks."""
    import uuid

    from riskweave.operators import profile_state as PS
    from riskweave.session import ensure_checkpoint_dir
    li = lineitem_with_missing(spark, sf).withColumn("half", F.col("l_linenumber") % 2)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/profile-state-{uuid.uuid4().hex}"
    for half in (0, 1):
        PS.profile_state(li.where(F.col("half") == half), STATE_COLS, ["half", "l_linenumber"]).write.mode("append").parquet(path)
    got = PS.read_state(PS.merge_state(PS.merge_state(spark.read.parquet(path), ["half"])))
    # exact: distinct values, and the share of values up to each estimated quantile
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    exact = li.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), clean(c).alias("v")) for c in STATE_COLS])).alias("p")).select("p.*").where("v is not null")
    ranks = exact.join(F.broadcast(got.select("variable", "q25", "q50", "q75")), "variable").groupBy("variable").agg(
        F.count_distinct("v").alias("exact_distinct"), F.count(F.lit(1)).alias("k"),
        *[F.count_if(F.col("v") < F.col(f"q{p}")).alias(f"below{p}") for p in (25, 50, 75)], *[F.count_if(F.col("v") <= F.col(f"q{p}")).alias(f"upto{p}") for p in (25, 50, 75)])
    near = F.lit(True)
    for p in (25, 50, 75):
        near = near & (F.col(f"below{p}") / F.col("k") <= p / 100 + 0.01) & (F.col(f"upto{p}") / F.col("k") >= p / 100 - 0.01)
    out = got.join(ranks, "variable").withColumns({"distinct_within_error": F.abs(F.col("n_distinct") - F.col("exact_distinct")) <= 0.04 * F.col("exact_distinct"), "quantiles_within_error": near})
    return rounded(out.select("variable", "n", "missing", "mean", "std", "min", "max", "distinct_within_error", "quantiles_within_error"), 4, only=["mean", "std"])
