"""Data-quality queries: duplicates on a lineitem projection, missing values
on events with injected NULLs, outliers on lineitem's measures."""

from riskweave.operators import quality as Q
from riskweave.plans.catalog import register, rounded, table
from riskweave.plans.derived import EVENTS_NULLS_SQL, LINEITEM_MISSING_SQL, ORDERS_HOT_SQL, events_with_nulls, lineitem_with_missing, orders_hot
from riskweave.plans.q_profile import L_NUM, LONG

EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
EV_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
            "value": "double", "props": "string"}


def _miss_sql():
    parts = []
    for c in EV_COLS:
        cond = f"{c} IS NULL OR isnan({c})" if EV_TYPES[c] == "double" else f"{c} IS NULL"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {cond}) AS missing, "
                     f"'{EV_TYPES[c]}' AS dtype, count(*) AS rows FROM events_n")
    return "m AS (" + " UNION ALL ".join(parts) + ")"


MISS = f"WITH {EVENTS_NULLS_SQL}, {_miss_sql()}"


@register("duplicate_rows", """
WITH g AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem
           GROUP BY l_returnflag, l_linestatus, l_quantity)
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(n) AS BIGINT) AS total_rows,
       round(sum(n - 1) * 100.0 / sum(n), 4) AS duplicate_pct FROM g""")
def q_dups(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(Q.duplicate_rows(li, ["l_returnflag", "l_linestatus", "l_quantity"]), 4)


@register("missing_summary", MISS + """
SELECT "column", missing, round(missing * 100.0 / rows, 4) AS missing_pct, dtype FROM m WHERE missing > 0""")
def q_missing(spark, sf):
    return rounded(Q.missing_summary(events_with_nulls(spark, sf)), 4)


@register("missing_total", MISS + """
SELECT CAST(sum(missing) AS BIGINT) AS missing_cells, round(sum(missing) * 100.0 / (max(rows) * 6), 4) AS missing_pct
FROM m""")
def q_missing_total(spark, sf):
    return rounded(Q.missing_total(events_with_nulls(spark, sf)), 4)


@register("missing_per_row", f"""WITH {EVENTS_NULLS_SQL}
SELECT CAST((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT
            + (value IS NULL OR isnan(value))::INT + (props IS NULL)::INT AS INTEGER) AS missing_count,
       count(*) AS rows
FROM events_n GROUP BY 1""")
def q_missing_per_row(spark, sf):
    return Q.missing_per_row(events_with_nulls(spark, sf))


@register("rows_with_missing", f"""WITH {EVENTS_NULLS_SQL}
SELECT count(*) FILTER (WHERE event_type IS NULL OR value IS NULL OR props IS NULL OR event_id IS NULL
                         OR ts IS NULL OR user_id IS NULL) AS rows_affected,
       count(*) AS rows,
       round(count(*) FILTER (WHERE event_type IS NULL OR value IS NULL OR props IS NULL OR event_id IS NULL
                               OR ts IS NULL OR user_id IS NULL) * 100.0 / count(*), 4) AS pct
FROM events_n""")
def q_rows_missing(spark, sf):
    return rounded(Q.rows_with_missing(events_with_nulls(spark, sf)), 4)


@register("missing_by_type", MISS + """
SELECT dtype, count(*) AS columns, CAST(sum(missing) AS BIGINT) AS missing,
       round(sum(missing) * 100.0 / (max(rows) * count(*)), 4) AS missing_pct FROM m GROUP BY dtype""")
def q_missing_type(spark, sf):
    return rounded(Q.missing_by_type(events_with_nulls(spark, sf)), 4)


@register("impute_advice", MISS + """,
p AS (SELECT "column", missing * 100.0 / rows AS pct, dtype, dtype IN ('bigint', 'double') AS num FROM m WHERE missing > 0)
SELECT "column", round(pct, 4) AS missing_pct, dtype,
  CASE WHEN pct > 50 THEN 'Consider removing column or investigate data collection issue'
       WHEN pct > 20 THEN CASE WHEN num THEN 'Median imputation (robust to outliers) or advanced methods (KNN, MICE)'
                               ELSE 'Mode imputation or create ''Missing'' category' END
       WHEN pct > 5 THEN CASE WHEN num THEN 'Mean/Median imputation or forward/backward fill for time series'
                              ELSE 'Mode imputation or forward/backward fill' END
       ELSE CASE WHEN num THEN 'Mean/Median imputation (simple and effective)'
                 ELSE 'Mode imputation (simple and effective)' END END AS strategy
FROM p""")
def q_impute_advice(spark, sf):
    return rounded(Q.impute_advice(events_with_nulls(spark, sf)), 4)


BOUNDS = LONG + """,
b AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY variable),
f AS (SELECT variable, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b),
io AS (SELECT variable, count(*) AS rows,
              count(*) FILTER (WHERE value < lower OR value > upper) AS n_outliers,
              min(value) FILTER (WHERE value < lower OR value > upper) AS min_outlier,
              max(value) FILTER (WHERE value < lower OR value > upper) AS max_outlier,
              avg(value) FILTER (WHERE value < lower OR value > upper) AS mean_outlier
       FROM l JOIN f USING (variable) GROUP BY variable),
iq AS (SELECT f.*, n_outliers, n_outliers * 100.0 / rows AS pct_outliers, min_outlier, max_outlier, mean_outlier
       FROM f JOIN io USING (variable)),
ms AS (SELECT variable, avg(value) AS mean, stddev_pop(value) AS sd FROM l GROUP BY variable),
zo AS (SELECT variable, count(*) AS n,
              count(*) FILTER (WHERE abs((value - mean) / nullif(sd, 0)) > 3) AS n_outliers,
              min(value) FILTER (WHERE abs((value - mean) / nullif(sd, 0)) > 3) AS min_outlier,
              max(value) FILTER (WHERE abs((value - mean) / nullif(sd, 0)) > 3) AS max_outlier
       FROM l JOIN ms USING (variable) WHERE value IS NOT NULL GROUP BY variable)"""


@register("iqr_outliers", "WITH " + BOUNDS + """
SELECT variable, round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr, round(lower, 4) AS lower,
       round(upper, 4) AS upper, n_outliers, round(pct_outliers, 4) AS pct_outliers,
       round(min_outlier, 4) AS min_outlier, round(max_outlier, 4) AS max_outlier,
       round(mean_outlier, 4) AS mean_outlier FROM iq""")
def q_iqr(spark, sf):
    return rounded(Q.iqr_outliers(table(spark, sf, "lineitem"), L_NUM), 4)


@register("zscore_outliers", "WITH " + BOUNDS + """
SELECT variable, CAST(3.0 AS DOUBLE) AS threshold, n_outliers, round(n_outliers * 100.0 / n, 4) AS pct_outliers,
       round(min_outlier, 4) AS min_outlier, round(max_outlier, 4) AS max_outlier FROM zo""")
def q_z(spark, sf):
    return rounded(Q.zscore_outliers(table(spark, sf, "lineitem"), L_NUM), 4)


@register("outlier_compare", "WITH " + BOUNDS + """
SELECT variable, iq.n_outliers AS iqr_count, round(iq.pct_outliers, 4) AS iqr_pct, zo.n_outliers AS z_count,
       round(zo.n_outliers * 100.0 / zo.n, 4) AS z_pct, iq.n_outliers - zo.n_outliers AS difference
FROM iq JOIN zo USING (variable)""")
def q_compare(spark, sf):
    return rounded(Q.outlier_compare(table(spark, sf, "lineitem"), L_NUM), 4)


@register("high_outlier_features", "WITH " + BOUNDS + """
SELECT variable, n_outliers, round(pct_outliers, 4) AS pct_outliers FROM iq WHERE pct_outliers > 5""")
def q_high(spark, sf):
    return rounded(Q.high_outlier_features(table(spark, sf, "lineitem"), L_NUM), 4)


@register("outlier_advice", "WITH " + BOUNDS + """
SELECT variable, round(pct_outliers, 2) AS pct_outliers,
  CASE WHEN round(pct_outliers, 2) > 20 THEN 'Investigate data quality - high outlier percentage suggests data issues'
       WHEN round(pct_outliers, 2) > 10 THEN 'Consider capping/winsorizing or robust statistical methods'
       WHEN round(pct_outliers, 2) > 5 THEN 'Consider capping at bounds or using robust methods (median, IQR-based)'
       WHEN round(pct_outliers, 2) > 1 THEN 'May keep if legitimate values, or cap at bounds'
       ELSE 'Likely legitimate outliers - keep or investigate individually' END AS treatment FROM iq""")
def q_advice(spark, sf):
    return Q.outlier_advice(table(spark, sf, "lineitem"), L_NUM)


@register("duplicate_sample", """
WITH g AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem
           GROUP BY l_returnflag, l_linestatus, l_quantity HAVING count(*) > 1
           ORDER BY l_returnflag, l_linestatus, l_quantity LIMIT 10)
SELECT l.l_returnflag, l.l_linestatus, l.l_quantity FROM lineitem l
WHERE (l.l_returnflag, l.l_linestatus, l.l_quantity) IN (SELECT * FROM g)
ORDER BY 1, 2, 3 LIMIT 10""")
def q_dup_sample(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return Q.duplicate_sample(li, ["l_returnflag", "l_linestatus", "l_quantity"], 10, 10)


@register("missing_matrix_sample", f"""WITH {EVENTS_NULLS_SQL},
s AS (SELECT * FROM events_n ORDER BY md5('42|' || event_id), event_id LIMIT 1000)
SELECT event_id, CAST(ts IS NULL AS INTEGER) AS ts, CAST(user_id IS NULL AS INTEGER) AS user_id,
       CAST(event_type IS NULL AS INTEGER) AS event_type, CAST(value IS NULL AS INTEGER) AS value,
       CAST(props IS NULL AS INTEGER) AS props FROM s""")
def q_missing_matrix(spark, sf):
    return Q.missing_matrix_sample(events_with_nulls(spark, sf), ["event_id"], None, 1000, 42)


# --------------------------------------------------------------------------- the same on a table with NaN and NULL cells
LONG_M = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM lineitem_m" for c in L_NUM) + ")"
BOUNDS_M = f"WITH {LINEITEM_MISSING_SQL}, " + BOUNDS.replace(LONG, LONG_M)


@register("iqr_outliers_missing", BOUNDS_M + """
SELECT variable, round(lower, 4) AS lower, round(upper, 4) AS upper, n_outliers, round(pct_outliers, 4) AS pct_outliers,
       round(min_outlier, 4) AS min_outlier, round(max_outlier, 4) AS max_outlier, round(mean_outlier, 4) AS mean_outlier FROM iq""")
def q_iqr_missing(spark, sf):
    out = Q.iqr_outliers(lineitem_with_missing(spark, sf), L_NUM)
    return rounded(out.select("variable", "lower", "upper", "n_outliers", "pct_outliers", "min_outlier", "max_outlier", "mean_outlier"), 4)


@register("outlier_compare_missing", BOUNDS_M + """
SELECT variable, iq.n_outliers AS iqr_count, round(iq.pct_outliers, 4) AS iqr_pct, zo.n_outliers AS z_count,
       round(zo.n_outliers * 100.0 / zo.n, 4) AS z_pct, iq.n_outliers - zo.n_outliers AS difference
FROM iq JOIN zo USING (variable)""")
def q_compare_missing(spark, sf):
    return rounded(Q.outlier_compare(lineitem_with_missing(spark, sf), L_NUM), 4)


@register("quantiles_hot_groups", f"""WITH {ORDERS_HOT_SQL}
SELECT priority, round(quantile_cont(amount, 0.1), 4) AS p10, round(quantile_cont(amount, 0.5), 4) AS p50,
       round(quantile_cont(amount, 0.9), 4) AS p90 FROM orders_hot GROUP BY priority""")
def q_quantiles_hot(spark, sf):
    """A NULL group with a third of the rows and infinite values; the size from which a group counts as hot is set low,
    so that the radix selection runs at every table size."""
    from riskweave.functions.quantiles import quantiles
    return rounded(quantiles(orders_hot(spark, sf), ["priority"], "amount", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, hot_rows=100, final_rows=50), 4)
