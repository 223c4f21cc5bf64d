"""RFM queries: orders stand in for transactions (customer o_custkey, time
o_orderdate, amount o_totalprice); events for the fixed-snapshot variant."""

from pyspark.sql import functions as F

from riskweave.operators import rfm as R
from riskweave.operators.schema_ops import table_overview
from riskweave.plans.catalog import register, rounded, table

RFM_SQL = """
WITH s AS (SELECT max(o_orderdate) AS snap FROM orders)
SELECT o_custkey,
       CAST(floor((epoch_us(max(s.snap)) - epoch_us(max(o_orderdate))) / 86400000000.0) AS INTEGER) AS recency,
       count(*) AS frequency, round(sum(abs(o_totalprice)), 2) AS monetary
FROM orders, s WHERE o_custkey IS NOT NULL GROUP BY o_custkey
"""


def orders_rfm(spark, sf):
    return R.rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


@register("rfm_metrics", RFM_SQL)
def rfm_metrics(spark, sf):
    return rounded(orders_rfm(spark, sf), 2)


@register("rfm_fixed_snapshot", """
SELECT user_id,
       CAST(floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 86400000000.0) AS INTEGER) AS recency,
       count(*) AS frequency, round(sum(abs(value)), 2) AS monetary
FROM events WHERE user_id IS NOT NULL GROUP BY user_id
""")
def rfm_fixed_snapshot(spark, sf):
    ev = table(spark, sf, "events")
    return rounded(R.rfm(ev, "user_id", "ts", "value", snapshot="2024-02-01"), 2)


@register("rfm_summary", """
WITH r AS (""" + RFM_SQL + """),
l AS (UNPIVOT (SELECT CAST(recency AS DOUBLE) AS recency, CAST(frequency AS DOUBLE) AS frequency,
                      CAST(monetary AS DOUBLE) AS monetary FROM r)
      ON recency, frequency, monetary INTO NAME variable VALUE value)
SELECT variable, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
       round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS p25,
       round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75,
       round(max(value), 4) AS max
FROM l GROUP BY variable
""")
def rfm_summary(spark, sf):
    r = rounded(orders_rfm(spark, sf), 2)
    return rounded(R.rfm_summary(r), 4)


@register("table_overview", """
SELECT column_name AS column, CAST(ordinal_position AS INTEGER) AS position, data_type AS dtype,
       (SELECT count(*) FROM orders) AS rows, CAST(6 AS INTEGER) AS columns
FROM information_schema.columns WHERE table_name = 'orders'
""")
def q_table_overview(spark, sf):
    return table_overview(table(spark, sf, "orders")).drop("spark_type")


@register("dtype_frequency", """
SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
                      WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END AS dtype,
       count(*) AS columns
FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1""")
def q_dtype_frequency(spark, sf):
    from riskweave.operators.schema_ops import dtype_frequency
    return dtype_frequency(table(spark, sf, "lineitem"))
