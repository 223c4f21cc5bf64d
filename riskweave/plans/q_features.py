"""Temporal and customer features."""

from pyspark.sql import functions as F

from riskweave.operators import features as FE
from riskweave.plans.catalog import register, rounded, table
from riskweave.plans.derived import EVENTS_NULLS_SQL, ORDERS_REFUNDS_SQL, events_with_nulls, orders_with_refunds


@register("temporal_features", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS transaction_hour, CAST(day(ts) AS INTEGER) AS transaction_day,
       CAST(month(ts) AS INTEGER) AS transaction_month, CAST(year(ts) AS INTEGER) AS transaction_year,
       CAST(isodow(ts) - 1 AS INTEGER) AS transaction_dayofweek, CAST(weekofyear(ts) AS INTEGER) AS transaction_week
FROM events""")
def q_temporal(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return FE.temporal_features(e, "ts").drop("ts")


AGG_SQL = """agg AS (
  SELECT o_custkey, coalesce(sum(o_totalprice), 0) AS total_transaction_amount,
         avg(o_totalprice) AS avg_transaction_amount, count(o_totalprice) AS transaction_count,
         coalesce(stddev_samp(o_totalprice), 0) AS std_transaction_amount,
         min(o_totalprice) AS min_transaction_amount, max(o_totalprice) AS max_transaction_amount,
         quantile_cont(o_totalprice, 0.5) AS median_transaction_amount
  FROM orders_r WHERE o_custkey IS NOT NULL GROUP BY o_custkey)"""
AGG_COLS = """round(total_transaction_amount, 2) AS total_transaction_amount,
       floor(round(total_transaction_amount, 2) / transaction_count * 10000 + 0.5) / 10000 AS avg_transaction_amount,
       transaction_count,
       round(std_transaction_amount, 4) AS std_transaction_amount,
       round(min_transaction_amount, 4) AS min_transaction_amount,
       round(max_transaction_amount, 4) AS max_transaction_amount,
       round(median_transaction_amount, 4) AS median_transaction_amount"""


def _round_aggs(df):
    # The mean of 2-decimal amounts is often an exact rounding tie; take it
    # from the exactly rounded total so both engines see the same double,
    # and round it with one explicit formula.
    df = rounded(df, 2, only=["total_transaction_amount"])
    avg = F.floor(F.col("total_transaction_amount") / F.col("transaction_count") * 10000 + 0.5) / 10000
    return rounded(df.withColumn("avg_transaction_amount", avg), 4)


@register("customer_aggregates", f"WITH {ORDERS_REFUNDS_SQL}, {AGG_SQL} SELECT o_custkey, {AGG_COLS} FROM agg")
def q_customer_aggs(spark, sf):
    o = orders_with_refunds(spark, sf)
    return _round_aggs(FE.customer_aggregates(o, "o_custkey", "o_totalprice"))


@register("customer_features_joined", f"""WITH {ORDERS_REFUNDS_SQL}, {AGG_SQL}
SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, {AGG_COLS}
FROM orders_r LEFT JOIN agg USING (o_custkey)""")
def q_joined(spark, sf):
    o = orders_with_refunds(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    return _round_aggs(FE.with_customer_aggregates(o, "o_custkey", "o_totalprice"))


@register("drop_null_rows", f"""WITH {EVENTS_NULLS_SQL}
SELECT event_id, user_id, event_type, value FROM events_n
WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL
  AND value IS NOT NULL AND NOT isnan(value)""")
def q_drop_nulls(spark, sf):
    e = events_with_nulls(spark, sf).select("event_id", "user_id", "event_type", "value")
    return FE.drop_null_rows(e)
