"""Deterministic variants of driver tables used where a query needs
missing values or refunds (the generated tables have none)."""

from pyspark.sql import functions as F

from riskweave.plans.catalog import table

EVENTS_NULLS_SQL = """events_n AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE props END AS props
  FROM events)"""


def events_with_nulls(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 13 != 0, F.col("props")).alias("props"))


ORDERS_REFUNDS_SQL = """orders_r AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 10 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders)"""


def orders_with_refunds(spark, sf):
    o = table(spark, sf, "orders")
    return o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, -F.col("o_totalprice"))
                        .otherwise(F.col("o_totalprice")))


# lineitem with missing cells: NaN and NULL mixed (SQL sees both as NULL, which is what missing means here).
LINEITEM_MISSING_SQL = """lineitem_m AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
         CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 19 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
         CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax
  FROM lineitem)"""


def lineitem_with_missing(spark, sf):
    li = table(spark, sf, "lineitem")
    key, nan = F.col("l_orderkey"), F.lit(float("nan"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
        F.when(key % 17 == 0, nan).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(key % 11 == 0, nan).when(key % 19 == 0, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(key % 13 == 0, nan).otherwise(F.col("l_discount")).alias("l_discount"), "l_tax")


# orders with a third of the rows under a NULL priority, and amounts at both infinities
ORDERS_HOT_SQL = """orders_hot AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority,
         CASE WHEN o_orderkey % 101 = 0 THEN 'inf'::DOUBLE WHEN o_orderkey % 103 = 0 THEN '-inf'::DOUBLE
              WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END AS amount FROM orders)"""


def orders_hot(spark, sf):
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    amount = (F.when(key % 101 == 0, F.lit(float("inf"))).when(key % 103 == 0, F.lit(float("-inf")))
              .when(key % 5 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")))
    return o.select(F.when(key % 3 != 0, F.col("o_orderpriority")).alias("priority"), amount.alias("amount"))
