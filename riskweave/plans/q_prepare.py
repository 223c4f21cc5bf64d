"""Imputation, encoding, scaling and the full feature table."""

from pyspark.sql import functions as F

from riskweave.operators import prepare as PR
from riskweave.operators.processor import FeatureProcessor
from riskweave.plans.catalog import register, rounded, table
from riskweave.plans.derived import EVENTS_NULLS_SQL, events_with_nulls
from riskweave.plans.q_profile import L_NUM
from riskweave.sources.schemas import ID_RULES


def _impute(spark, sf, method):
    e = events_with_nulls(spark, sf).select("event_id", "value", "event_type")
    p = PR.fit_imputer(e, ["value"], ["event_type"], method)
    return rounded(PR.apply_imputer(e, p), 6)


MODE_T = """mt AS (SELECT event_type AS t FROM events_n WHERE event_type IS NOT NULL
                GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)"""
IMPUTE_SQL = f"""WITH {EVENTS_NULLS_SQL}, {MODE_T}, f AS (SELECT {{fill}} AS v FROM events_n {{where}})
SELECT event_id, round(coalesce(value, f.v), 6) AS value, coalesce(event_type, mt.t) AS event_type
FROM events_n, f, mt"""


@register("impute_mean", IMPUTE_SQL.format(fill="avg(value)", where=""))
def q_impute_mean(spark, sf):
    return _impute(spark, sf, "mean")


@register("impute_median", IMPUTE_SQL.format(fill="quantile_cont(value, 0.5)", where=""))
def q_impute_median(spark, sf):
    return _impute(spark, sf, "median")


@register("impute_mode", IMPUTE_SQL.format(
    fill="value", where="WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1"))
def q_impute_mode(spark, sf):
    return _impute(spark, sf, "mode")


ORD_CATS = {"o_orderstatus": ["F", "O", "P"],
            "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}


def _onehot_sql():
    cols = []
    for c, vals in ORD_CATS.items():
        for v in vals[1:]:
            cols.append(f"""CAST(CASE WHEN {c} IS NULL THEN NULL ELSE ({c} = '{v}') END AS DOUBLE) AS "{c}_{v}" """)
    return ", ".join(cols)


@register("onehot_drop_first", f"SELECT o_orderkey, {_onehot_sql()} FROM orders")
def q_onehot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", *ORD_CATS)
    return PR.onehot(o, list(ORD_CATS))


@register("label_encode", """
WITH c AS (SELECT 'o_orderstatus' AS variable, o_orderstatus AS value FROM orders
           UNION SELECT 'o_orderpriority', o_orderpriority FROM orders),
k AS (SELECT variable, value, CAST(row_number() OVER (PARTITION BY variable ORDER BY value) - 1 AS INTEGER) AS code
      FROM c WHERE value IS NOT NULL)
SELECT o_orderkey, s.code AS o_orderstatus, p.code AS o_orderpriority
FROM orders
LEFT JOIN (SELECT * FROM k WHERE variable = 'o_orderstatus') s ON orders.o_orderstatus = s.value
LEFT JOIN (SELECT * FROM k WHERE variable = 'o_orderpriority') p ON orders.o_orderpriority = p.value""")
def q_label(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", *ORD_CATS)
    return PR.label_encode(o, list(ORD_CATS))


@register("label_encode_wide", """
WITH k AS (SELECT c_name, CAST(row_number() OVER (ORDER BY c_name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_name FROM customer))
SELECT c_custkey, code AS c_name FROM customer JOIN k USING (c_name)""")
def q_label_wide(spark, sf):
    """As many categories as rows: codes are a distributed rank, joined back."""
    return PR.label_encode(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name"])


def _scale_sql(center, spread):
    params = ", ".join(f"{center.format(c=c)} AS {c}__c, {spread.format(c=c)} AS {c}__s" for c in L_NUM)
    body = ", ".join(f"round(({c} - {c}__c) / CASE WHEN {c}__s = 0 THEN 1 ELSE {c}__s END, 6) AS {c}" for c in L_NUM)
    return f"WITH p AS (SELECT {params} FROM lineitem) SELECT l_orderkey, l_linenumber, {body} FROM lineitem, p"


def _scaled(spark, sf, method):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *L_NUM)
    return rounded(PR.scale(li, L_NUM, method), 6)


@register("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def q_scale_std(spark, sf):
    return _scaled(spark, sf, "standardize")


@register("scale_minmax", _scale_sql("min({c})", "max({c}) - min({c})"))
def q_scale_minmax(spark, sf):
    return _scaled(spark, sf, "normalize")


@register("scale_robust", _scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def q_scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


@register("scale_none", f"SELECT l_orderkey, l_linenumber, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in L_NUM)} FROM lineitem")
def q_scale_none(spark, sf):
    return _scaled(spark, sf, "none")


def _inverse_sql():
    back = lambda c: f"CASE WHEN {c}__s = 0 THEN 1 ELSE {c}__s END"
    params = ", ".join(f"avg({c}) AS {c}__c, stddev_pop({c}) AS {c}__s" for c in L_NUM)
    means = ", ".join(f"round(avg(({c} - {c}__c) / {back(c)}) * any_value({back(c)}) + any_value({c}__c), 4) AS {c}" for c in L_NUM)
    return f"WITH p AS (SELECT {params} FROM lineitem) SELECT l_returnflag, {means} FROM lineitem, p GROUP BY l_returnflag"


@register("scale_inverse", _inverse_sql())
def q_scale_inverse(spark, sf):
    """centres of groups in scaled space, brought back to the columns' own units."""
    li = table(spark, sf, "lineitem").select("l_returnflag", *L_NUM)
    params = PR.fit_scaler(li, L_NUM, "standardize")
    centres = PR.apply_scaler(li, params).groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in L_NUM])
    return rounded(PR.apply_scaler(centres, params, inverse=True), 4)


# --------------------------------------------------------------------------- full feature table
TEMPORAL_SQL = {"transaction_hour": "hour(o_orderdate)", "transaction_day": "day(o_orderdate)",
                "transaction_month": "month(o_orderdate)", "transaction_year": "year(o_orderdate)",
                "transaction_dayofweek": "isodow(o_orderdate) - 1", "transaction_week": "weekofyear(o_orderdate)"}
AGGS_SQL = {"total_transaction_amount": "coalesce(sum(o_totalprice), 0)",
            "avg_transaction_amount": "avg(o_totalprice)", "transaction_count": "count(o_totalprice)",
            "std_transaction_amount": "coalesce(stddev_samp(o_totalprice), 0)",
            "min_transaction_amount": "min(o_totalprice)", "max_transaction_amount": "max(o_totalprice)",
            "median_transaction_amount": "quantile_cont(o_totalprice, 0.5)"}
FT_NUM = ["o_totalprice", *TEMPORAL_SQL, *AGGS_SQL]


def _feature_sql():
    temporal = ", ".join(f"CAST({e} AS INTEGER) AS {n}" for n, e in TEMPORAL_SQL.items())
    aggs = ", ".join(f"{e} AS {n}" for n, e in AGGS_SQL.items())
    params = ", ".join(f"avg({c}) AS {c}__c, stddev_pop({c}) AS {c}__s" for c in FT_NUM)
    scaled = ", ".join(f"round(({c} - {c}__c) / CASE WHEN {c}__s = 0 THEN 1 ELSE {c}__s END, 6) AS {c}" for c in FT_NUM)
    return f"""WITH base AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, {temporal}
                    FROM orders),
agg AS (SELECT o_custkey, {aggs} FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
b2 AS (SELECT * FROM base LEFT JOIN agg USING (o_custkey)),
p AS (SELECT {params} FROM b2)
SELECT o_orderkey, {scaled}, {_onehot_sql()} FROM b2, p"""


key_rule = ID_RULES["key_or_id"]


def feature_processor():
    return FeatureProcessor("o_custkey", "o_orderdate", "o_totalprice", None, imputation="median",
                            encoding="onehot", scaling="standardize", id_rule="key_or_id", keep_cols=("o_orderkey",))


@register("feature_table", _feature_sql())
def q_feature_table(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(feature_processor().fit_transform(o), 6)


@register("knn_impute", f"""WITH {EVENTS_NULLS_SQL},
x AS (SELECT event_id, CAST(user_id AS DOUBLE) AS u, CAST(hour(ts) AS DOUBLE) AS h, value FROM events_n),
r AS (SELECT * FROM x WHERE value IS NULL OR isnan(value)),
d AS (SELECT * FROM x WHERE value IS NOT NULL AND NOT isnan(value)),
p AS (SELECT r.event_id AS rid, d.event_id AS did, d.value AS v,
             sqrt(3.0 / 2 * ((r.u - d.u) * (r.u - d.u) + (r.h - d.h) * (r.h - d.h))) AS dist FROM r, d),
k AS (SELECT rid, v, row_number() OVER (PARTITION BY rid ORDER BY dist, did) AS rn FROM p),
f AS (SELECT rid, avg(v) AS fill FROM k WHERE rn <= 5 GROUP BY rid)
SELECT x.event_id, round(coalesce(x.value, f.fill), 6) AS value FROM x LEFT JOIN f ON f.rid = x.event_id""")
def q_knn(spark, sf):
    from riskweave.operators.knn import knn_impute
    e = events_with_nulls(spark, sf).select("event_id", "user_id", F.hour("ts").alias("hour"), "value")
    return rounded(knn_impute(e, ["user_id", "hour", "value"], "event_id", 5).select("event_id", "value"), 6)


@register("knn_transform", f"""WITH {EVENTS_NULLS_SQL},
x AS (SELECT event_id, CAST(user_id AS DOUBLE) AS u, CAST(hour(ts) AS DOUBLE) AS h, value FROM events_n),
r AS (SELECT * FROM x WHERE event_id % 2 = 1 AND (value IS NULL OR isnan(value))),
d AS (SELECT * FROM x WHERE event_id % 2 = 0 AND value IS NOT NULL AND NOT isnan(value)),
p AS (SELECT r.event_id AS rid, d.event_id AS did, d.value AS v,
             sqrt(3.0 / 2 * ((r.u - d.u) * (r.u - d.u) + (r.h - d.h) * (r.h - d.h))) AS dist FROM r, d),
k AS (SELECT rid, v, row_number() OVER (PARTITION BY rid ORDER BY dist, did) AS rn FROM p),
f AS (SELECT rid, avg(v) AS fill FROM k WHERE rn <= 5 GROUP BY rid)
SELECT x.event_id, round(coalesce(x.value, f.fill), 6) AS value FROM x LEFT JOIN f ON f.rid = x.event_id WHERE x.event_id % 2 = 1""")
def q_knn_transform(spark, sf):
    """Donors fitted on the even events fill the odd ones, by way of a saved and reloaded index."""
    import uuid

    from riskweave.operators.knn import KnnIndex
    from riskweave.session import ensure_checkpoint_dir
    e = events_with_nulls(spark, sf).select("event_id", "user_id", F.hour("ts").alias("hour"), "value")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/knn-index-{uuid.uuid4().hex}"
    KnnIndex.fit(e.where("event_id % 2 = 0"), ["user_id", "hour", "value"], "event_id").save(path)
    return rounded(KnnIndex.load(spark, path).impute(e.where("event_id % 2 = 1"), "event_id", 5).select("event_id", "value"), 6)


@register("feature_table_woe")
def q_feature_table_woe(spark, sf):
    """The processor with its WoE step: target 'order status F', WoE columns for
    the first five numeric features with more than ten distinct values."""
    o = table(spark, sf, "orders").withColumn("is_f", (F.col("o_orderstatus") == "F").cast("int"))
    fp = FeatureProcessor("o_custkey", "o_orderdate", "o_totalprice", "is_f", imputation="median",
                          encoding="onehot", scaling="standardize", id_rule="key_or_id", keep_cols=("o_orderkey",),
                          use_woe=True)
    return rounded(fp.fit_transform(o), 6)
