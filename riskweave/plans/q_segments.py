"""Segment statistics and the proxy label on the orders RFM table.

The SQL-checked queries use a deterministic segment column (recency bands:
<= 90 days, <= 365 days, older) so both engines agree; K-Means queries are
checked on row counts (cluster ids of an iterative fit are not comparable).
"""

from pyspark.sql import functions as F

from riskweave.operators import segments as SG
from riskweave.operators.sampling import head_per_group
from riskweave.plans.catalog import register, rounded, table
from riskweave.plans.q_rfm import RFM_SQL, orders_rfm

RC = "WITH r AS (" + RFM_SQL + """),
rc AS (SELECT *, CASE WHEN recency <= 90 THEN 0 WHEN recency <= 365 THEN 1 ELSE 2 END AS cluster FROM r)"""


def rfm_banded(spark, sf):
    r = orders_rfm(spark, sf)
    r = r.withColumn("monetary", F.round("monetary", 2))
    band = F.when(F.col("recency") <= 90, 0).when(F.col("recency") <= 365, 1).otherwise(2)
    return r.withColumn("cluster", band.cast("int"))


def _stat_sql(full):
    cols = []
    for f in ("recency", "frequency", "monetary"):
        cols.append(f"round(avg({f}), 4) AS mean_{f}, round(quantile_cont({f}, 0.5), 4) AS median_{f}")
        if full:
            cols.append(f"round(stddev_samp({f}), 4) AS std_{f}, round(CAST(min({f}) AS DOUBLE), 4) AS min_{f}, "
                        f"round(CAST(max({f}) AS DOUBLE), 4) AS max_{f}")
    return ", ".join(cols)


@register("cluster_stats", RC + f"""
SELECT CAST(cluster AS INTEGER) AS cluster_id, count(*) AS n_customers,
       round(count(*) * 100.0 / (SELECT count(*) FROM rc), 4) AS pct_customers, {_stat_sql(True)}
FROM rc GROUP BY cluster""")
def q_cluster_stats(spark, sf):
    t = SG.cluster_stats(rfm_banded(spark, sf), k=3, full=True)
    return rounded(t.withColumns({c: F.col(c).cast("double") for c in t.columns if c.startswith(("min_", "max_"))}), 4)


SCORES = RC + """,
st AS (SELECT cluster AS cluster_id, avg(recency) AS mean_recency, avg(frequency) AS mean_frequency,
              avg(monetary) AS mean_monetary FROM rc GROUP BY cluster),
mm AS (SELECT min(mean_recency) AS rl, max(mean_recency) AS rh, min(mean_frequency) AS fl, max(mean_frequency) AS fh,
              min(mean_monetary) AS ml, max(mean_monetary) AS mh FROM st),
sc AS (SELECT cluster_id, mean_recency, mean_frequency, mean_monetary,
              CASE WHEN rh > rl THEN (mean_recency - rl) / (rh - rl) ELSE 0.5 END AS normalized_recency,
              CASE WHEN fh > fl THEN 1 - (mean_frequency - fl) / (fh - fl) ELSE 0.5 END AS normalized_frequency,
              CASE WHEN mh > ml THEN 1 - (mean_monetary - ml) / (mh - ml) ELSE 0.5 END AS normalized_monetary
       FROM st, mm),
es AS (SELECT *, normalized_recency + normalized_frequency + normalized_monetary AS engagement_score FROM sc),
w AS (SELECT cluster_id AS worst FROM es ORDER BY engagement_score DESC, cluster_id LIMIT 1)"""


def _scores(spark, sf):
    return SG.engagement_scores(SG.cluster_stats(rfm_banded(spark, sf), full=False))


@register("engagement_score", SCORES + """
SELECT CAST(cluster_id AS INTEGER) AS cluster_id, round(mean_recency, 6) AS mean_recency,
       round(mean_frequency, 6) AS mean_frequency, round(mean_monetary, 6) AS mean_monetary,
       round(normalized_recency, 6) AS normalized_recency, round(normalized_frequency, 6) AS normalized_frequency,
       round(normalized_monetary, 6) AS normalized_monetary, round(engagement_score, 6) AS engagement_score FROM es""")
def q_engagement(spark, sf):
    s = _scores(spark, sf)
    return rounded(s.select("cluster_id", "mean_recency", "mean_frequency", "mean_monetary", "normalized_recency",
                            "normalized_frequency", "normalized_monetary", "engagement_score"), 6)


@register("high_risk_summary", SCORES + """
SELECT CAST(cluster_id AS INTEGER) AS cluster_id, round(engagement_score, 6) AS engagement_score,
       cluster_id = worst AS is_high_risk FROM es, w""")
def q_hr_summary(spark, sf):
    s = SG.high_risk_summary(_scores(spark, sf))
    return rounded(s.select("cluster_id", "engagement_score", "is_high_risk"), 6)


@register("high_risk_label", SCORES + """
SELECT o_custkey, CAST(cluster AS INTEGER) AS cluster, CAST(cluster = worst AS INTEGER) AS is_high_risk FROM rc, w""")
def q_hr_label(spark, sf):
    r = rfm_banded(spark, sf)
    worst = SG.high_risk_cluster(SG.engagement_scores(SG.cluster_stats(r, full=False)))
    return SG.label_customers(r, worst).select("o_custkey", "cluster", "is_high_risk")


def _labelled_orders(spark, sf):
    r = rfm_banded(spark, sf)
    out = SG.create_high_risk_target(r, table(spark, sf, "orders"), "o_custkey")
    return out


@register("label_transactions", SCORES + """,
lab AS (SELECT o_custkey, CAST(cluster = worst AS INTEGER) AS is_high_risk, CAST(cluster AS INTEGER) AS cluster FROM rc, w)
SELECT o_orderkey, o_custkey, coalesce(is_high_risk, 0) AS is_high_risk, cluster FROM orders LEFT JOIN lab USING (o_custkey)""")
def q_label_tx(spark, sf):
    return _labelled_orders(spark, sf)["transactions"].select("o_orderkey", "o_custkey", "is_high_risk", "cluster")


@register("target_distribution", SCORES + """,
lab AS (SELECT CAST(cluster = worst AS INTEGER) AS is_high_risk FROM rc, w)
SELECT is_high_risk, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM lab), 6) AS pct FROM lab GROUP BY 1""")
def q_target_dist(spark, sf):
    return rounded(_labelled_orders(spark, sf)["distribution"], 6)


@register("cluster_distribution", RC + """
SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM rc), 6) AS pct
FROM rc GROUP BY 1""")
def q_cluster_dist(spark, sf):
    return rounded(SG.distribution(rfm_banded(spark, sf), "cluster"), 6)


@register("top_per_group", RC + """
SELECT CAST(cluster AS INTEGER) AS cluster, o_custkey, recency, frequency, monetary FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY o_custkey) AS rn FROM rc) WHERE rn <= 5""")
def q_top_per_group(spark, sf):
    r = rfm_banded(spark, sf)
    return head_per_group(r, ["cluster"], ["o_custkey"], 5).select("cluster", "o_custkey", "recency", "frequency",
                                                                     "monetary")


def _segmenter(spark, sf):
    r = orders_rfm(spark, sf)
    return r, SG.CustomerSegmenter(3, "standardize", 42).fit(r)


@register("kmeans_segments")
def q_kmeans(spark, sf):
    r, seg = _segmenter(spark, sf)
    return seg.predict(r).select("o_custkey", "recency", "frequency", "monetary", "cluster")


@register("kmeans_centroids")
def q_centroids(spark, sf):
    _, seg = _segmenter(spark, sf)
    return seg.centroids()


@register("kmeans_proxy_label")
def q_kmeans_label(spark, sf):
    """The reference flow end to end: RFM -> K-Means -> worst segment -> label."""
    r, seg = _segmenter(spark, sf)
    out = SG.create_high_risk_target(seg.predict(r), None, "o_custkey")
    return out["customers"].select("o_custkey", "cluster", "is_high_risk")


# Segment centres in the features' own units (recency, frequency, monetary).
CENTRES = [[30.0, 12.0, 2000000.0], [200.0, 8.0, 1200000.0], [700.0, 3.0, 300000.0]]


def _cost_sql(i):
    r, f, m = CENTRES[i]
    return f"(recency - {r}) * (recency - {r}) + (frequency - {f}) * (frequency - {f}) + (monetary - {m}) * (monetary - {m})"


@register("kmeans_assign", "WITH r AS (" + RFM_SQL + f"""),
d AS (SELECT o_custkey, {_cost_sql(0)} AS c0, {_cost_sql(1)} AS c1, {_cost_sql(2)} AS c2 FROM r)
SELECT o_custkey, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS cluster, round(least(c0, c1, c2), 0) AS cost FROM d""")
def q_assign(spark, sf):
    """K2 with given centres: each customer's nearest centre and its squared distance."""
    r = orders_rfm(spark, sf).withColumn("monetary", F.round("monetary", 2))
    return rounded(SG.assign_nearest(r, CENTRES).select("o_custkey", "cluster", "cost"), 0)


def _steps_sql(n):
    """n moves of the centres, each from the assignment to those before."""
    steps = ["c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(str(v) + '::DOUBLE' for v in c)})" for i, c in enumerate(STARTS)) + ") t(cluster, a, b, c))"]
    for k in range(n + 1):
        steps.append(f"""n{k} AS (SELECT o_custkey, x, y, z, min({{'d': (x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c), 'cluster': cluster}}) AS best FROM p, c{k} GROUP BY o_custkey, x, y, z)""")
        if k < n:
            steps.append(f"c{k + 1} AS (SELECT best.cluster AS cluster, avg(x) AS a, avg(y) AS b, avg(z) AS c FROM n{k} GROUP BY best.cluster)")
    return ", ".join(steps)


# Starting centres of (days since the last order / 100, orders, spent in millions).
STARTS, MOVES = [[0.5, 14.0, 2.0], [2.0, 8.0, 1.0], [8.0, 3.0, 0.3]], 4


@register("kmeans_steps", "WITH r AS (" + RFM_SQL + f"""), p AS (SELECT o_custkey, recency / 100.0 AS x, CAST(frequency AS DOUBLE) AS y, monetary / 1000000.0 AS z FROM r),
{_steps_sql(MOVES)}
SELECT CAST(c.cluster AS INTEGER) AS cluster, round(c.a, 6) AS a, round(c.b, 6) AS b, round(c.c, 6) AS c, count(o_custkey) AS n
FROM c{MOVES} c LEFT JOIN n{MOVES} n ON n.best.cluster = c.cluster GROUP BY ALL""")
def q_kmeans_steps(spark, sf):
    """K-Means from given centres: the centres after four moves, and the customers nearest to each."""
    r = orders_rfm(spark, sf).withColumn("monetary", F.round("monetary", 2)).select((F.col("recency") / 100).alias("x"), F.col("frequency").cast("double").alias("y"), (F.col("monetary") / 1000000).alias("z"))
    got = SG.lloyd(r, ["x", "y", "z"], [STARTS], MOVES, tol=-1.0)[0]
    rows = [(i, *map(float, c), n) for i, (c, n) in enumerate(zip(got["centres"], got["sizes"], strict=True))]
    return rounded(spark.createDataFrame(rows, "cluster int, a double, b double, c double, n long"), 6)
