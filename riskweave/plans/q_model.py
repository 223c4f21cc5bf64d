"""Splits, metrics, models, tuning, run tracking and scoring.

The modelling table is the orders feature table (F11) with the proxy label
of the recency-band segments (A10/J2/J3) attached by order key.
"""

import uuid

from pyspark.sql import functions as F

from riskweave.operators import metrics as ME
from riskweave.operators import models as MO
from riskweave.operators import runs as RU
from riskweave.operators import scoring as SC
from riskweave.operators import segments as SG
from riskweave.operators import splits as SP
from riskweave.operators.sampling import head, seeded_sample
from riskweave.plans.catalog import register, rounded, table
from riskweave.plans.derived import LINEITEM_MISSING_SQL, lineitem_with_missing
from riskweave.plans.q_prepare import feature_processor
from riskweave.plans.q_segments import SCORES, rfm_banded
from riskweave.session import ensure_checkpoint_dir
from riskweave.sources.tables import stored

LABEL = "is_high_risk"


def labelled_features(spark, sf):
    o = table(spark, sf, "orders")
    feats = feature_processor().fit_transform(o)
    lab = SG.create_high_risk_target(rfm_banded(spark, sf), o, "o_custkey")["transactions"]
    return stored(SG.attach_target(feats, lab, "o_orderkey", LABEL))


def feature_cols(df):
    return [c for c in df.columns if c not in ("o_orderkey", LABEL)]


# --------------------------------------------------------------------------- splits
def status_labelled(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))


QUOTAS = """
WITH o AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders),
c AS (SELECT y, count(*) AS n FROM o GROUP BY y),
t AS (SELECT sum(n) AS tot, CAST(ceil(sum(n) * 0.2) AS BIGINT) AS nt FROM c),
r AS (SELECT y, n, n * nt / tot AS raw, floor(n * nt / tot) AS base FROM c, t),
k AS (SELECT y, n, base, row_number() OVER (ORDER BY raw - base DESC, CAST(y AS VARCHAR)) AS rk,
             (SELECT nt FROM t) - sum(base) OVER () AS rest FROM r),
q AS (SELECT y, n, CAST(base + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS nt FROM k),
v1 AS (SELECT y, n - nt AS rem, nt FROM q),
vt AS (SELECT sum(rem) AS tr, CAST(ceil(sum(rem) * 0.1 / 0.8) AS BIGINT) AS nv FROM v1),
vr AS (SELECT y, rem, nt, rem * nv / tr AS raw, floor(rem * nv / tr) AS base FROM v1, vt),
vk AS (SELECT *, row_number() OVER (ORDER BY raw - base DESC, CAST(y AS VARCHAR)) AS rk,
              (SELECT nv FROM vt) - sum(base) OVER () AS rest FROM vr),
fin AS (SELECT y, nt, CAST(base + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS nv, rem FROM vk)"""


@register("stratified_split", QUOTAS + """,
h AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y, md5('42|' || o_orderkey) AS h FROM orders),
rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY substr(h, 1, 13), o_orderkey) AS rn FROM h)
SELECT o_orderkey, y, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + nv THEN 'val' ELSE 'train' END AS split FROM rk JOIN fin USING (y)""")
def q_strat_split(spark, sf):
    return SP.assign_split(status_labelled(spark, sf), ["o_orderkey"], "y", 0.2, 0.1, 42)


@register("stratified_split_counts", QUOTAS + """
SELECT 'test' AS split, y, nt AS n FROM fin
UNION ALL SELECT 'val', y, nv FROM fin
UNION ALL SELECT 'train', y, rem - nv FROM fin""")
def q_split_counts(spark, sf):
    s = SP.assign_split(status_labelled(spark, sf), ["o_orderkey"], "y", 0.2, 0.1, 42)
    return s.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"))


ORDERED = """WITH o AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
                  row_number() OVER (ORDER BY o_orderkey DESC) AS rn, count(*) OVER () AS n FROM orders),
s AS (SELECT *, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM o),
sm AS (SELECT split, count(*) AS rows, count(*) FILTER (WHERE y = 0) AS class_0, count(*) FILTER (WHERE y = 1) AS class_1,
              count(*) FILTER (WHERE y = 1) * 100.0 / count(*) AS pct_class_1 FROM s GROUP BY split)"""


def _ordered_split(spark, sf):
    return SP.assign_split(status_labelled(spark, sf), ["o_orderkey"], None, 0.2, None, stratify=False,
                           order_col="o_orderkey")


@register("split_summary", ORDERED + """
SELECT split, rows, class_0, class_1, round(pct_class_1, 6) AS pct_class_1 FROM sm""")
def q_split_summary(spark, sf):
    return rounded(SP.split_summary(_ordered_split(spark, sf), "y"), 6)


@register("class_drift", ORDERED + """
SELECT split, rows, class_0, class_1, round(pct_class_1, 6) AS pct_class_1,
       round((SELECT avg(y) * 100 FROM o), 6) AS overall_pct,
       round(abs(pct_class_1 - (SELECT avg(y) * 100 FROM o)), 6) AS drift_pct,
       abs(pct_class_1 - (SELECT avg(y) * 100 FROM o)) < 1.0 AS balanced FROM sm""")
def q_class_drift(spark, sf):
    return rounded(SP.class_drift(_ordered_split(spark, sf), "y"), 6)


BY_DATE = ORDERED.replace("ORDER BY o_orderkey DESC", "ORDER BY o_orderdate DESC, o_orderkey DESC")


def _dated_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return SP.assign_split(o, ["o_orderkey"], None, 0.2, None, stratify=False, order_col="o_orderdate")


@register("split_summary_by_date", BY_DATE + """
SELECT split, rows, class_0, class_1, round(pct_class_1, 6) AS pct_class_1 FROM sm""")
def q_split_summary_by_date(spark, sf):
    return rounded(SP.split_summary(_dated_split(spark, sf), "y"), 6)


@register("class_drift_by_date", BY_DATE + """
SELECT split, rows, class_0, class_1, round(pct_class_1, 6) AS pct_class_1,
       round((SELECT avg(y) * 100 FROM o), 6) AS overall_pct,
       round(abs(pct_class_1 - (SELECT avg(y) * 100 FROM o)), 6) AS drift_pct,
       abs(pct_class_1 - (SELECT avg(y) * 100 FROM o)) < 1.0 AS balanced FROM sm""")
def q_class_drift_by_date(spark, sf):
    return rounded(SP.class_drift(_dated_split(spark, sf), "y"), 6)


@register("fold_counts", """
WITH c AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT y, CAST(j AS INTEGER) AS fold,
             CAST(ceil((j + 1) * n / 5.0) - ceil(j * n / 5.0) AS BIGINT) AS n
      FROM c, range(0, 5) t(j))
SELECT fold, y, n FROM f""")
def q_fold_counts(spark, sf):
    f = SP.fold_column(status_labelled(spark, sf), ["o_orderkey"], "y", 5, 42)
    return f.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))


@register("fold_members", """
WITH o AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY substr(md5('42|' || o_orderkey), 1, 13), o_orderkey) AS rn,
             count(*) OVER (PARTITION BY y) AS n FROM o)
SELECT o_orderkey, y, CAST((SELECT count(*) FROM range(1, 5) t(j) WHERE rn > ceil(j * n / 5.0)) AS INTEGER) AS fold FROM r""")
def q_fold_members(spark, sf):
    return SP.fold_column(status_labelled(spark, sf), ["o_orderkey"], "y", 5, 42)


@register("seeded_sample", "SELECT * FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 1000")
def q_seeded_sample(spark, sf):
    return seeded_sample(table(spark, sf, "orders"), ["o_orderkey"], 1000, 42)


# --------------------------------------------------------------------------- metrics
LI_SCORE = """li AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_discount > 0.05 AS INTEGER) AS p,
                     l_discount AS score FROM lineitem)"""


def li_scored(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                     (F.col("l_discount") > 0.05).cast("int").alias("p"), F.col("l_discount").alias("score"))


@register("confusion_metrics", f"""WITH {LI_SCORE},
c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
             count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM li)
SELECT round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0.0), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1_score FROM c""")
def q_confusion(spark, sf):
    return rounded(ME.classification_metrics(li_scored(spark, sf), "y", "p"), 6)


@register("roc_auc", f"""WITH {LI_SCORE},
g AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM li GROUP BY score),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM g)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c""")
def q_roc(spark, sf):
    return rounded(ME.roc_auc(li_scored(spark, sf), "y", "score"), 6)


@register("grouped_auc", """
WITH li AS (SELECT l_linenumber, l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS y, round(l_discount + l_tax, 2) AS score FROM lineitem),
g AS (SELECT l_linenumber, l_linestatus, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM li GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY l_linenumber, l_linestatus ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT l_linenumber, l_linestatus, round(sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc FROM c GROUP BY ALL""")
def q_grouped_auc(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linenumber", "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"),
                                              F.round(F.col("l_discount") + F.col("l_tax"), 2).alias("score"))
    return rounded(ME.grouped_auc(li, ["l_linenumber", "l_linestatus"], "y", "score"), 6)


# A tree of depth two grown in SQL: every midpoint of a feature's values is tried, the least weighted Gini impurity wins. Nodes under
# 40 % of the rows are not split, leaves of one node that predict the same are merged.
TREE_FEATURES = ["l_discount", "l_tax", "l_linenumber"]


def _best_split(rows, name):
    tries = " UNION ALL ".join(
        f"SELECT {k} AS f, (v + nv) / 2.0 AS t FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nv FROM (SELECT DISTINCT x{k} AS v FROM {rows})) WHERE nv IS NOT NULL" for k in range(len(TREE_FEATURES)))
    value = "CASE f " + " ".join(f"WHEN {k} THEN x{k}" for k in range(len(TREE_FEATURES))) + " END"
    return f"""{name}_t AS ({tries}),
{name}_s AS (SELECT f, t, count(*) AS n, count(*) FILTER (WHERE {value} <= t) AS nl, sum(y) AS p, sum(y) FILTER (WHERE {value} <= t) AS pl FROM {rows}, {name}_t GROUP BY f, t),
{name} AS (SELECT f, t, n, nl, pl, p - pl AS pr, n - nl AS nr FROM {name}_s
  ORDER BY nl * (2.0 * pl / nl * (1 - pl / nl)) + (n - nl) * (2.0 * (p - pl) / (n - nl) * (1 - (p - pl) / (n - nl))), f, t LIMIT 1)"""


_SIDE = "CASE r.f " + " ".join(f"WHEN {k} THEN x{k}" for k in range(len(TREE_FEATURES))) + " END"
TREE_SQL = f"""d AS (SELECT l_orderkey, l_linenumber, l_discount AS x0, l_tax AS x1, CAST(l_linenumber AS DOUBLE) AS x2,
  CAST(l_discount > 0.035 AND l_tax + l_linenumber * 0.01 > 0.065 AS INTEGER) AS y FROM lineitem),
{_best_split('d', 'r')},
da AS (SELECT d.* FROM d, r WHERE {_SIDE} <= r.t), db AS (SELECT d.* FROM d, r WHERE {_SIDE} > r.t),
{_best_split('da', 'a')}, {_best_split('db', 'b')},
ka AS (SELECT * FROM a WHERE n >= ceil(0.4 * (SELECT count(*) FROM d)) AND (2 * pl > nl) <> (2 * pr > nr)),
kb AS (SELECT * FROM b WHERE n >= ceil(0.4 * (SELECT count(*) FROM d)) AND (2 * pl > nl) <> (2 * pr > nr)),
nodes AS (SELECT '' AS place, f, t, n, pl + pr AS p FROM r
  UNION ALL SELECT 'L', ka.f, ka.t, r.nl, r.pl FROM r LEFT JOIN ka ON true UNION ALL SELECT 'R', kb.f, kb.t, r.nr, r.pr FROM r LEFT JOIN kb ON true
  UNION ALL SELECT 'LL', NULL, NULL, nl, pl FROM ka UNION ALL SELECT 'LR', NULL, NULL, nr, pr FROM ka
  UNION ALL SELECT 'RL', NULL, NULL, nl, pl FROM kb UNION ALL SELECT 'RR', NULL, NULL, nr, pr FROM kb)"""


def fitted_tree(spark, sf):
    """(rows, nodes) of a decision tree of depth two on lineitem, cut at 40 % of the rows."""
    from riskweave.operators import trees as TR
    li = table(spark, sf, "lineitem")
    rule = (F.col("l_discount") > 0.035) & (F.col("l_tax") + F.col("l_linenumber") * 0.01 > 0.065)
    rows = li.select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(TREE_FEATURES)], rule.cast("int").alias("y"))
    cols = [f"x{k}" for k in range(len(TREE_FEATURES))]
    model = MO.train_model("decision_tree", rows, cols, "y", max_depth=2, min_samples_split=0.4)
    return rows, cols, TR.tree_nodes(model.stages[-1], spark)


@register("tree_nodes", f"""WITH {TREE_SQL}
SELECT place, CAST(f AS INTEGER) AS feature, round(t, 6) AS threshold, n AS n_rows, CAST(p AS DOUBLE) AS n_positive FROM nodes""")
def q_tree_nodes(spark, sf):
    """The nodes of a trained tree by their place (L and R from the root)."""
    _, _, nodes = fitted_tree(spark, sf)
    place = {0: ""}
    for n in nodes:
        if n["left"] >= 0:
            place[n["left"]], place[n["right"]] = place[n["node"]] + "L", place[n["node"]] + "R"
    rows = [(place[n["node"]], n["feature"] if n["left"] >= 0 else None, n["threshold"], n["rows"], n["counts"][1]) for n in nodes]
    return rounded(spark.createDataFrame(rows, "place string, feature int, threshold double, n_rows long, n_positive double"), 6, only=["threshold"])


@register("tree_score", f"""WITH {TREE_SQL},
s AS (SELECT l_orderkey, l_linenumber, CASE WHEN {_SIDE} <= r.t THEN 'L' ELSE 'R' END AS side, x0, x1, x2 FROM d, r),
w AS (SELECT s.*, side || CASE WHEN n.t IS NULL THEN '' WHEN CASE n.f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= n.t THEN 'L' ELSE 'R' END AS place FROM s JOIN nodes n ON n.place = side)
SELECT l_orderkey, l_linenumber, round(p / CAST(n AS DOUBLE), 6) AS probability FROM w JOIN nodes USING (place)""")
def q_tree_score(spark, sf):
    """Every row scored by the node table, as one expression."""
    from riskweave.operators import trees as TR
    rows, cols, nodes = fitted_tree(spark, sf)
    return rounded(rows.select("l_orderkey", "l_linenumber", TR.probability(nodes, [F.col(c) for c in cols]).alias("probability")), 6)


@register("risk_bands", """
SELECT l_orderkey, l_linenumber, l_discount * 10 AS probability,
       CASE WHEN l_discount * 10 < 0.3 THEN 'low' WHEN l_discount * 10 <= 0.6 THEN 'medium' ELSE 'high' END AS risk_band,
       CASE WHEN l_discount * 10 < 0.3 THEN 'approve' WHEN l_discount * 10 <= 0.6 THEN 'review' ELSE 'reject' END
         AS decision
FROM lineitem""")
def q_risk_bands(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                              (F.col("l_discount") * 10).alias("probability"))
    return SC.with_risk_bands(li)


@register("risk_bands_missing", f"""WITH {LINEITEM_MISSING_SQL}
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount * 10 < 0.3 THEN 'low' WHEN l_discount * 10 <= 0.6 THEN 'medium' WHEN l_discount * 10 > 0.6 THEN 'high' END AS risk_band,
       CASE WHEN l_discount * 10 < 0.3 THEN 'approve' WHEN l_discount * 10 <= 0.6 THEN 'review' WHEN l_discount * 10 > 0.6 THEN 'reject' END
         AS decision
FROM lineitem_m""")
def q_risk_bands_missing(spark, sf):
    """Rows without a score (NULL or NaN) have no band and no decision."""
    li = lineitem_with_missing(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("probability"))
    return SC.with_risk_bands(li).drop("probability")


@register("features_with_target", SCORES + """,
lab AS (SELECT o_custkey, CAST(cluster = worst AS INTEGER) AS is_high_risk FROM rc, w)
SELECT o_orderkey, o_totalprice, coalesce(is_high_risk, 0) AS is_high_risk FROM orders LEFT JOIN lab USING (o_custkey)""")
def q_features_with_target(spark, sf):
    """The label joined to a table of features by the transaction's key."""
    o = table(spark, sf, "orders")
    lab = SG.create_high_risk_target(rfm_banded(spark, sf), o, "o_custkey")["transactions"]
    return SG.attach_target(o.select("o_orderkey", "o_totalprice"), lab, "o_orderkey", LABEL)


@register("preview", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def q_preview(spark, sf):
    return head(table(spark, sf, "orders"), [F.col("o_orderdate").desc(), "o_orderkey"], 5)


# --------------------------------------------------------------------------- models
def _split_labelled(labelled):
    """(train, test) of the labelled features, stored as they are read by every fit and metric."""
    d = stored(SP.assign_split(labelled, ["o_orderkey"], LABEL, 0.2, None, 42))
    return d.where("split = 'train'").drop("split"), d.where("split = 'test'").drop("split")


# The example training parameters of the source project.
EXAMPLE_PARAMS = {"logistic_regression": {"max_iter": 1000, "C": 1.0},
                  "decision_tree": {"max_depth": 10, "min_samples_split": 20},
                  "random_forest": {"n_estimators": 100, "max_depth": 10, "min_samples_split": 20}}


@register("model_metrics")
def q_model_metrics(spark, sf):
    """The three example models with their parameters: train and test metrics per model."""
    train, test = _split_labelled(labelled_features(spark, sf))
    t = MO.ModelTrainer(42)
    t.train_multiple(list(EXAMPLE_PARAMS), train, test, feature_cols(train), LABEL, EXAMPLE_PARAMS)
    return t.metrics_summary(spark)


def _newton_sql(steps=10):
    """Newton's method for the fit of logistic_optimum, one scan a step: three unknowns, solved by Cramer's rule."""
    rows = """WITH x AS (SELECT l_quantity / 50.0 AS q, l_extendedprice / 100000.0 AS e, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
b0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v)"""
    for k in range(1, steps + 1):
        rows += f""",
a{k} AS (SELECT b, u, v, 1.0 / count(*) AS lam, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * q) AS h01, avg(p * (1 - p) * e) AS h02,
  avg(p * (1 - p) * q * q) AS h11, avg(p * (1 - p) * q * e) AS h12, avg(p * (1 - p) * e * e) AS h22,
  avg(p - y) AS g0, avg((p - y) * q) AS g1, avg((p - y) * e) AS g2
  FROM (SELECT q, e, y, b, u, v, 1 / (1 + exp(-(b + u * q + v * e))) AS p FROM x, b{k - 1}) GROUP BY b, u, v),
m{k} AS (SELECT b, u, v, h00, h01, h02, h11 + lam AS h11, h12, h22 + lam AS h22, g0, g1 + lam * u AS g1, g2 + lam * v AS g2 FROM a{k}),
d{k} AS (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM m{k}),
b{k} AS (SELECT b - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS b,
  u - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS u,
  v - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS v FROM d{k})"""
    last = f"b{steps}"
    return rows + f"""
SELECT '(intercept)' AS feature, round(b, 3) AS coefficient, true AS at_optimum FROM {last}
UNION ALL SELECT 'quantity', round(u, 3), true FROM {last}
UNION ALL SELECT 'price', round(v, 3), true FROM {last}"""


@register("logistic_optimum", _newton_sql())
def q_logistic_optimum(spark, sf):
    """M1's fit of two measures: its coefficients and whether the penalised gradient vanishes there."""
    li = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50.0).alias("quantity"), (F.col("l_extendedprice") / 100000.0).alias("price"),
                                             (F.col("l_returnflag") == "R").cast("int").alias("y"))
    fitted = MO.train_model("logistic_regression", li, ["quantity", "price"], "y", C=1.0, tol=1e-12, max_iter=1000)
    out = MO.logistic_optimum(fitted, li, ["quantity", "price"], "y", 1.0)
    return out.select("feature", F.round("coefficient", 3).alias("coefficient"), (F.abs("gradient") < 1e-6).alias("at_optimum"))


# The example logistic-regression search space of the source project.
EXAMPLE_LR_GRID = {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2"], "solver": ["liblinear", "lbfgs"]}


@register("grid_search")
def q_grid_search(spark, sf):
    from riskweave.operators.tuning import HyperparameterTuner
    train, _ = _split_labelled(labelled_features(spark, sf))
    t = HyperparameterTuner(cv=5, seed=42, key_cols=["o_orderkey"])
    t.grid_search("logistic_regression", train, feature_cols(train), LABEL, EXAMPLE_LR_GRID)
    return t.candidates_table(spark, "logistic_regression")


@register("random_search")
def q_random_search(spark, sf):
    """Random search with the default decision-tree space and 20 draws (seed 42)."""
    from riskweave.operators.tuning import HyperparameterTuner
    train, _ = _split_labelled(labelled_features(spark, sf))
    t = HyperparameterTuner(cv=5, seed=42, key_cols=["o_orderkey"])
    t.random_search("decision_tree", train, feature_cols(train), LABEL, n_iter=20)
    return t.candidates_table(spark, "decision_tree")


# --------------------------------------------------------------------------- runs
RUNS_SQL = """runs AS (
  SELECT 'run' || l_linenumber AS run_id, 'rule on line ' || l_linenumber AS run_name,
         CASE WHEN l_linenumber <= 4 THEN 'early' ELSE 'late' END AS experiment, min(l_shipdate) AS start_time,
         CAST(l_linenumber AS VARCHAR) AS line, round(avg(CAST((l_discount > 0.05) = (l_returnflag = 'R') AS INTEGER)), 6) AS accuracy,
         CAST(count(*) AS DOUBLE) AS n_rows
  FROM lineitem GROUP BY l_linenumber)"""


def line_runs(spark, sf):
    """One run per line number: how well the rule 'discount above 5 %' tells returned lines."""
    li = table(spark, sf, "lineitem")
    right = ((F.col("l_discount") > 0.05) == (F.col("l_returnflag") == "R")).cast("int")
    line = F.col("l_linenumber").cast("string")
    g = li.groupBy("l_linenumber").agg(F.min("l_shipdate").alias("start_time"), F.round(F.avg(right), 6).alias("accuracy"), F.count(F.lit(1)).cast("double").alias("n_rows"))
    return g.select(F.concat(F.lit("run"), line).alias("run_id"), F.concat(F.lit("rule on line "), line).alias("run_name"),
                    F.when(F.col("l_linenumber") <= 4, "early").otherwise("late").alias("experiment"), "start_time",
                    F.create_map(F.lit("line"), line, F.lit("threshold"), F.lit("0.05")).alias("params"),
                    F.create_map(F.lit("test_accuracy"), F.col("accuracy"), F.lit("n_rows"), F.col("n_rows")).alias("metrics"),
                    F.create_map(F.lit("model_type"), F.lit("rule")).alias("tags"))


@register("best_run", f"""WITH {RUNS_SQL}
SELECT run_id, run_name, accuracy AS test_accuracy FROM runs WHERE experiment = 'early' ORDER BY accuracy DESC, start_time, run_id LIMIT 1""")
def q_best_run(spark, sf):
    best = RU.best_run(line_runs(spark, sf), "test_accuracy", "early")
    return best.select("run_id", "run_name", F.col("metrics")["test_accuracy"].alias("test_accuracy"))


@register("compare_runs", f"""WITH {RUNS_SQL}
SELECT run_id, run_name, n_rows AS "metrics.n_rows", accuracy AS "metrics.test_accuracy", line AS "params.line", '0.05' AS "params.threshold"
FROM runs WHERE experiment = 'late'""")
def q_compare_runs(spark, sf):
    return RU.compare_runs(line_runs(spark, sf), None, "test_accuracy", "late")


@register("latest_version_per_stage", """
WITH e AS (SELECT o_orderpriority AS model_name, CAST(year(o_orderdate) - 1990 AS INTEGER) AS version, o_orderstatus AS stage, o_orderkey AS seq FROM orders),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name, version ORDER BY seq DESC) AS rn FROM e) WHERE rn = 1)
SELECT model_name, version, stage, seq FROM (SELECT *, row_number() OVER (PARTITION BY model_name, stage ORDER BY version DESC) AS k FROM c) WHERE k = 1""")
def q_latest_versions(spark, sf):
    """Orders as stage events: priority as model, year as version, status as stage, the order key as their sequence."""
    o = table(spark, sf, "orders")
    events = o.select(F.col("o_orderpriority").alias("model_name"), (F.year("o_orderdate") - 1990).cast("int").alias("version"),
                      F.col("o_orderstatus").alias("stage"), F.col("o_orderkey").alias("seq"))
    return RU.latest_versions(events)


# --------------------------------------------------------------------------- scoring
@register("batch_score")
def q_batch_score(spark, sf):
    """Score feature arrays with a model that was trained, logged, registered and looked up by name and stage; every
    tenth array is cut short and comes back rejected."""
    d = labelled_features(spark, sf)
    train, test = _split_labelled(d)
    cols = feature_cols(train)
    t = MO.ModelTrainer(42)
    t.train_multiple(["logistic_regression"], train, test, cols, LABEL, EXAMPLE_PARAMS)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runstore-{uuid.uuid4().hex}"
    store = RU.RunStore(spark, root, "credit_risk_model")
    for name, m in t.metrics.items():
        store.log_run(name, EXAMPLE_PARAMS[name], m, {"model_type": name}, train, LABEL)
    best = RU.best_run(store.runs(), "test_roc_auc").first()
    t.save_model(best["run_name"], f"{root}/models/{best['run_name']}")
    v = store.register_model("credit_risk_model", best["run_id"], f"{root}/models/{best['run_name']}")
    for stage in ("Staging", "Production"):
        store.transition_stage("credit_risk_model", v, stage)
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    rows = d.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.slice(arr, 1, 2)).otherwise(arr).alias("features"))
    scored = SC.batch_score(store.load_model("credit_risk_model", "Production"), rows, "features", len(cols))
    return scored.select("o_orderkey", "prediction", "probability", "risk_level", "reject_reason")


# Coefficients of a given scorecard on (price in 100,000s, month, day).
CARD, CARD_BIAS = [1.5, -0.2, 0.03], -1.0
CARD_SQL = """p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 3 AND o_orderkey % 11 <> 5 THEN
    1 / (1 + exp(-(-1.0 + 1.5 * (o_totalprice / 100000) + -0.2 * month(o_orderdate) + 0.03 * day(o_orderdate)))) END AS probability FROM orders)
SELECT {key} AS {name}, CAST(probability >= 0.5 AS INTEGER) AS prediction, round(probability, 6) AS probability,
       CASE WHEN probability >= 0.5 THEN 'high' WHEN probability < 0.5 THEN 'low' END AS risk_level,
       {more} CASE WHEN o_orderkey % 10 = 0 THEN 'expected 3 features, got 2' WHEN probability IS NULL THEN 'missing value in features' END AS reject_reason FROM p"""


def card_rows(o):
    """Feature arrays: every tenth is cut short, some have a NaN or a NULL."""
    key = F.col("o_orderkey")
    price = F.when(key % 7 == 3, F.lit(float("nan"))).when(key % 11 != 5, F.col("o_totalprice") / 100000)
    arr = F.array(price, F.month("o_orderdate").cast("double"), F.dayofmonth("o_orderdate").cast("double"))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.slice(arr, 1, 2)).otherwise(arr).alias("features"))


@register("batch_score_card", "WITH " + CARD_SQL.format(key="o_orderkey", name="o_orderkey", more=""))
def q_batch_card(spark, sf):
    """Given coefficients over feature arrays; every row comes back, arrays that are short or miss a value with a reason."""
    scored = SC.linear_score(card_rows(table(spark, sf, "orders")), CARD, CARD_BIAS)
    return rounded(scored.select("o_orderkey", "prediction", "probability", "risk_level", "reject_reason"), 6)


BANDS_SQL = """CASE WHEN probability < 0.3 THEN 'low' WHEN probability <= 0.6 THEN 'medium' WHEN probability > 0.6 THEN 'high' END AS risk_band,
       CASE WHEN probability < 0.3 THEN 'approve' WHEN probability <= 0.6 THEN 'review' WHEN probability > 0.6 THEN 'reject' END AS decision,"""


@register("stream_score_requests", "WITH " + CARD_SQL.format(key="CAST(o_orderkey AS VARCHAR)", name="id", more=BANDS_SQL))
def q_stream_requests(spark, sf):
    """Orders arrive as a file stream of JSON requests with a features array; wrong widths are rejected on the stream."""
    from riskweave.streaming import scoring as ST
    stream = ST.read_stream(spark, sf, table(spark, sf, "orders").schema, "orders.parquet")
    payload = card_rows(stream).select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), "features")).alias("value"))
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = ST.start_scoring(ST.score_requests(payload, CARD, CARD_BIAS), f"{run}/out", "requests_" + uuid.uuid4().hex[:8], f"{run}/ckpt")
    q.awaitTermination()
    return rounded(spark.read.parquet(f"{run}/out"), 6, only=["probability"])


@register("stream_score")
def q_stream_score(spark, sf):
    """Orders arrive as a file stream; customer aggregates are the static side, where every tenth customer is unknown."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from riskweave.operators.features import AGGREGATE_FEATURES, customer_aggregates
    from riskweave.streaming import scoring as ST
    o = table(spark, sf, "orders")
    cust = customer_aggregates(o, "o_custkey", "o_totalprice")
    lab = SG.create_high_risk_target(rfm_banded(spark, sf), o, "o_custkey")["transactions"]
    train = (lab.select("o_orderkey", "o_custkey", "o_totalprice", LABEL).join(cust, "o_custkey", "left")
             .withColumn(LABEL, F.col(LABEL).cast("double")))
    cols = ["o_totalprice", *AGGREGATE_FEATURES]
    model = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error"),
                             LogisticRegression(labelCol=LABEL, maxIter=1000)]).fit(train)
    stream = ST.read_stream(spark, sf, o.schema, "orders.parquet")
    scored = ST.score_stream(stream, cust.where("o_custkey % 10 <> 0"), "o_custkey", model, ["o_orderkey", "o_custkey"])
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = ST.start_scoring(scored, f"{run}/out", "risk_scores_" + uuid.uuid4().hex[:8], f"{run}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{run}/out")


# A second scorecard, promoted between the two halves of the stream.
CARD_TWO, CARD_TWO_BIAS = [0.5, 0.1, -0.02], 0.25


@register("stream_serving", """
WITH z AS (SELECT o_orderkey, CAST(1 + o_orderkey % 2 AS INTEGER) AS model_version, o_totalprice / 100000 AS a, month(o_orderdate) AS b, day(o_orderdate) AS c FROM orders),
p AS (SELECT *, 1 / (1 + exp(-CASE model_version WHEN 1 THEN -1.0 + 1.5 * a + -0.2 * b + 0.03 * c ELSE 0.25 + 0.5 * a + 0.1 * b + -0.02 * c END)) AS probability FROM z)
SELECT o_orderkey, model_version, round(probability, 6) AS probability, CASE WHEN probability >= 0.5 THEN 'high' ELSE 'low' END AS risk_level FROM p""")
def q_stream_serving(spark, sf):
    """Orders arrive in two files, a model version is promoted between them: each is scored by the version of its time."""
    import json

    from riskweave.streaming import scoring as ST
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/serving-{uuid.uuid4().hex}"
    store = RU.RunStore(spark, f"{run}/store", "serving")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    arr = F.array(F.col("o_totalprice") / 100000, F.month("o_orderdate").cast("double"), F.dayofmonth("o_orderdate").cast("double"))
    for half, card in enumerate(((CARD, CARD_BIAS), (CARD_TWO, CARD_TWO_BIAS))):
        version = store.register_model("card", f"run{half}", json.dumps(card))  # the coefficients are the model
        store.transition_stage("card", version, "Production")
        o.where(F.col("o_orderkey") % 2 == half).select("o_orderkey", arr.alias("features")).write.mode("append").parquet(f"{run}/in")
        stream = ST.read_stream(spark, f"{run}/in", "o_orderkey long, features array<double>", "*.parquet")
        q = ST.start_serving(stream, store, "card", f"{run}/out", lambda m, rows: SC.linear_score(rows, *m), json.loads, name="serving_" + uuid.uuid4().hex[:8], checkpoint=f"{run}/ckpt")
        q.awaitTermination()
    return rounded(spark.read.parquet(f"{run}/out/scores").select("o_orderkey", "model_version", "probability", "risk_level"), 6)


@register("stream_rfm", """
WITH s AS (SELECT max(o_orderdate) AS snap FROM orders)
SELECT o_custkey,
       CAST(floor((epoch_us(max(s.snap)) - epoch_us(max(o_orderdate))) / 86400000000.0) AS INTEGER) AS recency,
       count(*) AS frequency, round(sum(abs(o_totalprice)), 2) AS monetary
FROM orders, s WHERE o_custkey IS NOT NULL GROUP BY o_custkey""")
def q_stream_rfm(spark, sf):
    """RFM kept as streaming state: orders arrive as a file stream, a stateful
    per-customer aggregate runs in update mode; the latest state per customer
    equals the batch RFM."""
    from riskweave.streaming import scoring as ST
    o = table(spark, sf, "orders")
    stream = ST.read_stream(spark, sf, o.schema, "orders.parquet")
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-rfm-{uuid.uuid4().hex}"
    q = ST.start_incremental_rfm(ST.incremental_rfm(stream, "o_custkey", "o_orderdate", "o_totalprice"),
                                 f"{run}/state", "o_custkey", "rfm_state_" + uuid.uuid4().hex[:8], f"{run}/ckpt")
    q.awaitTermination()
    return rounded(ST.read_rfm_state(spark, f"{run}/state", "o_custkey"), 2)
