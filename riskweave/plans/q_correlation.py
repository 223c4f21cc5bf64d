"""Correlation queries on lineitem's numeric columns; the target is the
return flag 'R' as 0/1."""

from pyspark.sql import functions as F

from riskweave.operators import correlation as CR
from riskweave.plans.catalog import register, rounded, table

CC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_net", "l_charge"]
LX = """lx AS (SELECT *, l_extendedprice * (1 - l_discount) AS l_net,
                  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS l_charge FROM lineitem)"""


def li(spark, sf):
    """lineitem plus the derived net price and charge (strongly correlated)."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf, "lineitem").withColumns({"l_net": net, "l_charge": net * (1 + F.col("l_tax"))})


def _pairs_sql(diagonal=False):
    rows = []
    for i, a in enumerate(CC):
        for j in range(i if diagonal else i + 1, len(CC)):
            b = CC[j]
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            rows.append(
                f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {i} AS i, {j} AS j, "
                f"covar_pop(CASE WHEN {both} THEN {a} END, CASE WHEN {both} THEN {b} END) / "
                f"nullif(stddev_pop(CASE WHEN {both} THEN {a} END) * stddev_pop(CASE WHEN {both} THEN {b} END), 0) "
                f"AS corr FROM lx")
    return LX + ", p AS (" + " UNION ALL ".join(rows) + ")"


@register("corr_matrix", "WITH " + _pairs_sql(True) + """
SELECT feature_1 AS "row", feature_2 AS "column", round(corr, 6) AS corr FROM p
UNION ALL SELECT feature_2, feature_1, round(corr, 6) FROM p WHERE i <> j""")
def q_corr_matrix(spark, sf):
    return rounded(CR.corr_matrix(li(spark, sf), CC), 6)


@register("strong_pairs", "WITH " + _pairs_sql() + """
SELECT feature_1, feature_2, round(corr, 6) AS corr,
       CASE WHEN abs(corr) >= 0.9 THEN 'Very Strong' WHEN abs(corr) >= 0.8 THEN 'Strong' ELSE 'Moderate-Strong' END
         AS strength,
       CASE WHEN corr > 0 THEN 'Positive' ELSE 'Negative' END AS type
FROM p WHERE abs(corr) >= 0.7""")
def q_strong(spark, sf):
    return rounded(CR.strong_pairs(li(spark, sf), CC), 6)


@register("corr_bands", "WITH " + _pairs_sql() + """,
a AS (SELECT abs(corr) AS a FROM p WHERE corr IS NOT NULL),
s AS (SELECT count(*) AS pairs, avg(a) AS mean_abs, quantile_cont(a, 0.5) AS median_abs, max(a) AS max_abs,
             min(a) AS min_abs FROM a),
b AS (SELECT CASE WHEN a >= 0.9 THEN 0 WHEN a >= 0.8 THEN 1 WHEN a >= 0.5 THEN 2 WHEN a >= 0.3 THEN 3 ELSE 4 END AS k
      FROM a),
names AS (SELECT * FROM (VALUES (0, 'Very Strong (>=0.9)'), (1, 'Strong (0.8-0.9)'), (2, 'Moderate (0.5-0.8)'),
                                (3, 'Weak (0.3-0.5)'), (4, 'Very Weak (<0.3)')) t(band_order, band))
SELECT CAST(band_order AS INTEGER) AS band_order, band, (SELECT count(*) FROM b WHERE b.k = names.band_order) AS n,
       round((SELECT count(*) FROM b WHERE b.k = names.band_order) * 100.0 / pairs, 6) AS pct, pairs,
       round(mean_abs, 6) AS mean_abs, round(median_abs, 6) AS median_abs, round(max_abs, 6) AS max_abs,
       round(min_abs, 6) AS min_abs
FROM names, s""")
def q_bands(spark, sf):
    return rounded(CR.corr_bands(li(spark, sf), CC), 6)


@register("top_pairs", "WITH " + _pairs_sql() + """
SELECT side, CAST(rank AS INTEGER) AS rank, feature_1, feature_2, round(corr, 6) AS corr FROM (
  SELECT 'positive' AS side, row_number() OVER (ORDER BY corr DESC, i, j) AS rank, * FROM p WHERE corr IS NOT NULL
  UNION ALL
  SELECT 'negative', row_number() OVER (ORDER BY corr ASC, i, j), * FROM p WHERE corr IS NOT NULL) WHERE rank <= 10""")
def q_top_pairs(spark, sf):
    return rounded(CR.top_pairs(li(spark, sf), CC, 10), 6)


def _target_sql():
    rows = []
    for c in CC:
        both = f"{c} IS NOT NULL AND t IS NOT NULL"
        rows.append(f"SELECT '{c}' AS feature, covar_pop(CASE WHEN {both} THEN {c} END, CASE WHEN {both} THEN t END) / "
                    f"nullif(stddev_pop(CASE WHEN {both} THEN {c} END) * stddev_pop(CASE WHEN {both} THEN t END), 0) "
                    f"AS corr FROM lt")
    return " UNION ALL ".join(rows)


@register("target_corr", "WITH " + LX + """, lt AS (SELECT *, CAST(l_returnflag = 'R' AS DOUBLE) AS t FROM lx),
c AS (""" + _target_sql() + """)
SELECT feature, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr FROM c""")
def q_target_corr(spark, sf):
    df = li(spark, sf).withColumn("is_r", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(CR.target_corr(df, "is_r", CC), 6)


def _scatter_sql():
    value = lambda side: "CASE " + " ".join(f"WHEN t.{side} = '{c}' THEN s.{c}" for c in CC) + " END"
    return "WITH " + _pairs_sql() + f""",
t AS (SELECT feature_1, feature_2 FROM p WHERE abs(corr) >= 0.7 ORDER BY abs(corr) DESC, feature_1, feature_2 LIMIT 6),
s AS (SELECT * FROM lx ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber LIMIT 5000)
SELECT l_orderkey, l_linenumber, feature_1, feature_2, round({value('feature_1')}, 8) AS x, round({value('feature_2')}, 8) AS y FROM s, t"""


@register("scatter_sample", _scatter_sql())
def q_scatter(spark, sf):
    return rounded(CR.scatter_sample(li(spark, sf), ["l_orderkey", "l_linenumber"], CC, 6, 5000, 42), 8)
