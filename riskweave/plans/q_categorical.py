"""Categorical profiling queries on part's brand/type/name and orders'
status/priority."""

from riskweave.operators import categorical as C
from riskweave.plans.catalog import register, rounded, table

P_CAT = ["p_brand", "p_type", "p_name"]
O_CAT = ["o_orderstatus", "o_orderpriority"]

P_VC = """l AS (UNPIVOT (SELECT p_brand, p_type, p_name FROM part) ON p_brand, p_type, p_name
               INTO NAME variable VALUE value),
vc AS (SELECT variable, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY variable, value),
tot AS (SELECT variable, sum(n) AS tot, count(*) AS k FROM vc GROUP BY variable),
r AS (SELECT vc.variable, value, n, n * 100.0 / tot AS pct, k,
             row_number() OVER (PARTITION BY vc.variable ORDER BY n DESC, value) AS rank
      FROM vc JOIN tot USING (variable))"""
O_VC = P_VC.replace("SELECT p_brand, p_type, p_name FROM part) ON p_brand, p_type, p_name",
                    "SELECT o_orderstatus, o_orderpriority FROM orders) ON o_orderstatus, o_orderpriority")


@register("cardinality", """
SELECT variable, "distinct", total, round(ratio, 6) AS ratio FROM (
  SELECT 'p_brand' AS variable, count(DISTINCT p_brand) AS "distinct", count(*) AS total,
         count(DISTINCT p_brand) / count(*) AS ratio FROM part
  UNION ALL SELECT 'p_type', count(DISTINCT p_type), count(*), count(DISTINCT p_type) / count(*) FROM part
  UNION ALL SELECT 'p_name', count(DISTINCT p_name), count(*), count(DISTINCT p_name) / count(*) FROM part)""")
def q_cardinality(spark, sf):
    return rounded(C.cardinality(table(spark, sf, "part"), P_CAT), 6)


@register("value_counts_top10", "WITH " + P_VC + """
SELECT variable, CAST(rank AS INTEGER) AS rank, value, n, round(pct, 4) AS pct,
       greatest(k - 10, 0) AS more_values FROM r WHERE rank <= 10""")
def q_vc_top10(spark, sf):
    return rounded(C.value_counts_top(table(spark, sf, "part"), P_CAT, 10), 4)


@register("categorical_summary", "WITH " + P_VC + """,
miss AS (SELECT 'p_brand' AS variable, count(*) FILTER (WHERE p_brand IS NULL) AS missing, count(*) AS rows FROM part
         UNION ALL SELECT 'p_type', count(*) FILTER (WHERE p_type IS NULL), count(*) FROM part
         UNION ALL SELECT 'p_name', count(*) FILTER (WHERE p_name IS NULL), count(*) FROM part),
top AS (SELECT variable, max(k) AS "distinct", max(CASE WHEN rank = 1 THEN value END) AS mode,
               max(CASE WHEN rank = 1 THEN n END) AS mode_count, max(CASE WHEN rank = 1 THEN pct END) AS mode_pct,
               string_agg(printf('%s(%.1f%%)', value, round(pct, 1)), ', ' ORDER BY rank) AS top3
        FROM r WHERE rank <= 3 GROUP BY variable)
SELECT variable, "distinct", mode, mode_count, round(mode_pct, 4) AS mode_pct, missing,
       round(missing * 100.0 / rows, 4) AS missing_pct, top3
FROM miss JOIN top USING (variable)""")
def q_cat_summary(spark, sf):
    return rounded(C.categorical_summary(table(spark, sf, "part"), P_CAT), 4)


@register("entropy", "WITH " + O_VC + """,
e AS (SELECT variable, sum(-(n / tot) * log2(n / tot)) AS entropy, max(k) AS k
      FROM vc JOIN tot USING (variable) GROUP BY variable),
m AS (SELECT variable, entropy, CASE WHEN k > 1 THEN log2(k) ELSE 0.0 END AS max_entropy FROM e),
nm AS (SELECT *, CASE WHEN max_entropy > 0 THEN entropy / max_entropy ELSE 0.0 END AS normalized_entropy FROM m)
SELECT variable, round(entropy, 6) AS entropy, round(max_entropy, 6) AS max_entropy,
       round(normalized_entropy, 6) AS normalized_entropy,
       CASE WHEN normalized_entropy > 0.7 THEN 'High diversity'
            WHEN normalized_entropy > 0.4 THEN 'Moderate diversity'
            ELSE 'Low diversity (concentrated)' END AS label FROM nm""")
def q_entropy(spark, sf):
    return rounded(C.entropy(table(spark, sf, "orders"), O_CAT), 6)


@register("top20_bars", "WITH " + P_VC + """
SELECT variable, CAST(rank AS INTEGER) AS rank, value, n, round(pct, 4) AS pct FROM r WHERE rank <= 20""")
def q_top20(spark, sf):
    return rounded(C.top_bars(table(spark, sf, "part"), P_CAT, 20), 4)


@register("category_share", "WITH " + O_VC + """
SELECT variable, value, n, round(pct, 4) AS pct FROM r WHERE k <= 15""")
def q_share(spark, sf):
    return rounded(C.category_share(table(spark, sf, "orders"), O_CAT, 15), 4)
