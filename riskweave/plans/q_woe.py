"""WoE / IV queries on lineitem with target 'return flag is R'."""

from pyspark.sql import functions as F

from riskweave.operators import woe as W
from riskweave.plans.catalog import register, rounded, table
from riskweave.plans.derived import LINEITEM_MISSING_SQL, lineitem_with_missing
from riskweave.plans.q_prepare import key_rule

T = "is_r"
LT = """lt AS (SELECT *, CAST(l_returnflag = 'R' AS DOUBLE) AS is_r FROM lineitem)"""


def lt(spark, sf):
    return table(spark, sf, "lineitem").withColumn(T, (F.col("l_returnflag") == "R").cast("int"))


def _woe_cte(feature, numeric, bins=10, name="s"):
    if numeric:
        keyed = f"""b_{name} AS (SELECT min({feature}) AS lo, max({feature}) AS hi FROM lt
                     WHERE {feature} IS NOT NULL AND is_r IS NOT NULL),
k_{name} AS (SELECT CASE WHEN hi = lo THEN 1 ELSE greatest(1, least({bins}, CAST(ceil(({feature} - lo) / ((hi - lo) / {bins})) AS INTEGER))) END AS bin,
                   lo, (hi - lo) / {bins} AS w, is_r AS t
            FROM lt, b_{name} WHERE {feature} IS NOT NULL AND is_r IS NOT NULL),
g_{name} AS (SELECT bin, lo + (bin - 1) * w AS bin_lo, lo + bin * w AS bin_hi, count(*) AS total, sum(t) AS good
             FROM k_{name} GROUP BY bin, lo, w)"""
    else:
        keyed = f"""g_{name} AS (SELECT {feature} AS value, count(*) AS total, sum(is_r) AS good FROM lt
             WHERE {feature} IS NOT NULL AND is_r IS NOT NULL GROUP BY {feature})"""
    return keyed + f""",
t_{name} AS (SELECT sum(good) AS tg, sum(total - good) AS tb FROM g_{name}),
{name} AS (SELECT g_{name}.*, total - good AS bad,
             CASE WHEN good / tg = 0 THEN 0.0001 ELSE good / tg END AS pct_good,
             CASE WHEN (total - good) / tb = 0 THEN 0.0001 ELSE (total - good) / tb END AS pct_bad
      FROM g_{name}, t_{name} WHERE tg > 0 AND tb > 0)"""


WOE_COLS = """total, good, bad, round(pct_good, 6) AS pct_good, round(pct_bad, 6) AS pct_bad,
       round(ln(pct_good / pct_bad), 6) AS woe, round((pct_good - pct_bad) * ln(pct_good / pct_bad), 6) AS iv"""
SPARK_WOE_COLS = ["total", "good", "bad", "pct_good", "pct_bad", "woe", "iv"]


@register("woe_categorical", f"WITH {LT}, {_woe_cte('l_linestatus', False)} SELECT value, {WOE_COLS} FROM s")
def q_woe_cat(spark, sf):
    t = W.woe_iv(lt(spark, sf), "l_linestatus", T)
    return rounded(t.select(F.col("bin_key").alias("value"), *SPARK_WOE_COLS), 6)


@register("woe_binned", f"""WITH {LT}, {_woe_cte('l_extendedprice', True)}
SELECT bin, round(bin_lo, 4) AS bin_lo, round(bin_hi, 4) AS bin_hi, {WOE_COLS} FROM s""")
def q_woe_binned(spark, sf):
    t = W.woe_iv(lt(spark, sf), "l_extendedprice", T, bins=10)
    t = rounded(t, 4, only=["bin_lo", "bin_hi"])
    return rounded(t.select("bin", "bin_lo", "bin_hi", *SPARK_WOE_COLS), 6, only=SPARK_WOE_COLS)


IV_FEATS = [("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True),
            ("l_linestatus", False)]


def _iv_sql():
    ctes = ", ".join(_woe_cte(f, num, 10, f"s{i}") for i, (f, num) in enumerate(IV_FEATS))
    ivs = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, coalesce((SELECT sum((pct_good - pct_bad) * ln(pct_good / pct_bad)) FROM s{i}), 0.0) AS iv"
        for i, (f, _) in enumerate(IV_FEATS))
    return f"""WITH {LT}, {ctes}, iv AS ({ivs})
SELECT feature, round(iv, 6) AS iv,
       CASE WHEN iv < 0.02 THEN 'Not useful' WHEN iv < 0.1 THEN 'Weak' WHEN iv < 0.3 THEN 'Medium'
            WHEN iv < 0.5 THEN 'Strong' ELSE 'Very Strong' END AS strength FROM iv"""


@register("iv_features", _iv_sql())
def q_iv(spark, sf):
    return rounded(W.iv_features(lt(spark, sf), T, [f for f, _ in IV_FEATS], 10), 6)


def _encode_sql(feats, key_sql="l_orderkey, l_linenumber"):
    ctes = ", ".join(_woe_cte(f, num, 10, f"s{i}") for i, (f, num) in enumerate(feats))
    sel, joins = [], []
    for i, (f, num) in enumerate(feats):
        if num:
            joins.append(f"""LEFT JOIN (SELECT k.rid, s{i}.pct_good, s{i}.pct_bad FROM
                (SELECT rid, CASE WHEN hi = lo THEN 1 ELSE greatest(1, least(10, CAST(ceil(({f} - lo) / ((hi - lo) / 10)) AS INTEGER))) END AS bin
                 FROM lr, b_s{i} WHERE {f} IS NOT NULL) k JOIN s{i} USING (bin)) j{i} ON j{i}.rid = lr.rid""")
        else:
            joins.append(f"LEFT JOIN s{i} j{i} ON j{i}.value = lr.{f}")
        sel.append(f"round(coalesce(ln(j{i}.pct_good / j{i}.pct_bad), 0.0), 6) AS {f}_woe")
    return f"""WITH {LT}, {ctes}, lr AS (SELECT row_number() OVER () AS rid, * FROM lineitem)
SELECT {key_sql}, {', '.join(sel)} FROM lr {' '.join(joins)}"""


ENC = [("l_linestatus", False), ("l_extendedprice", True)]


@register("woe_encode", _encode_sql(ENC))
def q_woe_encode(spark, sf):
    df = lt(spark, sf)
    feats = [f for f, _ in ENC]
    tab = W.woe_table(df, T, feats, 10)
    out = W.apply_woe(df, tab, feats, 10).select("l_orderkey", "l_linenumber", *[f"{f}_woe" for f in feats])
    return rounded(out, 6)


@register("woe_transformer", _encode_sql([("l_quantity", True), ("l_extendedprice", True), ("l_discount", True)]))
def q_woe_transformer(spark, sf):
    df = lt(spark, sf)
    tr = W.WoETransformer(T, bins=10, id_rule=key_rule).fit(df)
    out = tr.transform(df).select("l_orderkey", "l_linenumber", *[f"{f}_woe" for f in tr.features])
    return rounded(out, 6)


def _monotonic_sql(lo=3, hi=20):
    fracs = sorted({k / n for n in range(lo, hi + 1) for k in range(1, n)})
    at = {f: i + 1 for i, f in enumerate(fracs)}
    edges = " UNION ALL ".join(f"SELECT {n} AS n, list_sort(list_distinct([{', '.join(f'q[{at[k / n]}]' for k in range(1, n))}])) AS e FROM q" for n in range(lo, hi + 1))
    return f"""WITH {LT}, x AS (SELECT l_extendedprice AS x, is_r AS t FROM lt),
q AS (SELECT quantile_cont(x, [{', '.join(repr(f) for f in fracs)}]) AS q FROM x),
ed AS ({edges}),
b AS (SELECT n, len(list_filter(e, lambda v: v < x)) + 1 AS b, t FROM x, ed),
g AS (SELECT n, b, count(*) AS total, sum(t) AS good FROM b GROUP BY n, b),
m AS (SELECT n, good / total AS mean, lag(good / total) OVER (PARTITION BY n ORDER BY b) AS prev FROM g),
ok AS (SELECT n FROM m GROUP BY n HAVING count(*) >= 2 AND (bool_and(prev IS NULL OR mean >= prev) OR bool_and(prev IS NULL OR mean <= prev))),
pick AS (SELECT coalesce(max(n), {lo}) AS n FROM ok)
SELECT CAST(g.n AS INTEGER) AS bins, CAST(row_number() OVER (ORDER BY b) AS INTEGER) AS bin, round(e[b - 1], 4) AS bin_lo, round(e[b], 4) AS bin_hi,
       total, good, round(good / total, 6) AS mean FROM g JOIN pick USING (n) JOIN ed USING (n)"""


@register("monotonic_bins", _monotonic_sql())
def q_monotonic(spark, sf):
    out = W.monotonic_bins(lt(spark, sf), "l_extendedprice", T)
    return rounded(rounded(out, 4, only=["bin_lo", "bin_hi"]), 6, only=["mean"])


# --------------------------------------------------------------------------- values the fit has not seen
MISSING_ENC = _encode_sql(ENC, "lr.l_orderkey, lr.l_linenumber").replace(f"WITH {LT}", f"WITH {LINEITEM_MISSING_SQL}, " + LT.replace("FROM lineitem", "FROM lineitem_m")).replace("* FROM lineitem)", "* FROM lineitem_m)")


@register("woe_encode_missing", MISSING_ENC)
def q_woe_encode_missing(spark, sf):
    """NULL and NaN take part in neither the fit nor the lookup: their WoE is 0."""
    df = lineitem_with_missing(spark, sf).withColumn(T, (F.col("l_returnflag") == "R").cast("int"))
    feats = [f for f, _ in ENC]
    out = W.apply_woe(df, W.woe_table(df, T, feats, 10), feats, 10)
    return rounded(out.select("l_orderkey", "l_linenumber", *[f"{f}_woe" for f in feats]), 6)
