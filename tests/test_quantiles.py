import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.functions import quantiles as Q
from riskweave.functions.ordering import double_key, global_rank, running_total
from tests.conftest import SF

quantiles = Q.quantiles
PROBS = {"q0": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "q99": 0.99, "q100": 1.0}
INF = float("inf")


def test_small_values_interpolate_like_pandas(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (100.0,), (None,), (float("nan"),)], "x double")
    r = quantiles(df, [], "x", {"q1": 0.25, "med": 0.5}).first()
    assert r["q1"] == 1.75 and r["med"] == 3.0


def test_hot_group_path_equals_builtin(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").withColumn("g", (F.col("o_custkey") % 2).cast("int"))
    o = o.withColumn("v", F.when(F.col("o_orderkey") % 4 == 0, F.lit(5.0)).otherwise(F.col("o_totalprice")))
    cold = {r["g"]: r.asDict() for r in quantiles(o, ["g"], "v", PROBS).collect()}
    hot = {r["g"]: r.asDict() for r in quantiles(o, ["g"], "v", PROBS, hot_rows=5, final_rows=7).collect()}
    assert cold == hot


def test_all_equal_values(spark):
    df = spark.range(50).select(F.lit(3.0).alias("x"), F.lit("a").alias("g"))
    r = quantiles(df, ["g"], "x", PROBS, hot_rows=5).first()
    assert all(r[k] == 3.0 for k in PROBS)


def test_null_group_infinities_and_extremes_in_bounded_passes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    values = [*rng.normal(size=300), INF, -INF, 1e308, -1e308, 5e-324, 0.0, -0.0, *([7.0] * 40)]
    rows = [(None if i % 3 else "a", float(v)) for i, v in enumerate(values)]
    passes = []
    plain = Q._rows_of
    monkeypatch.setattr(Q, "_rows_of", lambda *a: passes.append(1) or plain(*a))
    got = {r["g"]: r for r in quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", PROBS, hot_rows=10, final_rows=5).collect()}
    assert len(passes) <= 2 * len(Q.SHIFTS)
    for g in (None, "a"):
        own = sorted(v for k, v in rows if k == g)
        for name, p in PROBS.items():
            pos = p * (len(own) - 1)
            lo, hi = own[math.floor(pos)], own[math.ceil(pos)]
            want = lo if lo == hi else (math.ceil(pos) - pos) * lo + (pos - math.floor(pos)) * hi
            assert got[g][name] == pytest.approx(want, rel=1e-12)


def test_no_window_partition_exceeds_the_final_size(spark, monkeypatch):
    """What is ranked in one task after the passes are at most final_rows rows."""
    df = spark.range(5000).select((F.col("id") * 1.5).alias("x"))
    sizes = []
    plain = Q._read_off
    monkeypatch.setattr(Q, "_read_off", lambda x, state, *a: sizes.extend(r["_cnt"] for r in state.collect()) or plain(x, state, *a))
    r = quantiles(df, [], "x", {"med": 0.5}, hot_rows=100, final_rows=50).first()
    assert r["med"] == 2499.5 * 1.5 and max(sizes, default=0) <= 50


def test_double_key_sorts_like_the_value(spark):
    rng = np.random.default_rng(1)
    xs = [0.0, INF, -INF, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1.0, 2.0, 0.5, np.nextafter(1, 0), np.nextafter(2, 0), np.nextafter(2, 3)]
    xs += list(np.ldexp(rng.normal(size=400), rng.integers(-1070, 1020, 400))) + [float(2.0 ** k) for k in range(-1074, 1024, 37)]
    xs = sorted(set(float(x) for x in xs))
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", double_key(F.col("x")).alias("k")).collect()
    key = {r["x"]: r["k"] for r in got}
    bits = lambda x: int(np.float64(abs(x)).view(np.int64)) * (-1 if x < 0 else 1)
    assert [key[x] for x in xs] == [bits(x) for x in xs]


def test_global_rank_and_running_total(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 400), "v": rng.integers(0, 20, 400), "id": np.arange(400)})
    df = spark.createDataFrame([(g, int(v), int(i)) for g, v, i in pdf.itertuples(index=False)], "g string, v int, id int").repartition(7)
    got = {r["id"]: r["rank"] for r in global_rank(df, ["v", "id"], "rank", ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((int(v), int(i)) for gg, v, i in pdf.itertuples(index=False) if gg is g or gg == g)
        assert [got[i] for _, i in own] == list(range(len(own)))
    total = {r["id"]: r["t"] for r in running_total(df, ["v", "id"], F.col("v"), "t").collect()}
    at = 0
    for v, i in sorted((int(v), int(i)) for _, v, i in pdf.itertuples(index=False)):
        assert total[i] == at
        at += v


def test_hot_groups_are_read_twice_not_once_per_prefix(spark, monkeypatch):
    """Ranks of hot groups come from the intervals their sketch names; the radix passes stay unused."""
    monkeypatch.setattr(Q, "_rows_of", lambda *a: pytest.fail("radix pass"))
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b", None], 20000), "x": np.concatenate([rng.lognormal(0, 3, 20000), rng.integers(0, 7, 20000) * 1.0, rng.normal(0, 1, 20000)])})
    got = {r["g"]: r for r in quantiles(spark.createDataFrame(pdf, "g string, x double").repartition(7), ["g"], "x", PROBS, hot_rows=10_000).collect()}
    for g, own in pdf.groupby("g", dropna=False)["x"]:
        for name, p in PROBS.items():
            assert got[g if isinstance(g, str) else None][name] == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12)


def test_ranks_outside_their_interval_are_found_all_the_same(spark, monkeypatch):
    """A sketch that is far off, and intervals of too many values, fall back on radix selection."""
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 4001 * 0.5).alias("x"))
    inner = {"q1": 0.25, "med": 0.5}
    want = {r["g"]: r.asDict() for r in quantiles(df, ["g"], "x", inner).collect()}
    radix, plain = [], Q._by_radix
    monkeypatch.setattr(Q, "_by_radix", lambda *a: radix.append(1) or plain(*a))
    monkeypatch.setattr(Q, "MARGIN", -30)
    assert {r["g"]: r.asDict() for r in quantiles(df, ["g"], "x", inner, hot_rows=1000, final_rows=50).collect()} == want and radix
    radix.clear()
    monkeypatch.setattr(Q, "MARGIN", 5000)
    assert {r["g"]: r.asDict() for r in quantiles(df, ["g"], "x", inner, hot_rows=1000, final_rows=50).collect()} == want and radix


def test_column_quantiles_equal_percentile_without_radix(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 30_000
    pdf = pd.DataFrame({"price": np.round(rng.lognormal(8, 3, n), 2), "few": rng.integers(0, 7, n) * 1.0, "short": np.where(np.arange(n) < 500, rng.normal(size=n), np.nan),
                        "ends": rng.choice([-np.inf, np.inf, 0.0, 1.0], n), "flat": 4.0, "nothing": np.nan})
    df = spark.createDataFrame(pdf).repartition(7)
    probs = {"lowest": 0.0, "q1": 0.25, "med": 0.5, "q1b": 0.2501, "q3": 0.75, "most": 1.0}

    def no_radix(*a, **k):
        raise AssertionError("the intervals hold every rank")

    monkeypatch.setattr(Q, "_by_radix", no_radix)
    got = {r["variable"]: r for r in Q.column_quantiles(df, list(pdf.columns), probs, wide_rows=1000).collect()}
    assert set(got) == set(pdf.columns) - {"nothing"}
    for c in got:
        values = np.sort(pdf[c].dropna().to_numpy())
        for name, p in probs.items():
            pos = p * (len(values) - 1)
            lo, hi = int(np.floor(pos)), int(np.ceil(pos))
            want = values[lo] if values[lo] == values[hi] else (hi - pos) * values[lo] + (pos - lo) * values[hi]
            assert got[c][name] == want, (c, name)


def test_column_quantiles_without_rows_and_by_radix(spark, monkeypatch):
    empty = spark.createDataFrame([], "a double, b int")
    assert Q.column_quantiles(empty, ["a", "b"], {"q": 0.5}).count() == 0
    df = spark.range(5001).select(F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("int").alias("b"))
    # intervals of too many distinct values are left to the radix selection
    got = {r["variable"]: r["q"] for r in Q.column_quantiles(df, ["a", "b"], {"q": 0.5}, wide_rows=100, hot_rows=50, final_rows=10).collect()}
    assert got == {"a": 2500.0, "b": 1.0}


def test_column_quantiles_need_no_sketch_and_survive_cells_out_of_order(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"wide": rng.normal(size=4000) * 10.0 ** rng.integers(-300, 300, 4000), "near": 1e9 + rng.normal(size=4000), "zero": rng.choice([0.0, -0.0, 5e-324, -5e-324], 4000),
                        "ends": rng.choice([-INF, INF, 1.0, -1.7e308], 4000)})
    df = spark.createDataFrame(pdf).repartition(5)
    monkeypatch.setattr(Q.F, "percentile_approx", lambda *a: pytest.fail("sketch"))
    radix, plain = [], Q._by_radix
    monkeypatch.setattr(Q, "_by_radix", lambda *a: radix.append(1) or plain(*a))

    def check():
        got = {r["variable"]: r for r in Q.column_quantiles(df, list(pdf.columns), PROBS, wide_rows=100).collect()}
        for c in pdf.columns:
            own = np.sort(pdf[c].to_numpy())
            for name, p in PROBS.items():
                pos = p * (len(own) - 1)
                lo, hi = float(own[math.floor(pos)]), float(own[math.ceil(pos)])
                assert got[c][name] == (lo if lo == hi else (math.ceil(pos) - pos) * lo + (pos - math.floor(pos)) * hi), (c, name)

    check()
    assert not radix
    plain_cell = Q._cell
    monkeypatch.setattr(Q, "_cell", lambda x: F.abs(plain_cell(x)))  # negative values among the positive ones
    check()
    assert radix
