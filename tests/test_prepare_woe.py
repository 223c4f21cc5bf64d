import math

from pyspark.sql import functions as F

from riskweave.operators import prepare as PR
from riskweave.operators import woe as W
from riskweave.operators.processor import FeatureProcessor


def test_imputers(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "b"), (10.0, "b")], "x double, c string")
    for method, fill in (("mean", 14.0 / 3), ("median", 3.0), ("mode", 1.0), ("unknown", 3.0)):
        out = PR.apply_imputer(df, PR.fit_imputer(df, ["x"], ["c"], method)).collect()
        assert abs(out[1]["x"] - fill) < 1e-12 and out[1]["c"] == "b"


def test_onehot_and_label(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    oh = PR.onehot(df, ["k"])
    assert oh.columns == ["k_b", "k_c"]
    unseen = PR.onehot(spark.createDataFrame([("z",)], "k string"), ["k"], {"k": ["a", "b", "c"]}).first()
    assert (unseen["k_b"], unseen["k_c"]) == (0.0, 0.0)
    codes = {r["k"] for r in PR.label_encode(df, ["k"]).collect()}
    assert codes == {0, 1, 2}


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (100.0, 5.0)], "x double, c double")
    st = [r["x"] for r in PR.scale(df, ["x", "c"], "standardize").collect()]
    assert abs(sum(st)) < 1e-9
    assert {r["c"] for r in PR.scale(df, ["c"], "standardize").collect()} == {0.0}
    mm = [r["x"] for r in PR.scale(df, ["x"], "normalize").collect()]
    assert min(mm) == 0.0 and max(mm) == 1.0
    assert {r["c"] for r in PR.scale(df, ["c"], "normalize").collect()} == {0.0}
    rb = [r["x"] for r in PR.scale(df, ["x"], "robust").collect()]
    # median 3, IQR 28 - 1.75 (interpolated quartiles)
    assert abs(sorted(rb)[0] - (1 - 3) / 26.25) < 1e-12
    p = PR.fit_scaler(df, ["x"], "standardize")
    back = PR.apply_scaler(PR.apply_scaler(df, p), p, inverse=True).collect()
    assert abs(back[3]["x"] - 100.0) < 1e-9


def test_processor_fit_transform(spark):
    import datetime as dt
    rows = [(f"T{i}", f"C{i % 3}", dt.datetime(2018, 11, 15) + dt.timedelta(hours=i), float(1000 + 37 * (i % 11)),
             "ABC"[i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "TransactionId string, CustomerId string, TransactionStartTime timestamp_ntz, "
                                     "Amount double, Category string")
    out = FeatureProcessor(imputation="median", encoding="onehot", scaling="standardize").fit_transform(df)
    assert "Category_B" in out.columns and "Category_A" not in out.columns
    assert "TransactionId" not in out.columns and "CustomerId" not in out.columns
    assert out.count() == 30


def test_woe_iv_values(spark):
    df = spark.createDataFrame(list(zip("AAABBBCCC", [1, 1, 0, 1, 0, 0, 0, 0, 0])), "feature string, target int")
    t = {r["bin_key"]: r for r in W.woe_iv(df, "feature", "target").collect()}
    assert t["C"]["pct_good"] == 0.0001
    assert abs(t["A"]["woe"] - math.log((2 / 3) / (1 / 6))) < 1e-12
    iv = W.iv_features(df, "target", ["feature"]).first()
    assert iv["iv"] > 0 and iv["strength"] in ("Medium", "Strong", "Very Strong")
    one_class = spark.createDataFrame([("A", 1), ("B", 1)], "feature string, target int")
    assert W.iv_features(one_class, "target", ["feature"]).first()["iv"] == 0.0


def test_numeric_bins_and_apply(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    t = W.woe_table(df, "y", ["x"], 5)
    assert sorted(r["total"] for r in t.collect()) == [20, 20, 20, 20, 20]
    applied = W.apply_woe(df, t, ["x"], 5)
    assert applied.where(F.col("x_woe").isNull()).count() == 0


def test_unseen_values_have_no_woe(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") < 30, "a").otherwise("b").alias("c"), (F.col("id") % 4 == F.when(F.col("id") < 50, 0).otherwise(9)).cast("int").alias("y"))
    t = W.woe_table(df, "y", ["x", "c"], 5)
    other = spark.createDataFrame([(float("nan"), "z"), (None, None), (-1.0, "a"), (99.5, "b"), (0.0, "a"), (99.0, "b")], "x double, c string")
    got = W.apply_woe(other, t, ["x", "c"], 5).collect()
    assert [r["x_woe"] == 0.0 for r in got] == [True] * 4 + [False] * 2
    assert [r["c_woe"] == 0.0 for r in got] == [True, True, False, False, False, False]


def test_distinct_gate_is_exact(spark):
    df = spark.range(2000).select(*[(F.col("id") % k).alias(f"c{k}") for k in (9, 10, 11, 12, 500)])
    assert W.more_distinct_than(df, df.columns, 10) == ["c11", "c12", "c500"]
    assert W.more_distinct_than(df, [], 10) == []


def test_monotonic_bins_have_exact_edges(spark):
    import numpy as np
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("x"), (F.col("id") > 600).cast("int").alias("y"))
    rows = sorted(W.monotonic_bins(df, "x", "y").collect(), key=lambda r: r["bin"])
    assert len(rows) == rows[0]["bins"] == 20
    assert np.allclose([r["bin_hi"] for r in rows[:-1]], np.quantile(np.arange(1, 1001), np.arange(1, 20) / 20)) and rows[-1]["bin_hi"] is None
    assert sum(r["total"] for r in rows) == 1000 and [r["total"] for r in rows] == [50] * 20
    assert W.monotonic_bins(df.limit(0), "x", "y").collect() == []


def test_wide_columns_are_encoded(spark):
    df = spark.range(1500).select(F.format_string("v%05d", "id").alias("k"), F.lit("a").alias("n"))
    codes = sorted((r["k0"], r["k"]) for r in PR.label_encode(df.withColumn("k0", F.col("k")), ["k"]).collect())
    assert [c for _, c in codes] == list(range(1500))
    out = PR.onehot(df.withColumn("k0", F.col("k")).unionByName(spark.createDataFrame([(None, "a", None)], "k string, n string, k0 string")), ["k", "n"])
    assert out.columns == ["k0", "k_onehot"]
    got = {r["k0"]: r["k_onehot"] for r in out.collect()}
    assert got["v00000"].numNonzeros() == 0 and got[None].numNonzeros() == 0 and got["v00007"].indices.tolist() == [6] and got["v00007"].size == 1499


def test_scaling_none_and_inverse(spark):
    df = spark.createDataFrame([(1.0,), (5.0,)], "x double")
    assert [r["x"] for r in PR.scale(df, ["x"], "none").collect()] == [1.0, 5.0]
    for method in ("standardize", "normalize", "robust", "none"):
        p = PR.fit_scaler(df, ["x"], method)
        assert [round(r["x"], 9) for r in PR.apply_scaler(PR.apply_scaler(df, p), p, inverse=True).collect()] == [1.0, 5.0]
