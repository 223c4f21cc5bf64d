import datetime as dt

from pyspark.sql import functions as F

from riskweave.operators import categorical as C
from riskweave.operators import features as FE
from riskweave.operators import profile as P
from riskweave.operators import quality as Q
from riskweave.sources.schemas import detect_roles


def test_temporal_features(spark):
    rows = [(dt.datetime(2018, 11, 15) + dt.timedelta(hours=2 * i), 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "TransactionStartTime timestamp_ntz, Amount double")
    out = FE.temporal_features(df).collect()
    assert {r["transaction_year"] for r in out} == {2018}
    assert out[0]["transaction_dayofweek"] == 3  # a Thursday, Monday = 0
    assert out[0]["transaction_week"] == 46
    same = FE.temporal_features(spark.createDataFrame([(1.0,)], "Amount double"))
    assert same.columns == ["Amount"]


def test_customer_aggregates(spark):
    df = spark.createDataFrame([("C1", 100.0), ("C1", 200.0), ("C1", 300.0), ("C2", 150.0), ("C2", 250.0),
                                ("C3", 7.0)], "CustomerId string, Amount double")
    a = {r["CustomerId"]: r for r in FE.customer_aggregates(df).collect()}
    c1 = a["C1"]
    assert (c1["total_transaction_amount"], c1["avg_transaction_amount"], c1["transaction_count"]) == (600.0, 200.0, 3)
    assert (c1["std_transaction_amount"], c1["min_transaction_amount"], c1["max_transaction_amount"],
            c1["median_transaction_amount"]) == (100.0, 100.0, 300.0, 200.0)
    assert a["C3"]["std_transaction_amount"] == 0.0  # single row: NULL std -> 0
    joined = FE.with_customer_aggregates(df)
    assert joined.count() == 6 and "median_transaction_amount" in joined.columns


def test_roles_and_drop_nulls(spark):
    df = spark.createDataFrame([("T1", "C1", 1.0, "a", 1), ("T2", "C2", None, "b", 0)],
                               "TransactionId string, CustomerId string, Amount double, Cat string, FraudResult int")
    cats, nums = detect_roles(df, "CustomerId", None, "FraudResult")
    assert cats == ["Cat"] and nums == ["Amount"]
    assert FE.drop_null_rows(df).count() == 1


def test_describe_and_shape(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (100.0,)], "x double")
    d = P.describe(df, ["x"]).first()
    assert (d["count"], d["p25"], d["p50"], d["max"]) == (4, 1.75, 3.0, 100.0)
    s = P.shape(df, ["x"]).first()
    assert round(s["skewness"], 5) == 1.15245 and round(s["kurtosis"], 5) == -0.66842
    assert s["skew_label"] == "Highly skewed"


def test_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (2.0,)], "x double")
    assert P.central_tendency(df, ["x"]).first()["mode"] == 1.0


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    h = {r["bin"]: r["n"] for r in P.histogram(df, ["x"], 5).collect()}
    assert sum(h.values()) == 11 and max(h) == 5


def test_categorical_profile(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    card = C.cardinality(df, ["c"]).first()
    assert (card["distinct"], card["total"]) == (2, 4)
    s = C.categorical_summary(df, ["c"]).first()
    assert (s["mode"], s["mode_count"], s["missing"]) == ("a", 2, 1)
    assert s["top3"] == "a(66.7%), b(33.3%)"
    e = C.entropy(df, ["c"]).first()
    assert abs(e["max_entropy"] - 1.0) < 1e-12 and e["label"] == "High diversity"


def test_missing_and_outliers(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (float("nan"), None), (2.0, "z")], "v double, s string")
    m = {r["column"]: r["missing"] for r in Q.missing_summary(df).collect()}
    assert m == {"v": 2, "s": 1}
    per_row = {r["missing_count"]: r["rows"] for r in Q.missing_per_row(df).collect()}
    assert per_row == {0: 2, 1: 1, 2: 1}
    vals = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "x double")
    o = Q.iqr_outliers(vals, ["x"]).first()
    assert o["n_outliers"] == 1 and o["max_outlier"] == 100.0 and o["pct_outliers"] == 10.0
    dup = Q.duplicate_rows(spark.createDataFrame([(1,), (1,), (1,), (2,)], "a int")).first()
    assert dup["duplicate_rows"] == 2
