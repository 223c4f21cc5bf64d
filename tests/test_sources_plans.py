"""Readers and writers, schema rules, small projections, missing cells in outliers, and what the executed plans read."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators import correlation as CR
from riskweave.operators import features as FE
from riskweave.operators import quality as Q
from riskweave.operators import sampling as SA
from riskweave.operators import schema_ops as SO
from riskweave.sources import schemas as SC
from riskweave.sources import tables as TB
from tests.conftest import SF

NAN = float("nan")


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_csv_round_trip_and_bounded_scan(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("at", T.TimestampNTZType())])
    df = spark.sql("select * from values (1L, 'a,b', timestamp_ntz'2020-01-02 03:04:05'), (2L, null, null) as t(id, name, at)")
    TB.write_table(df.coalesce(1), str(tmp_path / "csv"), "csv")
    back = TB.read_csv(spark, str(tmp_path / "csv"), schema)
    assert sorted(back.collect()) == sorted(df.collect())
    assert TB.read_csv(spark, str(tmp_path / "csv")).columns == ["id", "name", "at"]
    assert TB.bounded_scan(back, 1).count() == 1
    TB.write_table(df, str(tmp_path / "parts"), partition_by=["id"])
    assert spark.read.parquet(str(tmp_path / "parts")).where("id = 2").count() == 1


def test_column_rules(spark):
    df = spark.createDataFrame([], "CustomerId string, Amount double, CountryCode int, FraudResult int, ProviderId int, at timestamp_ntz, Category string")
    assert SC.columns_of_kind(df, "int") == ["CountryCode", "FraudResult", "ProviderId"] and SC.columns_of_kind(df, "datetime") == ["at"]
    assert SC.correlation_columns(df) == ["Amount", "CountryCode", "FraudResult"]
    assert SC.detect_target(df) == "FraudResult" and SC.detect_target(df.drop("FraudResult")) is None
    cats, nums = SC.detect_roles(df, "CustomerId", "at", "FraudResult")
    assert (cats, nums) == (["Category"], ["Amount", "CountryCode"])
    assert SC.id_rule_name(SC.ID_RULES["key_or_id"]) == "key_or_id" and SC.id_rule_name(lambda c: True) is None


def test_small_projections(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 5.0, 1)], "id int, x double, y int")
    x, y = FE.split_xy(df, "y")
    assert x.columns == ["id", "x"] and [r[0] for r in y.collect()] == [0, 1]
    assert [r["x"] for r in FE.fill_constant(df, ["x"]).collect()] == [0.0, 5.0]
    assert [r["id"] for r in SA.head(df, [F.col("id").desc()], 1).collect()] == [2]
    assert SA.arg_max(df, "x", ["id"]).first()["id"] == 2
    assert [r[0] for r in spark.createDataFrame([("1",), ("0",)], "y string").select(SO.label_to_int("y")).collect()] == [1, 0]


def test_customer_aggregates_with_null_and_hot_customers(spark):
    rows = [("A", float(v)) for v in (5, 1, 3, 8)] + [("B", 2.0), ("B", None), ("B", NAN), ("C", None)] + [(None, 7.0)] * 50
    df = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(rows)], "id int, CustomerId string, Amount double")
    for hot in (1_000_000, 2):
        got = {r["CustomerId"]: r for r in FE.customer_aggregates(df, hot_rows=hot).collect()}
        assert set(got) == {"A", "B", "C"}
        assert (got["A"]["median_transaction_amount"], got["A"]["total_transaction_amount"], got["A"]["transaction_count"]) == (4.0, 17.0, 4)
        assert (got["B"]["median_transaction_amount"], got["B"]["transaction_count"], got["B"]["std_transaction_amount"]) == (2.0, 1, 0.0)
        assert got["C"]["median_transaction_amount"] is None and got["C"]["total_transaction_amount"] == 0.0
    joined = FE.with_customer_aggregates(df).collect()
    assert len(joined) == len(rows) and all(r["transaction_count"] is None for r in joined if r["CustomerId"] is None)


def test_outliers_leave_missing_cells_out(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(20), 1000]] + [(NAN,)] * 5 + [(None,)] * 4, "x double")
    r = Q.iqr_outliers(df, ["x"]).first()
    assert (r["n_outliers"], r["min_outlier"], r["max_outlier"], r["mean_outlier"]) == (1, 1000.0, 1000.0, 1000.0)
    assert abs(r["pct_outliers"] - 100 / 30) < 1e-12  # of all rows
    c = Q.outlier_compare(df, ["x"]).first()
    assert (c["iqr_count"], c["z_count"]) == (1, 1) and abs(c["z_pct"] - 100 / 21) < 1e-12
    flags = df.select(Q.iqr_outlier_flag("x", F.lit(0.0), F.lit(10.0)).alias("i"), Q.zscore_flag("x", F.lit(0.0), F.lit(1.0)).alias("z")).where("isnan(x)")
    assert all(not r["i"] and not r["z"] for r in flags.collect())


def test_correlation_of_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, NAN), (3.0, 6.0, 5.0, 1.0)], "a double, b double, c double, d double")
    m = {(r["row"], r["column"]): r["corr"] for r in CR.corr_matrix(df, list("abcd")).collect()}
    assert len(m) == 16 and m["a", "b"] == m["b", "a"] and abs(m["a", "b"] - 1) < 1e-12 and m["a", "c"] is None and m["a", "d"] is None


@pytest.mark.parametrize(("query", "most"), [("corr_matrix", 1), ("top_pairs", 1), ("outlier_compare", 2), ("customer_features_joined", 2), ("iqr_outliers", 2), ("feature_table", 2)])
def test_scans_of_the_plan(spark, query, most):
    import __spark_entry__ as E
    assert scans(E.queries()[query](spark, SF)) <= most


def test_large_inputs_take_more_scans_not_wider_aggregates(spark, monkeypatch):
    monkeypatch.setattr(CR, "MAX_PAIRS", 2)
    df = spark.range(50).select(*[(F.col("id") * k % 7).cast("double").alias(f"c{k}") for k in (1, 2, 3)])
    assert CR.pairs(df, ["c1", "c2", "c3"]).count() == 3
