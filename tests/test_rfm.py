import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave.operators.rfm import rfm, rfm_summary, snapshot_date
from riskweave.sources.schemas import SchemaError

S = dt.datetime(2019, 2, 13)
SCHEMA = "CustomerId string, TransactionStartTime timestamp_ntz, Amount double"


def _rows(df, key="CustomerId"):
    return {r[key]: (r["recency"], r["frequency"], r["monetary"]) for r in df.collect()}


def test_basic_values(spark):
    tx = spark.createDataFrame([("C1", S - dt.timedelta(days=10), 100.0), ("C1", S - dt.timedelta(days=5), 200.0),
                                ("C2", S - dt.timedelta(days=20), 150.0)], SCHEMA)
    assert _rows(rfm(tx, snapshot=S)) == {"C1": (5, 2, 300.0), "C2": (20, 1, 150.0)}


def test_refunds_use_absolute_amount(spark):
    tx = spark.createDataFrame([("C1", S - dt.timedelta(days=5), 100.0), ("C1", S - dt.timedelta(days=3), -50.0)],
                               SCHEMA)
    assert _rows(rfm(tx, snapshot=S)) == {"C1": (3, 2, 150.0)}


def test_auto_snapshot_is_max_timestamp(spark):
    tx = spark.createDataFrame([("C1", S - dt.timedelta(days=10), 100.0), ("C1", S - dt.timedelta(days=5), 200.0),
                                ("C2", S - dt.timedelta(days=20), 150.0)], SCHEMA)
    out = rfm(tx, keep_snapshot=True)
    assert _rows(out)["C1"][0] == 0
    assert out.first()["snapshot_date"] == S - dt.timedelta(days=5)
    assert snapshot_date(tx, "TransactionStartTime").first()[0] == S - dt.timedelta(days=5)


def test_many_customers(spark):
    rows = [(f"C{i}", S - dt.timedelta(days=2 * j), 100.0 * (j + 1)) for i in range(10) for j in range(5)]
    out = _rows(rfm(spark.createDataFrame(rows, SCHEMA), snapshot=S))
    assert len(out) == 10 and all(v == (0, 5, 1500.0) for v in out.values())


def test_missing_column_raises(spark):
    tx = spark.createDataFrame([("C1", 1.0)], "CustomerId string, Amount double")
    with pytest.raises(SchemaError, match="Missing required columns"):
        rfm(tx)


def test_text_dates_are_parsed(spark):
    tx = spark.createDataFrame([("C1", "2019-02-08", 10.0), ("C1", "2019-02-10", 20.0)],
                               "CustomerId string, TransactionStartTime string, Amount double")
    assert _rows(rfm(tx, snapshot=S))["C1"][0] == 3


def test_custom_names_and_negative_fraction_floors(spark):
    tx = spark.createDataFrame([("A", dt.datetime(2019, 2, 13, 12), 1.0)], "cust_id string, ts timestamp_ntz, amt double")
    out = rfm(tx, "cust_id", "ts", "amt", snapshot=S).collect()
    # half a day AFTER the snapshot floors to -1, like a floored day difference
    assert out[0]["cust_id"] == "A" and out[0]["recency"] == -1


def test_sample_run_and_summary(spark):
    d = dt.timedelta
    tx = spark.createDataFrame([("C1", S - d(30), 100.0), ("C1", S - d(20), 200.0), ("C1", S - d(5), 150.0),
                                ("C2", S - d(15), 300.0), ("C2", S - d(10), 250.0), ("C3", S - d(25), 50.0)], SCHEMA)
    r = rfm(tx, snapshot=S)
    assert _rows(r) == {"C1": (5, 3, 450.0), "C2": (10, 2, 550.0), "C3": (25, 1, 50.0)}
    s = {x["variable"]: x for x in rfm_summary(r).collect()}
    assert s["recency"]["count"] == 3 and s["recency"]["p50"] == 10.0 and s["monetary"]["max"] == 550.0


def test_null_customer_rows_are_skipped(spark):
    tx = spark.createDataFrame([(None, S, 1.0), ("C1", S, 2.0)], SCHEMA)
    assert set(_rows(rfm(tx, snapshot=S))) == {"C1"}
