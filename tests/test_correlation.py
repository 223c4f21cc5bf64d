import math

import numpy as np
import pandas as pd

from riskweave.operators import correlation as CR


def table(n=3000, k=9, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * 10.0 ** rng.integers(-3, 4, k) + 10.0 ** rng.integers(0, 7, k)
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=n)
    x[rng.random((n, k)) < 0.2] = np.nan
    return pd.DataFrame(x, columns=[f"c{j}" for j in range(k)])


def test_equals_pairwise_complete_correlation(spark):
    pdf = table()
    pdf["flat"] = 0.1
    pdf["nothing"] = np.nan
    pdf["flat_where_c0"] = np.where(pdf["c0"].isna(), np.arange(len(pdf)) * 1.0, 1e9 + 0.1)
    df = spark.createDataFrame(pdf).repartition(5)
    want = pdf.corr(min_periods=1)
    got = {(r["row"], r["column"]): r["corr"] for r in CR.corr_matrix(df, list(pdf.columns)).collect()}
    assert len(got) == len(pdf.columns) ** 2
    for (a, b), r in got.items():
        if "flat" in (a, b) or "nothing" in (a, b) or {a, b} == {"c0", "flat_where_c0"}:
            assert r is None, (a, b)
        else:
            assert abs(r - want.loc[a, b]) < 1e-7, (a, b)  # columns up to 1e6 with a spread of 1e-3


def test_infinite_values_and_few_rows(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, float("inf"), 6.0), (3.0, 1.0, None), (4.0, 7.0, 8.0)]
    got = {(r["feature_1"], r["feature_2"]): r["corr"] for r in CR.pairs(spark.createDataFrame(rows, "a double, b double, c double")).collect()}
    assert got["a", "b"] is None or math.isnan(got["a", "b"])
    assert abs(got["a", "c"] - np.corrcoef([1, 2, 4], [5, 6, 8])[0, 1]) < 1e-12
    empty = spark.createDataFrame([], "a double, b double")
    assert [r["corr"] for r in CR.pairs(empty).collect()] == [None] and CR.pairs(empty, ["a"]).collect() == []


def test_two_hundred_columns_take_two_scans(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(400, 200)), columns=[f"c{j}" for j in range(200)])
    group = "wide-corr"
    spark.sparkContext.setJobGroup(group, group)
    out = CR.pairs(spark.createDataFrame(pdf), list(pdf.columns))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext._jsc.clearJobGroup()
    got = np.array([r["corr"] for r in out.orderBy("i", "j").collect()])
    assert jobs <= 4 and len(got) == 199 * 100  # a scan each, and a shuffle stage under adaptive execution
    assert np.allclose(got, np.corrcoef(pdf.to_numpy().T)[np.triu_indices(200, 1)], atol=1e-10)
