import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import segments as SG
from riskweave.operators import splits as SP

GROUPS = [(0, (0, 10), (20, 50), (50000, 100000)), (1, (60, 90), (1, 5), (100, 5000)),
          (2, (20, 40), (5, 15), (10000, 30000))]


def rfm_fixture(spark, with_cluster=True):
    rng = random.Random(42)
    rows = []
    for cid, r, f, m in GROUPS:
        for i in range(10):
            rows.append((f"C{cid}{i}", float(rng.uniform(*r)), float(rng.uniform(*f)), float(rng.uniform(*m)), cid))
    df = spark.createDataFrame(rows, "CustomerId string, recency double, frequency double, monetary double, cluster int")
    return df if with_cluster else df.drop("cluster")


def test_worst_cluster_is_the_planted_one(spark):
    df = rfm_fixture(spark)
    stats = SG.cluster_stats(df, full=False)
    scores = SG.engagement_scores(stats)
    assert SG.high_risk_cluster(scores).first()[0] == 1
    summary = SG.high_risk_summary(scores).collect()
    assert sum(r["is_high_risk"] for r in summary) == 1
    lab = SG.label_customers(df, SG.high_risk_cluster(scores))
    assert {(r["cluster"], r["is_high_risk"]) for r in lab.collect()} == {(0, 0), (1, 1), (2, 0)}
    assert SG.label_customers(df, 2).where("is_high_risk = 1").count() == 10


def test_full_stats_include_empty_clusters(spark):
    df = rfm_fixture(spark)
    st = SG.cluster_stats(df, k=4).orderBy("cluster_id").collect()
    assert [r["n_customers"] for r in st] == [10, 10, 10, 0]
    assert abs(sum(r["pct_customers"] for r in st[:3]) - 100.0) < 1e-9


def test_label_transactions_one_label_per_customer(spark):
    df = rfm_fixture(spark)
    lab = SG.label_customers(df, 1)
    tx = spark.createDataFrame([("C10", "T1", 5.0), ("C10", "T2", 6.0), ("X", "T3", 1.0)],
                               "CustomerId string, TransactionId string, Amount double")
    out = {r["TransactionId"]: r["is_high_risk"] for r in SG.label_transactions(tx, lab).collect()}
    assert out == {"T1": 1, "T2": 1, "T3": 0}


def test_several_labels_of_a_customer(spark):
    lab = spark.createDataFrame([("A", 0, 2), ("A", 1, 1), ("B", 0, 0)], "CustomerId string, is_high_risk int, cluster int")
    tx = spark.createDataFrame([("A", "T1"), ("B", "T2")], "CustomerId string, TransactionId string")
    assert {(r["TransactionId"], r["is_high_risk"], r["cluster"]) for r in SG.label_transactions(tx, lab).collect()} == {("T1", 1, 1), ("T2", 0, 0)}


def test_nearest_of_given_centres(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (9.0, 0.0, 0.0), (5.0, 0.0, 0.0), (None, 1.0, 1.0)], "recency double, frequency double, monetary double")
    got = [(r["cluster"], r["cost"]) for r in SG.assign_nearest(df, [[0, 0, 0], [10, 0, 0]]).collect()]
    assert got == [(0, 0.0), (1, 1.0), (0, 25.0), (None, None)]


def test_kmeans_segmenter(spark):
    df = rfm_fixture(spark, with_cluster=False)
    seg = SG.CustomerSegmenter(3, "standardize", 42, n_init=3, max_iter=50).fit(df)
    pred = seg.predict(df)
    assert pred.select("cluster").distinct().count() == 3
    assert seg.inertia() > 0
    assert seg.centroids().count() == 3
    again = SG.CustomerSegmenter(3, "standardize", 42, n_init=3, max_iter=50).fit_predict(df)
    a = {r["CustomerId"]: r["cluster"] for r in pred.collect()}
    b = {r["CustomerId"]: r["cluster"] for r in again.collect()}
    assert a == b
    with pytest.raises(ValueError, match="not been fitted"):
        SG.CustomerSegmenter().predict(df)
    # every row is with its nearest centre, and the cost is the sum of the squared distances
    from riskweave.operators.prepare import apply_scaler
    scaled = apply_scaler(pred.select(*SG.RFM, "cluster"), seg.scale_params)
    centres = seg.centres
    near = SG.assign_nearest(scaled.withColumnRenamed("cluster", "given"), centres).collect()
    assert all(r["given"] == r["cluster"] for r in near) and abs(sum(r["cost"] for r in near) - seg.inertia()) < 1e-6
    assert abs(seg.inertia(df) - seg.inertia()) < 1e-6
    nan = df.withColumn("recency", F.when(F.col("CustomerId") == "C00", float("nan")).otherwise(F.col("recency")))
    with pytest.raises(ValueError, match="missing"):
        SG.CustomerSegmenter(n_init=1).fit(nan)
    bad = df.withColumn("recency", F.when(F.col("CustomerId") == "C00", None).otherwise(F.col("recency")))
    with pytest.raises(ValueError, match="missing"):
        SG.CustomerSegmenter(n_init=1).fit(bad)


def _xy(spark, n=100, pos=20):
    return spark.createDataFrame([(i, float(i), float(i % 7), 1 if i < pos else 0) for i in range(n)],
                                 "id long, feature1 double, feature2 double, y int")


def test_split_exact_sizes_and_stratified(spark):
    df = _xy(spark)
    s = SP.assign_split(df, ["id"], "y", 0.2, None, 42)
    counts = {(r["split"], r["y"]): r["count"] for r in s.groupBy("split", "y").count().collect()}
    assert counts == {("test", 1): 4, ("test", 0): 16, ("train", 1): 16, ("train", 0): 64}
    again = SP.assign_split(df.repartition(5), ["id"], "y", 0.2, None, 42)
    assert ({r["id"] for r in s.where("split='test'").collect()}
            == {r["id"] for r in again.where("split='test'").collect()})
    three = SP.assign_split(df, ["id"], "y", 0.2, 0.1, 42)
    sizes = {r["split"]: r["count"] for r in three.groupBy("split").count().collect()}
    assert sizes == {"train": 70, "val": 10, "test": 20}
    with pytest.raises(ValueError):
        SP.assign_split(df, ["id"], "y", 1.5)


def test_ordered_split_and_summary(spark):
    df = _xy(spark)
    s = SP.assign_split(df, ["id"], None, 0.2, stratify=False, order_col="id")
    assert {r["id"] for r in s.where("split='test'").collect()} == set(range(80, 100))
    summ = {r["split"]: r for r in SP.split_summary(s, "y").collect()}
    assert summ["train"]["class_1"] == 20 and summ["test"]["class_1"] == 0
    drift = {r["split"]: r["balanced"] for r in SP.class_drift(s, "y").collect()}
    assert drift == {"train": False, "test": False}


def test_folds_balanced(spark):
    f = SP.fold_column(_xy(spark), ["id"], "y", 5)
    c = {(r["fold"], r["y"]): r["count"] for r in f.groupBy("fold", "y").count().collect()}
    assert all(c[(k, 1)] == 4 and c[(k, 0)] == 16 for k in range(5))


def test_save_and_load_splits(spark, tmp_path):
    s = SP.assign_split(_xy(spark), ["id"], "y", 0.2)
    SP.save_splits(s, str(tmp_path / "splits"))
    assert SP.load_split(spark, str(tmp_path / "splits"), "test").count() == 20
    assert SP.load_split(spark, str(tmp_path / "splits"), "train").count() == 80


def test_null_labels_are_a_class(spark):
    df = _xy(spark).withColumn("y", F.when(F.col("id") >= 20, F.when(F.col("id") < 60, 0)).otherwise(1))
    c = {(r["split"], r["y"]): r["count"] for r in SP.assign_split(df, ["id"], "y", 0.2).groupBy("split", "y").count().collect()}
    assert c[("test", None)] == 8 and c[("test", 0)] == 8 and c[("test", 1)] == 4


@pytest.mark.parametrize("kind", ["timestamp_ntz", "date", "string", "long"])
def test_order_by_any_type(spark, kind):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 10).cast("int"))  # ten rows share a value
    df = _xy(spark).withColumn("o", (F.col("id") % 10 if kind == "long" else day).cast(kind))
    s = SP.assign_split(df.repartition(6), ["id"], None, 0.25, 0.15, stratify=False, order_col="o").collect()
    order = sorted(s, key=lambda r: (r["o"], r["id"]))
    assert [r["split"] for r in order] == ["train"] * 60 + ["val"] * 15 + ["test"] * 25


def test_load_split_save(spark, tmp_path):
    _xy(spark).coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    counts = SP.load_split_save(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["id"], "y", fmt="csv", test_size=0.2, val_size=0.1)
    assert counts == {"train": 70, "val": 10, "test": 20}
    assert SP.load_split(spark, str(tmp_path / "out"), "val").count() == 10
    with pytest.raises(ValueError, match="Missing required columns"):
        SP.load_split_save(spark, str(tmp_path / "in"), str(tmp_path / "out2"), ["id"], "no_such", fmt="csv")


def test_restarts_side_by_side_equal_single_ones(spark):
    """Every restart as a plain loop gives it; the scans are those of the longest restart and one for the costs."""
    import numpy as np
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.4, (70, 2)) for m in ((0, 0), (3, 1), (0, 4))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(3)
    starts = [SG.starting_centres(x, 3, seed) for seed in range(4)] + [np.array([[0.0, 0.0], [3.0, 1.0], [99.0, 99.0]])]
    got = SG.lloyd(df, ["a", "b"], starts, 50)
    for start, r in zip(starts, got, strict=True):
        c, n = np.array(start, dtype=float), 0
        while True:
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(3)])
            n += 1
            if np.array_equal(new, c) or np.allclose(new, c, atol=1e-15):
                break
            c = new
        own = ((x[:, None] - new[None]) ** 2).sum(2)
        assert np.allclose(r["centres"], new) and abs(r["cost"] - own.min(1).sum()) < 1e-9 and sum(r["sizes"]) == len(x) and abs(r["iterations"] - n) <= 2
    assert got[4]["sizes"][2] == 0 and got[4]["centres"][2].tolist() == [99.0, 99.0]
    assert SG.lloyd(df, ["a", "b"], starts[:1], 0)[0]["iterations"] == 0
