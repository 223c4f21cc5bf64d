import pytest
from pyspark.sql import functions as F

from tests.conftest import SF


def test_stream_rfm_equals_batch_rfm(spark):
    import __spark_entry__ as E
    q = E.queries()
    streamed = {r["o_custkey"]: tuple(r)[1:] for r in q["stream_rfm"](spark, SF).collect()}
    batch = {r["o_custkey"]: tuple(r)[1:] for r in q["rfm_metrics"](spark, SF).collect()}
    assert streamed == batch and len(batch) > 0


OPTIONS = [dict(imputation="median", encoding="onehot", scaling="standardize"), dict(imputation="mode", encoding="label", scaling="robust"),
           dict(imputation="remove", encoding="onehot", scaling=None), dict(imputation="knn", encoding="label", scaling="normalize", key_col="o_orderkey"),
           dict(imputation="mean", encoding="onehot", scaling="standardize", use_woe=True, target_col="is_f")]


@pytest.mark.parametrize("options", OPTIONS, ids=lambda o: "-".join(str(v) for v in o.values()))
def test_processor_save_load_roundtrip(spark, tmp_path, options):
    from riskweave.operators.processor import FeatureProcessor
    o = spark.read.parquet(f"{SF}/orders.parquet").withColumn("is_f", (F.col("o_orderstatus") == "F").cast("int")).limit(600)
    o = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 40 != 0, F.col("o_totalprice")))
    fp = FeatureProcessor("o_custkey", "o_orderdate", "o_totalprice", id_rule="key_or_id", keep_cols=("o_orderkey",), **options)
    direct = fp.fit_transform(o)
    fp.save(str(tmp_path / "proc"))
    loaded = FeatureProcessor.load(spark, str(tmp_path / "proc"))
    out = loaded.transform(o)
    assert out.columns == direct.columns and len(loaded.feature_names) == len(fp.feature_names)
    assert sum(c.endswith("_woe") for c in out.columns) == (5 if options.get("use_woe") else 0)
    rows = [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()) for d in (direct, out, fp.transform(o))]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 500


def test_processor_options_that_cannot_work(spark, tmp_path):
    from riskweave.operators.processor import FeatureProcessor
    with pytest.raises(ValueError, match="key_col"):
        FeatureProcessor(imputation="knn")
    own = FeatureProcessor("o_custkey", "o_orderdate", "o_totalprice", id_rule=lambda c: "key" in c)
    own.fit(spark.read.parquet(f"{SF}/orders.parquet"))
    own.save(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="id rule"):
        FeatureProcessor.load(spark, str(tmp_path / "p"))
    assert FeatureProcessor.load(spark, str(tmp_path / "p"), id_rule=own.id_rule).num_cols == own.num_cols


def test_requests_on_a_stream(spark):
    from riskweave.streaming import scoring as ST
    rows = [('{"id": "a", "features": [1, 2]}',), ('{"id": "b", "features": [1]}',), ("no json",), ('{"id": "c", "features": [1, null]}',), (None,),
            ('{"id": "d", "features": ["x", 2]}',), ('{"id": "e", "features": ["1", "2"]}',), ('{"id": "f", "features": [1, NaN]}',), ('{"id": "g", "features": [{"a": 1}, true]}',),
            ('{"id": "h", "features": []}',), ('{"id": "i", "features": ["x"]}',)]
    out = {r["id"]: r for r in ST.score_requests(spark.createDataFrame(rows, "value string"), [1.0, -1.0], 0.0).collect()}
    assert abs(out["a"]["probability"] - 0.2689414213699951) < 1e-12 and out["a"]["decision"] == "approve" and out["a"]["reject_reason"] is None
    assert out["b"]["reject_reason"] == "expected 2 features, got 1" and out["b"]["decision"] is None and "missing" in out["c"]["reject_reason"]
    assert out[None]["reject_reason"] == "expected 2 features, got 0"
    assert out["d"]["reject_reason"] == "no number at feature 0" and out["g"]["reject_reason"] == "no number at feature 0, 1"
    assert out["e"]["probability"] == out["a"]["probability"] and out["f"]["reject_reason"] == "missing value in features"
    assert out["h"]["reject_reason"] == "expected 2 features, got 0" and out["i"]["reject_reason"] == "expected 2 features, got 1"


def test_unknown_customers_do_not_end_the_stream(spark, tmp_path):
    from riskweave.operators import models as MO
    from riskweave.streaming import scoring as ST
    train = spark.range(60).selectExpr("id", "id % 7 * 1.0 AS amount", "id % 5 * 1.0 AS avg_amount", "cast(id % 7 > 3 AS int) AS y")
    model = MO.train_model("logistic_regression", train, ["amount", "avg_amount"], "y")
    static = spark.createDataFrame([("a", 1.0), ("b", None), ("c", float("nan"))], "customer string, avg_amount double")
    rows = [(1, "a", 2.0), (2, "nobody", 2.0), (3, None, 2.0), (4, "b", 2.0), (5, "c", 2.0), (6, "a", None)]
    spark.createDataFrame(rows, "id long, customer string, amount double").write.parquet(str(tmp_path / "in"))
    stream = ST.read_stream(spark, str(tmp_path / "in"), "id long, customer string, amount double", "*.parquet")
    ST.start_scoring(ST.score_stream(stream, static, "customer", model, ["id", "customer", "amount"]), str(tmp_path / "out"), "unknown_customers", str(tmp_path / "ck")).awaitTermination()
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {i: r["reject_reason"] for i, r in got.items()} == {1: None, 2: "unknown customer", 3: "unknown customer", 4: "missing value in features", 5: "missing value in features", 6: "missing value in features"}
    assert all((got[i]["prediction"] is None) == (i > 1) and (got[i]["risk_level"] is None) == (i > 1) for i in got) and got[6]["amount"] is None and got[1]["amount"] == 2.0


def serve(spark, tmp_path, store, rows, name, **kw):
    from riskweave.operators import scoring as SC
    from riskweave.streaming import scoring as ST
    if rows:
        spark.createDataFrame(rows, "id long, features array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ST.read_stream(spark, str(tmp_path / "in"), "id long, features array<double>", "*.parquet", max_files_per_trigger=1)
    import json
    loads = []
    q = ST.start_serving(stream, store, "card", str(tmp_path / "out"), lambda m, d: SC.linear_score(d, *m), lambda path: loads.append(path) or json.loads(path), name=name,
                         checkpoint=str(tmp_path / "ck"), **kw)
    q.awaitTermination()
    return loads


def test_serving_follows_promotions_and_replays(spark, tmp_path):
    import json
    import math
    from riskweave.operators.runs import RunStore
    store = RunStore(spark, str(tmp_path / "store"), "s")
    cards = [([1.0], 0.0), ([-2.0], 0.5)]
    for card in cards:
        store.register_model("card", "run", json.dumps(card))
    store.transition_stage("card", 1, "Production")
    serve(spark, tmp_path, store, [(1, [0.3]), (2, [float("nan")])], "serve_one")
    store.transition_stage("card", 2, "Production")
    serve(spark, tmp_path, store, [(3, [0.3])], "serve_two")
    read = lambda: {r["id"]: (r["model_version"], r["probability"]) for r in spark.read.parquet(str(tmp_path / "out" / "scores")).collect()}
    p = lambda z: 1 / (1 + math.exp(-z))
    want = {1: (1, p(0.3)), 2: (1, None), 3: (2, p(-0.1))}
    got = read()
    assert {i: v for i, (v, _) in got.items()} == {i: v for i, (v, _) in want.items()} and got[2][1] is None
    assert all(abs(got[i][1] - want[i][1]) < 1e-12 for i in (1, 3))
    # the last batch failed before it was committed: its commit is gone, version 1 is back, the batch runs again by its note
    for f in (tmp_path / "ck" / "commits").glob("*1*"):
        f.unlink()
    store.transition_stage("card", 1, "Archived")
    loads = serve(spark, tmp_path, store, None, "serve_again")
    assert loads == [json.dumps(cards[1])] and read() == got


def test_rfm_sink_rewrites_touched_buckets_only(spark, tmp_path):
    from riskweave.streaming import scoring as ST
    o = spark.read.parquet(f"{SF}/orders.parquet")
    schema, sink = o.schema, str(tmp_path / "sink")

    def run(name):
        stream = ST.read_stream(spark, str(tmp_path / "in"), schema, "*.parquet", max_files_per_trigger=1)
        ST.start_incremental_rfm(ST.incremental_rfm(stream, "o_custkey", "o_orderdate", "o_totalprice"), sink, "o_custkey", name, str(tmp_path / "ck")).awaitTermination()

    o.limit(0).coalesce(1).write.parquet(str(tmp_path / "none"))
    (tmp_path / "in").mkdir()
    run("rfm_none")
    assert ST.read_rfm_state(spark, sink, "o_custkey").collect() == []
    o.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run("rfm_all")
    few = [r[0] for r in o.select("o_custkey").distinct().orderBy("o_custkey").limit(10).collect()]
    more = o.where(F.col("o_custkey").isin(few)).withColumn("o_totalprice", F.lit(1.0))
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run("rfm_few")
    last = ST._manifests(spark, sink)[-1]
    named = ST._named(spark, sink, last)
    assert 1 <= sum(v == last for v in named.values()) <= 10 and len(named) > 40
    assert len(list((tmp_path / "sink" / "data" / f"batch={last}").glob("bucket=*"))) <= 10
    state = {r["o_custkey"]: r for r in ST.read_rfm_state(spark, sink, "o_custkey").collect()}
    assert len(state) == o.select("o_custkey").distinct().count()
    assert sum(r["frequency"] for r in state.values()) == o.count() + more.count()
    # the last batch once more, as after a failure before its commit
    for f in (tmp_path / "ck" / "commits").glob(f"*{last}*"):
        f.unlink()
    run("rfm_replay")
    again = {r["o_custkey"]: r for r in ST.read_rfm_state(spark, sink, "o_custkey").collect()}
    assert again == state and ST._named(spark, sink, last) == named
    # a third batch: files that neither of the last two manifests names are gone
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run("rfm_third")
    done = ST._manifests(spark, sink)
    assert done == [last, last + 1] and sum(r["frequency"] for r in ST.read_rfm_state(spark, sink, "o_custkey").collect()) == o.count() + 2 * more.count()


def test_scan_pushdown_and_pruning(spark):
    from riskweave.sources.tables import read_table
    df = read_table(spark, SF, "lineitem").where(F.col("l_quantity") > 10).select("l_returnflag")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
