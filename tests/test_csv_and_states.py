import random
import statistics

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators import profile_state as PS
from riskweave.sources.tables import read_csv_kept

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampNTZType()), T.StructField("amount", T.DoubleType()), T.StructField("kind", T.StringType())])


def test_bad_rows_are_kept_with_their_reasons(spark, tmp_path):
    lines = ["id,at,amount,kind", "1,2024-01-01 10:00:00,1.5,a", "2,2024-01-02 10:00:00,much,b", "", "3,someday,2.5,c", "4,2024-01-04 10:00:00,3.5", "5,,,", "6,2024-01-06 10:00:00, 4.5 ,\"x, y\"",
             "x7,never,no,d", "8,2024-01-08 10:00:00,1,e,extra"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    good, bad = read_csv_kept(spark, str(tmp_path / "t.csv"), SCHEMA)
    assert good.schema.simpleString() == SCHEMA.simpleString()
    assert [(r["id"], r["amount"], r["kind"]) for r in good.orderBy("id").collect()] == [(1, 1.5, "a"), (5, None, None), (6, 4.5, "x, y")]
    got = [(r["record"], r["column"], r["reason"]) for r in bad.orderBy("record").collect()]
    assert got == [(2, "amount", "not a double"), (3, "at", "not a timestamp_ntz"), (4, None, "wrong number of cells"), (7, "id", "not a bigint"), (8, None, "wrong number of cells")]
    text = {r["record"]: r["line"] for r in bad.collect()}
    assert text[2] == lines[2] and text[4] == lines[5] and text[8] == lines[9]
    assert good.count() + bad.count() == len([x for x in lines[1:] if x])


def test_records_are_numbered_over_splits_and_files(spark, tmp_path):
    want = set()
    for f in range(2):
        rows = [f"{i},2024-01-01 00:00:00,{'bad' if i % 997 == f else i},k" for i in range(1, 4001)]
        (tmp_path / f"f{f}.csv").write_text("id,at,amount,kind\n" + "\n".join(rows) + "\n")
        want |= {(f"f{f}.csv", i) for i in range(1, 4001) if i % 997 == f}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        good, bad = read_csv_kept(spark, str(tmp_path), SCHEMA)
        assert {(r["file"].split("/")[-1], r["record"]) for r in bad.collect()} == want
        assert good.count() == 8000 - len(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_merged_states_equal_one_pass(spark):
    rng = random.Random(4)
    rows = [(k % 5, rng.choice([None, float("nan"), rng.gauss(1e6, 1.0), float(rng.randrange(40))]) if k % 5 else None, float(k)) for k in range(4000)]
    df = spark.createDataFrame(rows, "day int, a double, b double")
    state = PS.profile_state(df, ["a", "b"], ["day"])
    got = {r["variable"]: r for r in PS.read_state(PS.merge_state(state)).collect()}
    for c, name in ((1, "a"), (2, "b")):
        v = [r[c] for r in rows if r[c] is not None and r[c] == r[c]]
        r = got[name]
        assert (r["n"], r["missing"], r["min"], r["max"]) == (len(v), len(rows) - len(v), min(v), max(v))
        assert abs(r["mean"] - statistics.fmean(v)) < 1e-9 * abs(r["mean"]) and abs(r["std"] - statistics.stdev(v)) < 1e-9 * r["std"]
        assert abs(r["n_distinct"] - len(set(v))) <= 0.03 * len(set(v))
        for p in (25, 50, 75):
            assert abs(sum(x <= r[f"q{p}"] for x in v) / len(v) - p / 100) < 0.02 or sum(x < r[f"q{p}"] for x in v) / len(v) <= p / 100 <= sum(x <= r[f"q{p}"] for x in v) / len(v)
    # a day that comes again replaces its row; merging in two steps gives the same
    again = state.where("day <> 3").unionByName(PS.profile_state(df.where("day = 3"), ["a", "b"], ["day"]))
    two = PS.merge_state(PS.merge_state(again.withColumn("odd", F.col("day") % 2), ["odd"]))
    for r in PS.read_state(two).collect():
        one = got[r["variable"]]
        assert r["n"] == one["n"] and abs(r["mean"] - one["mean"]) < 1e-9 * abs(one["mean"]) and abs(r["std"] - one["std"]) < 1e-9 * one["std"]
        assert abs(r["n_distinct"] - one["n_distinct"]) <= 0.02 * one["n_distinct"]  # a union depends a little on its order
    empty = PS.read_state(PS.merge_state(PS.profile_state(df.where("day = 0"), ["a"], ["day"]))).first()
    assert (empty["n"], empty["missing"], empty["mean"], empty["std"], empty["q50"]) == (0, 800, None, None, None)
    assert PS.merge_state(state.limit(0)).collect() == []
