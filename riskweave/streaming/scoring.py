"""Streaming scoring (X7) and incremental RFM.

Arriving transactions are read as a file stream, joined (stream-static,
left) to the current customer feature table, scored by the fitted model and
written to a file sink.  The query is stateless, so it needs no watermark;
its progress lives in a checkpoint under the cluster's shared checkpoint
folder, so a restarted or re-scheduled job resumes where it stopped.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.session import ensure_checkpoint_dir
from riskweave.sources.records import publish, read_text


def _checkpoint(spark: SparkSession, name: str, checkpoint: str | None) -> str:
    return checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def read_stream(spark: SparkSession, source_dir: str, schema, file_glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("parquet").schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def input_columns(model) -> list[str]:
    """The columns that a fitted pipeline assembles into its features."""
    from pyspark.ml.feature import VectorAssembler
    return [c for stage in model.stages if isinstance(stage, VectorAssembler) for c in stage.getInputCols()]


def score_rows(joined: DataFrame, model, keep_cols: list[str], known: str | None = None, low: float = 0.30, high: float = 0.60) -> DataFrame:
    """Score rows that hold the model's inputs, batch or stream. Every row comes back: one whose ``known`` column is NULL or whose
    inputs have a NULL or NaN has a ``reject_reason`` and no score; zeros go through the model in its place."""
    from pyspark.ml.functions import vector_to_array
    from riskweave.operators.scoring import risk_level, with_risk_bands
    cols = input_columns(model)
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    reason = F.when(missing, F.lit("missing value in features"))
    if known:
        reason = F.when(F.col(known).isNull(), F.lit("unknown customer")).otherwise(reason)
    # inputs may be wanted in the result: they go through the model under names of their own and come back
    own = {c: f"_own_{k}" for k, c in enumerate(cols)}
    marked = joined.withColumn("reject_reason", reason).withColumnsRenamed(own)
    good = F.col("reject_reason").isNull()
    marked = marked.withColumns({c: F.when(good, F.col(o).cast("double")).otherwise(F.lit(0.0)) for c, o in own.items()})
    out = model.transform(marked)
    prob = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction").cast("double")
    scored = good & ~F.isnan(prob)
    out = out.withColumns({"_p": F.when(scored, prob), "_y": F.when(scored, F.col("prediction").cast("int"))})
    out = out.drop("probability", "prediction", *cols).withColumnsRenamed({"_p": "probability", "_y": "prediction"} | {o: c for c, o in own.items()})
    out = with_risk_bands(out.withColumn("risk_level", risk_level()), "probability", low, high)
    return out.select(*keep_cols, "prediction", "probability", "risk_level", "risk_band", "decision", "reject_reason")


def score_stream(stream: DataFrame, customer_features: DataFrame, customer_col: str, model,
                 keep_cols: list[str], low: float = 0.30, high: float = 0.60) -> DataFrame:
    """Stream-static left join + model transform + risk bands (lazy); a customer without features is rejected, not scored."""
    static = customer_features.withColumn("_known", F.lit(True))
    return score_rows(stream.join(static, customer_col, "left"), model, keep_cols, "_known", low, high)


def parse_requests(stream: DataFrame, payload_col: str = "value") -> DataFrame:
    """JSON request rows ``{"id": ..., "features": [...]}`` to ``id``, ``features`` (numbers, also written as text) and ``not_numbers``, the
    places of what is neither a number nor null; a payload that is no such JSON has NULLs."""
    body = F.from_json(F.col(payload_col).cast("string"), "id STRING, features ARRAY<STRING>", {"mode": "PERMISSIVE"})
    given = F.col("_body.features")
    numbers = F.transform(given, lambda x: F.btrim(x, F.lit('"')).try_cast("double"))  # a bare NaN is read with quotes
    wrong = F.filter(F.sequence(F.lit(1), F.size(given)), lambda k: F.element_at(given, k).isNotNull() & F.element_at(numbers, k).isNull())
    wrong = F.when(F.size(given) > 0, F.transform(wrong, lambda k: k - 1))
    return stream.withColumn("_body", body).withColumns({"id": F.col("_body.id"), "features": numbers, "not_numbers": wrong}).drop("_body")


def score_requests(stream: DataFrame, coefficients: list[float], intercept: float, payload_col: str = "value") -> DataFrame:
    """X7 for requests that carry their features: type and width check, score and bands on the stream; every request has a row."""
    from riskweave.operators.scoring import linear_score, with_risk_bands
    scored = with_risk_bands(linear_score(parse_requests(stream, payload_col), coefficients, intercept))
    wrong = F.when(F.size("not_numbers") > 0, F.concat(F.lit("no number at feature "), F.array_join("not_numbers", ", ")))
    whole = F.size("features") == len(coefficients)  # a wrong width is named first
    return scored.select("id", "prediction", "probability", "risk_level", "risk_band", "decision", F.when(whole, F.coalesce(wrong, "reject_reason")).otherwise(F.col("reject_reason")).alias("reject_reason"))


def start_serving(stream: DataFrame, store, model_name: str, sink_dir: str, score, load=None, stage: str = "Production", name: str = "serving",
                  checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """X7 with X8: every micro-batch is scored by the model version that is in ``stage`` when it starts.

    ``score(model, rows)`` gives the scored rows, ``load(path)`` a model (default: a saved pipeline), once per version. The version is
    noted before a batch is scored and written beside each score: a batch that is run again, after a failure, uses the version noted
    for it and writes the same rows again, whatever has been promoted since."""
    from pyspark.ml import PipelineModel
    spark = stream.sparkSession
    load, loaded = load or PipelineModel.load, {}

    def write(batch: DataFrame, batch_id: int) -> None:
        note = f"{sink_dir}/notes/{batch_id:012d}.json"
        version, path = store.current(model_name, stage)
        if not publish(spark, note, json.dumps({"batch": batch_id, "version": version, "path": path})):
            noted = json.loads(read_text(spark, note))
            version, path = noted["version"], noted["path"]
        if version not in loaded:
            loaded[version] = load(path)
        score(loaded[version], batch).withColumn("model_version", F.lit(version)).write.mode("overwrite").parquet(f"{sink_dir}/scores/batch={batch_id}")

    w = stream.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", _checkpoint(spark, name, checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_scoring(scored: DataFrame, sink_dir: str, name: str = "risk_scores", checkpoint: str | None = None,
                  available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    spark = scored.sparkSession
    w = (scored.writeStream.format(fmt).outputMode("append").queryName(name)
         .option("checkpointLocation", _checkpoint(spark, name, checkpoint)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink_dir)


def incremental_rfm(stream: DataFrame, customer_col: str, datetime_col: str, amount_col: str) -> DataFrame:
    """Running per-customer last time, count and |amount| sum (update mode);
    recency is derived at read time against the chosen snapshot."""
    return (stream.where(F.col(customer_col).isNotNull()).groupBy(customer_col).agg(
        F.max(datetime_col).cast("timestamp_ntz").alias("last_ts"), F.count(F.lit(1)).alias("frequency"),
        F.coalesce(F.sum(F.abs(F.col(amount_col).cast("double"))), F.lit(0.0)).alias("monetary")))


def start_incremental_rfm(state: DataFrame, sink_dir: str, customer_col: str, name: str = "rfm_state",
                          checkpoint: str | None = None, available_now: bool = True, buckets: int = 64) -> StreamingQuery:
    """Run the stateful aggregate; the sink holds one row per customer, in ``buckets`` by a hash of the customer.

    Each micro-batch writes new files for the buckets it touches only, then a manifest that names every bucket's current files; a
    reader sees the batches whose manifest is finished. A batch that is run again writes the same files again, from the manifest
    before it. Files that neither of the last two manifests names are removed."""
    spark = state.sparkSession
    spark.createDataFrame([], state.schema).write.mode("ignore").parquet(f"{sink_dir}/empty")

    def write(batch: DataFrame, batch_id: int) -> None:
        done = [v for v in _manifests(spark, sink_dir) if v < batch_id]
        before = _named(spark, sink_dir, done[-1]) if done else {}
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(customer_col), F.lit(buckets)).cast("int")).persist()
        try:
            touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most the number of buckets
            old = [f"{sink_dir}/data/batch={before[b]}/bucket={b}" for b in touched if b in before]
            if old:
                kept = spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", F.pmod(F.xxhash64(customer_col), F.lit(buckets)).cast("int"))
                new = rows.unionByName(kept.join(rows.select(customer_col), customer_col, "left_anti"))
            else:
                new = rows
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{sink_dir}/data/batch={batch_id}")
        finally:
            rows.unpersist()
        now = before | {b: batch_id for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{sink_dir}/manifest/batch={batch_id}")
        if len(done) > 1:  # the manifest before the last two goes, with the files that only it named
            for b, v in _named(spark, sink_dir, done[-2]).items():
                if v not in (before.get(b), now.get(b)):
                    _path(spark, f"{sink_dir}/data/batch={v}/bucket={b}", delete=True)
            _path(spark, f"{sink_dir}/manifest/batch={done[-2]}", delete=True)

    w = (state.writeStream.outputMode("update").queryName(name).foreachBatch(write)
         .option("checkpointLocation", _checkpoint(spark, name, checkpoint)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _path(spark: SparkSession, path: str, delete: bool = False):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if delete:
        fs.delete(p, True)
    return fs, p


def _manifests(spark: SparkSession, sink_dir: str) -> list[int]:
    """The batches whose manifest is finished, ascending."""
    fs, top = _path(spark, f"{sink_dir}/manifest")
    if not fs.exists(top):
        return []
    jvm = spark._jvm.org.apache.hadoop.fs
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(top) if fs.exists(jvm.Path(s.getPath(), "_SUCCESS")))


def _named(spark: SparkSession, sink_dir: str, batch: int) -> dict[int, int]:
    """Each bucket's batch in a manifest: one row per bucket."""
    return {r.bucket: r.batch for r in spark.read.schema("bucket int, batch long").parquet(f"{sink_dir}/manifest/batch={batch}").collect()}


def read_rfm_state(spark: SparkSession, sink_dir: str, customer_col: str, snapshot_col_value=None) -> DataFrame:
    """The current row per customer with recency against the snapshot (default: the latest transaction time seen); no rows
    before the first batch."""
    from riskweave.functions.exprs import floor_days_between
    empty = spark.read.parquet(f"{sink_dir}/empty")
    done = _manifests(spark, sink_dir)
    named = _named(spark, sink_dir, done[-1]) if done else {}
    latest = spark.read.schema(empty.schema).parquet(*[f"{sink_dir}/data/batch={v}/bucket={b}" for b, v in named.items()]) if named else empty
    snap = (latest.agg(F.max("last_ts").alias("_snap")) if snapshot_col_value is None
            else spark.range(1).select(F.lit(snapshot_col_value).cast("timestamp_ntz").alias("_snap")))
    return (latest.crossJoin(F.broadcast(snap))  # one row
            .select(customer_col, floor_days_between("_snap", "last_ts").alias("recency"), "frequency", "monetary"))
