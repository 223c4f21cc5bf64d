"""Experiment runs and model versions as tables.

A run is one row ``(run_id, run_name, experiment, start_time, params MAP<STRING,STRING>, metrics MAP<STRING,DOUBLE>, tags
MAP<STRING,STRING>)``; versions and stage changes are events, and "current" is the latest event per key (a window).  The
queries are functions of such tables, wherever they come from. ``RunStore`` keeps each record as a file that only one writer can
create: any number of writers may log runs, register versions and change stages at once.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.sources.records import append_numbered, numbers, publish, unbroken

RUN_SCHEMA = ("run_id string, run_name string, experiment string, start_time timestamp_ntz, "
              "params map<string,string>, metrics map<string,double>, tags map<string,string>")
VERSION_SCHEMA = "model_name string, version int, run_id string, model_path string, created timestamp_ntz"
STAGE_SCHEMA = "model_name string, version int, stage string, changed timestamp_ntz, seq long"


# --------------------------------------------------------------------------- queries over run tables
def best_run(runs: DataFrame, metric: str = "test_roc_auc", experiment: str | None = None, ascending: bool = False) -> DataFrame:
    """The best run (of the experiment) that has the metric, as at most one row; the earliest wins a tie."""
    r = runs if experiment is None else runs.where(F.col("experiment") == experiment)
    score = F.col("metrics")[metric]
    return r.where(score.isNotNull() & ~F.isnan(score)).orderBy(score.asc() if ascending else score.desc(), "start_time", "run_id").limit(1)


def compare_runs(runs: DataFrame, run_ids: list[str] | None = None, metric: str = "test_roc_auc", experiment: str | None = None) -> DataFrame:
    """One row per run with a column per metric and param, best first."""
    r = runs if experiment is None else runs.where(F.col("experiment") == experiment)
    if run_ids:
        r = r.where(F.col("run_id").isin(list(run_ids)))
    names = {kind: sorted(x[0] for x in r.select(F.explode(F.map_keys(kind))).distinct().collect()) for kind in ("metrics", "params")}  # column names
    out = r.select("run_id", "run_name", *[F.col(kind)[k].alias(f"{kind}.{k}") for kind in names for k in names[kind]])
    if metric in names["metrics"]:
        out = out.orderBy(F.col(f"`metrics.{metric}`").desc_nulls_last(), "run_id")
    return out


def current_stages(events: DataFrame) -> DataFrame:
    """The latest stage event per (model, version)."""
    w = Window.partitionBy("model_name", "version").orderBy(F.col("seq").desc())
    return events.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_versions(events: DataFrame) -> DataFrame:
    """The newest version currently in each stage of each model."""
    w = Window.partitionBy("model_name", "stage").orderBy(F.col("version").desc())
    return current_stages(events).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# --------------------------------------------------------------------------- store
class RunStore:
    """Runs, versions and stage events below ``root``; ``runs`` reads the store's experiment only.

    A run is a file named by its id; versions (per model) and stage events (over all) are files numbered without gaps, of which a
    number that another writer has just taken is never overwritten. Readers take the unbroken run of numbers from 1 on."""

    def __init__(self, spark: SparkSession, root: str, experiment: str):
        self.spark, self.root, self.experiment = spark, root.rstrip("/"), experiment

    # ------------------------------------------------------------------ tables
    def _read(self, name: str, schema: str) -> DataFrame:
        """The table, empty only if nothing was ever written; any other failure to read it is an error."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True)
        return reader.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{self.root}/{name}")

    def runs(self) -> DataFrame:
        return self._read("runs", RUN_SCHEMA).where(F.col("experiment") == self.experiment)

    def versions(self) -> DataFrame:
        w = Window.partitionBy("model_name").orderBy("version")
        return self._read("model_versions", VERSION_SCHEMA).withColumn("_k", F.row_number().over(w)).where("_k = version").drop("_k")

    def stage_events(self) -> DataFrame:
        upto = unbroken(numbers(self.spark, f"{self.root}/stage_events"))
        return self._read("stage_events", STAGE_SCHEMA).where(F.col("seq") <= upto)

    @staticmethod
    def _text(schema: str, *values) -> str:
        names = [f.split()[0] for f in schema.split(", ")]
        plain = [v.strftime("%Y-%m-%dT%H:%M:%S.%f") if isinstance(v, dt.datetime) else v for v in values]
        return json.dumps(dict(zip(names, plain, strict=True)))

    # ------------------------------------------------------------------ logging
    def log_run(self, run_name: str, params: dict, metrics: dict, tags: dict | None = None,
                dataset: DataFrame | None = None, label_col: str | None = None) -> str:
        """Add one run; row/column/class counts come from ``dataset``."""
        run_id = uuid.uuid4().hex
        metrics = {k: float(v) for k, v in metrics.items() if v is not None}
        tags = {k: str(v) for k, v in (tags or {}).items()}
        if dataset is not None:
            stats = dataset.agg(F.count(F.lit(1)).alias("n"),
                                *([F.count_if(F.col(label_col) == 1).alias("pos")] if label_col else [])).first()
            metrics["n_rows"] = float(stats["n"])
            metrics["n_features"] = float(len(dataset.columns) - (1 if label_col else 0))
            if label_col:
                metrics["n_positive"] = float(stats["pos"])
        publish(self.spark, f"{self.root}/runs/{run_id}.json",
                self._text(RUN_SCHEMA, run_id, run_name, self.experiment, dt.datetime.now(), {k: str(v) for k, v in params.items()}, metrics, tags))
        return run_id

    def log_tuning(self, model_name: str, result: dict, method: str = "grid_search", cv: int = 5, n_iter: int | None = None,
                   test_metrics: dict | None = None, dataset: DataFrame | None = None, label_col: str | None = None) -> str:
        """The best candidate of a search: its mean validation score and the spread of its scores over the folds, with the test metrics
        and the counts of ``dataset`` where given. A grid search logs its combinations, a random one its draws. NaN scores never win."""
        scores = result["cv_scores"]
        best = max((k for k, s in enumerate(scores) if s == s), key=lambda k: (scores[k], -k), default=None)
        metrics = {"cv_best_score": result["best_score"], "cv_mean_score": None if best is None else scores[best],
                   "cv_std_score": None if best is None else result["std_scores"][best], **(test_metrics or {})}
        size = {"n_combinations": len(result["params"])} if method == "grid_search" else {"n_iter": len(result["params"]) if n_iter is None else n_iter}
        return self.log_run(f"{model_name}_{method}", {**result["best_params"], "tuning_method": method, "cv_folds": cv, **size}, metrics,
                            {"model_type": model_name, "tuning_method": method}, dataset, label_col)

    # ------------------------------------------------------------------ registry
    def register_model(self, model_name: str, run_id: str, model_path: str) -> int:
        """The next version number for the name, taken by this caller alone."""
        folder = f"{self.root}/model_versions/{model_name}"
        return append_numbered(self.spark, folder, lambda n: self._text(VERSION_SCHEMA, model_name, n, run_id, model_path, dt.datetime.now()))

    def transition_stage(self, model_name: str, version: int, stage: str) -> None:
        append_numbered(self.spark, f"{self.root}/stage_events", lambda n: self._text(STAGE_SCHEMA, model_name, int(version), stage, dt.datetime.now(), n))

    def current(self, model_name: str, stage: str = "Production") -> tuple[int, str]:
        """X8 lookup: number and path of the newest version currently in ``stage``."""
        cur = (latest_versions(self.stage_events()).where((F.col("model_name") == model_name) & (F.col("stage") == stage))
               .join(self.versions(), ["model_name", "version"]).select("version", "model_path").first())
        if cur is None:
            raise ValueError(f"No version of {model_name!r} in stage {stage!r}")
        return cur["version"], cur["model_path"]

    def load_model(self, model_name: str, stage: str = "Production"):
        from pyspark.ml import PipelineModel
        return PipelineModel.load(self.current(model_name, stage)[1])
