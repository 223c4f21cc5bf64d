"""Customer segmentation and the proxy risk label.

Cluster statistics are one ``groupBy(cluster)`` aggregate (the customer table
is shuffled once; per-cluster medians go through the skew-safe quantile
helper because a cluster may hold a third of all customers).  Everything
after that works on k-row tables: scores, the arg-max and the labels are
broadcast joins of at most k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.exprs import is_missing
from riskweave.functions.quantiles import materialise, quantiles
from riskweave.sources.schemas import require_columns

RFM = ("recency", "frequency", "monetary")


# --------------------------------------------------------------------------- statistics
def cluster_stats(df: DataFrame, features=RFM, cluster_col: str = "cluster", k: int | None = None,
                  full: bool = True) -> DataFrame:
    """A5 (``full``): n, pct of customers and mean/median/std/min/max per
    feature for cluster ids 0..k-1 (empty ones included when ``k`` given).
    A6 (``full=False``): present clusters, n, pct, mean and median."""
    require_columns(df, [cluster_col, *features], "clustered table")
    aggs = [F.count(F.lit(1)).alias("n_customers")]
    for f in features:
        x = F.col(f).cast("double")
        aggs.append(F.avg(x).alias(f"mean_{f}"))
        if full:
            aggs += [F.stddev_samp(x).alias(f"std_{f}"), F.min(x).alias(f"min_{f}"), F.max(x).alias(f"max_{f}")]
    g = df.groupBy(F.col(cluster_col).cast("int").alias("cluster_id")).agg(*aggs)
    from riskweave.operators.profile import long_values
    med = quantiles(long_values(df.withColumn("cluster_id", F.col(cluster_col).cast("int")), list(features),
                                keep=["cluster_id"]), ["cluster_id", "variable"], "value", {"median": 0.5})
    med_wide = med.groupBy("cluster_id").agg(
        *[F.max(F.when(F.col("variable") == f, F.col("median"))).alias(f"median_{f}") for f in features])
    total = g.agg(F.sum("n_customers").alias("_total"))
    out = g.join(med_wide, "cluster_id", "left")
    if k is not None:
        ids = df.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
        out = ids.join(out, "cluster_id", "left").withColumn("n_customers", F.coalesce("n_customers", F.lit(0)))
    out = out.crossJoin(F.broadcast(total))
    out = out.withColumn("pct_customers", F.col("n_customers") * 100.0 / F.col("_total"))
    cols = ["cluster_id", "n_customers", "pct_customers"]
    for f in features:
        cols += [f"mean_{f}", f"median_{f}"] + ([f"std_{f}", f"min_{f}", f"max_{f}"] if full else [])
    return out.select(*cols)


def engagement_scores(stats: DataFrame, features=RFM) -> DataFrame:
    """Min-max normalise each cluster mean across clusters (recency as is,
    frequency and monetary inverted; 0.5 when all clusters are equal) and sum.
    Higher = less engaged = riskier.  ``stats`` has k rows."""
    mm = stats.agg(*[F.min(f"mean_{f}").alias(f"_min_{f}") for f in features],
                   *[F.max(f"mean_{f}").alias(f"_max_{f}") for f in features])
    s = stats.crossJoin(F.broadcast(mm))
    norm = {}
    for f in features:
        lo, hi, m = F.col(f"_min_{f}"), F.col(f"_max_{f}"), F.col(f"mean_{f}")
        scaled = (m - lo) / (hi - lo)
        if f != "recency":
            scaled = 1 - scaled
        norm[f"normalized_{f}"] = F.when(hi > lo, scaled).otherwise(F.lit(0.5))
    s = s.withColumns(norm)
    score = None
    for f in features:
        score = F.col(f"normalized_{f}") if score is None else score + F.col(f"normalized_{f}")
    return s.withColumn("engagement_score", score).drop(*mm.columns)


def high_risk_cluster(scores: DataFrame) -> DataFrame:
    """One row, the highest engagement score; lowest id wins ties."""
    return (scores.where(F.col("engagement_score").isNotNull())
            .orderBy(F.col("engagement_score").desc(), F.col("cluster_id")).limit(1)
            .select(F.col("cluster_id").alias("high_risk_cluster")))


def high_risk_summary(scores: DataFrame, worst: DataFrame | None = None) -> DataFrame:
    """The score table with a boolean flag on the chosen cluster."""
    worst = worst if worst is not None else high_risk_cluster(scores)
    return (scores.crossJoin(F.broadcast(worst))
            .withColumn("is_high_risk", F.col("cluster_id") == F.col("high_risk_cluster"))
            .drop("high_risk_cluster"))


# --------------------------------------------------------------------------- labels
def label_customers(df: DataFrame, worst: DataFrame | int, cluster_col: str = "cluster",
                    label_col: str = "is_high_risk") -> DataFrame:
    """``label = (cluster == worst)`` as 0/1 int; ``worst`` is a 1-row
    table or a manual cluster id."""
    if isinstance(worst, int):
        return df.withColumn(label_col, (F.col(cluster_col) == F.lit(worst)).cast("int"))
    return (df.crossJoin(F.broadcast(worst))
            .withColumn(label_col, F.coalesce((F.col(cluster_col) == F.col("high_risk_cluster")).cast("int"),
                                              F.lit(0)))
            .drop("high_risk_cluster"))


def label_transactions(tx: DataFrame, labelled: DataFrame, customer_col: str = "CustomerId",
                       label_col: str = "is_high_risk", cluster_col: str | None = "cluster") -> DataFrame:
    """Customer labels joined onto transactions (left); a customer with several
    labels has the highest (with it, the highest cluster); unmatched rows get label 0."""
    cols = [customer_col, label_col] + ([cluster_col] if cluster_col and cluster_col in labelled.columns else [])
    lab = labelled.groupBy(customer_col).agg(F.max(F.struct(*cols[1:])).alias("_l")).select(customer_col, "_l.*")
    tx = tx.drop(*[c for c in cols[1:] if c in tx.columns])
    return tx.join(lab, customer_col, "left").withColumn(label_col, F.coalesce(F.col(label_col), F.lit(0)))


def attach_target(features: DataFrame, labelled_tx: DataFrame, key: str = "TransactionId",
                  label_col: str = "is_high_risk") -> DataFrame:
    """Add the label to the processed feature table by transaction key
    (positional pairing has no meaning on a distributed table)."""
    lab = labelled_tx.groupBy(key).agg(F.max(label_col).alias(label_col))
    return features.join(lab, key, "left").withColumn(label_col, F.coalesce(F.col(label_col), F.lit(0)).cast("int"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Count and pct per value."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    t = g.agg(F.sum("n").alias("_t"))
    return g.crossJoin(F.broadcast(t)).select(col, "n", (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


def create_high_risk_target(rfm_clustered: DataFrame, tx: DataFrame | None = None,
                            customer_col: str = "CustomerId", features=RFM) -> dict[str, DataFrame]:
    """A10: worst cluster -> customer labels (-> transaction labels) + summary."""
    stats = cluster_stats(rfm_clustered, features, full=False)
    scores = engagement_scores(stats, features)
    worst = high_risk_cluster(scores)
    labelled = label_customers(rfm_clustered, worst)
    out = {"high_risk_cluster": worst, "customers": labelled, "summary": high_risk_summary(scores, worst),
           "distribution": distribution(labelled, "is_high_risk")}
    if tx is not None:
        out["transactions"] = label_transactions(tx, labelled, customer_col)
    return out


# --------------------------------------------------------------------------- K-Means
SAMPLE_ROWS = 10_000  # rows that starting centres are drawn from


def starting_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of a sample, each drawn with a chance in proportion to the squared distance to those before (k-means++)."""
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]]
    while len(chosen) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in chosen], axis=0)
        chosen.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
    return np.array(chosen)


def _moved(starts: dict[int, np.ndarray]):
    """Tasks' sums by (restart, cluster): rows, cost and the total of each feature. Ties go to the lower cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {r: np.zeros((len(c), c.shape[1] + 2)) for r, c in starts.items()}
        for batch in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False) for col in batch.columns])
            for r, centres in starts.items():
                d = np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)
                own = d.argmin(1)
                for j in range(len(centres)):
                    mine = own == j
                    sums[r][j] += [mine.sum(), d[mine, j].sum(), *x[mine].sum(0)]
        rows = [(r, j, *s) for r, total in sums.items() for j, s in enumerate(total)]
        cols = list(zip(*rows, strict=True))
        names = ["restart", "cluster", "n", "cost", *[f"s{k}" for k in range(len(cols) - 4)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.float64()) for k, c in enumerate(cols)], names=names)

    return run


def lloyd(df: DataFrame, features: list[str], starts: list, max_iter: int = 300, tol: float = 0.0) -> list[dict]:
    """K1 from given centres, all restarts in the same scans: each pass moves the centres of every restart that still moves, from one
    aggregate of a row per restart, cluster and task. Per restart: ``centres``, the ``cost`` of the rows to them, the ``sizes`` and the
    ``iterations``.

    A restart is done after ``max_iter`` moves, or one that moved its centres by a squared distance of ``tol`` together or less. A
    cluster without rows keeps its centre. One more scan gives the cost of the last centres."""
    d = len(features)
    rows = df.select(*[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)])
    schema = "restart int, cluster int, n double, cost double, " + ", ".join(f"s{j} double" for j in range(d))
    totals = [F.sum(c).alias(c) for c in ("n", "cost", *[f"s{j}" for j in range(d)])]

    def scan(which: dict[int, np.ndarray]) -> dict:
        got = rows.mapInArrow(_moved(which), schema).groupBy("restart", "cluster").agg(*totals).collect()  # one row a restart and cluster
        return {(r.restart, r.cluster): r for r in got}

    centres = {r: np.array(c, dtype=float) for r, c in enumerate(starts)}
    moves = dict.fromkeys(centres, 0)
    moving = dict(centres) if max_iter else {}
    while moving:
        sums = scan(moving)
        for r, old in list(moving.items()):
            new = old.copy()
            for j in range(len(old)):
                s = sums.get((r, j))
                if s is not None and s.n:
                    new[j] = [s[f"s{k}"] / s.n for k in range(d)]
            centres[r], moves[r] = new, moves[r] + 1
            if ((new - old) ** 2).sum() <= tol or moves[r] >= max_iter:
                del moving[r]
            else:
                moving[r] = new
    last = scan(centres)
    none = lambda r, j, c: last[r, j][c] if (r, j) in last else 0.0
    return [{"centres": c, "cost": sum(none(r, j, "cost") for j in range(len(c))), "sizes": [int(none(r, j, "n")) for j in range(len(c))], "iterations": moves[r]}
            for r, c in centres.items()]


class CustomerSegmenter:
    """K1-K5: K-Means on scaled RFM features.

    ``n_init`` restarts, from k-means++ centres of a sample of ``SAMPLE_ROWS`` rows (the first by hash), run side by side in the
    scans of one (``lloyd``); the lowest cost wins. Clusters are numbered by their centres' order. Scaling parameters are a
    one-row table (F6/F8).
    """

    def __init__(self, n_clusters: int = 3, scaling: str | None = "standardize", seed: int = 42,
                 features=RFM, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4):
        self.k, self.scaling, self.seed, self.tol = n_clusters, scaling, seed, tol
        self.features, self.n_init, self.max_iter = list(features), n_init, max_iter
        self.centres: list[list[float]] | None = None  # in scaled units
        self.cost: float | None = None
        self.scale_params: DataFrame | None = None

    @property
    def _names(self) -> list[str]:
        return [f"_s_{f}" for f in self.features]

    def _scaled(self, df: DataFrame) -> DataFrame:
        """``df`` with scaled copies of the features."""
        from riskweave.operators.prepare import apply_scaler
        params = self.scale_params.select(*[F.col(c).alias(f"_s_{c}") for c in self.scale_params.columns])
        return apply_scaler(df.withColumns({t: F.col(f).cast("double") for t, f in zip(self._names, self.features, strict=True)}), params)

    def fit(self, df: DataFrame) -> "CustomerSegmenter":
        from riskweave.operators.prepare import fit_scaler
        require_columns(df, self.features, "RFM table")
        nulls = df.agg(*[F.count_if(is_missing(F.col(f).cast("double"))).alias(f) for f in self.features]).first()
        bad = [f for f in self.features if nulls[f]]
        if bad:
            raise ValueError(f"RFM features contain missing values: {bad}")
        self.scale_params = materialise(fit_scaler(df, self.features, self.scaling or "none"))
        data = self._scaled(df).select(*self._names).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sample = data.orderBy(F.xxhash64(*self._names, F.lit(self.seed)), *self._names).limit(SAMPLE_ROWS).collect()
            x = np.array(sample, dtype=float).reshape(-1, len(self.features))
            if len(x) < self.k:
                raise ValueError(f"{len(x)} rows for {self.k} clusters")
            spread = [v or 0.0 for v in data.agg(*[F.var_pop(c) for c in self._names]).first()]
            starts = [starting_centres(x, self.k, self.seed + i) for i in range(self.n_init)]
            best = min(lloyd(data, self._names, starts, self.max_iter, self.tol * float(np.mean(spread))), key=lambda r: r["cost"])
        finally:
            data.unpersist()
        self.centres, self.cost = sorted(best["centres"].tolist()), float(best["cost"])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.centres is None:
            raise ValueError("the segmenter has not been fitted")
        return assign_nearest(self._scaled(df), self.centres, self._names).drop("cost", *self._names)

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)

    def centroids(self) -> DataFrame:
        """K4: centres in original units (inverse scaling, F10)."""
        from riskweave.operators.prepare import apply_scaler
        spark = self.scale_params.sparkSession
        cdf = spark.createDataFrame([(i, *c) for i, c in enumerate(self.centres)], ["cluster_id", *self.features])
        return apply_scaler(cdf, self.scale_params, inverse=True)

    def inertia(self, df: DataFrame | None = None) -> float:
        """K5: within-cluster sum of squares (of the fit, or on ``df``)."""
        if df is None:
            return self.cost
        return float(assign_nearest(self._scaled(df).select(*self._names), self.centres, self._names).agg(F.sum("cost")).first()[0])


def assign_nearest(df: DataFrame, centres: list[list[float]], features=RFM, cluster_col: str = "cluster") -> DataFrame:
    """K2 with given centres (in the features' own units): the nearest one's number and the squared distance ``cost``.

    A projection: the centres are literals.  The lowest number wins a tie; a missing feature leaves both NULL."""
    def cost(c):
        out = None
        for f, v in zip(features, c, strict=True):
            d = (F.col(f).cast("double") - F.lit(float(v)))
            out = d * d if out is None else out + d * d
        return out

    best = F.array_min(F.array(*[F.struct(cost(c).alias("cost"), F.lit(i).alias("id")) for i, c in enumerate(centres)]))
    known = None
    for f in features:
        ok = ~is_missing(F.col(f).cast("double"))
        known = ok if known is None else known & ok
    return df.withColumn("_best", F.when(known, best)).withColumns({cluster_col: F.col("_best.id"), "cost": F.col("_best.cost")}).drop("_best")
