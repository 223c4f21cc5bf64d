"""Pearson correlation tables.

All pairs come from two scans whatever the number of columns: one for the column means, one for a Gram matrix. With the values
shifted by the means and missing cells as zeros, the products of the blocks [x, x squared, present] hold every sum that a pair needs over the
rows where both values are present (pairwise-complete, like pandas). Each task adds up its own matrix and hands on one row per pair.

The sums of squares of a side that hardly varies where the other is present cancel; such a pair, and one with an infinite
value, is computed again by mergeable covariance states, ``MAX_PAIRS`` pairs a scan. The pair table (one row per two
columns) is local data; the matrix is it mirrored. A constant column yields NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.sources.schemas import correlation_columns

# Strength and band labels of the source report.
STRENGTH = ((0.9, "Very Strong"), (0.8, "Strong"))
STRENGTH_ELSE = "Moderate-Strong"
BANDS = ["Very Strong (>=0.9)", "Strong (0.8-0.9)", "Moderate (0.5-0.8)", "Weak (0.3-0.5)", "Very Weak (<0.3)"]


MAX_PAIRS = 400


def _pair_corr(x, y):
    """NULL without data or for a constant side; NaN counts as missing."""
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    xs, ys = F.when(both, x), F.when(both, y)
    # not corr(): that divides by zero for a constant side; a constant's deviation may also be a rounding error above zero
    varies = (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
    return F.when(varies, F.covar_pop(xs, ys) / F.nullif(F.stddev_pop(xs) * F.stddev_pop(ys), F.lit(0.0)))


SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
CANCELLED = 1e-6  # of a variance to the mean square about the column mean: below, the difference has lost too many digits


def _gram(means: list[float]):
    """Tasks' sums of every pair of columns, over the rows where both are present; values are shifted by ``means``."""
    shift = np.array(means)
    k = len(means)
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, one, square, cross = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
            there = ~np.isnan(x)
            x[~there] = 0.0
            m = there.astype(np.float64)
            both += m.T @ m
            one += x.T @ m
            square += (x * x).T @ m
            cross += x.T @ x
        columns = [both[i, j], one[i, j], one[j, i], square[i, j], square[j, i], cross[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(c) for c in columns]], names=["i", "j", *SUMS])

    return run


def _pair_states(x: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float | None]:
    """Correlations of the given pairs of columns _x0, _x1 ... by covariance states."""
    found = {}
    for at in range(0, len(wanted), MAX_PAIRS):
        some = wanted[at:at + MAX_PAIRS]
        found |= dict(zip(some, x.agg(*[_pair_corr(F.col(f"_x{i}"), F.col(f"_x{j}")) for i, j in some]).first(), strict=True))
    return found


def pairs(df: DataFrame, cols: list[str] | None = None, diagonal: bool = False) -> DataFrame:
    """Upper triangle ``(feature_1, feature_2, i, j, corr)`` in column order; pairs without data keep a NULL."""
    cols = list(cols or correlation_columns(df))
    schema = "feature_1 string, feature_2 string, i int, j int, corr double"
    if len(cols) < (1 if diagonal else 2):
        return df.sparkSession.createDataFrame([], schema)
    x = df.select(*[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(cols)])
    # NaN is what the tasks take for missing
    given = x.select(*[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in x.columns])
    means = x.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))) for c in x.columns]).first()
    finite = [m if m is not None and np.isfinite(m) else 0.0 for m in means]
    kinds = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    sums = given.mapInArrow(_gram(finite), kinds).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS]).collect()  # by the schema: one row a pair
    found, again = {}, []
    with np.errstate(all="ignore"):
        for i, j, n, sx, sy, sxx, syy, sxy in sums:
            if i == j and not diagonal:
                continue
            if not n:
                found[i, j] = None
                continue
            mx, my, vx, vy = sx / n, sy / n, sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
            if not (vx > CANCELLED * sxx / n and vy > CANCELLED * syy / n and np.isfinite(sxx + syy + sxy)):
                again.append((i, j))
            else:
                found[i, j] = float((sxy / n - mx * my) / (np.sqrt(vx) * np.sqrt(vy)))
    if again:
        found |= _pair_states(x, sorted(again))
    return df.sparkSession.createDataFrame([(cols[i], cols[j], i, j, r) for (i, j), r in sorted(found.items())], schema)


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The full symmetric matrix in long form (row, column, corr)."""
    both = F.array(F.struct(F.col("feature_1").alias("row"), F.col("feature_2").alias("column")),
                   F.struct(F.col("feature_2").alias("row"), F.col("feature_1").alias("column")))
    sides = F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)
    return pairs(df, cols, diagonal=True).select(F.explode(sides).alias("s"), "corr").select("s.row", "s.column", "corr")


def strength_label(r):
    a = F.abs(r)
    e = None
    for bound, label in STRENGTH:
        e = F.when(a >= bound, F.lit(label)) if e is None else e.when(a >= bound, F.lit(label))
    return e.otherwise(F.lit(STRENGTH_ELSE))


def strong_pairs(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """Pairs with |r| >= threshold, labelled, strongest first."""
    p = pairs(df, cols).where(F.abs("corr") >= threshold)
    return (p.select("feature_1", "feature_2", "corr", strength_label(F.col("corr")).alias("strength"),
                     F.when(F.col("corr") > 0, F.lit("Positive")).otherwise(F.lit("Negative")).alias("type"))
            .orderBy(F.abs("corr").desc(), "feature_1", "feature_2"))


def corr_bands(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """abs(r) summary (mean, median, max, min) and pair counts per band."""
    a = pairs(df, cols).select(F.abs("corr").alias("a")).where(F.col("a").isNotNull())
    band = (F.when(F.col("a") >= 0.9, F.lit(0)).when(F.col("a") >= 0.8, F.lit(1))
            .when(F.col("a") >= 0.5, F.lit(2)).when(F.col("a") >= 0.3, F.lit(3)).otherwise(F.lit(4)))
    counts = [F.count_if(band == k).alias(f"_b{k}") for k in range(5)]
    s = a.agg(F.count(F.lit(1)).alias("pairs"), F.avg("a").alias("mean_abs"), F.median("a").alias("median_abs"),
              F.max("a").alias("max_abs"), F.min("a").alias("min_abs"), *counts)
    entries = [F.struct(F.lit(k).alias("band_order"), F.lit(BANDS[k]).alias("band"), F.col(f"_b{k}").alias("n"))
               for k in range(5)]
    return (s.select("pairs", "mean_abs", "median_abs", "max_abs", "min_abs", F.explode(F.array(*entries)).alias("b"))
            .select("b.band_order", "b.band", "b.n", (F.col("b.n") * 100.0 / F.col("pairs")).alias("pct"),
                    "pairs", "mean_abs", "median_abs", "max_abs", "min_abs"))


def top_pairs(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most positive and ``k`` most negative pairs."""
    p = pairs(df, cols).where(F.col("corr").isNotNull())
    # the pair table holds k*(k-1)/2 rows for k columns: global windows are fine here
    ranks = {"positive": Window.orderBy(F.col("corr").desc(), "i", "j"), "negative": Window.orderBy(F.col("corr").asc(), "i", "j")}
    ranked = p.select("*", *[F.row_number().over(w).alias(side) for side, w in ranks.items()])
    sides = F.filter(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("rank")) for side in ranks]), lambda s: s["rank"] <= k)
    return ranked.select(F.explode(sides).alias("s"), "feature_1", "feature_2", "corr").select("s.side", "s.rank", "feature_1", "feature_2", "corr")


def target_corr(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """Correlation of each feature with the target, strongest first."""
    cols = [c for c in (cols or correlation_columns(df)) if c != target]
    t = F.col(target).cast("double")
    wide = df.agg(*[_pair_corr(F.col(c).cast("double"), t).alias(f"_c{i}") for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("corr")) for i, c in enumerate(cols)]
    return (wide.select(F.explode(F.array(*entries)).alias("e"))
            .select("e.feature", "e.corr", F.abs("e.corr").alias("abs_corr"))
            .orderBy(F.col("abs_corr").desc_nulls_last(), "feature"))


def scatter_sample(df: DataFrame, key_cols: list[str], cols: list[str] | None = None, pairs_n: int = 6,
                   n: int = 5000, seed: int = 42, threshold: float = 0.7) -> DataFrame:
    """Sampled (x, y) points for the ``pairs_n`` strongest pairs."""
    from riskweave.operators.sampling import seeded_sample
    sp = strong_pairs(df, cols, threshold).limit(pairs_n)
    chosen = [(r["feature_1"], r["feature_2"]) for r in sp.collect()]  # at most pairs_n rows
    s = seeded_sample(df, key_cols, n, seed)
    if not chosen:
        return df.sparkSession.createDataFrame([], "feature_1 string, feature_2 string, x double, y double")
    entries = [F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
                        F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in chosen]
    return s.select(*key_cols, F.explode(F.array(*entries)).alias("e")).select(*key_cols, "e.*")
