"""Feature preparation with fit/apply pairs.

``fit_*`` returns a ONE-ROW parameters DataFrame (means, medians, modes,
centres and scales); ``apply_*`` cross-joins it as a broadcast, which keeps
the transform a narrow, codegen'd projection over the data.  Label codes are a
table of any size, ranked without a single-task sort and joined.  One-hot columns
define the schema, so only columns of up to ``max_columns`` categories are spread
out; a wider one becomes one sparse vector column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.exprs import is_missing
from riskweave.functions.ordering import global_rank
from riskweave.functions.quantiles import column_quantiles, materialise
from riskweave.operators.profile import long_values


def _wide_from_long(long_df: DataFrame, key: str, value: str, names: list[str], suffix: str) -> DataFrame:
    """(variable, value) rows -> one row with a column per variable."""
    return long_df.agg(*[F.max(F.when(F.col(key) == n, F.col(value))).alias(f"{n}{suffix}") for n in names])


def _mode_long(df: DataFrame, cols: list[str], as_string: bool) -> DataFrame:
    """Most frequent value per column, smallest on ties (sklearn most_frequent)."""
    if as_string:
        lv = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
        lv = lv.where(F.col("value").isNotNull())
    else:
        lv = long_values(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = lv.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("variable").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("b"))
    return best.select("variable", F.col("b.v").alias("fill"))


def fit_imputer(df: DataFrame, num_cols: list[str], cat_cols: list[str] = (), method: str = "median") -> DataFrame:
    """F1 + F3: fill values; numeric by mean / median / mode (unknown -> median),
    categorical always by mode."""
    method = method if method in ("mean", "median", "mode") else "median"
    parts = []
    if num_cols:
        if method == "mean":
            stats = df.agg(*[F.avg(F.when(~is_missing(c), F.col(c).cast("double"))).alias(f"{c}__fill")
                             for c in num_cols])
        elif method == "median":
            q = column_quantiles(df, num_cols, {"fill": 0.5})
            stats = _wide_from_long(q, "variable", "fill", num_cols, "__fill")
        else:
            stats = _wide_from_long(_mode_long(df, num_cols, False), "variable", "fill", num_cols, "__fill")
        parts.append(stats)
    if cat_cols:
        parts.append(_wide_from_long(_mode_long(df, list(cat_cols), True), "variable", "fill", list(cat_cols), "__fill"))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def apply_imputer(df: DataFrame, params: DataFrame) -> DataFrame:
    cols = [c[:-len("__fill")] for c in params.columns if c.endswith("__fill")]
    j = df.crossJoin(F.broadcast(params))
    fills = {}
    for c in cols:
        missing = is_missing(c) if df.schema[c].dataType.simpleString() in ("double", "float") else F.col(c).isNull()
        fills[c] = F.when(missing, F.col(f"{c}__fill").cast(df.schema[c].dataType)).otherwise(F.col(c))
    return j.withColumns(fills).drop(*params.columns)


def _distinct_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, value) of the distinct non-null values as text."""
    return (df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
            .where(F.col("value").isNotNull()).distinct())


def categories(df: DataFrame, cols: list[str], max_columns: int = 1000) -> dict[str, list[str]]:
    """Sorted distinct values (as text) of the columns that have at most ``max_columns`` of them; wider ones are left out."""
    lv = materialise(_distinct_text(df, cols))
    sizes = {r["variable"]: r["k"] for r in lv.groupBy("variable").agg(F.count(F.lit(1)).alias("k")).collect()}
    out = {c: [] for c in cols if sizes.get(c, 0) <= max_columns}
    for r in lv.where(F.col("variable").isin(list(out))).collect():   # at most max_columns rows a column
        out[r["variable"]].append(r["value"])
    return {c: sorted(v, key=lambda t: t.encode()) for c, v in out.items()}


def onehot(df: DataFrame, cols: list[str], cats: dict[str, list[str]] | None = None, drop_first: bool = True, max_columns: int = 1000,
           wide_codes: DataFrame | None = None) -> DataFrame:
    """``col_value`` 0/1 doubles for sorted categories, first dropped; an
    unseen value gets all zeros; the source column is removed.

    A column that is not in ``cats`` (more than ``max_columns`` categories) becomes the sparse vector ``col_onehot``,
    indexed by label code (less one with ``drop_first``), from ``wide_codes`` or codes fitted here."""
    cats = categories(df, cols, max_columns) if cats is None else cats
    wide = [c for c in cols if c not in cats]
    new = {}
    for c in cols:
        if c in cats:
            for v in cats[c][1:] if drop_first else cats[c]:
                new[f"{c}_{v}"] = (F.col(c).cast("string") == F.lit(v)).cast("double")
    out = df.withColumns(new) if new else df
    if wide:
        out = _onehot_vectors(out, wide, wide_codes if wide_codes is not None else fit_label_codes(df, wide), drop_first)
    return out.drop(*cols)


def _onehot_vectors(df: DataFrame, cols: list[str], codes: DataFrame, drop_first: bool) -> DataFrame:
    from pyspark.ml.feature import OneHotEncoder
    skip = 1 if drop_first else 0
    sizes = {r["variable"]: r["k"] for r in codes.groupBy("variable").agg((F.max("code") + 1).alias("k")).collect()}  # one row per column
    out = apply_label_codes(df.withColumns({f"_code_{c}": F.col(c) for c in cols}), codes, cols, {c: f"_code_{c}" for c in cols})
    for c in cols:
        n = max(1, sizes.get(c, 0) - skip)
        code = F.col(f"_code_{c}") - skip
        # what has no code of its own is the encoder's invalid category, which dropLast makes all zeros
        out = out.withColumn(f"_code_{c}", F.when(code >= 0, code).otherwise(F.lit(n)).cast("double"))
        fitted = OneHotEncoder(inputCol=f"_code_{c}", outputCol=f"{c}_onehot", handleInvalid="keep", dropLast=True).fit(
            df.sparkSession.range(n).select(F.col("id").cast("double").alias(f"_code_{c}")))
        out = fitted.transform(out).drop(f"_code_{c}")
    return out


def fit_label_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """F5 fit: ``(variable, value, code)`` with codes 0..k-1 in sorted text order, for any number of values."""
    ranked = global_rank(_distinct_text(df, cols), ["value"], "code", ["variable"])
    return ranked.select("variable", "value", F.col("code").cast("int").alias("code"))


def apply_label_codes(df: DataFrame, codes: DataFrame, cols: list[str], targets: dict[str, str] | None = None) -> DataFrame:
    """F5 apply: replace each column (or its target) by its code; the join strategy is left to the optimizer."""
    out = df
    for c in cols:
        m = codes.where(F.col("variable") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = (out.join(m, out[c].cast("string") == F.col(f"_v_{c}"), "left")
               .withColumn((targets or {}).get(c, c), F.col(f"_c_{c}")).drop(f"_v_{c}", f"_c_{c}"))
    return out


def label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    return apply_label_codes(df, fit_label_codes(df, cols), cols)


def fit_scaler(df: DataFrame, cols: list[str], method: str = "standardize") -> DataFrame:
    """F6-F8 fit: one row with ``{c}__center`` and ``{c}__scale``.

    standardize: mean / population std; normalize: min / range;
    robust: median / interpolated IQR.  A zero scale becomes 1 (constant
    columns map to 0)."""
    if method is None or method == "none":
        return df.sparkSession.range(1).select(*[F.lit(0.0).alias(f"{c}__center") for c in cols],
                                               *[F.lit(1.0).alias(f"{c}__scale") for c in cols])
    x = {c: F.when(~is_missing(c), F.col(c).cast("double")) for c in cols}
    if method == "standardize":
        p = df.agg(*[F.avg(x[c]).alias(f"{c}__center") for c in cols],
                   *[F.stddev_pop(x[c]).alias(f"{c}__scale") for c in cols])
    elif method == "normalize":
        p = df.agg(*[F.min(x[c]).alias(f"{c}__center") for c in cols],
                   *[(F.max(x[c]) - F.min(x[c])).alias(f"{c}__scale") for c in cols])
    elif method == "robust":
        q = column_quantiles(df, cols, {"q1": 0.25, "med": 0.5, "q3": 0.75})
        p = q.agg(*[F.max(F.when(F.col("variable") == c, F.col("med"))).alias(f"{c}__center") for c in cols],
                  *[F.max(F.when(F.col("variable") == c, F.col("q3") - F.col("q1"))).alias(f"{c}__scale")
                    for c in cols])
    else:
        raise ValueError(f"unknown scaling method {method!r}")
    return p.select(*[F.col(f"{c}__center") for c in cols],
                    *[F.when(F.col(f"{c}__scale") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__scale"))
                      .alias(f"{c}__scale") for c in cols])


def apply_scaler(df: DataFrame, params: DataFrame, inverse: bool = False) -> DataFrame:
    """F6-F8 apply, F10 inverse (x * scale + center)."""
    cols = [c[:-len("__center")] for c in params.columns if c.endswith("__center")]
    j = df.crossJoin(F.broadcast(params))
    if inverse:
        new = {c: F.col(c) * F.col(f"{c}__scale") + F.col(f"{c}__center") for c in cols}
    else:
        new = {c: (F.col(c).cast("double") - F.col(f"{c}__center")) / F.col(f"{c}__scale") for c in cols}
    return j.withColumns(new).drop(*params.columns)


def scale(df: DataFrame, cols: list[str], method: str = "standardize") -> DataFrame:
    return apply_scaler(df, fit_scaler(df, cols, method))
