"""Data-quality profiling: duplicates, missing values, outliers.

Each operator makes one pass for its counts: a wide aggregate of
``count_if`` expressions, or an aggregate over the unpivoted values joined to
a one-row-per-variable bounds table (bounded by the schema width).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.exprs import col_, is_missing, safe_div
from riskweave.functions.quantiles import column_quantiles
from riskweave.operators.profile import _numeric_cols, moments

# Recommendation texts of the source profiling report.
IMPUTE_ADVICE = {
    "drop": "Consider removing column or investigate data collection issue",
    "num_20": "Median imputation (robust to outliers) or advanced methods (KNN, MICE)",
    "cat_20": "Mode imputation or create 'Missing' category",
    "num_5": "Mean/Median imputation or forward/backward fill for time series",
    "cat_5": "Mode imputation or forward/backward fill",
    "num_0": "Mean/Median imputation (simple and effective)",
    "cat_0": "Mode imputation (simple and effective)",
}
OUTLIER_ADVICE = [
    (20, "Investigate data quality - high outlier percentage suggests data issues"),
    (10, "Consider capping/winsorizing or robust statistical methods"),
    (5, "Consider capping at bounds or using robust methods (median, IQR-based)"),
    (1, "May keep if legitimate values, or cap at bounds"),
]
OUTLIER_ADVICE_ELSE = "Likely legitimate outliers - keep or investigate individually"


def _missing_expr(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    return is_missing(c) if isinstance(dt, (T.FloatType, T.DoubleType)) else F.col(c).isNull()


# ---------------------------------------------------------------- duplicates
def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows beyond the first copy of each distinct row, and their share.

    Copies are counted per distinct row with map-side partial counts, so a
    row repeated millions of times shrinks to one row per task before the
    shuffle.
    """
    cols = list(cols or df.columns)
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_rows"),
    ).withColumn("duplicate_pct", safe_div(F.col("duplicate_rows") * 100.0, "total_rows"))


def duplicate_sample(df: DataFrame, cols: list[str] | None = None, groups: int = 10,
                     n: int = 10) -> DataFrame:
    """D12 sample: up to ``n`` rows that have a copy (keep=False semantics).

    At most ``groups`` duplicated keys are picked (a bounded broadcast),
    then matching rows are semi-joined null-safely.
    """
    cols = list(cols or df.columns)
    picked = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
              .drop("_n").orderBy(*cols).limit(groups))
    cond = [df[c].eqNullSafe(picked[c]) for c in cols]
    return df.join(F.broadcast(picked), cond, "left_semi").orderBy(*cols).limit(n)


# ---------------------------------------------------------------- missing values
def missing_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: missing count, pct of rows and type, in one aggregate."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(_missing_expr(df, c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("missing"),
                        F.lit(df.schema[c].dataType.simpleString()).alias("dtype"))
               for i, c in enumerate(cols)]
    return (wide.select("_rows", F.explode(F.array(*entries)).alias("e"))
            .select("e.column", "e.missing", (safe_div(F.col("e.missing") * 100.0, "_rows")).alias("missing_pct"),
                    "e.dtype", F.col("_rows").alias("rows")))


def missing_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns with missing values, most missing first."""
    m = missing_counts(df, cols)
    return (m.where(F.col("missing") > 0).select("column", "missing", "missing_pct", "dtype")
            .orderBy(F.col("missing").desc(), "column"))


def missing_total(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """D15 totals: missing cells and their share of all cells."""
    cols = list(cols or df.columns)
    m = missing_counts(df, cols)
    return m.agg(F.sum("missing").cast("long").alias("missing_cells"),
                 (safe_div(F.sum("missing") * 100.0, F.first("rows") * F.lit(len(cols)))).alias("missing_pct"))


def missing_per_row(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distribution of the number of missing cells per row."""
    cols = list(cols or df.columns)
    k = sum((_missing_expr(df, c).cast("int") for c in cols), F.lit(0))
    return (df.select(k.alias("missing_count")).groupBy("missing_count")
            .agg(F.count(F.lit(1)).alias("rows")).orderBy("missing_count"))


def rows_with_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """D16 headline: rows affected and their share."""
    d = missing_per_row(df, cols)
    return d.agg(F.coalesce(F.sum(F.when(F.col("missing_count") > 0, F.col("rows"))), F.lit(0)).alias("rows_affected"),
                 F.sum("rows").alias("rows")).withColumn(
        "pct", safe_div(F.col("rows_affected") * 100.0, "rows"))


def missing_matrix_sample(df: DataFrame, key_cols: list[str], cols: list[str] | None = None,
                          n: int = 1000, seed: int = 42) -> DataFrame:
    """0/1 missing flags for a seeded sample of ``n`` rows (hash order)."""
    from riskweave.operators.sampling import seeded_sample
    cols = list(cols or [c for c in df.columns if c not in key_cols])
    s = seeded_sample(df, key_cols, n, seed)
    return s.select(*key_cols, *[_missing_expr(df, c).cast("int").alias(c) for c in cols])


def missing_by_type(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per data type: columns, missing cells, pct of that type's cells."""
    m = missing_counts(df, cols)
    return (m.groupBy("dtype").agg(F.count(F.lit(1)).alias("columns"),
                                   F.sum("missing").cast("long").alias("missing"),
                                   F.first("rows").alias("_rows"))
            .select("dtype", "columns", "missing",
                    safe_div(F.col("missing") * 100.0, F.col("_rows") * F.col("columns")).alias("missing_pct"))
            .orderBy(F.col("missing").desc(), "dtype"))


def impute_advice(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A strategy per column with missing values, by missing % and kind."""
    m = missing_summary(df, cols)
    numeric = F.col("dtype").isin("bigint", "int", "double", "float", "smallint", "tinyint") | \
        F.col("dtype").startswith("decimal")
    a = IMPUTE_ADVICE
    pct = F.col("missing_pct")
    advice = (F.when(pct > 50, F.lit(a["drop"]))
              .when(pct > 20, F.when(numeric, F.lit(a["num_20"])).otherwise(F.lit(a["cat_20"])))
              .when(pct > 5, F.when(numeric, F.lit(a["num_5"])).otherwise(F.lit(a["cat_5"])))
              .otherwise(F.when(numeric, F.lit(a["num_0"])).otherwise(F.lit(a["cat_0"]))))
    return m.select("column", "missing_pct", "dtype", advice.alias("strategy"))


# ---------------------------------------------------------------- outliers
def iqr_bounds(df: DataFrame, cols: list[str] | None = None, whisker: float = 1.5,
               extra: dict | None = None) -> DataFrame:
    """Per variable: Q1, Q3, IQR and the fences Q1 - w*IQR, Q3 + w*IQR (NULL and NaN left out)."""
    cols = _numeric_cols(df, cols)
    probs = {"q1": 0.25, "q3": 0.75, **(extra or {})}
    q = column_quantiles(df, cols, probs)
    iqr = F.col("q3") - F.col("q1")
    return q.select("variable", *probs.keys(), iqr.alias("iqr"),
                    (F.col("q1") - whisker * iqr).alias("lower"),
                    (F.col("q3") + whisker * iqr).alias("upper"))


def iqr_outlier_flag(c, lower, upper):
    """Outside the fences; a NaN is missing, not an outlier."""
    x = col_(c)
    return ~F.isnan(x) & ((x < lower) | (x > upper))


def zscore_flag(c, mean, std_pop, threshold: float = 3.0):
    """|z| > threshold; a NaN is missing, not an outlier."""
    x = col_(c)
    return ~F.isnan(x) & (F.abs(safe_div(x - mean, std_pop)) > F.lit(threshold))


def _flagged(df: DataFrame, cols: list[str], flags: dict[str, dict]) -> DataFrame:
    """One wide aggregate, one scan: per variable its rows, present values and, for each flag (name -> variable ->
    predicate of a column), the flagged count, min, max and mean."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs.append(F.count(F.when(~F.isnan(x), x)).alias(f"_n{i}"))
        for name, of in flags.items():
            hit = F.when(of[c](x), x) if c in of else F.lit(None).cast("double")
            aggs += [F.count(hit).alias(f"_{name}_count{i}"), F.min(hit).alias(f"_{name}_min{i}"), F.max(hit).alias(f"_{name}_max{i}"), F.avg(hit).alias(f"_{name}_mean{i}")]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    rows = [F.struct(F.lit(c).alias("variable"), F.col(f"_n{i}").alias("n"),
                     *[F.col(f"_{name}_{k}{i}").alias(f"{name}_{k}") for name in flags for k in ("count", "min", "max", "mean")]) for i, c in enumerate(cols)]
    return wide.select(F.col("_rows").alias("rows"), F.explode(F.array(*rows)).alias("v")).select("rows", "v.*")


def _iqr_flags(bounds: list) -> dict:
    # one row per variable: the bounds become literals of the scan that counts
    return {r["variable"]: (lambda x, lo=r["lower"], hi=r["upper"]: iqr_outlier_flag(x, F.lit(lo), F.lit(hi))) for r in bounds}


def _z_flags(df: DataFrame, cols: list[str], threshold: float) -> dict:
    m = moments(df, cols).select("variable", "mean", "std_pop").collect()  # one row per variable
    return {r["variable"]: (lambda x, mu=r["mean"], sd=r["std_pop"]: zscore_flag(x, F.lit(mu), F.lit(sd), threshold)) for r in m if r["mean"] is not None}


def iqr_outliers(df: DataFrame, cols: list[str] | None = None, whisker: float = 1.5) -> DataFrame:
    """Per variable bounds, outlier count, pct of ALL rows, and the
    min / max / mean of the outlying values."""
    cols = _numeric_cols(df, cols)
    bounds = iqr_bounds(df, cols, whisker).collect()  # one row per variable
    schema = "variable string, q1 double, q3 double, iqr double, lower double, upper double"
    b = df.sparkSession.createDataFrame([tuple(r) for r in bounds], schema)
    found = _flagged(df, cols, {"iqr": _iqr_flags(bounds)})
    return (found.join(F.broadcast(b), "variable")  # one row per variable
            .select("variable", "q1", "q3", "iqr", "lower", "upper", F.col("iqr_count").alias("n_outliers"),
                    safe_div(F.col("iqr_count") * 100.0, "rows").alias("pct_outliers"),
                    F.col("iqr_min").alias("min_outlier"), F.col("iqr_max").alias("max_outlier"), F.col("iqr_mean").alias("mean_outlier")))


def zscore_outliers(df: DataFrame, cols: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """|x - mean| / std_pop > threshold; pct of the NON-NULL values."""
    cols = _numeric_cols(df, cols)
    flags = _z_flags(df, cols, threshold)
    return _flagged(df, cols, {"z": flags}).where(F.col("variable").isin(list(flags))).select(
        "variable", F.lit(threshold).alias("threshold"), F.col("z_count").alias("n_outliers"),
        safe_div(F.col("z_count") * 100.0, "n").alias("pct_outliers"), F.col("z_min").alias("min_outlier"), F.col("z_max").alias("max_outlier"))


def outlier_compare(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """IQR and z-score counts side by side, and their difference: both predicates in one scan."""
    cols = _numeric_cols(df, cols)
    iqr = _iqr_flags(iqr_bounds(df, cols).collect())  # one row per variable
    found = _flagged(df, cols, {"iqr": iqr, "z": _z_flags(df, cols, 3.0)}).where(F.col("variable").isin(list(iqr)))
    return found.select("variable", F.col("iqr_count"), safe_div(F.col("iqr_count") * 100.0, "rows").alias("iqr_pct"), F.col("z_count"),
                        safe_div(F.col("z_count") * 100.0, "n").alias("z_pct"), (F.col("iqr_count") - F.col("z_count")).alias("difference"))


def high_outlier_features(df: DataFrame, cols: list[str] | None = None, share: float = 0.05) -> DataFrame:
    """Variables whose IQR outliers exceed ``share`` of all rows."""
    o = iqr_outliers(df, cols)
    return o.where(F.col("pct_outliers") > share * 100).select("variable", "n_outliers", "pct_outliers")


def outlier_advice(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Treatment advice from the IQR outlier % (rounded to 2 places first)."""
    o = iqr_outliers(df, cols)
    pct = F.round("pct_outliers", 2)
    advice = None
    for bound, text in OUTLIER_ADVICE:
        advice = F.when(pct > bound, F.lit(text)) if advice is None else advice.when(pct > bound, F.lit(text))
    return o.select("variable", pct.alias("pct_outliers"),
                    advice.otherwise(F.lit(OUTLIER_ADVICE_ELSE)).alias("treatment"))
