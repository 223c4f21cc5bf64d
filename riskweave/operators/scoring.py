"""Batch scoring and risk policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The documented decision policy.
LOW_THRESHOLD, HIGH_THRESHOLD = 0.30, 0.60
N_FEATURES = 26


def risk_level(pred_col: str = "prediction"):
    """P10: 'high' when the prediction is 1, else 'low'; none without a prediction (NULL or NaN)."""
    p = F.col(pred_col)
    return F.when(p.isNull() | F.isnan(p.cast("double")), F.lit(None).cast("string")).when(p == 1, F.lit("high")).otherwise(F.lit("low"))


def risk_band(prob_col: str = "probability", low: float = LOW_THRESHOLD, high: float = HIGH_THRESHOLD):
    """(band, decision): < low -> low/approve, <= high -> medium/review,
    else high/reject; a row without a score (NULL or NaN) has neither."""
    p = F.col(prob_col)
    none = F.lit(None).cast("string")
    ladder = lambda a, b, c: F.when(p.isNull() | F.isnan(p), none).when(p < low, F.lit(a)).when(p <= high, F.lit(b)).otherwise(F.lit(c))
    return ladder("low", "medium", "high"), ladder("approve", "review", "reject")


def with_risk_bands(df: DataFrame, prob_col: str = "probability", low: float = LOW_THRESHOLD,
                    high: float = HIGH_THRESHOLD) -> DataFrame:
    band, decision = risk_band(prob_col, low, high)
    return df.withColumns({"risk_band": band, "decision": decision})


def valid_width(features_col: str = "features", n: int = N_FEATURES):
    """An array of exactly ``n`` numbers, none of them NULL or NaN."""
    arr = F.col(features_col)
    return arr.isNotNull() & (F.size(arr) == n) & F.forall(arr, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))


def reject_reason(features_col: str = "features", n: int = N_FEATURES):
    """Why a row cannot be scored (expected and received width, or a cell that is NULL or NaN); NULL for a good row."""
    width = F.coalesce(F.size(features_col), F.lit(0))
    return (F.when(F.coalesce(valid_width(features_col, n), F.lit(False)), F.lit(None).cast("string"))
            .when(width == n, F.lit("missing value in features"))
            .otherwise(F.format_string(f"expected {n} features, got %d", width)))


def split_valid(df: DataFrame, features_col: str = "features", n: int = N_FEATURES):
    """(good rows, quarantined rows with a reason)."""
    marked = df.withColumn("reject_reason", reject_reason(features_col, n))
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def batch_score(model, df: DataFrame, features_col: str = "features", n: int = N_FEATURES) -> DataFrame:
    """Score rows carrying a ``features`` array.  Every input row comes back: one that cannot be scored has a
    ``reject_reason`` and no prediction.  One pass: a rejected row is given zeros to go through the model."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    stage = model.stages[-1] if hasattr(model, "stages") else model
    fc = stage.getFeaturesCol()
    marked = df.withColumnRenamed(features_col, "_raw").withColumn("reject_reason", reject_reason("_raw", n))
    good = F.col("reject_reason").isNull()
    zeros = F.array_repeat(F.lit(0.0), n)
    out = stage.transform(marked.withColumn(fc, array_to_vector(F.when(good, F.col("_raw").cast("array<double>")).otherwise(zeros))))
    prob = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction").cast("double")
    scored = good & ~F.isnan(prob)  # infinite features can leave no probability
    out = out.withColumns({"_p": F.when(scored, prob), "_y": F.when(scored, F.col("prediction").cast("int"))})
    out = out.drop("probability", "rawPrediction", "prediction", fc).withColumnsRenamed({"_p": "probability", "_y": "prediction", "_raw": features_col})
    return out.withColumn("risk_level", risk_level())


def linear_score(df: DataFrame, coefficients: list[float], intercept: float, features_col: str = "features") -> DataFrame:
    """Score with given logistic coefficients, as one expression: probability, prediction (from 0.5 on) and level, rejects as in ``batch_score``."""
    n = len(coefficients)
    marked = df.withColumn("reject_reason", reject_reason(features_col, n))
    terms = F.zip_with(F.col(features_col).cast("array<double>"), F.array(*[F.lit(float(c)) for c in coefficients]), lambda x, w: x * w)
    z = F.aggregate(terms, F.lit(float(intercept)), lambda a, t: a + t)
    probability = F.when(F.col("reject_reason").isNull(), 1 / (1 + F.exp(-z)))
    marked = marked.withColumn("probability", F.when(~F.isnan(probability), probability))
    return marked.withColumn("prediction", (F.col("probability") >= 0.5).cast("int")).withColumn("risk_level", risk_level())
