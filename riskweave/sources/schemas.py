"""Declared schemas, role detection and input guards (driver-side metadata only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Raw transaction table (the 13 attested columns of the source data).
TRANSACTIONS = T.StructType([
    T.StructField("TransactionId", T.StringType()),
    T.StructField("AccountId", T.StringType()),
    T.StructField("CustomerId", T.StringType()),
    T.StructField("CurrencyCode", T.StringType()),
    T.StructField("CountryCode", T.IntegerType()),
    T.StructField("ProviderId", T.StringType()),
    T.StructField("ProductCategory", T.StringType()),
    T.StructField("ChannelId", T.StringType()),
    T.StructField("Amount", T.DoubleType()),
    T.StructField("Value", T.DoubleType()),
    T.StructField("TransactionStartTime", T.TimestampNTZType()),
    T.StructField("PricingStrategy", T.IntegerType()),
    T.StructField("FraudResult", T.IntegerType()),
])

# Candidate target names, in the order they are tried.
TARGET_CANDIDATES = ["target", "Target", "TARGET", "label", "Label", "LABEL",
                     "FraudResult", "fraud_result", "default", "Default", "DEFAULT"]


class SchemaError(ValueError):
    """Raised when required columns are missing."""


def require_columns(df: DataFrame, cols, what: str = "input") -> None:
    """Raise naming the missing and the available columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise SchemaError(
            f"Missing required columns in {what}: {missing}. Available columns: {list(df.columns)}")


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Select column names by type family (numeric/string/int/float/datetime)."""
    tests = {
        "numeric": is_numeric,
        "string": lambda t: isinstance(t, T.StringType),
        "int": lambda t: isinstance(t, T.IntegralType),
        "float": lambda t: isinstance(t, T.FractionalType),
        "datetime": is_datetime,
        "boolean": lambda t: isinstance(t, T.BooleanType),
    }
    test = tests[kind]
    return [f.name for f in df.schema.fields if test(f.dataType)]


def _looks_like_id(name: str) -> bool:
    # Case-sensitive substring rule of the source project ("Id" or "id").
    return "Id" in name or "id" in name


def _key_or_id(name: str) -> bool:
    # The driver tables name their ids '*key'.
    return "key" in name or _looks_like_id(name)


#: Named rules for id columns, so that a saved processor can name its own; add to it for rules of your own.
ID_RULES = {"id_substring": _looks_like_id, "key_or_id": _key_or_id, "none": None}


def id_rule_name(rule) -> str | None:
    """The name under which a rule is known; None for an unnamed function."""
    return next((name for name, r in ID_RULES.items() if r is rule), None)


def detect_roles(df: DataFrame, customer_col: str | None = None, datetime_col: str | None = None,
                 target_col: str | None = None, id_rule=_looks_like_id):
    """Split columns into (categorical, numeric) feature lists.

    Removed: customer, datetime and target columns, every datetime-typed column
    and any column whose name matches ``id_rule`` (default: contains Id/id).
    """
    skip = {c for c in (customer_col, datetime_col, target_col) if c}
    cats, nums = [], []
    for f in df.schema.fields:
        if f.name in skip or is_datetime(f.dataType) or (id_rule and id_rule(f.name)):
            continue
        if is_numeric(f.dataType):
            nums.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            cats.append(f.name)
    return cats, nums


def correlation_columns(df: DataFrame, keep=("CountryCode",)) -> list[str]:
    """T4: numeric columns whose name lacks 'Id', except the kept ones."""
    return [c for c in columns_of_kind(df, "numeric") if "Id" not in c or c in keep]


def detect_target(df: DataFrame, candidates=TARGET_CANDIDATES) -> str | None:
    """First candidate that is present among the correlation columns wins."""
    usable = set(correlation_columns(df))
    for c in candidates:
        if c in usable:
            return c
    return None
