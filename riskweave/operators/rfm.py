"""Recency / frequency / monetary per customer (A2-A4).

One hash aggregate per customer replaces the source project's per-customer
rescan of the table.  The snapshot date, when not given, is the global
maximum timestamp, computed as a one-row aggregate and joined as a one-row
broadcast, so no value travels through the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.exprs import floor_days_between
from riskweave.sources.schemas import require_columns
from riskweave.sources.tables import ensure_timestamp


def _snapshot_literal(snapshot):
    """A timestamp_ntz literal built from text, so no time zone is involved."""
    if isinstance(snapshot, str):
        snapshot = _dt.datetime.fromisoformat(snapshot)
    elif isinstance(snapshot, _dt.date) and not isinstance(snapshot, _dt.datetime):
        snapshot = _dt.datetime(snapshot.year, snapshot.month, snapshot.day)
    return F.lit(snapshot.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def snapshot_date(tx: DataFrame, datetime_col: str, snapshot=None) -> DataFrame:
    """A3: one-row DataFrame ``snapshot_date`` (argument or max timestamp)."""
    if snapshot is not None:
        return tx.sparkSession.range(1).select(_snapshot_literal(snapshot).alias("snapshot_date"))
    tx = ensure_timestamp(tx, datetime_col)
    return tx.agg(F.max(datetime_col).cast("timestamp_ntz").alias("snapshot_date"))


def rfm(tx: DataFrame, customer_col: str = "CustomerId", datetime_col: str = "TransactionStartTime",
        amount_col: str = "Amount", snapshot=None, keep_snapshot: bool = False) -> DataFrame:
    """A2: ``customer, recency INT, frequency BIGINT, monetary DOUBLE``.

    recency = floor days(snapshot - last transaction); frequency = rows;
    monetary = sum of |amount| (refunds count by size).  Rows without a
    customer id are skipped.
    """
    require_columns(tx, [customer_col, datetime_col, amount_col], "transactions")
    tx = ensure_timestamp(tx, datetime_col)
    per_customer = (tx.where(F.col(customer_col).isNotNull())
                    .groupBy(customer_col)
                    .agg(F.max(datetime_col).cast("timestamp_ntz").alias("_last"),
                         F.count(F.lit(1)).alias("frequency"),
                         F.coalesce(F.sum(F.abs(F.col(amount_col).cast("double"))),
                                    F.lit(0.0)).alias("monetary")))
    # the default snapshot is the latest transaction of the whole table: a
    # map-side max over one column (one row per task reaches the driver side)
    snap = snapshot_date(tx, datetime_col, snapshot)
    out = per_customer.crossJoin(F.broadcast(snap)).select(
        customer_col,
        floor_days_between("snapshot_date", "_last").alias("recency"),
        "frequency", "monetary", "snapshot_date")
    return out if keep_snapshot else out.drop("snapshot_date")


def rfm_summary(rfm_df: DataFrame, features=("recency", "frequency", "monetary")) -> DataFrame:
    """A4: count, mean, std, min, quartiles, max per RFM feature (long form)."""
    from riskweave.operators.profile import describe
    return describe(rfm_df, list(features))
