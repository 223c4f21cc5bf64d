"""Schema-level operators (T5, T6): metadata comes from ``df.schema`` on the
driver; only the row count runs a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark type name -> SQL standard name used in overview tables.
_SQL_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
    "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
}


def table_overview(df: DataFrame) -> DataFrame:
    """T5: one row per column: name, position, type, row and column counts."""
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(f.name, i + 1, _SQL_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()),
          f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "column STRING, position INT, dtype STRING, spark_type STRING")
    n = df.agg(F.count(F.lit(1)).alias("rows"))
    return meta.crossJoin(n).withColumn("columns", F.lit(len(df.columns)))


def dtype_frequency(df: DataFrame) -> DataFrame:
    """T5: how many columns of each type."""
    meta = df.sparkSession.createDataFrame(
        [(f.dataType.simpleString(),) for f in df.schema.fields], "dtype STRING")
    return meta.groupBy("dtype").agg(F.count(F.lit(1)).alias("columns"))


def label_to_int(c) -> F.Column:
    """Boolean / float label -> 0/1 int (NULL -> 0 as after fillna(0))."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("int"), F.lit(0))
