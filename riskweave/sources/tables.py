"""Reading and writing tables.

Parquet is the storage format; CSV is accepted at the edge with a declared
schema (no inference pass over the data).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.quantiles import materialise
from riskweave.session import ensure_checkpoint_dir

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, min_partitions: int | None = None) -> DataFrame:
    """Parquet scan of one driver table; Catalyst prunes columns and pushes filters.

    ``min_partitions`` spreads a scan that yields fewer tasks (a file written
    as one row group scans as ONE task) with a round-robin exchange; off by
    default because real inputs have one task per split and the exchange
    costs more than it saves on small files.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if min_partitions and df.rdd.getNumPartitions() < min_partitions:
        df = df.repartition(min_partitions)
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             timestamp_format: str | None = None) -> DataFrame:
    """CSV with header. A declared schema avoids an inference scan."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if timestamp_format:
        reader = reader.option("timestampNTZFormat", timestamp_format)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_csv_kept(spark: SparkSession, path: str, schema: T.StructType, timestamp_format: str | None = None, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """S1, T1 with bad rows kept: (good rows in their types, quarantined rows), from one scan of a CSV file or folder with headers.

    A quarantined row has its ``file``, its ``record`` (its number among the file's non-empty lines after the header), the first bad
    ``column`` (NULL where the number of cells is wrong), a ``reason`` and the ``line`` as written. Together both are all records. Every
    line is a record: quoted line breaks are not joined."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField("_line", T.StringType())])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").option("sep", sep).option("enforceSchema", True)
    raw = reader.schema(text).csv(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    # a short or long line has its text in _line already; the others' text is their cells
    cells = F.array_join(F.array(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")) for f in schema.fields]), sep)
    typed, first_bad = [], F.lit(None).cast("string")
    for f in reversed(schema.fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)) and timestamp_format:
            value = F.try_to_timestamp(c, F.lit(timestamp_format)).cast(f.dataType)
        elif isinstance(f.dataType, T.StringType):
            value = c
        else:
            value = F.trim(c).try_cast(f.dataType)
        typed.append(value.alias(f.name))
        first_bad = F.when(c.isNotNull() & value.isNull(), F.lit(f.name)).otherwise(first_bad)
    kinds = F.create_map(*[F.lit(x) for f in schema.fields for x in (f.name, f"not a {f.dataType.simpleString()}")])
    marked = raw.withColumn("_bad", F.when(F.col("_line").isNull(), first_bad)).withColumn("_at", F.monotonically_increasing_id())
    marked = marked.withColumn("_why", F.when(F.col("_line").isNotNull(), F.lit("wrong number of cells")).otherwise(kinds[F.col("_bad")]))
    marked = materialise(marked.withColumn("_line", F.when(F.col("_why").isNotNull(), F.coalesce("_line", cells))))
    good = marked.where("_why is null").select(*reversed(typed))
    # A split's rows are numbered in order: a record's number is that of the splits before it and its place in its own.
    splits = marked.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bad = marked.where("_why is not null").join(splits, ["_file", "_start"])
    return good, bad.select(F.col("_file").alias("file"), (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("record"), F.col("_bad").alias("column"),
                            F.col("_why").alias("reason"), F.col("_line").alias("line"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder: readers that come back many times run none of its plan
    and read the columns they need."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_scan(df: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` rows (a LIMIT; the scan stops early)."""
    return df.limit(n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """S3: write without an index column; partitioned output on request."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def parse_timestamp(col: str, fmt: str | None = None, lenient: bool = False):
    """Text -> timestamp_ntz.  ANSI raises on junk unless ``lenient``."""
    c = F.col(col)
    fn = F.try_to_timestamp if lenient else F.to_timestamp
    if fmt:
        parsed = fn(c, F.lit(fmt)) if lenient else fn(c, fmt)
    else:
        parsed = fn(c)
    return parsed.cast("timestamp_ntz")


def ensure_timestamp(df: DataFrame, col: str) -> DataFrame:
    """Parse only if the column is text (reference: ``to_datetime`` when needed)."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.StringType):
        return df.withColumn(col, parse_timestamp(col))
    if isinstance(dt, T.DateType):
        return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    return df
