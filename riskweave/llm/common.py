"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import ensure_checkpoint_dir


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): extra columns, whatever their names, never reach an operator."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def held_out_rows(id_col: str, mod: int, part: int):
    """Boolean column: crc32 of the id as text, modulo ``mod``, is ``part`` (a null id counts as '')."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % F.lit(mod) == F.lit(part)


def write_shared(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut lineage: write Parquet below the cluster's checkpoint folder and read it back.

    Every executor sees that folder, so a lost executor costs nothing but its running tasks."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_shared(spark: SparkSession, path: str) -> None:
    """Remove a table of write_shared once nothing that is still lazy reads it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_blocks(ids: list, texts: list, chars: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """Cut one Arrow batch into runs of at most about ``chars`` characters, to bound a task's memory."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            yield ids[at:k + 1], texts[at:k + 1]
            at, size = k + 1, 0
    if at < len(ids):
        yield ids[at:], texts[at:]


def batch_slices(batch: pa.RecordBatch, text_col: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut one Arrow batch into runs of rows of at most about ``size`` bytes of text, before any text becomes a Python string."""
    before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    for at in np.unique(before, return_index=True)[1]:
        yield batch.slice(at, np.searchsorted(before, before[at], "right") - at)


def row_draws(df: DataFrame, *cols: str) -> DataFrame:
    """With a column ``_draw``, from 0 to 1, hashed from ``cols`` and the row's place in the table: rows that are equal in
    ``cols``, or null there, have draws of their own. Which rows have low ones depends on how the table is partitioned."""
    salted = df.withColumn("_place", F.monotonically_increasing_id())
    return salted.withColumn("_draw", F.pmod(F.xxhash64(*cols, "_place"), F.lit(1 << 30)) / float(1 << 30)).drop("_place")


def sample_by_key(df: DataFrame, key: str, per_key: int, max_keys: int) -> DataFrame:
    """About ``per_key`` rows of each value of ``key`` (null left out): those whose draw falls below per_key / count. Draws
    are by row, whatever ids and texts are null or repeated. Of more than ``max_keys`` values the most frequent are sampled.

    One counting pass over the key column and one filtering pass, no sort and no shuffle of texts. The number of rows
    is binomial around ``per_key``; it does not grow with the table. Only the counts come to the driver."""
    tally = df.where(F.col(key).isNotNull()).groupBy(key).count()
    counts = {r[0]: r[1] for r in tally.orderBy(F.col("count").desc(), key).limit(max_keys).collect()}
    if not counts:
        return df.limit(0)
    share = F.lit(None).cast("double")
    for value, n in counts.items():
        share = F.when(F.col(key) == F.lit(value), F.lit(min(1.0, per_key / n))).otherwise(share)
    return row_draws(df, *df.columns).where(F.col(key).isNotNull() & (F.col("_draw") < share)).drop("_draw")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_rows(docs: DataFrame, text_col: str, accepted: Callable[[list], list[bool]]) -> DataFrame:
    """The rows whose text ``accepted`` takes, with all their columns and without a shuffle."""
    if len({c.lower() for c in docs.columns}) != len(docs.columns):
        raise ValueError("column names must differ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in batch_slices(batch, at):
                yield part.filter(pa.array(accepted(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
