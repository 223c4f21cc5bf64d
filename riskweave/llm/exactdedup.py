"""Exact deduplication against a persistent digest index, in DataFrame functions only.

The index is a Parquet table (digest, keep_id, n_chars, batch) bucketed by the digest and sorted by it within its
buckets, one row per distinct text ever taken in. New data is met with it in four steps:

1. Every row's text is read once: its SHA-256 without white space and its code points. Only these numbers move on.
2. One row per digest: the text with the most code points, then the smallest id, and the number of rows. Copies shrink
   before the shuffle, so a text that a third of all rows hold is one row per task.
3. Digests that the index has are left out by a sort-merge anti-join; the index side is read by buckets, unshuffled. What
   is left is appended.
4. Each row learns its group's decision. Groups of over 1/8 of a partition's rows, by their number at most eight for
   each partition, are joined by broadcast; the rest by sort-merge.

A batch has a name, and its appended rows carry it: a batch that failed half way and is taken in again finds its own rows
and ends with the same index and the same decisions. One writer at a time.

Defined results: null text is empty, and all texts without other characters than white space are equal; a null id comes
before all others; of rows with equal id and equal text one stays, whichever; a text that an earlier batch brought keeps
none of its new rows, and ``keep_id`` is that batch's; an empty table gives no rows and leaves the index as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import docs_of, drop_shared, write_shared
from riskweave.llm.linededup import LEAST
from riskweave.session import ensure_checkpoint_dir

WHITE = r"[\x20\x09-\x0D]+"
COLUMNS = "digest BINARY, keep_id BIGINT, n_chars BIGINT, batch STRING"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, digest of the text without white space, n_chars of the whole text, and a number for the row."""
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(text, WHITE, "")
    return docs_of(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LEAST)).alias("did"), F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"),
                                                 F.length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("uid"))


class DigestIndex:
    """A digest index in the folder ``path`` (of the checkpoint folder's file system); made there when first used.

    ``buckets`` counts for a new index only: as many tasks read it. Default: the session's shuffle partitions."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        meta = f"{self.path}/meta"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(meta)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(meta)
        self.buckets = spark.read.schema("buckets int").parquet(meta).first().buckets
        # The catalogue may forget the table with the session; its files name their buckets.
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Forget the index and delete its folder, once no result that is still lazy reads it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        drop_shared(self.spark, self.path)

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Take in a batch. Per row: doc_id, digest, n_chars, group_size (rows of the batch with that text), keep_id and whether
        it is the row that stays."""
        read, _ = write_shared(digests(docs, id_col, text_col), "digests")
        best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), "did", "uid")).alias("best")
        groups, _ = write_shared(read.groupBy("digest").agg(best, F.count("*").alias("group_size")), "groups")
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        fresh = fresh.select("digest", F.col("best.did").alias("keep_id"), (-F.col("best.shorter")).alias("n_chars"), F.lit(batch).alias("batch"))
        # As many tasks as buckets, each with one of them: one sorted file a bucket and batch.
        fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        entry = self.rows().select("digest", "keep_id", "batch").hint("merge")
        decided = groups.join(entry, "digest").select("digest", "keep_id", "group_size", F.when(F.col("batch") == batch, F.col("best.uid")).alias("kept_uid"))
        return self._decide(read, decided)

    def _decide(self, read: DataFrame, decided: DataFrame) -> DataFrame:
        total = read.count()
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        bound = max(1, total // (8 * partitions))
        hot = F.broadcast(decided.where(F.col("group_size") > bound))  # under 8 rows for each partition
        rare = decided.where(F.col("group_size") <= bound)
        parts = [read.join(hot, "digest"), read.join(F.broadcast(decided.where(F.col("group_size") > bound).select("digest")), "digest", "left_anti").join(rare.hint("merge"), "digest")]
        back = lambda c: F.when(F.col(c) != LEAST, F.col(c))
        return parts[0].unionByName(parts[1]).select(back("did").alias("doc_id"), "digest", "n_chars", "group_size", back("keep_id").alias("keep_id"),
                                                     F.coalesce(F.col("uid") == F.col("kept_uid"), F.lit(False)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Deduplicate one table by an index of its own, made for it below the checkpoint folder: the rows of ``DigestIndex.add``."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/digest-index-{uuid.uuid4().hex}"
    return DigestIndex(spark, path, buckets).add(docs, "all", id_col, text_col)
