"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage works on all that the one before kept, and all but the last return the columns of ``documents``. Rows with
the same id and text count as one from the second stage on. A text that loses lines has its ``n_chars`` counted anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import decontamination, jaccardjoin, langid, linededup, packing
from riskweave.llm.queries import bpe_path
from riskweave.session import ensure_checkpoint_dir
from riskweave.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language stay; those without a letter, or of no prevailing language, go."""
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each class of near-equal lines keeps its first line; a document of which no line stays goes."""
    out = linededup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are alike by word 5-grams one stays."""
    return jaccardjoin.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of 1024-token sequences."""
    return packing.pack(docs, bpe_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Models, hashing and tokenisation have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written below the shared checkpoint folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    top = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{top}/{k}-{name}")
    return docs
