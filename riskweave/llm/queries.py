"""The registered queries of the text operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (alignment, decontamination, exactdedup, extraction, jaccardjoin, langid, licences, linededup, oracles, packing, pii, spelling,
                           toxicity, winnowing)
from riskweave.llm.common import held_out_rows
from riskweave.sources.tables import read_table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), bpe_path())


@register("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out_rows("doc_id", 4, 2)))
    out = langid.label(docs, model)
    return out.select("doc_id", held_out_rows("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "n_words", "switches")


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels.where(~held_out_rows("doc_id", 5, 0)))
    out = toxicity.score(docs, weights)
    return out.select("doc_id", held_out_rows("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      "n_evidence", "evidence")


@register("op4_extraction")
def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read_table(spark, sf_dir, "pages"))


@register("op5_decontamination", oracles.DECONTAMINATION)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op10_line_dedup", oracles.LINE_DEDUP)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", "class_doc_id", "class_line_no", "class_lines", "kept")


@register("op6_jaccard_join", oracles.JACCARD_JOIN)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccardjoin.join(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_links", "equal_docs")


@register("op2_winnowing")
def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(read_table(spark, sf_dir, "documents"))


@register("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.search(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(F.transform(base, lambda s: s["kind"]), lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


@register("op8_licences")
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs))


def piece_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@register("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), bpe_path(), piece_path())[0]


@register("op12_exact_dedup", oracles.EXACT_DEDUP)
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "n_chars")


@register("op13_spelling", oracles.SPELLING)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))
