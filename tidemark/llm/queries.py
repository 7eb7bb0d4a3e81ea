"""Queries over the corpus tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, fingerprints, hamming, infill, languages, licenses, mixing, nearjoin, oracles, pii, quality, repeats, toxicity, turns
from tidemark.llm.blocks import documents, fold

Query = Callable[[SparkSession, str], DataFrame]


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op2_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_semi_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.detect_pii(docs, pii.fit_spans(docs))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = languages.identify_languages(docs, languages.fit_languages(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op8_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op9_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.link_documents(documents(spark, sf_dir))


def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.link_fingerprints(documents(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.trie_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_syncmer_fingerprints": op1_syncmer_fingerprints,
    "op2_bigru_toxicity": op2_bigru_toxicity,
    "op3_semi_crf_pii": op3_semi_crf_pii,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_entropy_mix": op5_entropy_mix,
    "op6_license_scan": op6_license_scan,
    "op7_language_id": op7_language_id,
    "op8_maximal_repeats": op8_maximal_repeats,
    "op9_crf_quality": op9_crf_quality,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_simhash_trie": op11_simhash_trie,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {"op8_maximal_repeats": oracles.OP8, "op10_jaccard_join": oracles.OP10, "op12_conversation_trie": oracles.OP12, "op13_fill_in_middle": oracles.OP13}
