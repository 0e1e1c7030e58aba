"""The registered queries ``opN_<name>``: each operator over its whole table, with its
production parameters, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, license_notices, licenses, line_dedup, packing, parity_join, periodic_runs, permutation_index, quality_classifier, quality_rules, substring_dedup, toxicity, warc, whitening
from seqloom.llm.common import held_out, table

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    aside = held_out(F.col("doc_id"), 5, 0)
    scored = toxicity.score_toxicity(docs, *toxicity.fit_toxicity(docs, labels, ~aside))
    return scored.select("doc_id", aside.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BPE_JSON)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices.scan_notices(table(spark, sf_dir, "documents"))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_stretch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.stretch_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    aside = held_out(F.col("doc_id"), 3, 1)
    scored = quality_classifier.score_quality(docs, quality_classifier.fit_quality(docs, labels, ~aside))
    return scored.select("doc_id", aside.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_digest(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(docs, quality_rules.trusted_ids(labels))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_digest(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_history(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position", F.col("capture_no").cast("long"))


REGISTRY: dict = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_packing": (op2_packing, None),
    "op3_licenses": (op3_licenses, licenses.oracle_sql()),
    "op3_license_notices": (op3_license_notices, None),
    "op4_parity_join": (op4_parity_join, None),
    "op5_permutation_index": (op5_permutation_index, None),
    "op6_line_dedup": (op6_line_dedup, line_dedup.ORACLE_SQL),
    "op6_stretch_dedup": (op6_stretch_dedup, line_dedup.MINIMA_SQL),
    "op7_quality_classifier": (op7_quality_classifier, None),
    "op8_substring_dedup": (op8_substring_dedup, None),
    "op9_bpe": (op9_bpe, None),
    "op10_quality_rules": (op10_quality_rules, quality_rules.ORACLE_SQL),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_whitening": (op12_whitening, None),
    "op13_warc": (op13_warc, warc.ORACLE_SQL),
}
