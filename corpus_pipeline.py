"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, substring dedup, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but
the last return the columns of ``documents``; where a text changes, ``n_chars`` (if there is
such a column) is counted anew. ``run`` writes each stage to the shared scratch folder and
reads it back. Null texts and ids, empty tables and further columns are treated as the
operators' modules state; packing has no SQL form, so the whole has none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import line_dedup, packing, parity_join, quality_rules, substring_dedup
from seqloom.llm.common import maybe_broadcast, stored, table

ORACLE_SQL = None


def _recounted(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``df``, with ``n_chars`` counted from the text as it is now."""
    kind = dict(df.dtypes).get("n_chars")
    return df.select(*[F.char_length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio; the trusted target are those
    labelled good."""
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that occur earlier in the corpus leave the texts."""
    return _recounted(line_dedup.stretch_dedup(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of linked documents the one with the smallest id stays."""
    found = parity_join.near_duplicates(docs)
    losers = stored(found.where("component_id < doc_id").select("doc_id").distinct(), "losers")
    return docs.join(maybe_broadcast(losers, 16), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that start in an earlier document leave the texts."""
    return _recounted(substring_dedup.remove_repeats(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised and packed: one row per piece. The word caches are small: executors hold what the
    stages before have grown to."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cached=50_000)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
    return docs
