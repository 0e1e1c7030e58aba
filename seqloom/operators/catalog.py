"""Catalog and locate: which genomes, which directory version, which file.

The reference walks FTP listings per genome with a thread pool; here the listings are
tables and every choice is a grouped aggregate, so a million genomes are one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.hashing import hash_int
from seqloom.operators.positions import dense_index

# Download root and the file suffixes the ingest looks for.
DEFAULT_BASE_URL = "https://ftp.ncbi.nlm.nih.gov/genomes/all/GCF"
CDS_SUFFIX = "_cds_from_genomic.fna.gz"
FEATURE_TABLE_SUFFIX = "_feature_table.txt.gz"
VERSION_DIGIT_RE = r"^GCF_[0-9]+\.([0-9])_.+$"


def refseq_only(catalog: DataFrame, mode: str = "prefix", col: str = "accession") -> DataFrame:
    """Keep RefSeq assemblies (prefix ``GCF`` or, in notebook mode, containing ``GCF_``)."""
    c = F.col(col)
    cond = c.startswith("GCF") if mode == "prefix" else c.contains("GCF_")
    return catalog.where(cond)


def latest_version(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """The subdirectory to use per accession, with a status column.

    One entry -> take it. Otherwise keep entries holding ``v<d>`` or ``.<d>`` (d = the
    accession's last character); of those the largest digit in ``GCF_<n>.<digit>_``
    wins, the first listed on ties; an entry without that digit ranks last.
    """
    acc = catalog.select("accession").distinct()
    d = F.substring("accession", -1, 1)
    lst = listing.join(acc, "accession")
    match = F.col("entry").contains(F.concat(F.lit("v"), d)) | F.col("entry").contains(F.concat(F.lit("."), d))
    digit = F.coalesce(F.nullif(F.regexp_extract("entry", VERSION_DIGIT_RE, 1), F.lit("")).cast("bigint"), F.lit(-1))
    rank_key = F.when(match, F.struct(digit, -F.col("pos")))
    agg = lst.groupBy("accession").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.min_by("entry", "pos").alias("_only"),
        F.count_if(match).alias("n_match"),
        F.max_by("entry", rank_key).alias("_best"))
    out = acc.join(agg, "accession", "left")
    subdir = F.when(F.col("n_entries") == 1, F.col("_only")).when(F.col("n_match") >= 1, F.col("_best"))
    status = (F.when(F.col("n_entries").isNull(), "no_entries").when(subdir.isNull(), "no_match")
              .otherwise("ok"))
    return out.select("accession", subdir.alias("subdir"), status.alias("status"))


def pick_file(files: DataFrame, suffix: str = CDS_SUFFIX) -> DataFrame:
    """First file (by listing position) named ``<at least one char><suffix>`` per directory."""
    ok = F.col("entry").endswith(suffix) & (F.length("entry") > len(suffix))
    return files.groupBy("accession", "dir").agg(F.min_by(F.when(ok, F.col("entry")), F.when(ok, F.col("pos"))).alias("file"))


def fetch_manifest(located: DataFrame, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """K5: sharded directory (3+3+3 digits of the accession) and the file's URL."""
    a = F.col("accession")
    dir_path = F.concat_ws("/", F.substring(a, 5, 3), F.substring(a, 8, 3), F.substring(a, 11, 3))
    url = F.when(F.col("subdir").isNotNull() & F.col("file").isNotNull(),
                 F.concat_ws("/", F.lit(base_url), dir_path, F.col("subdir"), F.col("file")))
    return located.withColumn("dir_path", dir_path).withColumn("url", url)


def locate(catalog: DataFrame, listing: DataFrame, files: DataFrame, suffix: str = CDS_SUFFIX,
           base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """P2 + P3 + K5: ``accession, subdir, file, dir_path, url, status`` per genome."""
    latest = latest_version(catalog, listing)
    picked = pick_file(files, suffix).withColumnRenamed("dir", "subdir")
    j = latest.join(picked, ["accession", "subdir"], "left")
    status = F.when((F.col("status") == "ok") & F.col("file").isNull(), "no_file").otherwise(F.col("status"))
    return fetch_manifest(j.withColumn("status", status), base_url)


def pending(catalog: DataFrame, done: DataFrame, key: str = "accession") -> DataFrame:
    """K4: genomes of the work list not yet in the written manifest (replaces the start index)."""
    return catalog.join(done.select(key).distinct(), key, "left_anti")


def progress(work_list: DataFrame, order_cols: Sequence, results: DataFrame, key: str = "accession") -> DataFrame:
    """K6: position of each accession in the work list (first match) beside its result columns."""
    idx = dense_index(work_list.select(key, *[c for c in order_cols if c != key]), order_cols, out="position")
    first = idx.groupBy(key).agg(F.min("position").alias("position"))
    return first.join(results, key, "left")


def shuffle(df: DataFrame, key: str, seed: int = 0, out: str = "idx") -> DataFrame:
    """Seeded shuffle, then reindex: ``out`` is the row's place in the shuffled order."""
    h = hash_int(seed, key)
    return dense_index(df.withColumn("_sl_h", h), ["_sl_h", key], out=out).drop("_sl_h")
