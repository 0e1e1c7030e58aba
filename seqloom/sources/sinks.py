"""Sinks (K1-K3): corpus lines, vocabulary, packed uint16 shards and raw shard files.

Writes go through Spark's committers (one file per task, atomic job commit), so a
retried task never leaves a half-written or duplicated file behind.
"""

from __future__ import annotations

import gzip
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.operators.positions import _same_as_before
from seqloom.session import stored
from seqloom.sources.rawfiles import NULL_SPLIT, write_raw

U16_MAX = 65535
ZEROS = "_sl_zeros"  # zero ids that follow a block's ids, written but not shuffled


def corpus_lines(df: DataFrame, labelled: bool = True, key: str = "accession", col: str = "genes") -> DataFrame:
    """K1 line form: ``<accession>: <tokens>`` (rows with no tokens skipped) or, unlabelled,
    the tokens alone (a line even when empty)."""
    if labelled:
        keep = df.where(F.col(col).isNotNull() & (F.length(col) > 0))
        return keep.select(F.concat(F.col(key), F.lit(": "), F.col(col)).alias("value"))
    return df.select(F.coalesce(F.col(col), F.lit("")).alias("value"))


def write_corpus(df: DataFrame, path: str, labelled: bool = True, key: str = "accession", col: str = "genes",
                 mode: str = "append") -> None:
    """K1: write corpus lines as text (no session marker lines)."""
    corpus_lines(df, labelled, key, col).write.mode(mode).text(path)


def write_line_pieces(pieces: DataFrame, path: str, sep: str = " ", mode: str = "overwrite",
                      partitions: int | None = None) -> list[tuple[str, int]]:
    """K1 for lines of any length: rows ``accession, piece, text`` -> files ``part-<k>.txt`` that hold, one
    after the other, the lines ``<accession>: <pieces joined by sep>`` in accession order.

    Rows are dealt by ranges of (accession, piece) and written as they come, so no row and no task ever
    holds a whole line: a long line goes on in the next file (``cat part-*`` is the corpus;
    ``readers.read_line_pieces`` reads it back). A line's begin and end are rows of their own, so no row
    needs to know its neighbours. Empty and null texts write nothing, and genomes with no other ones no
    line; rows with a null accession are left out. ``sep`` is a space or empty. The files are committed as
    a whole (``rawfiles``); returns their names and bytes.
    """
    if sep not in ("", " "):
        raise ValueError("sep must be a space or empty")
    # read five times below (begins, ends and pieces, each sampled before it is dealt): made once
    kept = stored(pieces.select("accession", "piece", "text").where(F.col("accession").isNotNull() & (F.length("text") > 0)))
    lines = kept.select("accession").distinct()
    head = F.concat("accession", F.lit(":" if sep else ": "))
    rows = kept.select("accession", F.lit(1).alias("at"), F.col("piece").cast("long").alias("piece"), F.concat(F.lit(sep), "text").alias("data"))
    for at, data in ((0, head), (2, F.lit("\n"))):
        rows = rows.unionByName(lines.select("accession", F.lit(at).alias("at"), F.lit(0).cast("long").alias("piece"), data.alias("data")))
    order = ["accession", "at", "piece"]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    name = F.concat(F.lit("part-"), F.lpad(F.spark_partition_id().cast("string"), 7, "0"), F.lit(".txt"))
    return write_raw(dealt.sortWithinPartitions(*order).select(name.alias("file"), F.col("data").cast("binary").alias("data")), path, mode)


def write_vocab(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: ``token, id`` as parquet under ``path/table`` plus a one-row ``{vocab_size}`` summary."""
    vocab.select("token", F.col("id").cast("long")).write.mode(mode).parquet(f"{path}/table")
    vocab.agg(F.count(F.lit(1)).cast("bigint").alias("vocab_size")).coalesce(1).write.mode(mode).json(f"{path}/summary")


def write_vocab_json(vocab: DataFrame, path: str, specials: int = 3, mode: str = "overwrite") -> None:
    """K2, single-object form: one JSON object ``{id_vocab, vocab_size}`` with the tokens after the
    ``specials`` in id order, as ``read_vocab`` reads it. The object is one row by definition of
    the format (a vocabulary of at most 65,536 ids); use the table form for larger ones."""
    real = vocab.where(F.col("id") >= specials)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "token"))), lambda x: x["token"])
    real.agg(ordered.alias("id_vocab"), F.count(F.lit(1)).alias("vocab_size")).coalesce(1).write.mode(mode).json(path)


def _encode_u16(batches):
    for b in batches:
        # one conversion of the flat ids, then slices of its buffer
        lists = b.column("ids")
        ends = 2 * np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype("<u2").tobytes()
        zeros = b.column(ZEROS).to_pylist() if ZEROS in b.schema.names else [0] * b.num_rows
        data = [flat[i:j] + bytes(2 * (z or 0)) for i, j, z in zip(ends[:-1].tolist(), ends[1:].tolist(), zeros)]
        keep = [n for n in b.schema.names if n not in ("ids", ZEROS)]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(data, type=pa.binary())], names=keep + ["data"])


def shard_bytes(blocks: DataFrame, dtype: str = "uint16", col: str = "ids") -> DataFrame:
    """Blocks as little-endian ``uint16`` bytes, after a range check that fails the job on
    any id outside ``[0, 65535]`` (numpy would wrap silently)."""
    if dtype != "uint16":
        raise ValueError("only uint16 shards are written")
    c = F.col(col)
    bad = (F.array_max(c) > U16_MAX) | (F.array_min(c) < 0)
    checked = blocks.withColumn(col, F.when(bad, F.raise_error(F.concat(
        F.lit("id outside uint16 in block "), F.col("block_id").cast("string")))).otherwise(c))
    schema = T.StructType([f for f in checked.schema.fields if f.name not in (col, ZEROS)] + [T.StructField("data", T.BinaryType())])
    return checked.mapInArrow(_encode_u16, schema)


def write_shards(blocks: DataFrame, path: str, dtype: str = "uint16", mode: str = "overwrite") -> DataFrame:
    """K3: packed blocks -> parquet ``split=<s>/`` files of ``block_id, n, data`` in block order.

    Returns the manifest ``split, block_id, first_offset, n`` (a lazy frame over the written files). Blocks of
    ``pack(zeros=ZEROS)`` come with their padding as a number and keep it so up to the worker that writes their bytes.
    """
    if ZEROS in blocks.columns:
        b = blocks.select("split", "block_id", "n", ZEROS, "ids")
    else:
        blank = (F.array_max("ids") == 0) & (F.array_min("ids") == 0)
        # a block of padding travels as the number of its zeros
        b = blocks.select("split", "block_id", "n", F.when(blank, F.size("ids")).otherwise(0).alias(ZEROS),
                          F.when(blank, F.slice("ids", 1, 0)).otherwise(F.col("ids")).alias("ids"))
    # a given number of partitions: their bytes say nothing of the time where padding is a number
    sc = blocks.sparkSession.sparkContext
    n = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * sc.defaultParallelism)
    ordered = b.repartitionByRange(n, "split", "block_id").sortWithinPartitions("split", "block_id")
    shard_bytes(ordered, dtype).write.mode(mode).partitionBy("split").parquet(path)
    spark = blocks.sparkSession
    written = spark.read.parquet(path).select("split", "block_id", "n")
    # offsets: the block size is constant except for each split's last block
    bsz = written.groupBy("split").agg(F.max("n").alias("_b"))
    return written.join(F.broadcast(bsz), "split").select(
        "split", "block_id", (F.col("block_id") * F.col("_b")).alias("first_offset"), "n")


def write_stream(rows: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> DataFrame:
    """K3, raw form: rows of ``stream_shards`` -> ``split=<s>/shard-<k>.bin``, flat little-endian uint16.

    A shard is one file, written by one task in row order from compact rows (``body`` and ``pad``; the
    zeros are written, not shuffled) or padded ones (``ids``). The files are committed as a whole
    (``rawfiles``): a retried task leaves no second file, an id outside ``[0, 65535]`` fails the job.
    Returns the manifest ``split, shard, first_offset, n``.
    """
    from seqloom.sources.readers import stream_manifest

    name = F.concat(F.lit("split="), F.coalesce(F.url_encode(split_col), F.lit(NULL_SPLIT)), F.lit("/shard-"),
                    F.lpad(F.col("shard").cast("string"), 5, "0"), F.lit(".bin"))
    compact = "body" in rows.columns and "pad" in rows.columns
    ids = [F.col("body").alias("ids"), F.col("pad").cast("long").alias("pad")] if compact else [F.col("ids")]
    ordered = (rows.select(name.alias("file"), "row", *ids).repartition("file").sortWithinPartitions("file", "row").drop("row"))
    write_raw(ordered, path, mode)
    return stream_manifest(rows.sparkSession, path)


def _folder(accession: str | None) -> str:
    """The folder of a genome, named as Spark's ``partitionBy`` names it."""
    if not accession:
        return "accession=__HIVE_DEFAULT_PARTITION__"
    return "accession=" + re.sub(r"""[\x01-\x1f"#%'*/:=?\\{\[\]^\x7f]""", lambda m: f"%{ord(m[0]):02X}", accession)


def _fasta_bytes(name: str, pack):
    """Rows ``accession, value``, a genome's beside each other -> ``file, data``: the lines of each stretch of one genome."""
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            starts = np.concatenate([[0], np.flatnonzero(~_same_as_before(batch, ["accession"])) + 1])
            ends = pa.array(np.concatenate([starts, [batch.num_rows]]), pa.int32())
            text = pc.binary_join(pa.ListArray.from_arrays(ends, batch.column("value")), "\n").to_pylist()
            names = batch.column("accession").take(pa.array(starts)).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"{_folder(n)}/{name}" for n in names], pa.string()),
                                              pa.array([pack(f"{t}\n".encode()) for t in text], pa.binary())], ["file", "data"])
    return run


def write_fasta(records: DataFrame, path: str, mode: str = "overwrite", compression: str = "gzip") -> None:
    """One FASTA file per genome under ``path/accession=<acc>/``, records in ``ord`` order.

    Used to land CDS files for ingest (the reverse of ``read_cds_fasta``). The files are committed as a whole
    (``rawfiles``); Spark's own writer starts three processes a file on a local folder (the modes of folder, file
    and checksum), which outweighs the writing where genomes are many. A gzip file has a member for
    each stretch of records that reached the writer together, packed at zlib's fastest level: level 6 took longer
    than all else in the write.
    """
    if compression not in ("gzip", "none"):
        raise ValueError("compression must be gzip or none")
    name = f"part-{uuid.uuid4().hex}.txt" + (".gz" if compression == "gzip" else "")
    pack = (lambda data: gzip.compress(data, 1, mtime=0)) if compression == "gzip" else bytes
    lines = records.select("accession", "ord", F.coalesce(F.concat("header", F.lit("\n"), "seq"), F.lit("")).alias("value"))
    # a given number of partitions: a genome more or less in a task weighs little, its bytes say nothing of the time
    n = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * records.sparkSession.sparkContext.defaultParallelism)
    dealt = lines.repartition(n, "accession").sortWithinPartitions("accession", "ord").drop("ord")
    write_raw(dealt.mapInArrow(_fasta_bytes(name, pack), "file string, data binary"), path, mode)
