"""ST1: ingest newly landed CDS FASTA files once each, label them, append their sentences.

Two queries run one after the other over what has landed:

1. *Arrivals*: a file-source stream names the new files; a batch fingerprints each of them, read once,
   and appends ``(genome, content, file)`` to the arrivals table, one small folder a micro-batch.
2. *Lines*: a stream over the arrivals drops those whose ``(genome, content)`` was seen before, then
   reads the new files and writes per file one gene line and one nucleotide line. What was
   seen is Spark's keyed state (RocksDB): a batch looks its own keys up and adds them, whatever the
   number of files ingested before; nothing reads the whole manifest.

A copy of a file that is offered again (under whatever name) adds nothing, while a second file
of the same genome, in the same or a later batch, is ingested as lines of its own. Each
micro-batch N overwrites its own ``batch_id=N`` folders, so a replayed batch rewrites the same
output; arrivals that a replay writes again meet their own keys. With a ``gene_go`` map the
labels are GO terms and the nucleotide line follows the GO rules.
"""

from __future__ import annotations

from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import annotations as A
from seqloom.session import release
from seqloom.sources.readers import (ACCESSION_RE, dealt_names, file_ordinal, file_order, listing, packed_records,
                                     parse_fasta_records)
from seqloom.sources.sinks import corpus_lines

NAMED = "path string, modificationTime timestamp, length long, content binary"  # what Spark lists files as
ARRIVAL = "genome string, content string, file string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROW_BITS = (1 << 33) - 1  # of monotonically_increasing_id: the row's place in its partition
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _direct(spark: SparkSession, file: str) -> Column:
    """Whether a task opens the file itself: packed (no reader could split it) and on a mounted folder. Spark's
    reader takes the others, and all where it is told to skip broken or missing files."""
    if any(spark.conf.get(f"spark.sql.files.ignore{k}Files").lower() == "true" for k in ("Corrupt", "Missing")):
        return F.lit(False)
    return F.col(file).startswith("file:") & F.col(file).endswith(".gz")


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``value, _file, _block, _row`` of the records of files that Spark's reader takes."""
    with listing(spark):
        lines = file_order(spark.read.option("lineSep", "\n>").text([_literal(f) for f in files]))
    return parse_fasta_records(lines.where(F.length(F.trim("value")) > 0))


def write_arrivals(batch: DataFrame, batch_id: int, out: str) -> None:
    """Genome, content and name of the files (``_file``) of a batch; of equal files the first by name."""
    spark = batch.sparkSession
    record = F.xxhash64("ord", "header", "seq")
    content = F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(record), F.bit_xor(F.xxhash64(F.lit(1), record))).alias("content")
    # a stream may name a file several times where another's name is a pattern
    batch = batch.select("_file").distinct().persist()
    try:
        direct = _direct(spark, "_file")
        packed = dealt_names(batch.where(direct), "_file", batch.count()).withColumn("_key", F.monotonically_increasing_id())
        # a file's name comes with its first record only
        files = packed_records(packed).groupBy("_key").agg(F.max("_file").alias("accession"), content).drop("_key")
        others = [r["_file"] for r in batch.where(~direct).collect()]
        if others:
            rows = file_ordinal(_lines(spark, others)).withColumnRenamed("_file", "accession")
            files = files.unionByName(rows.groupBy("accession").agg(content))
        new = files.withColumn("genome", F.regexp_extract("accession", ACCESSION_RE, 1)).groupBy("genome", "content").agg(
            F.min("accession").alias("file")).persist()
        path = f"{out}/arrivals/batch_id={batch_id}"
        held = _written(spark, path)
        # a replayed batch leaves the file alone that the second query may have taken already
        if held is None or held.exceptAll(new).count() or new.exceptAll(held).count():
            new.coalesce(1).write.mode("overwrite").parquet(path)
        new.unpersist()
    finally:
        batch.unpersist()
        release()


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        df = spark.read.schema(ARRIVAL).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return df if df.inputFiles() else None


def _literal(path: str) -> str:
    """A file name as the reader takes it: no pattern."""
    return "".join("\\" + c if c in "[]{}*?\\" else c for c in unquote(path))


def write_lines(new: DataFrame, batch_id: int, gene_info: DataFrame, out: str, gene_go: DataFrame | None = None) -> None:
    """Label and write the files that a batch of new arrivals names."""
    spark = new.sparkSession
    new = new.persist()
    labels = None
    try:
        # records carry a number for their file's name; two names of one number (none to be expected) stay names
        names, numbers = new.agg(F.count_distinct("file"), F.count_distinct(F.xxhash64("file"))).first()
        key = F.xxhash64 if numbers == names else F.col
        direct = _direct(spark, "file")
        packed = dealt_names(new.where(direct).select(F.col("file").alias("_file")).distinct(), "_file", names)
        # a sentence asks for the order of its records only: their place in the block that one task reads.
        # Without new files the folders are emptied all the same: the batch may be a replay
        recs = packed_records(packed.withColumn("_key", key("_file"))).select(
            F.col("_key").alias("accession"), F.lit(0).cast("long").alias("_block"), "ord", "header", "seq")
        others = [r["file"] for r in new.where(~direct).select("file").distinct().collect()]
        if others:
            recs = recs.unionByName(_lines(spark, others).select(
                key("_file").alias("accession"), "_block", F.col("_row").bitwiseAND(ROW_BITS).alias("ord"), "header", "seq"))
        labels = A.label_records(recs, gene_info) if gene_go is None else A.go_tokens(recs, gene_go)
        # what the sentences and counts read, no headers
        labels = A.dealt_records(labels.select("accession", "_block", "ord", "seq", "gid", "label")).persist()
        names = new.select(key("file").alias("accession"), "genome")
        for folder, text, col in (("corpus", A.gene_sentence(labels), "genes"),
                                  ("nucleotides", A.nt_sentence(labels, "symbol" if gene_go is None else "go"), "nt")):
            named = text.join(names, "accession").select("genome", col)
            corpus_lines(named, key="genome", col=col).write.mode("overwrite").text(f"{out}/{folder}/batch_id={batch_id}")
        counts = labels.groupBy("accession").agg(F.count(F.lit(1)).cast("bigint").alias("n_records"),
                                                 F.count("label").cast("bigint").alias("n_labelled"))
        counted = new.withColumn("accession", key("file")).join(counts, "accession")
        counted.select("file", "genome", "content", "n_records", "n_labelled").write.mode("overwrite").parquet(f"{out}/manifest/batch_id={batch_id}")
    finally:
        for df in (labels, new):
            if df is not None:
                df.unpersist()
        release()


@contextmanager
def _keyed_state(spark: SparkSession):
    """State in RocksDB while the queries start, unless the session names a store of its own."""
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, own if own and "HDFSBackedStateStoreProvider" not in own else ROCKSDB)
    try:
        yield
    finally:
        if own:
            spark.conf.set(PROVIDER, own)
        else:
            spark.conf.unset(PROVIDER)


def ingest_stream(spark: SparkSession, landing: str, gene_info: DataFrame, out: str, checkpoint: str,
                  max_files_per_trigger: int | None = None, gene_go: DataFrame | None = None, nested: bool = False):
    """Run the ingest over everything landed so far (``availableNow``) and wait for it. Returns the
    finished query that wrote the lines. ``nested``: all files below ``landing`` are meant, whatever the folders'
    names; the driver need not read a partition value from each of them at every listing."""
    def limited(reader):
        return reader.option("maxFilesPerTrigger", int(max_files_per_trigger)) if max_files_per_trigger else reader

    with listing(spark):  # the stream lists by the settings of its session, also after it was started
        # the names alone: a batch reads its files itself
        raw = limited(spark.readStream.format("binaryFile").schema(NAMED)).option("recursiveFileLookup", nested).load(landing).select(
            F.col("_metadata.file_path").alias("_file"))
        arrivals = (raw.writeStream.foreachBatch(lambda df, bid: write_arrivals(df, bid, out))
                    .option("checkpointLocation", f"{checkpoint}/arrivals").trigger(availableNow=True).start())
        arrivals.awaitTermination()
    with _keyed_state(spark), listing(spark):
        # the folder may not exist before the first arrival; then the stream is empty
        seen = limited(spark.readStream.schema(ARRIVAL)).parquet(f"{out}/arrivals/*").dropDuplicates(["genome", "content"])
        lines = (seen.writeStream.foreachBatch(lambda df, bid: write_lines(df, bid, gene_info, out, gene_go))
                 .option("checkpointLocation", f"{checkpoint}/lines").trigger(availableNow=True).start())
        lines.awaitTermination()
    return lines


def read_ingested(spark: SparkSession, out: str, folder: str = "corpus") -> DataFrame:
    """All lines written by the ingest so far; ``folder`` is ``corpus`` or ``nucleotides``."""
    return spark.read.text(f"{out}/{folder}").select("value")
