"""Gzip files opened by the tasks give what Spark's text reader gives, and an ingest reads each of them once a query."""

import gzip

import pytest
from pyspark.sql import functions as F

from seqloom.session import scratch_path
from seqloom.sources import readers as R
from seqloom.sources import sinks as S
from seqloom.streaming import ingest as ST
from tests.test_io_streaming import _local

ODD = {
    "plain": b">a [x]\nAC\nGT\n>b\nT\n",
    "no mark": b"a\nAC\n>b",
    "empty end": b">a\nAC\n>",
    "only mark": b">",
    "breaks": b">a\r\nAC\r\nG\r\n>b\r\n",
    "blank": b"\n>  \n>\n>a\nA\n>\n>b\n",
    "blank first": b"   \n>a\nA\n>  \n>b\nC",
    "marks": b">>a\nA\n>>>b\nC\n\n>c\n\n\nG",
    "order mark": b"\xef\xbb\xbf>a\nA\n>b\nC\n",
    "wide": ">ä [gene=é]\nÄÖ\n>日本\n".encode(),
    "100% [{a}] *": b">a\nA\n",
    "empty": b"",
    "spaces": b"   ",
}


def _landed(path):
    import os

    os.makedirs(_local(path))
    for name, data in ODD.items():
        with open(f"{_local(path)}/GCF_{name}.fna.gz", "wb") as f:
            half = len(data) // 2
            f.write(gzip.compress(data[:half]) + gzip.compress(data[half:]))  # two members


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 22])
def test_packed_files_read_as_spark_reads_them(spark, chunk):
    path = scratch_path(spark, "odd")
    _landed(path)
    raw = spark.read.option("lineSep", "\n>").text(path)
    lines = R.file_order(raw).where(F.length(F.trim("value")) > 0)
    want = R.file_ordinal(R.parse_fasta_records(lines)).select("_file", "ord", "header", "seq")
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"))
    got = R.packed_records(R.dealt_names(names, "_file", 5).withColumn("_key", F.col("_file")), chunk)
    assert sorted(map(tuple, got.select("_key", "ord", "header", "seq").collect())) == sorted(map(tuple, want.collect()))
    firsts = [r for r in got.select("_key", "_file").collect() if r["_file"]]
    assert sorted(r["_key"] for r in firsts) == sorted({r["_file"] for r in want.collect()}) and all(r["_key"] == r["_file"] for r in firsts)


def test_both_readers_ingest_the_same(spark, monkeypatch):
    gi = spark.createDataFrame([], "gene_id string, symbol string, ord long")
    path = scratch_path(spark, "odd")
    _landed(path)
    found = []
    for other in (False, True):
        out, ckpt = scratch_path(spark, "oo"), scratch_path(spark, "oc")
        if other:
            monkeypatch.setattr(ST, "_direct", lambda *_: F.lit(False))
        ST.ingest_stream(spark, path, gi, out, ckpt)
        found.append([sorted(map(tuple, spark.read.parquet(f"{out}/{t}").drop("batch_id").collect())) for t in ("arrivals", "manifest")]
                     + [sorted(map(tuple, ST.read_ingested(spark, out, t).collect())) for t in ("corpus", "nucleotides")])
    for a, b in zip(*found):
        assert a == b
    assert len(found[0][0]) == 11 and len(found[0][3]) > 5


def test_a_file_is_opened_once_a_query_by_its_task(spark, monkeypatch):
    landing, out, ckpt = (scratch_path(spark, n) for n in ("lq", "oq", "cq"))
    S.write_fasta(spark.range(30).selectExpr("concat('GCF_', id, '.1') accession", "1L ord", "'>h [gene=abc] [x]' header", "repeat('A', 1 + id) seq"), landing)
    gi = spark.createDataFrame([], "gene_id string, symbol string, ord long")
    for other in ("_lines", "file_ordinal"):
        monkeypatch.setattr(ST, other, None)  # Spark's reader, and the scan that numbers its records
    made = spark.sparkContext.accumulator(0)
    own = ST.packed_records

    def counted(names):
        def count(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b
        return own(names.mapInArrow(count, names.schema))

    monkeypatch.setattr(ST, "packed_records", counted)
    ST.ingest_stream(spark, landing, gi, out, ckpt, nested=True)
    assert made.value == 60
    assert sorted(r["value"] for r in ST.read_ingested(spark, out, "nucleotides").collect()) == sorted(f"GCF_{i}.1:  " + "A" * (1 + i) for i in range(30))


def test_files_to_be_skipped_when_broken_are_left_to_the_reader(spark):
    rows = spark.createDataFrame([("file:/a/b.fna.gz",), ("file:/a/b.fna",), ("hdfs://h/b.fna.gz",)], "f string")
    taken = lambda: [r[0] for r in rows.where(ST._direct(spark, "f")).collect()]
    assert taken() == ["file:/a/b.fna.gz"]
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        assert taken() == []
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
