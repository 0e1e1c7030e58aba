"""Many genomes: one FASTA file each, without a process or a task a file."""

import gzip
import os

import pyarrow as pa
import pytest

from seqloom.session import scratch_path
from seqloom.sources import readers as R
from seqloom.sources import sinks as S
from tests.test_io_streaming import _local

SCHEMA = "accession string, ord long, header string, seq string"


def test_stretches_of_a_genome_make_one_file(spark):
    table = pa.table({"accession": ["a", "a", "a", None, "", "x=y"], "value": [">1\nAC", "", ">3\nG", ">4\n", ">5\nT", ">6\nC"]})
    want = {"accession=a": ">1\nAC\n\n>3\nG\n", "accession=__HIVE_DEFAULT_PARTITION__": ">4\n\n>5\nT\n", "accession=x%3Dy": ">6\nC\n"}
    for size in (1, 2, 100):
        got = {}
        for b in S._fasta_bytes("f", lambda data: gzip.compress(data))(iter(table.to_batches(max_chunksize=size))):
            for r in b.to_pylist():
                folder, name = r["file"].split("/")
                got[folder] = got.get(folder, b"") + r["data"]
        assert {k: gzip.decompress(v).decode() for k, v in got.items()} == want


def test_files_are_committed_as_a_whole_and_read_back(spark):
    path = scratch_path(spark, "many")
    first = [(f"GCF_{g:09d}.1", o, f">h{g}.{o} [x]", "ACGT" * o) for g in range(60) for o in (1, 2, 3)]
    S.write_fasta(spark.createDataFrame(first, SCHEMA), path)
    S.write_fasta(spark.createDataFrame([("GCA_000000001.1", 1, ">n", "T")], SCHEMA), path, mode="append")
    assert sorted(tuple(r) for r in R.read_cds_fasta(spark, path).collect()) == [("GCA_000000001.1", 1, ">n", "T"), *first]
    below = [f for _, _, names in os.walk(_local(path)) for f in names]
    assert sum(f.endswith(".txt.gz") for f in below) == 61
    assert not any(f.endswith(".crc") for f in below)  # Spark's own writer leaves one a file, and forks for its mode
    assert "_manifest.json" in below
    with pytest.raises(ValueError):
        S.write_fasta(spark.createDataFrame(first, SCHEMA), path, compression="zip")


def test_many_folders_are_listed_by_few_tasks(spark):
    path = scratch_path(spark, "listed")
    n = 4 * spark.sparkContext.defaultParallelism + 40
    S.write_fasta(spark.range(n).selectExpr("concat('GCF_', id, '.1') accession", "1L ord", "'>h' header", "'A' seq"), path)
    before = spark.conf.get(R.LISTING)
    spark.sparkContext.setJobGroup("listed", "")
    df = R.read_cds_fasta(spark, path)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listed") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert df.count() == n and spark.conf.get(R.LISTING) == before
    assert n not in tasks and 4 * spark.sparkContext.defaultParallelism in tasks


def test_pieces_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("b", 0, "x"), ("a", 1, "y"), ("a", 0, "z")], "accession string, piece long, text string")
    S.write_line_pieces(rows.mapInArrow(count, rows.schema), str(tmp_path / "p"))
    assert made.value == 3
    text = "".join(open(f).read() for f in sorted((tmp_path / "p").glob("part-*.txt")))
    assert text == "a: z y\nb: x\n"


def test_an_ingest_lists_its_folders_by_few_tasks(spark):
    from seqloom.streaming import ingest as ST

    landing, out, ckpt = (scratch_path(spark, n) for n in ("lm", "om", "cm"))
    few = 4 * spark.sparkContext.defaultParallelism
    n = few + 45
    S.write_fasta(spark.range(n).selectExpr("concat('GCF_', 100 + id, '.1') accession", "1L ord", "'>h [gene=abc] [x]' header", "repeat('A', 1 + id) seq"), landing)
    gi = spark.createDataFrame([], "gene_id string, symbol string, ord long")
    asked = []  # how many tasks a listing may take while the stream reads
    own, before = ST.write_arrivals, spark.conf.get(R.LISTING, None)
    ST.write_arrivals = lambda batch, *rest: (asked.append(spark.conf.get(R.LISTING)), own(batch, *rest))[1]
    try:
        ST.ingest_stream(spark, landing, gi, out, ckpt)
    finally:
        ST.write_arrivals = own
    assert asked == [str(few)] and spark.conf.get(R.LISTING, None) == before
    assert ST.read_ingested(spark, out).count() == n
