"""ST1's labelling reads new files once and deals their records once, under short keys."""

from pyspark.sql import functions as F

from seqloom.operators import annotations as A
from seqloom.session import scratch_path
from seqloom.sources import readers as R
from seqloom.streaming import ingest as ST
from tests.test_io_streaming import _write_text

LABELLED = "accession long, _block long, ord long, seq string, gid string, label string"


def test_labelling_numbers_no_records_beforehand(spark, monkeypatch):
    landing, out = (scratch_path(spark, n) for n in ("l1", "o1"))
    gi = spark.createDataFrame([("1", "symA", 1)], "gene_id string, symbol string, ord long")
    path = _write_text(landing, "GCF_000000001.1_x.fna", ">x [gene=abc] [x]\nAC\n>x [db_xref=GeneID:1] [y]\nGG\n>z [x]\nT\n")
    monkeypatch.setattr(ST, "file_ordinal", None)  # it scans every file a second time
    new = spark.createDataFrame([("GCF_000000001.1", "c", f"file:{path}")], ST.ARRIVAL)
    ST.write_lines(new, 0, gi, out)
    assert [r[0] for r in ST.read_ingested(spark, out).collect()] == ["GCF_000000001.1: abc symA"]
    assert [r[0] for r in ST.read_ingested(spark, out, "nucleotides").collect()] == ["GCF_000000001.1:  AC GGT"]
    manifest = spark.read.parquet(f"{out}/manifest/batch_id=0")
    assert manifest.columns == ["file", "genome", "content", "n_records", "n_labelled"]
    assert [tuple(r)[1:] for r in manifest.collect()] == [("GCF_000000001.1", "c", 3, 2)]


def test_a_file_read_in_many_blocks_keeps_its_order(spark):
    landing, out, ckpt = (scratch_path(spark, n) for n in ("lb", "ob", "cb"))
    gi = spark.createDataFrame([], "gene_id string, symbol string, ord long")
    names = ["".join("abcdefghij"[int(c)] for c in f"{i:05d}") for i in range(9000)]
    _write_text(landing, "GCF_000000005.1_big.fna", "".join(f">r{i} [gene={n}] [x]\n{n.upper()}\n" for i, n in enumerate(names)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        ST.ingest_stream(spark, landing, gi, out, ckpt)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r[0] for r in ST.read_ingested(spark, out).collect()] == ["GCF_000000005.1: " + " ".join(names)]
    assert [r[0] for r in ST.read_ingested(spark, out, "nucleotides").collect()] == ["GCF_000000005.1: " + "".join(f" {n.upper()}" for n in names)]


def test_files_of_one_number_stay_apart(spark, monkeypatch):
    landing, out = (scratch_path(spark, n) for n in ("lh", "oh"))
    gi = spark.createDataFrame([], "gene_id string, symbol string, ord long")
    files = [_write_text(landing, f"GCF_{i}.1_x.fna", f">x [gene={g}] [x]\nAC\n") for i, g in enumerate(("ab", "cd"))]
    new = spark.createDataFrame([(f"GCF_{i}.1", "c", f"file:{f}") for i, f in enumerate(files)], ST.ARRIVAL)
    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.lit(7).cast("long"))
    ST.write_lines(new, 0, gi, out)
    assert sorted(r[0] for r in ST.read_ingested(spark, out).collect()) == ["GCF_0.1: ab", "GCF_1.1: cd"]


def test_dealt_records_make_the_same_sentences(spark):
    rows = [(g, b, o, "ACGT"[o % 4], None if o % 3 else "1", None if o % 5 == 0 else f"l{b}{o}") for g in (1, 2) for b in (64, 0) for o in range(9)]
    df = spark.createDataFrame(rows, LABELLED).repartition(5)
    dealt = A.dealt_records(df, size=2).persist()
    want = {g: [r for r in sorted(rows) if r[0] == g] for g in (1, 2)}
    genes = {g: " ".join(r[5] for r in rs if r[5]) for g, rs in want.items()}
    assert {r["accession"]: r["genes"] for r in A.gene_sentence(dealt).collect()} == genes
    assert {r["accession"]: r["genes"] for r in A.gene_sentence(df).collect()} == genes
    for mode in ("symbol", "go"):
        nt = {g: "".join((" " if r[5] else "") + r[3] for r in rs if mode == "symbol" or r[4]) for g, rs in want.items()}
        assert {r["accession"]: r["nt"] for r in A.nt_sentence(dealt, mode).collect()} == nt
    plan = A._chunk_runs(dealt, F.col("label"), " ", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0]
    dealt.unpersist()


def test_a_listing_tries_no_types_on_folder_names(spark):
    before = spark.conf.get(R.FOLDER_TYPES, None)
    with R.listing(spark):
        assert spark.conf.get(R.FOLDER_TYPES) == "false"
    assert spark.conf.get(R.FOLDER_TYPES, None) == before
