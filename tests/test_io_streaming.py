"""Readers, sinks and the streaming ingest (S1-S9, K1-K3, ST1)."""

import gzip
import os

from pyspark.sql import functions as F

from seqloom.session import scratch_path
from seqloom.sources import readers as R
from seqloom.sources import sinks as S
from seqloom.streaming import ingest as ST


def _local(path):
    return path.replace("file:", "")


def _write_text(path, name, text, gz=False):
    os.makedirs(_local(path), exist_ok=True)
    full = os.path.join(_local(path), name)
    if gz:
        with gzip.open(full, "wt") as f:
            f.write(text)
    else:
        with open(full, "w") as f:
            f.write(text)
    return full


def test_read_cds_fasta_gzip_and_order(spark):
    d = scratch_path(spark, "t_fasta")
    _write_text(d, "GCF_000000001.1_x_cds_from_genomic.fna.gz", ">h1 a\nAC\nGT\n>h2\nTT\n", gz=True)
    _write_text(d, "GCF_000000002.3_y_cds_from_genomic.fna", ">k1\nCC\n")
    got = sorted((r["accession"], r["ord"], r["header"], r["seq"]) for r in R.read_cds_fasta(spark, d).collect())
    assert got == [("GCF_000000001.1", 1, ">h1 a", "ACGT"), ("GCF_000000001.1", 2, ">h2", "TT"),
                   ("GCF_000000002.3", 1, ">k1", "CC")]


def test_read_catalog_and_gene_info_na(spark):
    d = scratch_path(spark, "t_cat")
    _write_text(d, "c.tsv", "Assembly Accession\tAssembly Name\tOrganism Name\tAnnotation Count Gene Total\n"
                            "GCF_1.1\tA\tE. coli\t4000\nGCA_2.1\tB\tNA\t\n")
    rows = sorted(tuple(r) for r in R.read_catalog(spark, d).collect())
    assert rows == [("GCA_2.1", "B", None, None, []), ("GCF_1.1", "A", "E. coli", 4000, [])]
    g = scratch_path(spark, "t_gi")
    _write_text(g, "gi.tsv", "#tax_id\tGeneID\tSymbol\tLocusTag\n1\t10\tNA\t-\n1\t11\t-\tx\n1\t10\tdnaA\t-\n")
    from seqloom.operators.annotations import symbol_table
    sym = {r["gene_id"]: r["symbol"] for r in symbol_table(R.read_gene_info(spark, g)).collect()}
    assert sym == {"10": "dnaA", "11": "-"}


def test_gff_comment_and_vocab_json_keys(spark):
    d = scratch_path(spark, "t_gff")
    _write_text(d, "a.gff", "##gff-version 3\nNC_1\tRefSeq\tgene\t1\t90\t.\t+\t.\tID=a;gene=x\n")
    g = R.read_gff(spark, d).collect()
    assert len(g) == 1 and g[0]["end"] == 90
    v = scratch_path(spark, "t_vocab")
    _write_text(v, "v.json", '{\n "reduced_vocab": ["b", "a", "b"],\n "vocab_size": 3\n}\n')
    got = {r["token"]: r["id"] for r in R.read_vocab(spark, v).collect()}
    assert got == {"[PAD]": 0, "[EOS]": 1, "[SOS]": 2, "b": 5, "a": 4}


def test_write_corpus_skips_empty_labelled(spark):
    df = spark.createDataFrame([("GCF_1.1", "a b"), ("GCF_2.1", ""), ("GCF_3.1", None)], "accession string, genes string")
    p = scratch_path(spark, "t_k1")
    S.write_corpus(df, p)
    assert [r["value"] for r in spark.read.text(p).collect()] == ["GCF_1.1: a b"]
    p2 = scratch_path(spark, "t_k1u")
    S.write_corpus(df, p2, labelled=False)
    assert sorted(r["value"] for r in spark.read.text(p2).collect()) == ["", "", "a b"]


def test_ingest_replay_and_duplicate_file(spark):
    landing, out, ckpt = (scratch_path(spark, n) for n in ("t_land", "t_out", "t_ckpt"))
    gi = spark.createDataFrame([("1", "symA", 1)], "gene_id string, symbol string, ord long")
    text = ">x [gene=abc] [x]\nAC\n>x [db_xref=GeneID:1] [y]\nGG\n"
    _write_text(landing, "GCF_000000009.1_cds_from_genomic.fna", text)
    ST.ingest_stream(spark, landing, gi, out, ckpt)
    # the same genome offered again under another file name, and a replay with nothing new
    _write_text(landing, "GCF_000000009.1_copy_cds_from_genomic.fna", text)
    ST.ingest_stream(spark, landing, gi, out, ckpt)
    ST.ingest_stream(spark, landing, gi, out, ckpt)
    lines = [r["value"] for r in ST.read_ingested(spark, out).collect()]
    assert lines == ["GCF_000000009.1: abc symA"]
    assert F is not None


def test_read_cds_fasta_across_splits(spark):
    d = scratch_path(spark, "t_fasta_split")
    n = 3000
    text = "".join(f">rec{i} [gene=g] [x]\nACGTACGTACGTACGTACGTACGT\nTTTT\n" for i in range(n))
    _write_text(d, "GCF_000000077.1_big_cds_from_genomic.fna", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = R.read_cds_fasta(spark, d)
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n
    got = {r["ord"]: r["header"] for r in rows}
    assert got == {i + 1: f">rec{i} [gene=g] [x]" for i in range(n)}
    assert all(r["seq"] == "ACGTACGTACGTACGTACGTACGTTTTT" for r in rows)


def test_read_corpus_text_drops_markers_and_keeps_order(spark):
    d = scratch_path(spark, "t_corpus_txt")
    _write_text(d, "a.txt", "################ SESSION START ################\nGCF_1.1: a b\nGCF_2.1: c\n")
    rows = sorted((r["doc_id"], r["text"]) for r in R.read_corpus(spark, d, fmt="text").collect())
    assert rows == [(0, "GCF_1.1: a b"), (1, "GCF_2.1: c")]


def test_read_gene_go_whole_file_and_lines(spark):
    d = scratch_path(spark, "t_go_whole")
    _write_text(d, "m.json", '{\n  "1": ["GO:1", "GO:2"],\n  "2": []\n}\n')
    got = {r["gene_id"]: r["go_terms"] for r in R.read_gene_go(spark, d, whole_file=True).collect()}
    assert got == {"1": ["GO:1", "GO:2"], "2": []}
    d2 = scratch_path(spark, "t_go_lines")
    _write_text(d2, "m.jsonl", '{"1": ["GO:1"]}\n{"3": ["GO:3", "GO:4"]}\n')
    got2 = {r["gene_id"]: r["go_terms"] for r in R.read_gene_go(spark, d2).collect()}
    assert got2 == {"1": ["GO:1"], "3": ["GO:3", "GO:4"]}


def test_write_vocab_table_and_summary(spark):
    from seqloom.operators.corpus import build_vocab

    v = build_vocab(spark.createDataFrame([("b",), ("a",)], "token string"))
    p = scratch_path(spark, "t_vocab_out")
    S.write_vocab(v, p)
    assert spark.read.json(f"{p}/summary").first()["vocab_size"] == 5
    back = {r["token"]: r["id"] for r in R.read_vocab(spark, f"{p}/table", fmt="parquet").collect()}
    assert back == {"[PAD]": 0, "[EOS]": 1, "[SOS]": 2, "a": 3, "b": 4}
