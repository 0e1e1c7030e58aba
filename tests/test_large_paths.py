"""The paths taken when a table measures too big to broadcast give the same results."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.operators import annotations as A
from seqloom.operators import layout as L
from seqloom.operators import positions as P
from seqloom.sources import readers as R


@pytest.fixture
def no_broadcast(monkeypatch):
    never = lambda df, *a, **k: (df.persist(), False)
    for mod in (A, L, P, R):
        monkeypatch.setattr(mod, "broadcast_if_small", never)


def test_label_lookup_shuffled_path(spark, no_broadcast):
    rows = [("g", 1, ">a [db_xref=GeneID:1] [x]", "A"), ("g", 2, ">a [locus_tag=L_2] [db_xref=GeneID:2] [x]", "C"),
            ("g", 3, ">a [db_xref=GeneID:3] [x]", "G"), ("g", 4, ">a [locus_tag=L_4] [x]", "T"),
            ("g", 5, ">a [gene=abc] [db_xref=GeneID:1] [x]", "T")]
    recs = spark.createDataFrame(rows, "accession string, ord long, header string, seq string")
    info = spark.createDataFrame([("1", "sym1", 1)], "gene_id string, symbol string, ord long")
    lab = {r["ord"]: (r["label"], r["label_source"]) for r in A.label_records(recs, info).collect()}
    assert lab == {1: ("sym1", "symbol"), 2: ("L_2", "locus_tag"), 3: (None, "missed"),
                   4: (None, "dropped"), 5: ("abc", "gene")}


def test_group_index_and_pack_shuffled_paths(spark, no_broadcast):
    df = spark.range(300).select((F.col("id") % 4).alias("g"), (F.col("id") * 37 % 300).alias("k"))
    got = P.dense_index_within(df, ["g"], ["k"], out="ord", start=1, partitions=5)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert got.join(ref, ["g", "k"]).where(F.col("ord") != F.col("ref")).count() == 0
    enc = spark.createDataFrame([(i, "train", i, list(range(i * 10, i * 10 + n))) for i, n in enumerate([3, 8, 1, 5])],
                                "doc_id long, split string, order_key long, ids array<int>")
    blocks = L.pack(L.frame(enc, 6), 4).orderBy("block_id").collect()
    stream = []
    for i, n in enumerate([3, 8, 1, 5]):
        body = [2] + list(range(i * 10, i * 10 + n)) + [1]
        stream += body + [0] * max(6 - n - 2, 0)
    assert [x for b in blocks for x in b["ids"]] == stream


def test_file_ordinal_shuffled_path(spark, no_broadcast, tmp_path):
    p = tmp_path / "GCF_000000005.1_cds_from_genomic.fna"
    p.write_text(">h1\nAC\n>h2\nGG\n>h3\nTT\n")
    got = sorted((r["ord"], r["header"]) for r in R.read_cds_fasta(spark, str(tmp_path)).collect())
    assert got == [(1, ">h1"), (2, ">h2"), (3, ">h3")]
