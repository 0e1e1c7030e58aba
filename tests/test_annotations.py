"""Golden rows for FASTA annotation (F1-F9, J1-J3, P9), expected values from FIXTURES §3."""

from pyspark.sql import functions as F

from seqloom.operators import annotations as A


def _records(spark, rows):
    return spark.createDataFrame(rows, "accession string, ord long, header string, seq string")


def _info(spark, rows):
    return spark.createDataFrame(rows, "gene_id string, symbol string, ord long")


def test_header_fields_edge_rows(spark):
    rows = [("g", 1, ">x [gene=dnaA] [x=1]", ""), ("g", 2, ">x [gene=rpl2] [x=1]", ""),
            ("g", 3, ">x [gene=dnaA]", ""), ("g", 4, ">x [locus_tag=b_1] [x]", ""),
            ("g", 5, ">x [locus_tag=b_c_d] [x]", ""), ("g", 6, ">x [db_xref=GeneID:123] [y]", "")]
    got = {r["ord"]: (r["gene"], r["locus"], r["gid"]) for r in A.header_fields(_records(spark, rows)).collect()}
    assert got[1][0] == "dnaA"
    assert got[2][0] is None  # a digit is not a letter
    assert got[3][0] is None  # no following bracket
    assert got[4][1] == "b_1"
    assert got[5][1] is None
    assert got[6][2] == "123"


def test_label_cascade_and_missed(spark):
    rows = [("g", 1, ">a [db_xref=GeneID:1] [x]", "A"),            # GeneID with symbol
            ("g", 2, ">a [locus_tag=L_2] [db_xref=GeneID:2] [x]", "C"),  # no symbol, locus
            ("g", 3, ">a [db_xref=GeneID:3] [x]", "G"),             # neither -> missed
            ("g", 4, ">a [locus_tag=L_4] [x]", "T"),                # no GeneID -> dropped, not missed
            ("g", 5, ">a [locus_tag=L_5] [db_xref=GeneID:5] [x]", "A")]  # symbol missing -> locus
    info = _info(spark, [("1", "sym1", 1), ("5", None, 5)])
    lab = {r["ord"]: (r["label"], r["label_source"]) for r in A.label_records(_records(spark, rows), info).collect()}
    assert lab == {1: ("sym1", "symbol"), 2: ("L_2", "locus_tag"), 3: (None, "missed"),
                   4: (None, "dropped"), 5: ("L_5", "locus_tag")}
    missed = A.missed_genes(A.label_records(_records(spark, rows), info)).collect()
    assert missed[0]["missed"] == 1


def test_last_duplicate_symbol_wins(spark):
    info = _info(spark, [("7", "x", 1), ("7", "y", 2)])
    recs = _records(spark, [("g", 1, ">a [db_xref=GeneID:7] [x]", "A")])
    assert A.label_records(recs, info).first()["label"] == "y"


def test_nt_sentence_symbol_mode(spark):
    rows = [("g", 1, ">a [gene=A] [x]", "AC"), ("g", 2, ">a [x]", "GG"), ("g", 3, ">a [gene=B] [x]", "TT")]
    lab = A.label_records(_records(spark, rows), _info(spark, [("0", "z", 0)]))
    assert A.nt_sentence(lab, "symbol").first()["nt"] == " ACGG TT"
    assert A.gene_sentence(lab).first()["genes"] == "A B"


def test_nt_sentence_go_mode_and_go_tokens(spark):
    rows = [("g", 1, ">a [db_xref=GeneID:1] [x]", "AC"), ("g", 2, ">a [x]", "GG"),
            ("g", 3, ">a [db_xref=GeneID:3] [x]", "CC"), ("g", 4, ">a [db_xref=GeneID:4] [x]", "TT"),
            ("g", 5, ">a [db_xref=GeneID:5] [x]", "AA"), ("g", 6, ">a [db_xref=GeneID:9] [x]", "")]
    go = spark.createDataFrame([("1", ["a", "b"]), ("4", ["t"]), ("5", [])], "gene_id string, go_terms array<string>")
    toks = A.go_tokens(_records(spark, rows), go)
    got = {r["ord"]: r["label"] for r in toks.collect()}
    assert got[1] == "a:b" and got[5] is None and got[6] is None
    assert A.nt_sentence(toks, "go").first()["nt"] == " ACCC TTAA"


def test_fasta_records_from_lines(spark):
    lines = spark.createDataFrame([("g", 0, "orphan"), ("g", 1, ">h1"), ("g", 2, "AC"), ("g", 3, "GT"),
                                   ("g", 4, ">h2"), ("g", 5, "TT"), ("k", 1, ">h3"), ("k", 2, "CC")],
                                  "accession string, line_no long, line string")
    got = sorted((r["accession"], r["ord"], r["header"], r["seq"]) for r in A.fasta_records(lines).collect())
    assert got == [("g", 0, None, "orphan"), ("g", 1, ">h1", "ACGT"), ("g", 4, ">h2", "TT"), ("k", 1, ">h3", "CC")]


def test_gene2go_map_keeps_order_and_distinct(spark):
    rows = spark.createDataFrame([("1", "GO:2", 2), ("1", "GO:1", 1), ("1", "GO:2", 3)],
                                 "gene_id string, go_term string, ord long")
    assert A.gene2go_map(rows).first()["go_terms"] == ["GO:1", "GO:2"]


def test_gff_attributes_by_key(spark):
    rows = [("ID=a;Name=n;gbkey=Gene;gene=g1;gene_biotype=pc;locus_tag=L1;old_locus_tag=O1",),
            ("ID=b;Name=n;gbkey=Gene;gene_biotype=pc;locus_tag=L2;old_locus_tag=O2",),
            ("ID=c;Name=n;gbkey=Gene;gene_biotype=pc;locus_tag=L3",),
            ("ID=d;Name=n;Note=a=b;pseudogene=true;locus_tag=L4",)]
    g = A.gff_attributes(spark.createDataFrame(rows, "attributes string")).collect()
    assert (g[0]["gene"], g[0]["old_locus_tag"]) == ("g1", "O1")
    assert (g[1]["gene"], g[1]["old_locus_tag"]) == (None, "O2")
    assert (g[2]["gene"], g[2]["old_locus_tag"]) == (None, None)
    assert g[3]["gene"] is None and g[3]["locus_tag"] == "L4"


def test_missing_and_stringify(spark):
    df = spark.createDataFrame([("NA",), (None,), ("-",), ("WP_1",)], "x string")
    df = df.withColumn("x", F.when(F.col("x") == "NA", None).otherwise(F.col("x")))
    assert A.drop_missing(df, "x").count() == 2
    assert A.missing_rows(df, "x").count() == 2
    assert sorted(r["x"] for r in A.stringify(df, "x").collect()) == ["-", "WP_1", "nan", "nan"]
