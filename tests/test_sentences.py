"""Sentences of many records: dealt by chunk and joined run by run."""

import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.operators import annotations as A


def test_runs_go_on_in_the_next_batch():
    rows = [("a", 0, "1"), ("a", 0, None), ("a", 0, "2"), ("a", 1, None), (None, 0, "3"), (None, 0, "4"), ("b", None, "5")]
    kinds = pa.schema([("accession", pa.string()), ("_chunk", pa.int64()), ("_piece", pa.string()), ("_flag", pa.bool_())])
    table = pa.Table.from_pylist([dict(zip(kinds.names, (*r, r[2] is None))) for r in rows], schema=kinds)
    want = [("a", 0, "1 2", 2, 1), ("a", 1, "", 0, 1), (None, 0, "3 4", 2, 0), ("b", None, "5", 1, 0)]
    for size in (1, 2, 3, 100):
        out = A._joined_runs(["accession", "_chunk"], " ")(iter(table.to_batches(max_chunksize=size)))
        assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_a_header_is_taken_apart_once_and_no_record_is_collected(spark):
    rows = spark.range(3000).select(
        F.concat(F.lit("g"), F.col("id") % 300).alias("accession"), F.col("id").alias("ord"),
        F.concat(F.lit(">a [db_xref=GeneID:"), F.col("id") % 7, F.lit("] [x]")).alias("header"), F.lit("AC").alias("seq"))
    go = spark.createDataFrame([(str(i), ["t", f"u{i}"][:i]) for i in range(6)], "gene_id string, go_terms array<string>")
    out = A.gene_sentence(A.go_tokens(rows, go))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 1
    assert plan.count("collect_list") == 1  # of the chunks alone
    got = {r["accession"]: (r["genes"], r["n_genes"]) for r in out.collect()}
    terms = {1: "t", 2: "t:u2", 3: "t:u3", 4: "t:u4", 5: "t:u5"}
    want = {}
    for i in range(3000):
        if i % 7 in terms:
            want.setdefault(f"g{i % 300}", []).append(terms[i % 7])
    assert got == {k: (" ".join(v), len(v)) for k, v in want.items()}


def test_a_large_lookup_leaves_unused_columns_behind(spark, monkeypatch):
    from seqloom import session

    monkeypatch.setattr(session, "BROADCAST_MAX_BYTES", 0)
    rows = spark.range(50).select(F.lit("g").alias("accession"), F.col("id").alias("ord"),
                                  F.concat(F.lit(">a [db_xref=GeneID:"), F.col("id"), F.lit("] [x]")).alias("header"),
                                  F.concat(F.lit("unread"), F.col("id")).alias("seq"))
    go = spark.createDataFrame([("3", ["a", "b"])], "gene_id string, go_terms array<string>")
    out = A.gene_sentence(A.go_tokens(rows, go))
    assert "unread" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("g", "a:b", 1)]
