"""Tables whose columns are called like what the operators add: the stages keep them as they are."""

import corpus_pipeline as P
from seqloom.llm import line_dedup
from tests.conftest import SF0001

OWN = {"n_removed": 1, "n_lines": 2, "__id": 3, "__gone": 4, "__s": 5, "__text": 6, "removed": 7, "pieces": 8, "new_text": 9, "id_of_removed": 10, "id_of_spans": 11}


def test_stages_on_clashing_names(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    named = docs.selectExpr("*", *[f"{v} as {k}" for k, v in OWN.items()])
    for stage in (P.keep_quality, P.drop_repeated_lines, P.drop_near_duplicates, P.drop_repeated_passages):
        plain = {r["doc_id"]: r["text"] for r in stage(spark, docs, SF0001).collect()}
        out = stage(spark, named, SF0001)
        assert out.columns == named.columns
        rows = out.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == plain and all(r[k] == v for r in rows for k, v in OWN.items())
    assert line_dedup.stretch_dedup(named).columns == [*named.columns, "n_lines_", "n_removed_"]
