import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from tests.conftest import SF0001
from tests.llm.helpers import frame, prose


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(E.oracle_sql()) >= {"op3_licenses", "op6_line_dedup", "op10_quality_rules"}


def test_stages_in_turn(spark):
    """Each stage against the brute-force form of its rule, on what its predecessor kept."""
    from tests.llm.test_jaccard_join import brute as jaccard
    from tests.llm.test_substring_dedup import brute as repeats

    passage = prose(1, 70)
    block = "\n".join(" ".join(prose(50 + i, 4)) for i in range(14))
    texts = [" ".join(prose(k, 120)) + "\n" + block for k in range(6)]
    texts += [" ".join(prose(100 + k, 60) + passage + prose(200 + k, 60)) for k in range(6)]
    texts += [texts[0].replace("w", "w", 1), texts[7] + " tail", "too short", None, ""]
    docs = frame(spark, texts, 3)
    kept = P.keep_quality(spark, docs, SF0001).cache()
    assert {r["doc_id"] for r in kept.collect()} <= set(range(14)) and kept.columns == docs.columns
    lines = P.drop_repeated_lines(spark, docs.where("doc_id < 14"), SF0001)
    assert lines.columns == docs.columns and lines.count() == 14
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = P.drop_near_duplicates(spark, docs, SF0001)
    want = {d for d, _, c in jaccard(texts) if d == c}
    assert {r["doc_id"] for r in near.collect()} == want and near.columns == docs.columns
    cut = P.drop_repeated_passages(spark, docs, SF0001).collect()
    assert {r["doc_id"]: len((r["text"] or "").split()) for r in cut} == {d: n - gone for d, n, gone, _ in repeats(texts)}


@pytest.mark.parametrize("rows", ["true", "false"])
def test_run_and_empty_table(spark, rows):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").where(rows)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF0001)
    n = docs.agg({"length": "sum", "doc_id": "count"}).first()
    assert (n[1] if rows == "true" else 1) and docs.columns[:3] == ["doc_id", "start", "length"]
