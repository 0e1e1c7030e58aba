"""The stages against SQL or brute force on the same rows, and ``run`` against the stages chained."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline as P
from seqloom.llm import line_dedup, packing, quality_rules
from seqloom.llm.common import stored
from seqloom.llm.queries import BPE_JSON
from tests.conftest import SF0001
from tests.llm.test_stretches import alternating
from tests.llm.helpers import frame
from tests.llm.test_lines_and_licenses import corpus


def documents(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet")


def duck(sql, df):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    con.execute(f"CREATE VIEW labels AS SELECT * FROM read_parquet('{SF0001}/labels.parquet')")
    res = con.execute(sql)
    return [dict(zip([d[0] for d in res.description], row)) for row in res.fetchall()]


def test_quality_rules_keep_what_the_sql_keeps(spark):
    docs = documents(spark)
    want = sorted(r["doc_id"] for r in duck(quality_rules.ORACLE_SQL, docs) if r["kept"])
    kept = P.keep_quality(spark, docs, SF0001).collect()
    assert sorted(r["doc_id"] for r in kept) == want and 0 < len(want) < docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in kept)


@pytest.mark.parametrize("made", [True, False])
def test_line_dedup_leaves_what_the_sql_leaves(spark, made):
    docs = frame(spark, corpus() + alternating(), 3) if made else documents(spark)
    want = {r["doc_id"]: r["text"] for r in duck(line_dedup.MINIMA_SQL, docs)}
    rows = P.drop_repeated_lines(spark, docs, SF0001).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want and len(rows) == docs.count()
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)


def hold_coverage(pieces, rows):
    """Every id of every row in gapless pieces, once, and gapless windows."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(BPE_JSON).encode
    by_doc = dict(list(pieces.sort_values("start").groupby("doc_id")))
    assert set(by_doc) == {r["doc_id"] for r in rows} and rows
    for r in rows:
        ids = np.asarray([*encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        mine = by_doc[r["doc_id"]]
        assert mine.length.sum() == len(ids) and (mine.start == mine.length.cumsum() - mine.length).all()
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in mine.itertuples())
    order = pieces.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id").length.cumsum() - order.length == order.offset).all()
    assert order.groupby("sequence_id").length.sum().max() <= max(packing.TIERS)


def test_packing_covers_every_id_of_every_row(spark):
    docs = documents(spark)
    hold_coverage(P.pack(spark, docs, SF0001).toPandas(), docs.collect())


def test_run_equals_the_stages_chained(spark):
    """Where a piece is cut depends on the layout of the input; the ids of every text do not."""
    docs = documents(spark)
    for _, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF0001), "chained")
    got = P.run(spark, SF0001)
    assert got.columns == P.pack(spark, docs, SF0001).columns
    hold_coverage(got.toPandas(), docs.collect())
