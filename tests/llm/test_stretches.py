import random

import duckdb
import pytest

from seqloom.llm import line_dedup
from tests.conftest import SF0001
from tests.llm.helpers import EMPTY, frame
from tests.llm.test_lines_and_licenses import corpus, duck, lines


def alternating():
    rnd = random.Random(5)
    return ["\n".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 14))) for _ in range(150)]


def test_stretch_dedup_equals_sql(spark):
    runs = ["\n".join(lines(k, 3) + ["same"] * 5 + lines(50 + k, 3)) for k in range(4)] + ["x\nq\nq", "q\nq\ny", "q\nq\nz\nr\nr\n\n\n\nr"]
    df = frame(spark, corpus() + runs + alternating(), 3)
    got = line_dedup.stretch_dedup(df.select("doc_id", "text")).collect()
    assert sorted((tuple(r) for r in got), key=str) == duck(line_dedup.MINIMA_SQL, df)


def test_repeated_stretches_go(spark):
    block, run, pair = lines(1, 10), ["same line"] * 6, ["first line", "other line"] * 5
    texts = ["\n".join(lines(10 + k, 4) + s + lines(90 + k, 4)) for s in (run, pair, block) for k in (0, 30, 60)]
    rows = {r["doc_id"]: r["n_removed"] for r in line_dedup.stretch_dedup(frame(spark, texts)).collect()}
    assert [rows[i] for i in (0, 1, 2)] == [0, 6, 6]  # a block of one line, whatever stands around it
    assert rows[3] >= 4 and min(rows[4], rows[5]) >= 8
    assert min(rows[7], rows[8]) >= 5


def test_no_lone_chunks(spark):
    df = frame(spark, EMPTY[1:] + alternating() + corpus(), 2).where("text like '%\n%'")
    pieces = df.select(line_dedup.minima_pieces(df["text"])).collect()
    assert pieces and all("\nc" in p for r in pieces for p in r[0])


@pytest.mark.parametrize("name", ["op6_stretch_dedup"])
def test_query_equals_sql_at_sf0001(spark, name):
    from seqloom.llm.queries import REGISTRY

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF0001}/documents.parquet')")
    fn, sql = REGISTRY[name]
    got = fn(spark, SF0001).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(sql).fetchall()))
