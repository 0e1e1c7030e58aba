import duckdb
import pytest

from seqloom.llm import licenses, line_dedup
from tests.llm.helpers import EMPTY, frame, null_id, prose


def duck(sql, df):
    con = duckdb.connect()
    con.register("documents", df.toPandas()[["doc_id", "text"]])
    return sorted(con.execute(sql).fetchall(), key=str)


def lines(seed, n):
    w = prose(seed, 3 * n, 10 ** 6)
    return [" ".join(w[3 * i:3 * i + 3]) for i in range(n)]


def corpus():
    block = lines(1, 14)
    texts = list(EMPTY) + ["\n", "\n\n\n\n", "a\n\nb\n", "b\nc\n\nb"]
    texts += ["\n".join(lines(10 + k, 5) + block[k % 3:] + lines(90 + k, 6)) for k in range(12)]
    texts += ["\n".join(block + lines(3, 4) + block), "\n".join(block), "\n".join(block)]
    return texts + ["Licensed under the Apache License, Version 2.0.", "x\nAll rights reserved.\ny",
                    "this WORK is licensed under the GNU general public license version 3", "all\nrights reserved"]


def test_line_dedup_equals_sql(spark):
    df = frame(spark, corpus(), 3)
    got = line_dedup.line_dedup(df.select("doc_id", "text"))
    want = duck(line_dedup.ORACLE_SQL, df)
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str) == want
    assert sum(r[3] for r in want) > 50


def test_line_dedup_keeps_columns_null_ids_and_colliding_chunks(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = frame(spark, corpus(), 3, [null_id("\n".join(lines(1, 14)))])
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert out.where("doc_id is null").first()["n_removed"] == 0
    want = sorted((tuple(r) for r in out.select("doc_id", "text").collect()), key=str)
    monkeypatch.setattr(F, "xxhash64", lambda c: F.lit(1).cast("long"))  # every hash collides
    again = line_dedup.line_dedup(df).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in again), key=str) == want
    assert line_dedup.line_dedup(df.where("false")).collect() == []


def test_line_dedup_is_native(spark):
    df = frame(spark, corpus(), 2)
    for out in (line_dedup.line_dedup(df), licenses.scan_licenses(df)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_licenses_equal_sql(spark):
    df = frame(spark, corpus(), 2, [null_id(None)])
    got = sorted((tuple(r) for r in licenses.scan_licenses(df.where("doc_id is not null")).collect()), key=str)
    assert got == duck(licenses.oracle_sql(), df.where("doc_id is not null"))
    assert {r[2] for r in got} >= {"apache-2.0", "proprietary", "gpl-3.0"}
    assert licenses.scan_licenses(df.where("false")).collect() == []


@pytest.mark.parametrize("name", ["op3_licenses", "op6_line_dedup", "op10_quality_rules"])
def test_queries_equal_sql_at_sf0001(spark, name):
    from seqloom.llm.queries import REGISTRY
    from tests.conftest import SF0001

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    fn, sql = REGISTRY[name]
    df = fn(spark, SF0001)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, res.fetchall()))
