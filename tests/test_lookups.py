"""Lookups with frequent keys: spread over tasks, and equal to a plain left join."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.operators import corpus as K
from seqloom.operators import lookups as H


def rows_of(spark, n=40000):
    # a third "hot", a tenth null, a tenth "gone" (no table row), the rest spread
    i = F.col("id")
    token = F.when(i % 3 == 0, "hot").when(i % 10 == 1, F.lit(None)).when(i % 10 == 2, "gone").otherwise(F.concat(F.lit("t"), (i % 5003).cast("string")))
    return spark.range(n).select(i.alias("rid"), token.alias("token"))


def table_of(spark):
    return spark.range(4000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"), F.col("id").cast("int").alias("v")) \
        .unionByName(spark.createDataFrame([("hot", -7)], "token string, v int"))


@pytest.mark.parametrize("k", [1, 8, 1000])
def test_equals_left_join(spark, k):
    rows, table = rows_of(spark), table_of(spark)
    got = H.spread_lookup(rows, table, "token", "v", k)
    assert got.columns == ["rid", "token", "v"]
    plain = rows.join(table, "token", "left").select("rid", "token", "v")
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_frequent_keys_are_dealt_evenly(spark):
    rows = rows_of(spark)
    hot = H.frequent_keys(rows, "token", 8)
    assert {"hot", "gone"} <= set(hot) and len(hot) <= 8
    answered = spark.createDataFrame([(x, 1, True) for x in hot], "token string, _near int, _hot boolean")
    dealt = H.spread_keys(rows, answered, "token").repartition(16, "_t", "_s").groupBy(F.spark_partition_id()).count().collect()
    sizes = [r["count"] for r in dealt]
    assert len(sizes) == 16 and sum(sizes) == rows.count() and max(sizes) <= 2 * median(sizes)
    plain = [r["count"] for r in rows.repartition(16, "token").groupBy(F.spark_partition_id()).count().collect()]
    assert max(plain) > 4 * median(plain)  # what the same rows do under their plain key


def test_edge_tables(spark):
    rows, table = rows_of(spark, 50), table_of(spark)
    assert H.spread_lookup(rows.limit(0), table, "token", "v").collect() == []
    assert {r["v"] for r in H.spread_lookup(rows, table.limit(0), "token", "v").collect()} == {None}
    nulls = rows.select("rid", F.lit(None).cast("string").alias("token"))
    assert [r["v"] for r in H.spread_lookup(nulls, table, "token", "v").collect()] == [None] * 50
    long = "x" * (H.KEY_CHARS + 1)
    one = spark.createDataFrame([(1, long), (2, long)], "rid long, token string")
    assert H.frequent_keys(one, "token") == []
    assert [r["v"] for r in H.spread_lookup(one, spark.createDataFrame([(long, 5)], "token string, v int"), "token", "v").collect()] == [5, 5]


def test_encode_decode_reduce_of_a_skewed_corpus(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the"] * 5 + [f"w{rnd.randrange(400)}"] * 10) for _ in range(rnd.randrange(0, 40))) for _ in range(300)] + [None, "", "the", "§"]
    df = spark.createDataFrame(list(enumerate(texts)), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    vocab = K.build_vocab(K.unique_tokens(df.where("text <> '§'"))).persist()
    made = {s: sorted(map(tuple, K.encode(df, vocab, on_unknown="drop", strategy=s).collect())) for s in ("table", "join")}
    assert made["table"] == made["join"]
    enc = K.encode(df, vocab, on_unknown="drop", strategy="table")
    back = {s: sorted(map(tuple, K.decode(enc, vocab, strategy=s).collect())) for s in ("table", "join")}
    assert back["table"] == back["join"]
    small = sorted(map(tuple, K.reduce_vocab(df, 30)[0].collect()))
    monkeypatch.setattr(K, "broadcast_cap", lambda: -1)
    assert small == sorted(map(tuple, K.reduce_vocab(df, 30)[0].collect())) and small
    vocab.unpersist()
