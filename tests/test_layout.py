"""Positions, split, frame, pack, shard, sample, crop and the uint16 sink."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.operators import layout as L
from seqloom.operators.positions import dense_index, dense_index_within, running_sum
from seqloom.session import scratch_path
from seqloom.sources import readers as R
from seqloom.sources import sinks as S


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_dense_index_equals_global_row_number(spark, parts):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 3).alias("g"))
    got = {r["k"]: r["idx"] for r in dense_index(df, ["k"], partitions=parts).collect()}
    assert got == {k: k for k in range(500)}
    within = dense_index_within(df, ["g"], ["k"], out="ord", start=1, partitions=parts)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert within.join(ref, ["g", "k"]).where(F.col("ord") != F.col("ref")).count() == 0
    rs = running_sum(df.withColumn("w", F.col("k") % 5), ["k"], "w", out="cum", partitions=parts)
    expect, acc = {}, 0
    for k in range(500):
        acc += k % 5
        expect[k] = acc
    assert {r["k"]: r["cum"] for r in rs.collect()} == expect


@pytest.mark.parametrize("n,val", [(1, 1), (33, 1), (34, 2), (100, 3)])
def test_split_exact_sizes(spark, n, val):
    s = L.split_exact(spark.range(n).withColumnRenamed("id", "doc_id"), "doc_id", 0.03, seed=1)
    sizes = {r["split"]: r["n"] for r in L.split_sizes(s).collect()}
    assert sizes.get("val", 0) == val and sizes.get("train", 0) == n - val


def test_frame_and_pad_lengths(spark):
    enc = spark.createDataFrame([(i, list(range(10, 10 + n))) for i, n in enumerate([1, 3, 4, 5])],
                                "doc_id long, ids array<int>")
    f = {r["doc_id"]: (r["len"], r["ids"]) for r in L.frame_and_pad(enc, 5).collect()}
    assert [f[i][0] for i in range(4)] == [5, 5, 6, 7]
    assert f[0][1] == [2, 10, 1, 0, 0]


def _framed(spark, lens):
    rows = [(i, "train", i, [i * 100 + j for j in range(n)], n) for i, n in enumerate(lens)]
    return spark.createDataFrame(rows, "doc_id long, split string, order_key long, ids array<int>, len long")


def test_pack_is_the_concatenation(spark):
    lens = [3, 7, 1, 12, 5, 2]
    framed = _framed(spark, lens)
    blocks = L.pack(framed, 4).orderBy("block_id").collect()
    stream = [x for i, n in enumerate(lens) for x in [i * 100 + j for j in range(n)]]
    assert [x for b in blocks for x in b["ids"]] == stream
    assert all(b["n"] == 4 for b in blocks[:-1]) and blocks[-1]["n"] == len(stream) % 4 or 4


def test_compact_pack_equals_padded_pack(spark):
    enc = spark.createDataFrame([(i, "train", i, list(range(i * 10, i * 10 + n))) for i, n in enumerate([1, 9, 4, 0, 13, 2])],
                                "doc_id long, split string, order_key long, ids array<int>")
    for max_len, B in [(7, 4), (12, 5), (3, 8), (20, 1024)]:
        padded = {r["block_id"]: r["ids"] for r in L.pack(L.frame_and_pad(enc, max_len), B).collect()}
        compact = {r["block_id"]: r["ids"] for r in L.pack(L.frame(enc, max_len), B).collect()}
        assert padded == compact


def test_sample_blocks_shift_and_tail(spark):
    framed = _framed(spark, [5])  # N = B + 1 with B = 4: the only start is 0
    blocks = L.pack(framed, 4)
    s = L.sample_blocks(blocks, "train", 8, 4, seed=3).collect()
    assert {r["start"] for r in s} == {0}
    assert all(r["x"] == [0, 1, 2, 3] and r["y"] == [1, 2, 3, 4] for r in s)
    big = L.pack(_framed(spark, [50, 31, 17]), 8)
    for r in L.sample_blocks(big, "train", 20, 8, seed=5).collect():
        assert len(r["x"]) == 8 and r["y"][:-1] == r["x"][1:]


def test_contiguous_shards(spark):
    framed = _framed(spark, [1] * 10)
    sh = L.contiguous_shards(framed, ["order_key"], n_max=4).collect()
    sizes = {}
    for r in sh:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + 1
    assert sizes == {0: 3, 1: 3, 2: 2, 3: 2}


def test_crop_tail(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1],), ([],)], "ids array<int>")
    assert [r["ids"] for r in L.crop_tail(df, 3).collect()] == [[3, 4, 5], [1], []]


def test_uint16_shards_round_trip_and_range_check(spark):
    blocks = L.pack(_framed(spark, [6, 9]), 4).withColumn("ids", F.transform("ids", lambda x: x + 65000))
    path = scratch_path(spark, "t_shards")
    S.write_shards(blocks, path)
    back = {r["block_id"]: r["ids"] for r in R.read_shards(spark, path).collect()}
    assert back == {r["block_id"]: r["ids"] for r in blocks.collect()}
    edge = spark.createDataFrame([("train", 0, [65535], 1)], "split string, block_id long, ids array<int>, n long")
    S.write_shards(edge, scratch_path(spark, "t_edge"))
    over = spark.createDataFrame([("train", 0, [65536], 1)], "split string, block_id long, ids array<int>, n long")
    with pytest.raises(Exception, match="uint16"):
        S.write_shards(over, scratch_path(spark, "t_over"))


def test_blocks_inside_one_row_are_not_shuffled(spark):
    """Only the pieces at the ends of a row are grouped; a block of padding is written from a count."""
    enc = spark.createDataFrame([(i, "train", i, [5] * 3) for i in range(4)], "doc_id long, split string, order_key long, ids array<int>")
    blocks = L.pack(L.frame(enc, 1000), 8)
    moved = [x for x in blocks._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x or "Union" in x]
    assert "Union" in moved[0] and "Aggregate" in moved[1]
    stream = ([2] + [5] * 3 + [1] + [0] * 995) * 4
    assert [x for b in blocks.orderBy("block_id").collect() for x in b["ids"]] == stream
    path = scratch_path(spark, "t_blank")
    S.write_shards(blocks, path)
    back = R.read_shards(spark, path).orderBy("block_id").collect()
    assert [x for b in back for x in b["ids"]] == stream and all(b["n"] == 8 == len(b["ids"]) for b in back[:-1])


def test_lengths_need_no_padded_arrays(spark):
    enc = spark.createDataFrame([(0, [4, 5]), (1, []), (2, None)], "doc_id long, ids array<int>")
    lens = L.frame_and_pad(enc, 5).select("doc_id", "len")
    assert "array_repeat" not in lens._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["len"] for r in lens.collect()} == {0: 5, 1: 5, 2: None}
