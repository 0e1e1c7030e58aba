"""Raw uint16 streams: shard files (K3), byte ranges (S9), random access (W7), offsets on awkward keys."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import layout as L
from seqloom.session import scratch_path
from seqloom.sources import rawfiles as RF
from seqloom.sources import readers as R
from seqloom.sources import sinks as S


def compact(spark, rows, partitions=3):
    """``(split, order_key, body, pad)`` rows."""
    df = spark.createDataFrame(rows, "split string, order_key long, body array<int>, pad long").repartition(partitions)
    return df.withColumn("len", F.size("body") + F.col("pad"))


def streams(rows):
    out = {}
    for s, _, body, pad in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        out.setdefault(s, []).extend(body + [0] * pad)
    return out


ROWS = [("train", i, [7 * i % 65536, 65535, i], i % 5) for i in range(40)] + [("val set/1", i, [i + 3], 0) for i in range(3)] + \
    [(None, i, [i + 9] * (i + 1), 1) for i in range(6)]


def local(path):
    return path.removeprefix("file:")


@pytest.mark.parametrize("n_max", [1, 7, 1024])
def test_files_are_the_streams(spark, n_max):
    path = scratch_path(spark, "t-stream")
    manifest = S.write_stream(L.stream_shards(compact(spark, ROWS), ["order_key"], n_max), path).collect()
    want = streams(ROWS)
    rows = {s: sum(r[0] == s for r in ROWS) for s in want}
    for split, stream in want.items():
        mine = sorted((r["shard"], r["first_offset"], r["n"]) for r in manifest if r["split"] == split)
        assert [m[0] for m in mine] == list(range(min(n_max, rows[split])))
        folder = "__null__" if split is None else {"val set/1": "val+set%2F1"}.get(split, split)
        got = np.concatenate([np.fromfile(f"{local(path)}/split={folder}/shard-{k:05d}.bin", "<u2") for k, _, _ in mine])
        assert got.tolist() == stream
        assert [m[1] for m in mine] == [sum(x[2] for x in mine[:k]) for k in range(len(mine))]
    assert not [f for f in os.listdir(local(path)) if f.startswith("_staging")]
    for range_bytes, row_ids in ((2, 1), (10, 2), (1 << 20, 1 << 16)):
        back = {}
        for r in R.read_stream(spark, path, range_bytes, row_ids).collect():
            back.setdefault(r["split"], {}).update({r["offset"] + i: x for i, x in enumerate(r["ids"])})
        assert {s: [d[i] for i in range(len(d))] for s, d in back.items()} == want


def test_files_without_manifest(spark, tmp_path):
    ids = np.arange(1000, dtype="<u2")
    ids.tofile(tmp_path / "train.bin")
    ids[:10].tofile(tmp_path / "val.bin")
    got = R.read_stream(spark, str(tmp_path), range_bytes=64, row_ids=8).where("split = 'train'")
    assert got.rdd.getNumPartitions() > 20
    assert [x for r in got.orderBy("offset").collect() for x in r["ids"]] == ids.tolist()
    assert {(r["split"], r["n"]) for r in R.stream_manifest(spark, str(tmp_path)).collect()} == {("train", 1000), ("val", 10)}
    (tmp_path / "val.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        R.read_stream(spark, str(tmp_path)).collect()


def test_random_access_reads_only_the_windows(spark):
    path = scratch_path(spark, "t-stream")
    shards = L.stream_shards(compact(spark, ROWS), ["order_key"], 11)
    S.write_stream(shards, path)
    blocks = L.pack(shards, 4)
    for B in (3, 4, 20, 170):  # windows inside a file, over two, over many
        got = {r["draw_id"]: r for r in R.sample_stream(spark, path, "train", 50, B, seed=2).collect()}
        stream = streams(ROWS)["train"]
        assert len(got) == 50
        for r in got.values():
            assert r["x"] == stream[r["start"]:r["start"] + B] and r["y"] == stream[r["start"] + 1:r["start"] + B + 1]
            assert r["bytes_read"] == 2 * (B + 1)
        if B == 4:
            old = {r["draw_id"]: (r["start"], r["x"], r["y"]) for r in L.sample_blocks(blocks, "train", 50, B, seed=2).collect()}
            assert old == {k: (r["start"], r["x"], r["y"]) for k, r in got.items()}
    with pytest.raises(ValueError, match="need more"):
        R.sample_stream(spark, path, "val set/1", 1, 3)


def test_retries_and_failures_leave_no_file(spark, tmp_path):
    df = spark.range(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.array(F.lit(1)).alias("ids"))
    out = str(tmp_path / "out")
    RF.write_raw(df, out)
    # a second attempt of a task that had already staged its files
    writer = RF.RawWriter(out, overwrite=False)
    stage = tmp_path / "out" / f"_staging-{writer.job}"
    for attempt in ("1", "2"):
        (stage / attempt).mkdir(parents=True)
        (stage / attempt / "000000").write_bytes(b"\1\0")
    writer.commit([RF.Committed([("g", str(stage / "2" / "000000"), 2)]), None])
    assert [f for f, _ in RF.list_files(out)] == ["f0", "f1", "f2", "f3", "g"] and not stage.exists()
    with pytest.raises(Exception, match="written twice"):
        RF.write_raw(df, out, mode="append")
    with pytest.raises(Exception, match="uint16"):
        RF.write_raw(df.withColumn("ids", F.array(F.lit(65536))), out)
    with pytest.raises(Exception, match="not neighbours"):
        RF.write_raw(df.withColumn("file", (F.col("file") == "f1").cast("string")).coalesce(1), out)
    assert [f for f, _ in RF.list_files(out)] == ["f0", "f1", "f2", "f3", "g"]
    assert not [f for f in os.listdir(out) if f.startswith("_staging")]
    RF.write_raw(df.limit(1), out)
    assert sorted(os.listdir(out)) == ["_manifest.json", "f0"]


@pytest.mark.parametrize("partitions", [1, 4])
def test_pack_with_null_and_equal_order_keys(spark, partitions):
    rows = [("train", None, [5, 6], 0), ("train", None, [7, 8], 0), ("train", 1, [9], 0), ("train", 1, [10], 0), (None, None, [11], 1), (None, 2, [12], 0)]
    blocks = L.pack(compact(spark, rows, partitions), 4).collect()
    for split, want in (("train", [5, 6, 7, 8, 9, 10]), (None, [0, 11, 12])):
        mine = sorted(((b["block_id"], b["ids"], b["n"]) for b in blocks if b["split"] == split))
        ids = [x for _, i, _ in mine for x in i]
        assert sorted(ids) == want and sum(n for _, _, n in mine) == len(want)
        assert all(n == 4 for _, _, n in mine[:-1])
    first = next(b["ids"] for b in blocks if b["split"] == "train" and b["block_id"] == 0)
    assert {tuple(first[:2]), tuple(first[2:])} == {(5, 6), (7, 8)}


def test_padding_is_no_disk_space(spark, tmp_path):
    """Zeros between and after the ids are holes of a file that has its full length."""
    out = str(tmp_path / "sparse")
    pad = 1 << 21
    df = spark.createDataFrame([("f.bin", 0, [7, 8], pad), ("f.bin", 1, [9], pad)], "file string, row long, ids array<int>, pad long")
    assert RF.write_raw(df.coalesce(1).sortWithinPartitions("row").drop("row"), out) == [("f.bin", 2 * (3 + 2 * pad))]
    info = os.stat(f"{out}/f.bin")
    assert info.st_size == 2 * (3 + 2 * pad) and info.st_blocks * 512 < 1 << 20
    ids = np.fromfile(f"{out}/f.bin", "<u2")
    assert ids[:2].tolist() == [7, 8] and ids[pad + 2] == 9 and ids.sum() == 24 and len(ids) == 3 + 2 * pad
