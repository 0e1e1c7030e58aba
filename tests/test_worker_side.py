"""What is counted, summed or decoded in the worker that reads it."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqloom.operators import corpus as K
from seqloom.operators import layout as L
from seqloom.plans import queries as Q
from seqloom.sources import rawfiles as W
from seqloom.sources import readers as R
from seqloom.sources import sinks as S

TEXTS = ["a b a b a", "a b", "é  x", "", None, "a", " a b", "b c\x1cd"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_tokens_are_counted_and_kept_as_str_split_does(spark, monkeypatch):
    want = Counter(x for t in TEXTS if t for x in t.split())
    assert {r["token"]: r["n"] for r in K.token_counts(docs(spark)).collect()} == want
    monkeypatch.setattr(K, "BATCH_VALUES", 1)  # given on after every row
    each = list(K._count_tokens([pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["text"])]))
    assert len(each) > 2 and sum((Counter(dict(zip(*b.to_pydict().values()))) for b in each), Counter()) == want
    reduced, _ = K.reduce_vocab(docs(spark), 2)
    assert {r["doc_id"]: r["text"] for r in reduced.collect()} == {0: "a b a b a", 1: "a b", 5: "a", 6: "a b", 7: "b"}


def test_encoded_texts_of_one_batch(spark):
    vocab = spark.createDataFrame([("a", 3), ("b", 4), ("[UNK]", 9), ("", 5)], "token string, id long")
    for unknown, want in (("drop", [3, 4]), ("unk", [3, 4])):
        got = {r["doc_id"]: r["ids"] for r in K.encode(docs(spark), vocab, on_unknown=unknown).collect()}
        assert got[1] == want and got[3] == [5] and got[4] == [] and got[2] == ([9, 5, 9] if unknown == "unk" else [5])


@pytest.fixture()
def framed(spark):
    rnd = np.random.default_rng(5)
    rows = [("train" if i % 3 else "val", i, [int(x) for x in rnd.integers(0, 65536, int(rnd.integers(0, 30)))], int(rnd.integers(0, 40))) for i in range(60)]
    f = spark.createDataFrame([(s, i, b, p, len(b) + p) for s, i, b, p in rows], "split string, order_key long, body array<int>, pad long, len long")
    streams = {}
    for s, _, b, p in rows:
        streams.setdefault(s, []).extend(b + [0] * p)
    return f, streams


def test_padding_of_blocks_is_a_number_up_to_their_bytes(spark, tmp_path, framed):
    f, streams = framed
    counted = L.pack(f, 8, zeros=S.ZEROS)
    assert counted.where(f"{S.ZEROS} > 0").count() > 20
    S.write_shards(counted, str(tmp_path / "s"))
    want = {(s, i // 8): x[i:i + 8] for s, x in streams.items() for i in range(0, len(x), 8)}
    got = {(r["split"], r["block_id"]): (r["ids"], r["n"]) for r in R.read_shards(spark, str(tmp_path / "s")).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    with pytest.raises(ValueError, match="compact"):
        L.pack(f.withColumnRenamed("body", "ids").drop("pad"), 8, zeros=S.ZEROS)


def test_blocks_are_told_where_they_are_decoded(spark, tmp_path, framed):
    from hashlib import md5

    f, streams = framed
    S.write_shards(L.pack(f, 8), str(tmp_path / "s"))
    want = {(s, i // 8): x[i:i + 8] for s, x in streams.items() for i in range(0, len(x), 8)}
    got = R.read_shards(spark, str(tmp_path / "s"), Q._ids_md5, "split string, block_id long, n long, ids_md5 string").collect()
    assert {(r[0], r[1]): r[3] for r in got} == {k: md5(" ".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}
    held = R.read_shards(spark, str(tmp_path / "s"), Q._ids_held, "split string, block_id long, n long").collect()
    assert {(r[0], r[1]): r[2] for r in held} == {k: len(v) for k, v in want.items()}


def test_streams_are_summed_where_they_are_read(spark, tmp_path, framed, monkeypatch):
    f, streams = framed
    S.write_stream(L.stream_shards(f, ["order_key"], 4), str(tmp_path / "t"))
    monkeypatch.setattr(Q, "PLACES", 101)
    for block, ranges in ((8, {"range_bytes": 2}), (8, {"range_bytes": 30, "row_ids": 3}), (1024, {})):
        want = Counter()
        for s, ids in streams.items():
            for i, x in enumerate(ids):
                for k, v in (("n", 1), ("id_sum", x), ("place_sum", x * (i % 101))):
                    want[s, i // block, k] += v
        got = Q._checksums(spark, str(tmp_path / "t"), ["split"], block, **ranges).collect()
        assert {(r["split"], r["block_id"], k): r[k] for r in got for k in ("n", "id_sum", "place_sum")} == want
    by_file = {(r["split"], r["shard"]): r["n"] for r in Q._checksums(spark, str(tmp_path / "t"), ["split", "shard"]).collect()}
    assert by_file == {(r["split"], r["shard"]): r["n"] for r in R.stream_manifest(spark, str(tmp_path / "t")).collect() if r["n"]}


def test_small_ranges_share_tasks(spark, tmp_path):
    np.arange(5000, dtype="<u2").tofile(tmp_path / "train.bin")
    read = W.read_u16(spark, str(tmp_path), ".bin", range_bytes=2)
    assert read.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    assert sorted(x for r in read.collect() for x in r["ids"]) == list(range(5000))
