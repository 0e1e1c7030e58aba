"""Corpus: tokenizers, profile, reduction, vocabulary, encode/decode."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import corpus as K


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_two_tokenizers(spark):
    d = _docs(spark, ["a  b", "a\tb"])
    assert sorted(r["token"] for r in K.unique_tokens(d).collect()) == ["a", "b"]
    lens = {r["doc_id"]: r["n_tokens"] for r in K.with_lengths(d).collect()}
    assert lens == {0: 3, 1: 1}


def test_whitespace_split_matches_python(spark):
    texts = ["x y　z", " lead trail ", "a\x1cb c", "", "\t\n"]
    d = _docs(spark, texts)
    got = {r["doc_id"]: r["n"] for r in d.select("doc_id", F.size(K.whitespace_tokens("text")).alias("n")).collect()}
    assert got == {i: len(t.split()) for i, t in enumerate(texts)}


def test_length_stats_median_interpolates(spark):
    d = _docs(spark, ["a", "a b", "a b c", " ".join("x" * 10)])
    r = K.length_stats(d).first()
    assert (r["min_len"], r["max_len"], r["median_len"]) == (1, 10, 2.5)


def test_longest_and_max_len(spark):
    d = _docs(spark, ["a b c", "a", "a b"])
    assert [r["n_tokens"] for r in K.longest(d, 2).orderBy("pos").collect()] == [2, 3]
    assert K.max_len(d).first()["max_len"] == 3


def test_reduce_vocab_keeps_most_frequent(spark):
    d = _docs(spark, ["a b c", "a b", "a c"])
    reduced, kept = K.reduce_vocab(d, max_size=2)
    assert sorted(r["token"] for r in kept.collect()) == ["a", "b"]
    assert {r["doc_id"]: r["text"] for r in reduced.collect()} == {0: "a b", 1: "a b", 2: "a"}


def test_clean_tokens_and_row_slice(spark):
    d = _docs(spark, ["GCF_1.1: a b_1 c", "a  b", ""])
    assert [r["text"] for r in K.clean_tokens(d).orderBy("doc_id").collect()] == ["a c", "a  b", ""]
    s = K.row_slice(spark.range(100).withColumnRenamed("id", "k"), 20, 24, ["k"])
    assert [r["k"] for r in s.collect()] == [20, 21, 22, 23]


def test_vocab_specials_and_repeated_special(spark):
    toks = spark.createDataFrame([("b",), ("a",), ("[EOS]",)], "token string")
    v = {r["token"]: r["id"] for r in K.build_vocab(toks).collect()}
    assert v["[PAD]"] == 0 and v["[SOS]"] == 2
    assert v["[EOS]"] == 3 and v["a"] == 4 and v["b"] == 5  # a repeated special keeps its later id


@pytest.mark.parametrize("strategy", ["table", "join"])
def test_encode_decode_round_trip(spark, strategy):
    d = _docs(spark, ["b a c", "c c", "a"])
    v = K.build_vocab(K.unique_tokens(d))
    enc = K.encode(d, v, strategy=strategy)
    back = {r["doc_id"]: r["text"] for r in K.decode(enc, v, strategy=strategy).collect()}
    assert back == {0: "b a c", 1: "c c", 2: "a"}
    assert {r["doc_id"]: r["len"] for r in enc.collect()} == {0: 3, 1: 2, 2: 1}


@pytest.mark.parametrize("strategy", ["table", "join"])
def test_unknown_and_empty_tokens_raise(spark, strategy):
    v = K.build_vocab(spark.createDataFrame([("a",)], "token string"))
    with pytest.raises(Exception, match="unknown token"):
        K.encode(_docs(spark, ["a zz"]), v, strategy=strategy).collect()
    with pytest.raises(Exception, match="unknown token"):
        K.encode(_docs(spark, ["a  a"]), v, strategy=strategy).collect()
    dropped = K.encode(_docs(spark, ["a zz a"]), v, on_unknown="drop", strategy=strategy).first()
    assert dropped["len"] == 2


def test_lookups_work_on_bounded_stretches(monkeypatch):
    import pyarrow as pa

    from seqloom.operators import corpus as K

    monkeypatch.setattr(K, "BATCH_VALUES", 4)
    lists = [["a", "x"], None, ["b"] * 9, [], ["a"], ["x", "b", "a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "_toks"])
    cut = list(K._filter_tokens(["a", "b"])([batch, batch.slice(4)]))
    assert max(sum(len(x) for x in b.column(1).to_pylist()) for b in cut if b.num_rows > 1) <= 4
    rows = [x for b in cut for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    want = [(0, ["a"]), (1, []), (2, ["b"] * 9), (3, []), (4, ["a"]), (5, ["b", "a"])]
    assert rows == want + want[4:]
