import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import bpe, packing
from tests.llm.helpers import EMPTY, frame, null_id, prose

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ALPHABET = ["a", "the", " ", "  ", "\n", "'s", "'", "é", "1", "#", "日本", "\t", "ing", "\xa0", "\x1c", "x" * 9, " " * 7, "́", "ab" * 30]


@pytest.fixture(scope="module")
def coder():
    return bpe.TreeBPE(RANKS, P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=80).map("".join))
def test_tree_equals_the_library(text):
    coder = test_tree_equals_the_library.coder = getattr(test_tree_equals_the_library, "coder", None) or bpe.TreeBPE(RANKS, P.PATTERN)
    leaf, piece = bpe.LEAF_CHARS, bpe.LEAF_BYTES
    bpe.LEAF_CHARS, bpe.LEAF_BYTES = 8, 8  # many joins
    try:
        ids = coder.encode(text)
        whole = text.replace(" ", "").encode()
        tree = coder.encode_piece(whole)
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES = leaf, piece
    assert ids == coder._core.encode_ordinary(text) and coder.decode(ids) == text.encode()
    assert tree == coder._leaf(whole)


def test_long_runs(coder):
    r = random.Random(1)
    for text in (" " * 30_000 + "a", "".join(r.choice("abcdetion") for _ in range(50_000)), "#" * 20_000, "ab " * 9000):
        assert coder.encode(text) == coder._core.encode_ordinary(text)


def test_bpe_rows(spark, coder):
    df = frame(spark, EMPTY + ["x\n<|endoftext|> y"], 2, [null_id("a b")])
    rows = bpe.bpe_encode(df, RANKS, P.PATTERN)
    got = {r["doc_id"]: r["ids"] for r in rows.collect()}
    assert got[0] == [] == got[1] and got[6] == coder._core.encode_ordinary("x\n<|endoftext|> y") and len(got[None]) == 2
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.bpe_decode(rows, RANKS, P.PATTERN).collect()}
    assert back == {**{i: t or "" for i, t in enumerate(EMPTY)}, 6: "x\n<|endoftext|> y", None: "a b"}
    assert bpe.bpe_digest(df.where("false"), RANKS, P.PATTERN).collect() == []


def texts():
    out = EMPTY + ["  lead", "trail  ", "a  b\n c \t d", "<|endoftext|> x", "é \xa0 é"]
    return out + [" ".join(prose(k, 3 + 17 * k % 900)) for k in range(80)] + [" ".join(prose(99, 9000))] + ["same text"] * 3


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    all_texts = texts()
    pieces = packing.pack_documents(frame(spark, all_texts, 2, [null_id("b c")]), JSON, block_ids=4000).toPandas()
    encode = Tokenizer.from_file(JSON).encode
    for doc_id, text in enumerate(all_texts):
        ids = np.asarray([*encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = pieces[pieces.doc_id == doc_id].sort_values("start")
        assert (mine.doc_tokens == len(ids)).all() and mine.length.sum() == len(ids)
        assert (mine.start == mine.length.cumsum() - mine.length).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    assert pieces[pieces.doc_id.isna()].length.sum() == 3
    order = pieces.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id").length.cumsum() - order.length == order.offset).all()
    sizes = order.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048 and (~sizes.isin(packing.TIERS)).sum() <= 4  # one open window a task of the second pass
    assert order.groupby("step_group").length.sum().max() <= packing.STEP_IDS


def test_packing_of_nothing(spark):
    assert packing.pack_documents(frame(spark, []), JSON).count() == 0


def test_many_small_partitions_share_their_windows(spark):
    rows = spark.range(2000).select(packing.F.col("id").alias("doc_id"), packing.F.lit("ab cd ef gh").alias("text")).repartition(500)
    pieces = packing.pack_documents(rows, JSON).toPandas()
    ids = pieces.length.sum()
    sizes = pieces.groupby("sequence_id").length.sum()
    padded = sum(s if s in packing.TIERS else 2048 for s in sizes)
    assert ids == pieces.groupby("doc_id").doc_tokens.first().sum() and pieces.doc_id.nunique() == 2000
    assert padded <= 1.05 * ids + 2048
    order = pieces.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id").length.cumsum() - order.length == order.offset).all()


UNITS = ALPHABET + ["don't", "'re ", "It'S", "\n\n", "word,", "3rd", "<|endoftext|>", "<|", "|>", "Ñandú", "ß×÷", "\r\n", "...\n", "«a»", "ñ", "\u2028", " \n "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(UNITS), max_size=30).map("".join), max_size=6))
def test_cached_units_are_those_of_the_library(texts):
    from tokenizers import Tokenizer

    held = test_cached_units_are_those_of_the_library
    if not hasattr(held, "coders"):
        held.coders, held.library = [packing.UnitEncoder(JSON), packing.UnitEncoder(JSON)], Tokenizer.from_file(JSON)
        held.coders[1].limit = 5  # generations change all the time
    want = [np.asarray(e.ids, "<u4").tobytes() for e in held.library.encode_batch(texts, add_special_tokens=False)]
    assert [c.encode(texts) for c in held.coders] == [want, want]
