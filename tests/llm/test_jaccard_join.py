import random

import numpy as np
import pytest

from seqloom.llm import parity_join as J
from tests.llm.helpers import EMPTY, edited, frame, null_id, prose


def brute(texts):
    """Components by comparing all pairs of word-tuple sets."""
    def shingles(t):
        w = (t or "").encode().translate(J._LOWER).split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def corpus():
    texts = list(EMPTY) + ["A b C d", "a B c D", "a b c d e", "A B C D E"]
    for g in range(12):
        base = prose(g, random.Random(g).choice([6, 9, 15, 40, 120, 300, 900]))
        texts += [" ".join(edited(base, 100 * g + k, k * len(base) // 60)) for k in range(6)]
        texts.append(" ".join(base + prose(1000 + g, len(base) // 6)))
    boiler = prose(77, 60)  # a passage that many unrelated texts hold
    texts += [" ".join(prose(500 + k, 60) + boiler + prose(900 + k, 60)) for k in range(45)]
    hub = prose(5, 130)  # a large group of near copies
    texts += [" ".join(edited(hub, 7000 + k, 2 + k % 6)) for k in range(70)]
    return texts + texts[20:30]


def test_components_equal_brute_force(spark):
    texts = corpus()
    got = sorted(tuple(r) for r in J.near_duplicates(frame(spark, texts, 4)).collect())
    assert got == brute(texts)


@pytest.mark.parametrize("buckets", [7, 2048])
def test_every_key_is_frequent(spark, monkeypatch, buckets):
    monkeypatch.setattr(J, "RUN", 2)
    monkeypatch.setattr(J, "BUCKET_SETS", buckets)
    texts = corpus()[:120]
    got = sorted(tuple(r) for r in J.near_duplicates(frame(spark, texts, 2)).collect())
    assert got == brute(texts)


def test_null_ids_repeated_ids_and_empty_table(spark):
    text = " ".join(prose(1, 30))
    df = frame(spark, [text, text, None], 2, [null_id(text), (0, text, *[None] * 8)])
    got = sorted((tuple(r) for r in J.near_duplicates(df).collect()), key=str)
    assert got == sorted([(0, 26, 0), (0, 26, 0), (1, 26, 0), (2, 0, 2), (None, 26, None)], key=str)
    assert J.near_duplicates(df.where("false")).collect() == []


@pytest.mark.parametrize("n,m", [(4, 5), (8, 10), (31, 33), (60, 70), (130, 120), (300, 350), (1000, 900)])
def test_linked_sets_share_a_key_and_pass_the_bound(n, m):
    r = np.random.default_rng(n)
    for trial in range(60):
        common = int(np.ceil(0.8 * (n + m) / 1.8))
        if common > min(n, m):
            continue
        pool = np.unique(r.integers(0, 2 ** 63, 2 * (n + m), dtype=np.uint64))
        r.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n:n + m - common]]))
        assert 9 * J.hamming(J.bit_sketch(a), J.bit_sketch(b)) <= len(a) + len(b)
        keys = [{k for band in J.bands(len(x)) for k in J.block_keys(x, *band)[0].tolist()} for x in (a, b)]
        assert keys[0] & keys[1]


def test_hamming_folds_the_longer_sketch():
    a = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert J.hamming(J.bit_sketch(a), J.bit_sketch(a)) == 0
    assert J.hamming(J.bit_sketch(a), J.bit_sketch(a[:60])) <= 139


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in J.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
