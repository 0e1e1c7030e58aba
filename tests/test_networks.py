"""E2 on gene networks: refined labels against a plain set-based twin, and what they tell apart."""

import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from seqloom.operators import evaluate as E

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def nested(text, rounds):
    """Labels as nested tuples, no hashing: (label, sorted labels of the neighbours)."""
    toks = (text or "").split()
    near = {t: set() for t in toks}
    for a, b in zip(toks, toks[1:]):
        if a != b:
            near[a].add(b)
            near[b].add(a)
    labels, out = {t: t for t in near}, []
    for r in range(rounds + 1):
        out += [(r, x) for x in labels.values()]
        labels = {t: (labels[t], tuple(sorted((labels[u] for u in near[t]), key=repr))) for t in near}
    return out


def texts(seed, n):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(0, 9))) for _ in range(n)]


def test_equals_nested_labels(spark):
    made, real = texts(1, 60) + [None, "", "a", "a a", "a b a b", "é a\té"], texts(2, 40)
    g, r = frame(spark, made), frame(spark, real)
    known = {x for t in real for x in nested(t, 3)}
    want = {}
    for i, t in enumerate(made):
        ls = nested(t, 3)
        for k in range(4):
            mine = [x for x in ls if x[0] == k]
            want[i, k] = (len(mine), sum(x in known for x in mine))
    got = {(x["doc_id"], x["round"]): (x["n_nodes"], x["n_nodes_real"]) for x in E.network_similarity(g, r, 3).collect()}
    assert got == want
    a, b = (Counter(x for t in ts for x in nested(t, 3)) for ts in (made, real))
    for x in E.network_overlap(g, r, 3).collect():
        p, q = ({y: n for y, n in c.items() if y[0] == x["round"]} for c in (a, b))
        both = set(p) | set(q)
        assert (x["n_generated"], x["n_real"]) == (sum(p.values()), sum(q.values()))
        assert x["n_common"] == sum(min(p.get(y, 0), q.get(y, 0)) for y in both)
        assert x["n_union"] == sum(max(p.get(y, 0), q.get(y, 0)) for y in both)


def test_order_of_genes_matters_to_neighbours_only(spark):
    real = frame(spark, ["a b c d e"])
    rows = E.network_similarity(frame(spark, ["e d c b a", "a c e b d"]), real).orderBy("doc_id", "round").collect()
    assert [r["share"] for r in rows] == [1.0, 1.0, 1.0, 1.0, 0.0, 0.0]  # read backwards it is the same graph


def test_empty_tables(spark):
    none, one = frame(spark, []), frame(spark, ["a b"])
    assert E.network_similarity(none, one).collect() == [] and E.network_overlap(none, none).collect() == []
    assert [r["share"] for r in E.network_similarity(one, none).orderBy("round").collect()] == [0.0] * 3


@pytest.mark.parametrize("small", [True, False])
def test_same_whether_the_labels_are_broadcast_or_shuffled(spark, monkeypatch, small):
    seen = []
    monkeypatch.setattr(E, "_places", lambda df, own=E._places: seen.append(1) or (own(df) if small else (None, False)))
    mine = spark.createDataFrame([(1, "a b c"), (2, "x y"), (3, "")], "doc_id long, text string")
    real = spark.createDataFrame([(7, "a b c"), (7, "q r s t"), (None, "x z")], "doc_id long, text string")
    over = {r["round"]: (r["n_generated"], r["n_real"], r["n_common"], r["n_union"]) for r in E.network_overlap(mine, real).collect()}
    assert over == {0: (5, 9, 4, 10), 1: (5, 9, 3, 11), 2: (5, 9, 3, 11)}
    share = {(r["doc_id"], r["round"]): (r["n_nodes"], r["n_nodes_real"]) for r in E.network_similarity(mine, real).collect()}
    assert share[1, 2] == (3, 3) and share[2, 0] == (2, 1) and share[2, 1] == (2, 0) and share[3, 0] == (0, 0) and len(share) == 9
    assert seen == [1, 1]


def test_rows_of_a_stretch_are_graphs_of_their_own():
    import hashlib

    for texts in (["a b", "b a c", None, "", "a b"], ["a b a"], []):
        got = [(int(i), bytes(x).hex()) for of, held in E._refine(texts, 1) for i, x in zip(of, held)]
        want = []
        for i, t in enumerate(texts):
            h = {x: hashlib.md5(x.encode()).hexdigest() for x in (t or "").split()}
            near = {x: {b for a, b in zip((t or "").split(), (t or "").split()[1:]) if a == x != b}
                    | {a for a, b in zip((t or "").split(), (t or "").split()[1:]) if b == x != a} for x in h}
            sums = {x: [sum(int(h[y][at:at + 10], 16) for y in near[x]) for at in (0, 10)] for x in h}
            want += [(i, h[x]) for x in h] + [(i, hashlib.md5(f"{h[x]}|{sums[x][0]}|{sums[x][1]}".encode()).hexdigest()) for x in h]
        assert sorted(got) == sorted(want)


def test_labels_that_no_generated_row_has_stay_where_they_are_made(spark):
    real = frame(spark, [" ".join(f"r{i}" for i in range(k, k + 200)) for k in range(0, 2000, 200)] + ["a b"])
    wanted, _ = E._places(E._labels(frame(spark, ["a b c"]), 2, "doc_id", "text"))
    rows = E._labels(real, 2, "doc_id", "text", wanted, rest=True).collect()
    assert sum(r["n"] for r in rows) == 3 * 2002  # every node counts, few have a row
    assert len([r for r in rows if r["label"] is not None]) < 200
    held = {bytes(r["label"]) for r in rows if r["label"] is not None}
    assert held >= {bytes(r["label"]) for r in E._labels(frame(spark, ["a b"]), 0, "doc_id", "text").collect()}


def test_a_filter_at_its_cap_changes_nothing(spark, monkeypatch):
    made, real = frame(spark, texts(3, 50)), frame(spark, texts(4, 50))
    want = sorted(map(tuple, E.network_overlap(made, real).collect()))
    monkeypatch.setattr(E, "broadcast_cap", lambda: 16)  # 128 bits for all labels
    assert sorted(map(tuple, E.network_overlap(made, real).collect())) == want
    assert len(E._places(E._labels(made, 2, "doc_id", "text"))[0]) == 2
