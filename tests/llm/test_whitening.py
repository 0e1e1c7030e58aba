import math

import numpy as np
import pytest

from seqloom.llm import whitening as W
from seqloom.llm.queries import REGISTRY

SF001 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, n int, id string, x array<int>"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", [1]) for i, v in rows], SCHEMA).repartition(3)


def brute(rows):
    """Counting, exact sums and a dense eigensolver on the same rows."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float) - np.array(sums) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    return kept, n, sums, v, e[::-1], u[:, ::-1]


def check(got, rows, k=4):
    kept, n, sums, v, e, u = brute(rows)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(got) == k * len(kept)
    whitened = np.zeros((len(kept), k))
    for j, (i, x) in enumerate(kept):
        for c in range(k):
            r = by[i, c + 1][0]
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert abs(r["explained"] / (e[c] / np.trace(v)) - 1) < 1e-9 and 0 <= r["identity_error"] <= 1e-9
            whitened[j, c] = r["whitened"]
    want = (np.array([x for _, x in kept], float) - np.array(sums) / n) @ u[:, :k] / np.sqrt(e[:k])
    signs = np.sign((whitened * want).sum(0))
    assert np.abs(whitened - want * signs).max() < 1e-7


def test_query_against_dense_eigensolver(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    check(REGISTRY["op12_whitening"][0](spark, SF001).collect(), rows)


def test_copies_and_awkward_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=6) * [9, 5, 3, 2, 1, .5]).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2, rows[2][1])]
    awkward = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5)]
    other = [(3000, [1.0, 2.0]), (3001, [])]
    zero = [(4000, [0.0] * 6), (4001, [-0.0] * 6), (None, [1.0] * 6)]
    got = W.whiten(frame(spark, rows + awkward + other + zero)).collect()
    assert len([x for x in got if x["vec_id"] == 2]) == 8
    check([x for x in got], rows + awkward + zero)


def test_no_variance(spark):
    schema = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None)], [(1, [])]):
        got = W.whiten(frame(spark, rows))
        assert got.columns == schema and got.collect() == []
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]  # one dimension only
    got = W.whiten(frame(spark, line)).collect()
    assert {x["component"] for x in got} == {1} and len(got) == 20
    assert abs(sum(x["whitened"] ** 2 for x in got) / 20 - 1) < 1e-9


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e9 * (i % 5), -3e10 * i, float(i)]) for i in range(12)]
    kept, n, sums, *_ = brute(rows)
    got = {(r["vec_id"]): r["deviation"] for r in W.whiten(frame(spark, rows), 1).collect()}
    for i, x in kept:
        want = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert got[i] == (want if want < 2 ** 63 else None)
    far = W.whiten(frame(spark, [(i, [3e38 if i else -3e38, float(i)]) for i in range(4)]), 1).collect()
    assert len(far) == 4 and {r["deviation"] for r in far} == {None}


def symmetric(r, e):
    q = np.linalg.qr(r.normal(size=(len(e), len(e))))[0]
    a = (q * e) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("spectrum", [
    [5, 4, 3, 2, 1], [1e6, 1, 1e-3, 1e-6], [3, 3, 3, 1], [2, 2 - 1e-9, 1, 0, 0], [1 + 1e-13, 1, 1 - 1e-13, .5, .5], [1] * 6, list(range(1, 41))])
def test_leading_components(spectrum):
    r = np.random.default_rng(len(spectrum))
    a = symmetric(r, np.array(spectrum, float))
    e, u = W.leading_components(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    want = want[want > 1e-12 * want[0]]
    assert len(e) == len(want) and np.abs(e - want).max() < 1e-12 * want[0]
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12
    assert np.abs(a @ u - u * e).max() < 1e-11 * want[0]


def test_counts_are_inertia():
    r = np.random.default_rng(9)
    for n in (1, 2, 3, 8, 25):
        for _ in range(20):
            a = r.normal(size=(n, n))
            a = a + a.T
            e = np.linalg.eigvalsh(a)
            for shift in [0.0, *r.normal(size=5), *(e + 1e-9), *(e - 1e-9)]:
                assert W.count_above(a, shift) == (e > shift).sum()
    assert W.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and W.count_above(np.zeros((3, 3)), 0.0) == 0
