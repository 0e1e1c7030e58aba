import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from seqloom.llm import periodic_runs as P
from seqloom.llm.queries import REGISTRY

from .helpers import EMPTY, frame, null_id, prose

SF0001 = "/root/testdata/sf0.001"


def brute(words, min_length=6, exponent=4):
    """Every lag, every maximal stretch; a stretch counts under its smallest period alone."""
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, exponent * q):
                smaller = any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q))
                if not smaller:
                    out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plant(words, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def find(texts, *args):
    number = {}
    arrays = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in texts]
    return P.find_runs(arrays, *args)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words(letters):
    r = random.Random(letters)
    texts = [[r.randrange(letters) for _ in range(r.randrange(90))] for _ in range(150)]
    assert find(texts) == [brute(t) for t in texts]
    assert find(texts, 9, 3) == [brute(t, 9, 3) for t in texts]


def test_planted_periods_in_each_other():
    r = random.Random(5)
    texts = []
    for _ in range(120):
        t = [r.randrange(4) for _ in range(r.randrange(1, 9))]
        for _ in range(3):  # powers of powers, with edges cut and words changed
            t = t * r.randrange(1, 6)
            t = [9] * r.randrange(3) + t[r.randrange(2):] + [r.randrange(4)]
        texts.append(t[:260])
    assert find(texts) == [brute(t) for t in texts]


def test_fibonacci_and_long_documents():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert find([b[:300], b[:300] * 4]) == [brute(b[:300]), brute(b[:300] * 4)]
    r = random.Random(2)
    base = [r.randrange(10 ** 6) for _ in range(50_000)]
    long = base * 5 + [1] * 400_000 + [2, 3] * 100_000
    start = time.perf_counter()
    got = find([long, base, [7] * 6, [7] * 5])
    assert got == [[(0, 250_000, 50_000), (250_000, 400_000, 1), (650_000, 200_000, 2)], [], [(0, 6, 1)], []]
    assert time.perf_counter() - start < 20


def test_classes_leave_no_lag_out():
    for min_length, exponent in ((6, 4), (6, 3), (40, 4), (100, 7)):
        seen = []
        for lo, hi, k in P.lag_classes(2000, min_length, exponent):
            seen += range(lo + 1, hi + 1)
            assert k == min(max(min_length, exponent * q) - q for q in range(lo + 1, 4000)) and k >= hi
        assert seen[:2000 // exponent] == list(range(1, 2000 // exponent + 1))


def test_operator_on_awkward_rows(spark):
    phrase = " ".join(prose(1, 7))
    texts = EMPTY + ["a " * 9, "a b a b a b a b\ta\nb", phrase + " " + " ".join([phrase] * 4), "x\x0by\x0cx\r\ny x y x y ü", " ".join(prose(2, 3000))]
    got = P.periodic_runs(frame(spark, texts, extra=[null_id("q q q q q q"), null_id("q q q q q q")]), slice_bytes=20).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, t in enumerate(texts):
        words = (t or "").split()
        runs = brute(words)
        assert [tuple(x) for x in by[i]["runs"]] == runs and by[i]["n_words"] == len(words)
        assert by[i]["collapsed"] == collapsed(words, runs)
    assert [r["collapsed"] for r in got if r["doc_id"] is None] == ["q", "q"]
    assert P.periodic_runs(frame(spark, []).where("false")).collect() == []


def test_pieces_keep_words_whole(monkeypatch):
    monkeypatch.setattr(P, "PIECE", 3)
    number = {}
    text = b"alpha  be\tgamma x " * 20
    ids = P._numbered(text, number)
    assert [list(number)[i] for i in ids] == text.split()


def check_digest(spark, rows, got):
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in rows:
        words = plant([w.decode() for w in (text or "").encode().split()], doc_id)
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        r = by[doc_id][0]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert len(got) == len(rows)


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").where("length(text) < 6000").collect()]
    got = [r for r in REGISTRY["op11_periodic_runs"][0](spark, SF0001).collect() if r["doc_id"] in dict(rows)]
    check_digest(spark, rows, got)
    assert sum(r["n_runs"] > 0 for r in got) > 10


def test_digest_on_awkward_rows(spark):
    rows = [(i, t) for i, t in enumerate(EMPTY * 12 + [" ".join(prose(i, 5 + 7 * i)) for i in range(40)])]
    docs = frame(spark, [t for _, t in rows])
    check_digest(spark, rows, P.runs_digest(docs).collect())
    assert P.runs_digest(frame(spark, [], extra=[null_id("a a a a a a a")])).first()["length"] == 7
