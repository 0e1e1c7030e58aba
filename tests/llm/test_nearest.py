import math

import numpy as np
from pyspark.sql import functions as F

from seqloom.llm import permutation_index as X
from seqloom.llm.queries import REGISTRY

SF001 = "/root/testdata/sf0.01"


def brute(rows, query, k):
    q = dict(rows)[query]
    near = sorted((math.dist(q, v), i) for i, v in rows if i != query)
    return near[:k]


def test_recall_of_the_query(spark):
    got = REGISTRY["op5_permutation_index"][0](spark, SF001).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    hit = total = 0
    for q in {r["query_id"] for r in got}:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        want = brute(rows, q, 10)
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert all(abs(s - math.dist(dict(rows)[q], dict(rows)[v])) < 1e-12 for _, v, s in mine)
        hit += len({m[1] for m in mine} & {i for _, i in want})
        total += len(want)
    assert hit >= 0.9 * total


def test_copies_ties_and_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(X, "PART_ROWS", 150)
    monkeypatch.setattr(X, "QUERY_ROWS", 2)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=4).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(200)]  # one very common vector
    awkward = [(2000, None), (2001, []), (2002, [0.0] * 4), (2003, [1.0, None, 0.0, 0.0]), (2004, [float("nan"), 1.0, 0.0, 0.0]),
               (2005, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 0.0, 0.0]), (2100, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows + awkward],
                               "vec_id long, embedding array<float>, perm string, part int")
    got = X.nearest(df, F.col("vec_id") % 100 == 0, share=1.0).collect()
    plain = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    for q in (0, 100, 200, 1000, 1100):
        mine = [(s["score"], s["vec_id"]) for s in sorted(got, key=lambda s: s["rank"]) if s["query_id"] == q]
        want = brute(plain, q, 10)
        assert [m[1] for m in mine] == [w[1] for w in want]
    assert not any(s["query_id"] in (2000, 2100) or s["vec_id"] >= 2000 for s in got)
    assert X.nearest(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_recall_among_groups_of_copies(spark):
    """Most rows are copies, in groups of about 100 and one of 1,500; queries without copies."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").cache()
    u = F.xxhash64(F.lit("pivot"), F.col("embedding").cast("array<double>"))
    early = [r["vec_id"] for r in table.orderBy(u).limit(60).collect()]
    copies = F.when(F.col("vec_id") == early[0], 1500).when(F.col("vec_id").isin(early), 100).otherwise(1)
    rows = table.withColumn("c", F.explode(F.sequence(F.lit(0), copies - 1))).select(
        (F.col("vec_id") * 10_000 + F.col("c")).alias("vec_id"), "embedding")
    pivots = X.choose_pivots(X.valid_vectors(rows, "vec_id", "embedding"))
    assert {d: (len(p), len(set(map(tuple, p)))) for d, p in pivots.items()} == {64: (256, 256)}
    asked = sorted(r["vec_id"] for r in table.collect() if r["vec_id"] not in early)[::25]
    got = X.nearest(rows, F.col("vec_id").isin([q * 10_000 for q in asked])).collect()
    held = rows.collect()
    ids, x = np.array([r["vec_id"] for r in held]), np.array([r["embedding"] for r in held])
    hit = 0
    for q in asked:
        dist = np.linalg.norm(x - x[ids == q * 10_000][0], axis=1)
        order = [i for i in np.lexsort((ids, dist)) if ids[i] != q * 10_000][:10]
        hit += len(set(ids[order].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q * 10_000})
    print("recall", hit / (10 * len(asked)))
    assert hit >= 0.9 * 10 * len(asked)
