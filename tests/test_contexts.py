"""N7 from contexts of several tokens, N2 on foreign targets, and repeated keys and line numbers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import annotations as A
from seqloom.operators import contexts as C
from seqloom.operators import scoring as N


def brute_counts(texts, order):
    out = {}
    for t in texts:
        ts = t.split(" ")
        for i in range(1, len(ts)):
            for n in range(1, min(order, i) + 1):
                succ = out.setdefault((n, " ".join(ts[i - n:i])), {})
                succ[ts[i]] = succ.get(ts[i], 0) + 1
    return out


def draw(seed, key, step, total):
    return int(hashlib.md5(f"{seed}:{key}:{step}".encode()).hexdigest()[:15], 16) % total


def brute_continue(model, key, tokens, steps, block, order, k, seed):
    tokens, new = list(tokens), []
    for step in range(steps):
        seen = tokens[-min(block, order):]
        ctx = next((" ".join(seen[-n:]) for n in range(len(seen), 0, -1) if (n, " ".join(seen[-n:])) in model), None)
        n = None if ctx is None else next(n for n in range(len(seen), 0, -1) if (n, " ".join(seen[-n:])) in model)
        if n is None:
            break
        succ = model[n, ctx]
        if k is not None:
            least = sorted(succ.values(), reverse=True)[:k][-1]
            succ = {t: c for t, c in succ.items() if c >= least}
        at, cum = draw(seed, key, step, sum(succ.values())), 0
        for t in sorted(succ):
            cum += succ[t]
            if at < cum:
                break
        new.append(t)
        tokens.append(t)
    return new


def corpus(seed, n=80, words=12):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    return [" ".join(r.choice(vocab[:r.randint(1, words)]) for _ in range(r.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 4])
def test_counts_of_every_length(spark, order):
    texts = corpus(order) + ["", "one", "a  b  a", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {}
    for r in C.context_counts(df, order).collect():
        got.setdefault((r["level"], r["ctx"]), {})[r["next"]] = r["n"]
    assert got == brute_counts([t for t in texts if t is not None], order)


@pytest.mark.parametrize("order,block,k", [(3, 1024, None), (3, 2, None), (3, 1, 2), (4, 1024, 3), (1, 5, 1)])
def test_draws_match_a_walk(spark, order, block, k):
    texts = corpus(7)
    model = C.context_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), order)
    r = random.Random(order)
    seqs = [(i, r.choice(texts).split(" ")[:r.randint(1, 9)]) for i in range(150)]
    seqs += [(1000, []), (1001, None), (1002, ["unknown"]), (1003, ["unknown", "w1"]), (1004, ["w1", None]), (3, ["w2"]), (3, ["w2"]), (None, ["w1"])]
    df = spark.createDataFrame(seqs, "seq_id long, tokens array<string>").repartition(4)
    out = C.continue_in_context(df, model, 4, block, k=k, seed=5).collect()
    counts = brute_counts(texts, order)
    got = sorted((str(x["seq_id"]), x["tokens"], x["new"], x["done"]) for x in out if x["seq_id"] is not None)
    want = []
    for key, tokens in seqs:
        if key is not None:
            tokens = tokens or []
            known = ["\0" if t is None else t for t in tokens]
            new = brute_continue(counts, key, known, 4, block, order, k, 5)
            want.append((str(key), tokens + new, new, len(new) < 4))
    assert [(g[0], [x or "" for x in g[1]]) + g[2:] for g in got] == sorted((w[0], [x or "" for x in w[1]]) + w[2:] for w in want)
    assert len(out) == len(seqs)


def test_block_size_decides_what_a_draw_sees(spark):
    docs = spark.createDataFrame([(0, "a x b c"), (1, "d x b e"), (2, "x b f")], "doc_id long, text string")
    model = C.context_counts(docs, 3)
    seqs = spark.createDataFrame([(i, ["a", "x", "b"]) for i in range(30)], "seq_id long, tokens array<string>")
    full = {r["new"][0] for r in C.continue_in_context(seqs, model, 1, 3).collect()}
    cropped = {r["new"][0] for r in C.continue_in_context(seqs, model, 1, 2).collect()}
    assert full == {"c"} and cropped == {"c", "e", "f"}


def test_temperature_tiles_and_sharpens(spark):
    docs = spark.createDataFrame([(i, "h " + ("t" if i % 4 else f"r{i}")) for i in range(400)], "doc_id long, text string")
    model = C.context_counts(docs, 2)
    share = {}
    for T in (0.5, 1.0, 3.0):
        iv = C.successor_intervals(model, T).where("ctx = 'h'").orderBy("lo").collect()
        assert iv[0]["lo"] == 0 and iv[-1]["hi"] == iv[0]["total"] and all(a["hi"] == b["lo"] for a, b in zip(iv, iv[1:]))
        share[T] = next(r["hi"] - r["lo"] for r in iv if r["next"] == "t") / iv[0]["total"]
        want = 300 ** (1 / T) / (300 ** (1 / T) + 100)
        assert abs(share[T] - want) < 1e-9
    assert share[0.5] > share[1.0] > share[3.0]


def test_a_hot_context_is_spread_over_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot s"), F.col("id")).alias("text"))
    model = C.context_counts(docs, 1)
    iv = C.successor_intervals(model)
    sizes = [r["n"] for r in iv.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000
    from seqloom.operators.positions import running_sum
    spread = running_sum(model, ["level", "ctx", "next"], "n", out="c", partitions=8).withColumn("p", F.spark_partition_id())
    sizes = sorted(r["count"] for r in spread.groupBy("p").count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_foreign_targets(spark):
    logits = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 0.0), (1, 1, 0.0)], "row_id long, token_id long, logit double")
    good, foreign = (spark.createDataFrame(rows, "row_id long, target long") for rows in ([(0, 1), (1, -1)], [(0, 1), (1, 7), (2, 0), (0, None), (1, -1)]))
    assert N.cross_entropy(logits, good).first()["n"] == 1
    with pytest.raises(Exception, match="no logit for target"):
        N.cross_entropy(logits, foreign).collect()
    r = N.cross_entropy(logits, foreign, on_unknown="null").first()
    assert (r["n"], r["n_unknown"]) == (1, 3) and abs(r["loss"] - 0.31326168751822286) < 1e-12


def test_repeated_sequence_keys(spark):
    model = N.next_token_counts(spark.createDataFrame([(0, "a b c")], "doc_id long, text string"))
    seqs = spark.createDataFrame([(1, ["a"]), (1, ["b"]), (1, ["a"]), (None, ["a"])], "seq_id long, tokens array<string>")
    got = sorted((r["tokens"] for r in N.continue_sequences(seqs, model, 1).collect()))
    assert got == [["a", "b"], ["a", "b"], ["a", "b"], ["b", "c"]]


def test_repeated_line_numbers(spark):
    lines = spark.createDataFrame([("g", 1, ">x"), ("g", 2, "AC"), ("g", 2, "GT"), (None, 1, ">y"), (None, 2, "TT")], "accession string, line_no long, line string")
    got = sorted(((r["header"], r["seq"]) for r in A.fasta_records(lines).collect()))
    assert got == [(">x", "ACGT"), (">y", "TT")]


def test_tiles_past_64_bits_over_all_groups(spark):
    """The weights of all groups together pass 64 bits; every group still tiles its own total."""
    w = 1 << 61
    rows = [(g, i, w + i) for g in range(12) for i in range(3)]
    got = C.tiled(spark.createDataFrame(rows, "g int, item int, w long"), ["g"], "item", "w").orderBy("g", "item").collect()
    assert [(r["lo"], r["hi"], r["total"]) for r in got] == 12 * [(0, w, 3 * w + 3), (w, 2 * w + 1, 3 * w + 3), (2 * w + 1, 3 * w + 3, 3 * w + 3)]


def test_candidates_tile_and_keep_ties(spark):
    rows = [("a", "x", -1.0), ("a", "y", -1.0), ("a", "z", -2.0), ("a", "v", -3.0), ("a", "none", float("-inf")), ("a", "null", None), ("b", "q", -5.0), (None, "n", -1.0)]
    model = spark.createDataFrame(rows, "prev string, next string, logp double")
    got = N.candidate_table(model, temperature=0.5, k=3).select("row_id", "token_id", "cum_lo", "cum_hi").distinct().orderBy("row_id", "cum_lo").collect()
    mine = [r for r in got if r["row_id"] == "a"]
    assert [r["token_id"] for r in mine] == ["x", "y", "z"] and mine[0]["cum_lo"] == 0.0 and mine[-1]["cum_hi"] == float("inf")
    assert all(p["cum_hi"] == q["cum_lo"] for p, q in zip(mine, mine[1:]))
    assert abs(mine[0]["cum_hi"] - 1 / (2 + math.exp(-2))) < 1e-11
    assert [r["token_id"] for r in got if r["row_id"] == "b"] == ["q"]
    two = N.candidate_table(model, k=1).where("row_id = 'a'").select("token_id").distinct().collect()
    assert sorted(r[0] for r in two) == ["x", "y"]


def test_only_asked_contexts_are_listed_once(spark):
    """A context with few successors is one bucket: its successors are not listed under several."""
    model = C.context_counts(spark.createDataFrame([(0, "a b c d e"), (1, "a c")], "doc_id long, text string"), 2)
    assert {r["n_buckets"] for r in C.successor_intervals(model).collect()} == {1}
    scores = spark.createDataFrame([("a", "b", -1.0), ("a", "c", -0.5)], "prev string, next string, logp double")
    assert N.candidate_table(scores).count() == 2


def test_counts_need_one_shuffle_and_no_checkpoint(spark):
    plan = C.context_counts(spark.createDataFrame([(0, "a b c d e")], "doc_id long, text string"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_best_successor_joins_nothing(spark):
    from seqloom.operators import evaluate as E

    model = N.next_token_counts(spark.createDataFrame([(0, "a c a c a b a b d")], "doc_id long, text string"))
    best = E.best_successor(model)
    assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString()
    assert {r["prev"]: r["guess"] for r in best.collect()} == {"a": "b", "c": "a", "b": "a"}
    odd = spark.createDataFrame([("a", None, 3), ("b", "x", 2), ("b", None, 2), (None, "y", 1), ("c", "z", None)], "prev string, next string, n long")
    assert {r["prev"]: r["guess"] for r in E.best_successor(odd).collect()} == {"a": None, "b": "x"}


def test_stored_frames(spark):
    from seqloom.session import stored

    df = spark.createDataFrame([(1, [1, None], "x"), (2, None, None)], "a long, `b c` array<int>, d string")
    assert sorted(map(tuple, stored(df).collect())) == sorted(map(tuple, df.collect()))
    void = df.select("a", F.lit(None).alias("v"))
    assert sorted(map(tuple, stored(void).collect())) == [(1, None), (2, None)]
    assert stored(df.limit(0)).collect() == []
