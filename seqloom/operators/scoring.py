"""Next-token tables: a count model, loss, softmax, top-k, draws and continuation.

Logits live in a long table ``row_id, token_id, logit``; N4-N6 use windows over ``row_id`` (one
row per vocabulary entry). Totals and maxima per context token (N1, E3) are hash aggregates
joined back, so a frequent token is combined before it is shuffled; the candidate table of N7 sums
over a context's successors in one range pass over all contexts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.hashing import hash_unit
from seqloom.functions.text import single_space_tokens
from seqloom.operators.contexts import UNIT, tiled
from seqloom.session import broadcast_if_small, durable, stored

NEG_INF = float("-inf")


def zipped_pairs(tokens_col: str):
    """``[(prev, next), ...]`` of an array column: two slices zipped (linear, one pass)."""
    n = F.size(tokens_col)
    m = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(tokens_col, 1, m), F.slice(tokens_col, 2, m),
                      lambda a, b: F.struct(a.alias("prev"), b.alias("next")))


def successor_pairs(docs: DataFrame, col: str = "text", key: str = "doc_id") -> DataFrame:
    """Adjacent token pairs ``key, pos, prev, next`` of each row (single-space tokens; pos from 1)."""
    t = docs.select(key, single_space_tokens(col).alias("_t"))
    return (t.select(key, F.posexplode(zipped_pairs("_t")).alias("pos", "p"))
            .select(key, (F.col("pos") + 1).alias("pos"), "p.prev", "p.next"))


def next_token_counts(docs: DataFrame, col: str = "text", key: str = "doc_id") -> DataFrame:
    """For each context token its successors with count and log-probability."""
    counts = successor_pairs(docs, col, key).groupBy("prev", "next").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    totals = counts.groupBy("prev").agg(F.sum("n").alias("_total"))
    # every context has a total; as a left join it is left out where nobody asks for ``logp``
    return counts.where(F.col("prev").isNotNull()).join(totals, "prev", "left").select("prev", "next", "n", F.log(F.col("n") / F.col("_total")).alias("logp"))


def cross_entropy_rows(logits: DataFrame, targets: DataFrame, ignore_index: int = -1, on_unknown: str = "error") -> DataFrame:
    """Per-row loss ``row_id, loss`` = logsumexp(logits) - logit[target]; ignored rows dropped.

    A target that is no entry of its row's logits (or null) fails the job; with ``on_unknown="null"``
    its row is kept with a null loss.
    """
    if on_unknown not in ("error", "null"):
        raise ValueError("on_unknown must be error or null")
    mx = F.max("logit").over(Window.partitionBy("row_id"))
    lse = (logits.withColumn("_m", mx).groupBy("row_id")
           .agg((F.first("_m") + F.log(F.sum(F.exp(F.col("logit") - F.col("_m"))))).alias("_lse")))
    t = targets.where(~F.col("target").eqNullSafe(F.lit(ignore_index)))
    picked = t.join(logits.select("row_id", F.col("token_id").alias("target"), "logit"), ["row_id", "target"], "left")
    loss = F.col("_lse") - F.col("logit")
    if on_unknown == "error":
        what = F.concat_ws(" ", F.lit("no logit for target"), F.coalesce(F.col("target").cast("string"), F.lit("null")),
                           F.lit("of row"), F.col("row_id").cast("string"))
        loss = F.when(loss.isNull(), F.raise_error(what).cast("double")).otherwise(loss)
    return picked.join(lse, "row_id", "left").select("row_id", loss.alias("loss"))


def cross_entropy(logits: DataFrame, targets: DataFrame, ignore_index: int = -1, on_unknown: str = "error") -> DataFrame:
    """Mean cross-entropy over non-ignored targets (one row; null when all are ignored), ``n`` of
    them. With ``on_unknown="null"`` targets without a logit count in ``n_unknown``, not in ``n``."""
    rows = cross_entropy_rows(logits, targets, ignore_index, on_unknown)
    counts = [F.avg("loss").alias("loss"), F.count("loss").cast("bigint").alias("n")]
    if on_unknown == "null":
        counts.append((F.count(F.lit(1)) - F.count("loss")).cast("bigint").alias("n_unknown"))
    return rows.agg(*counts)


def split_loss(losses: DataFrame, split_col: str = "split") -> DataFrame:
    """Mean loss per split."""
    return losses.groupBy(split_col).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).cast("bigint").alias("n"))


def softmax(logits: DataFrame, temperature: float = 1.0, out: str = "p") -> DataFrame:
    """``exp((logit - max) / T) / sum`` per row; ``-inf`` logits get probability 0."""
    w = Window.partitionBy("row_id")
    z = (F.col("logit") - F.max("logit").over(w)) / F.lit(float(temperature))
    e = logits.withColumn("_e", F.exp(z))
    return e.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """Logits below the k-th largest become ``-inf``; ties at the k-th stay (rank, not row_number)."""
    r = F.rank().over(Window.partitionBy("row_id").orderBy(F.desc("logit")))
    kept = r <= F.lit(int(k))
    return logits.withColumn("kept", kept).withColumn(
        "logit", F.when(F.col("kept"), F.col("logit")).otherwise(F.lit(NEG_INF)))


def sample_token(probs: DataFrame, seed: int, step: int = 0) -> DataFrame:
    """One token per row: the first (by token id) whose running probability exceeds a
    hashed uniform ``u(seed, row_id, step)``; the last token if rounding leaves none."""
    w = Window.partitionBy("row_id").orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
    c = probs.withColumn("_cum", F.sum("p").over(w)).withColumn("_u", hash_unit(seed, F.col("row_id"), F.lit(step)))
    hit = F.when(F.col("_cum") > F.col("_u"), F.col("token_id"))
    return c.groupBy("row_id").agg(F.coalesce(F.min(hit), F.max("token_id")).alias("token_id"))


# ---------------------------------------------------------------- N7

def _kept(model: DataFrame, k: int) -> DataFrame:
    """Candidates at or above the k-th largest logit of their context (ties stay). Contexts are ranked by
    their different logits, counted map-side: few also where candidates are many, as logits come from counts."""
    w = Window.partitionBy("row_id").orderBy(F.desc("logit")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = model.groupBy("row_id", "logit").agg(F.count(F.lit(1)).alias("same"))
    least = sizes.withColumn("above", F.coalesce(F.sum("same").over(w), F.lit(0))).where(F.col("above") < k) \
        .groupBy("row_id").agg(F.min("logit").alias("_least"))
    return model.join(least, "row_id").where("logit >= _least").drop("_least")


def candidate_table(model: DataFrame, temperature: float = 1.0, k: int | None = None) -> DataFrame:
    """Per context token: successors after temperature, top-k and softmax, as intervals
    ``[cum_lo, cum_hi)`` in token order (the last one open to +inf).

    Probabilities are whole numbers of ``UNIT`` parts of the best one (at least one part), summed in one
    range pass over (context, token), so a token that is the context of a third of all pairs is spread
    over many tasks. Candidates without a probability (a null or ``-inf`` score) own no interval.

    Each context's [0, 1) is cut into ``n_buckets`` equal slices, one per candidate (one in all
    where they are few), and every candidate is listed under the slices it overlaps:
    at most about twice the model's rows, and a draw meets one or two candidates."""
    lg = model.select(F.col("prev").alias("row_id"), F.col("next").alias("token_id"),
                      (F.col("logp") / F.lit(float(temperature))).alias("logit")).where(F.col("logit") > F.lit(NEG_INF))
    lg = stored(lg)  # read by several aggregates, and by the sampling of the range pass
    if k is not None:
        lg = _kept(lg, k)
    best = lg.groupBy("row_id").agg(F.max("logit").alias("_best"))
    part = F.greatest(F.floor(F.exp(F.col("logit") - F.col("_best")) * F.lit(UNIT)), F.lit(1)).cast("bigint")
    c = tiled(lg.join(best, "row_id").select("row_id", "token_id", part.alias("_w")), ["row_id"], "token_id", "_w")
    # both ends come from the same expression of whole numbers, so the intervals tile [0, 1) exactly
    c = c.select("row_id", "token_id", (F.col("lo") / F.col("total")).alias("cum_lo"),
                 F.when(F.col("hi") == F.col("total"), F.lit(float("inf"))).otherwise(F.col("hi") / F.col("total")).alias("cum_hi"),
                 F.col("n_buckets").cast("int").alias("n_buckets"))
    nb = F.col("n_buckets")
    lo_b = F.floor(F.col("cum_lo") * nb).cast("int")
    hi_b = F.least(F.floor(F.least(F.col("cum_hi"), F.lit(1.0)) * nb).cast("int"), nb - 1)
    return c.select("row_id", "token_id", "cum_lo", "cum_hi", "n_buckets",
                    F.explode(F.sequence(F.least(lo_b, hi_b), hi_b)).alias("bucket"))


def continue_sequences(seqs: DataFrame, model: DataFrame, steps: int, temperature: float = 1.0,
                       k: int | None = None, seed: int = 0, key: str = "seq_id", col: str = "tokens") -> DataFrame:
    """Repeat ``steps`` times: context -> scores -> temperature -> top-k -> softmax -> draw -> append.

    The count model scores by the last token only (the crop to the last block does not
    change its context). A sequence whose context has no successor stops growing. Each
    step is checkpointed to cut the lineage: only the key, the last token and the new tokens
    travel, the prompts are joined once at the end. An empty or null sequence has no context
    and stays as it is. Rows are told apart by a stored id: rows of one key each continue, and
    draw alike.
    """
    seqs = stored(seqs.select(key, col).withColumn("_sl_rid", F.monotonically_increasing_id()))
    cand = stored(candidate_table(model, temperature, k))
    ctx, _ = broadcast_if_small(cand.select(F.col("row_id").alias("_ctx"), "n_buckets").distinct())
    cand = cand.withColumnRenamed("row_id", "_ctx").drop("n_buckets")
    cur = seqs.select("_sl_rid", key, F.try_element_at(col, F.lit(-1)).alias("_last"), F.array().cast("array<string>").alias("new"))
    for step in range(steps):
        q = (cur.withColumn("_u", hash_unit(seed, F.col(key), F.lit(step)))
             .withColumn("_ctx", F.col("_last"))
             .join(ctx, "_ctx", "left")
             .withColumn("bucket", F.floor(F.col("_u") * F.col("n_buckets")).cast("int")))
        hit = q.join(cand, ["_ctx", "bucket"], "left") \
            .where(F.col("token_id").isNull() | ((F.col("cum_lo") <= F.col("_u")) & (F.col("_u") < F.col("cum_hi"))))
        picked = hit.groupBy("_sl_rid").agg(F.min("token_id").alias("_next"))
        # a sequence that found no successor has no context any more
        cur = durable(cur.join(picked, "_sl_rid", "left").select(
            "_sl_rid", key, F.col("_next").alias("_last"),
            F.when(F.col("_next").isNotNull(), F.concat("new", F.array("_next"))).otherwise(F.col("new")).alias("new")))
    return seqs.join(cur.drop(key), "_sl_rid").select(
        key, F.concat(F.coalesce(F.col(col), F.array().cast("array<string>")), F.col("new")).alias(col), "new",
        (F.size("new") < steps).alias("done"))
