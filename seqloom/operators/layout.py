"""Split, frame, pack, shard and sample the encoded corpus.

Stream offsets are two-level prefix sums (``positions.running_sum``); documents are
cut into the blocks they overlap and regrouped per block, so arrays shuffle, never
single tokens, and no task ever holds more than one block's pieces.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.hashing import hash_int
from seqloom.operators.corpus import EOS_ID, PAD_ID, SOS_ID
from seqloom.operators.positions import dense_index, running_sum
from seqloom.session import broadcast_if_small, durable


def split_exact(df: DataFrame, key: str, frac: float = 0.03, seed: int = 0, out: str = "split",
                order_out: str = "order_key") -> DataFrame:
    """Exactly ``ceil(frac * n)`` rows become ``val``, the rest ``train``.

    Rows are ordered by an md5 hash of ``(seed, key)`` then ``key``; ``order_out`` is the
    row's place in that shuffled order (also the packing order inside a split).
    """
    n = df.count()
    k = math.ceil(frac * n)
    idx = dense_index(df.withColumn("_sl_h", hash_int(seed, key)), ["_sl_h", key], out=order_out).drop("_sl_h")
    return idx.withColumn(out, F.when(F.col(order_out) < k, F.lit("val")).otherwise(F.lit("train")))


def split_sizes(split_df: DataFrame, col: str = "split") -> DataFrame:
    """Rows per split."""
    return split_df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def frame_and_pad(encoded: DataFrame, max_len: int, col: str = "ids") -> DataFrame:
    """``[SOS] + ids + [EOS]`` then ``[PAD]`` up to ``max_len``; never truncates.

    ``len`` = max(n + 2, max_len), since ``max_len`` counts raw tokens.
    """
    ids = F.col(col)
    pad = F.greatest(F.lit(max_len) - F.size(ids) - 2, F.lit(0))
    framed = F.concat(F.array(F.lit(SOS_ID)), ids, F.array(F.lit(EOS_ID)), F.array_repeat(F.lit(PAD_ID), pad))
    # from the sizes, so that who only needs lengths builds no padding
    length = F.when(ids.isNull(), F.size(ids)).otherwise(F.size(ids) + 2 + pad)
    return encoded.withColumn("len", length.cast("bigint")).withColumn(col, framed)


def frame(encoded: DataFrame, max_len: int, col: str = "ids") -> DataFrame:
    """W4 without materialising the padding: ``body`` = ``[SOS] + ids + [EOS]``, ``pad`` =
    number of ``[PAD]`` ids that follow, ``len`` = size(body) + pad (same as frame_and_pad)."""
    ids = F.col(col)
    body = F.concat(F.array(F.lit(SOS_ID)), ids, F.array(F.lit(EOS_ID)))
    pad = F.greatest(F.lit(max_len) - F.size(ids) - 2, F.lit(0)).cast("long")
    return (encoded.withColumn("body", body).withColumn("pad", pad)
            .withColumn("len", (F.size("body") + F.col("pad")).cast("bigint")).drop(col))


def packed_length(encoded: DataFrame, split_col: str = "split") -> DataFrame:
    """Total ids per split, as BIGINT."""
    return encoded.groupBy(split_col).agg(F.sum("len").cast("bigint").alias("n_tokens"))


def stream_offsets(framed: DataFrame, order_cols: Sequence[str], split_col: str = "split",
                   out: str = "offset", row_out: str | None = None) -> DataFrame:
    """Start of each row in its split's concatenated stream (exclusive prefix sum of ``len``), and
    with ``row_out`` the row's place in its split.

    The rows go through one range pass and carry their offsets out of it, so null and equal
    order keys neither lose nor repeat a row. Only each split's first offset is joined.
    """
    cum = running_sum(framed, [split_col, *order_cols], "len", out="_sl_cum", row_out="_sl_row")
    begin = F.col("_sl_cum") - F.coalesce(F.col("len"), F.lit(0))
    base, _ = broadcast_if_small(cum.groupBy(F.col(split_col).alias("_sl_split")).agg(
        F.min(begin).alias("_sl_base"), F.min("_sl_row").alias("_sl_first")))
    placed = cum.join(base, F.col(split_col).eqNullSafe(F.col("_sl_split")))
    numbers = [(begin - F.col("_sl_base")).alias(out)]
    if row_out:
        numbers.append((F.col("_sl_row") - F.col("_sl_first")).alias(row_out))
    return placed.select(*[F.col(f"`{c}`") for c in framed.columns if c not in (out, row_out)], *numbers)


def pack(framed: DataFrame, block_size: int, order_cols: Sequence[str] = ("order_key",),
         split_col: str = "split", col: str = "ids", zeros: str | None = None) -> DataFrame:
    """Concatenate each split's rows in order and cut the stream into ``block_size`` blocks.

    Output ``split, block_id, ids, n``; the last block of a split may be short. Rows may
    come padded (``ids``) or compact from ``frame`` (``body`` + ``pad``): compact pieces
    carry only their real ids and a pad count through the shuffle, and the zeros are
    written when the block is assembled. A block that lies within one row is complete where
    the row is and is not shuffled: only the (at most two) pieces at a row's ends are. With ``zeros`` (of compact rows)
    the padding at the end of such a block stays a number in that column: ``n`` counts ``ids`` and ``zeros``.
    """
    B = int(block_size)
    compact = "body" in framed.columns and "pad" in framed.columns
    if zeros and not compact:
        raise ValueError("only compact rows have padding that is no id")
    off = stream_offsets(framed, order_cols, split_col)
    o, L = F.col("offset"), F.col("len")
    first_q, last_q = F.floor(o / B).cast("long"), F.floor((o + L - 1) / B).cast("long")
    keep = [split_col, "offset", "len"] + (["body", "pad"] if compact else [col])
    pieces = off.where(L > 0).select(*keep, F.explode(F.sequence(first_q, last_q)).alias("block_id"))
    q = F.col("block_id")
    lo = F.greatest(q * B, o) - o          # piece bounds relative to the row start
    hi = F.least((q + 1) * B, o + L) - o
    whole = (q * B >= o) & ((q + 1) * B <= o + L)
    if compact:
        r = F.size("body")
        real = F.when(lo < r, F.slice("body", (lo + 1).cast("int"), (F.least(hi, r) - lo).cast("int"))) \
            .otherwise(F.array().cast("array<int>"))
        npad = F.greatest(hi - F.greatest(lo, r), F.lit(0)).cast("int")
        parts = pieces.select(split_col, "block_id", "offset", whole.alias("_whole"), real.alias("_real"), npad.alias("_npad"))
        filled = lambda x: F.concat(x["_real"], F.array_repeat(F.lit(PAD_ID), x["_npad"]))
        ordered = F.array_sort(F.collect_list(F.struct("offset", "_real", "_npad")))
    else:
        piece = F.slice(col, (lo + 1).cast("int"), (hi - lo).cast("int"))
        parts = pieces.select(split_col, "block_id", "offset", whole.alias("_whole"), piece.alias("_piece"))
        filled = lambda x: x["_piece"]
        ordered = F.array_sort(F.collect_list(F.struct("offset", "_piece")))
    whole = parts.where("_whole")
    if zeros:
        alone = whole.select(split_col, "block_id", F.col("_real").alias(col), F.col("_npad").alias(zeros))
    else:
        alone = whole.select(split_col, "block_id", filled({c: F.col(c) for c in parts.columns}).alias(col))
    joined = parts.where("NOT _whole").groupBy(split_col, "block_id").agg(F.flatten(F.transform(ordered, filled)).alias(col))
    if zeros:
        joined = joined.withColumn(zeros, F.lit(0))
        return alone.unionByName(joined).withColumn("n", (F.size(col) + F.col(zeros)).cast("bigint"))
    return alone.unionByName(joined).withColumn("n", F.size(col).cast("bigint"))


def _shard_of(row: Column, rows: Column, n_max: int) -> Column:
    """Shard of the row at place ``row`` of ``rows``: contiguous parts, the first ``rows % n`` one row longer."""
    n = F.least(F.lit(n_max), rows)
    div, mod = F.floor(rows / n), rows % n
    cut = (div + 1) * mod
    return F.when(row < cut, F.floor(row / (div + 1))).otherwise(mod + F.floor((row - cut) / div)).cast("long")


def contiguous_shards(df: DataFrame, order_cols: Sequence[str], n_max: int = 1024, split_col: str = "split",
                      out: str = "shard") -> DataFrame:
    """Per split, ``min(n_max, rows)`` contiguous shards; the first ``rows % n`` one row longer.

    Adds ``row`` (position inside the split) and ``out``.
    """
    keys = [split_col, *order_cols]
    # rows meet their number by a stored id, so null and repeated keys neither lose nor repeat rows
    rows = durable(df.withColumn("_sl_id", F.monotonically_increasing_id()))
    # only keys and id are sorted and checkpointed again
    idx = dense_index(rows.select(*keys, "_sl_id"), [*keys, "_sl_id"], out="_sl_g")
    spans, _ = broadcast_if_small(idx.groupBy(F.col(split_col).alias("_sl_split")).agg(
        F.min("_sl_g").alias("_sl_start"), F.count(F.lit(1)).alias("_sl_n")))
    i = F.col("_sl_g") - F.col("_sl_start")
    shard = _shard_of(i, F.col("_sl_n"), n_max)
    placed, _ = broadcast_if_small(idx.join(spans, F.col(split_col).eqNullSafe(F.col("_sl_split"))).select(
        "_sl_id", i.alias("row"), shard.alias(out)))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return rows.join(placed, "_sl_id").select(*keys, *rest, "row", out)


def stream_shards(framed: DataFrame, order_cols: Sequence[str], n_max: int = 1024, split_col: str = "split") -> DataFrame:
    """Rows with their ``row`` and ``offset`` in the split's stream and their shard (the parts of W6), all
    from one range pass: what the shard files (K3) are written from."""
    rows = stream_offsets(framed, order_cols, split_col, row_out="row")
    sizes, _ = broadcast_if_small(rows.groupBy(F.col(split_col).alias("_sl_split")).agg(F.count(F.lit(1)).alias("_sl_n")))
    j = rows.join(sizes, F.col(split_col).eqNullSafe(F.col("_sl_split")))
    return j.withColumn("shard", _shard_of(F.col("row"), F.col("_sl_n"), n_max)).drop("_sl_split", "_sl_n")


def sample_blocks(blocks: DataFrame, split: str, n_draws: int, block_size: int, seed: int = 0,
                  split_col: str = "split", col: str = "ids", total: int | None = None) -> DataFrame:
    """``n_draws`` random windows of the split's stream: ``x`` = B ids, ``y`` = x moved by one.

    Start ``s`` is uniform in ``[0, N - B)`` from an md5 hash of ``(seed, split, draw)``; a
    window never spans more than blocks ``s div B`` and ``s div B + 1``, so each draw is an
    equi-join to two blocks. ``total`` is the split's number of ids where it is known (A7);
    without it the blocks are read once more to count them.
    """
    B = int(block_size)
    mine = blocks.where(F.col(split_col) == split)
    if total is None:
        total = mine.agg(F.sum("n")).first()[0] or 0
    if total <= B:
        raise ValueError(f"split {split!r} holds {total} ids, need more than block_size={B}")
    spark = blocks.sparkSession
    draws = spark.range(n_draws).withColumnRenamed("id", "draw_id").withColumn(split_col, F.lit(split))
    s = hash_int(seed, F.lit(split), F.col("draw_id")) % F.lit(total - B)
    draws = draws.withColumn("start", s)
    req = draws.withColumn("block_id", F.explode(F.array(F.floor(F.col("start") / B).cast("long"),
                                                         F.floor(F.col("start") / B).cast("long") + 1)))
    # the requests are 2 * n_draws rows: while they are few they are shipped to the blocks
    j = mine.select(split_col, "block_id", col).join(broadcast_if_small(req)[0], [split_col, "block_id"])
    buf = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block_id", col))), lambda x: x[col]))
    g = j.groupBy("draw_id", "start").agg(buf.alias("_buf"))
    r = (F.col("start") % B).cast("int")
    return g.select("draw_id", "start", F.slice("_buf", r + 1, B).alias("x"), F.slice("_buf", r + 2, B).alias("y"))


def crop_tail(df: DataFrame, block_size: int, col: str = "ids", out: str | None = None) -> DataFrame:
    """Keep the last ``block_size`` ids of each sequence."""
    c: Column = F.col(col)
    B = int(block_size)
    return df.withColumn(out or col, F.when(F.size(c) <= B, c).otherwise(F.slice(c, -B, B)))
