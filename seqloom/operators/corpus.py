"""Corpus: cleaning, profiling, vocabulary, encode and decode."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.text import single_space_tokens, token_count_single_space, whitespace_tokens
from seqloom.operators.lookups import spread_lookup
from seqloom.operators.positions import dense_index
from seqloom.session import broadcast_cap, durable, measured_bytes

# Special tokens and their ids, placed before the vocabulary.
SPECIALS = ["[PAD]", "[EOS]", "[SOS]"]
PAD_ID, EOS_ID, SOS_ID = 0, 1, 2

BATCH_VALUES = 1 << 18  # tokens or ids that are looked up at once

def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- P11-P13

def row_slice(df: DataFrame, start: int, stop: int, order_cols: Sequence) -> DataFrame:
    """Rows ``[start, stop)`` of ``df`` in an explicit order (bounded top-k + offset)."""
    return df.orderBy(*[_c(c) for c in order_cols]).offset(start).limit(max(stop - start, 0))


def clean_tokens(df: DataFrame, col: str = "text") -> DataFrame:
    """Split on single spaces, drop tokens holding ``_``, rejoin; one row per row."""
    kept = F.filter(single_space_tokens(col), lambda t: ~t.contains("_"))
    return df.withColumn(col, F.array_join(kept, " "))


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Drop consumed columns after a mapping."""
    return df.drop(*cols)


# ---------------------------------------------------------------- A1-A5, A8

def unique_tokens(docs: DataFrame, col: str = "text") -> DataFrame:
    """A1: distinct whitespace-run tokens (partial then final hash aggregate)."""
    return docs.select(F.explode(whitespace_tokens(col)).alias("token")).distinct()


def vocab_size(docs: DataFrame, col: str = "text") -> DataFrame:
    """A2: number of distinct tokens (one row)."""
    return unique_tokens(docs, col).agg(F.count(F.lit(1)).cast("bigint").alias("vocab_size"))


def with_lengths(docs: DataFrame, col: str = "text", out: str = "n_tokens") -> DataFrame:
    """Single-space token count per row (empty tokens count)."""
    return docs.withColumn(out, token_count_single_space(col))


def length_stats(docs: DataFrame, col: str = "text") -> DataFrame:
    """A3: min, max, mean and exact (interpolated) median of the per-row token counts."""
    n = token_count_single_space(col)
    return docs.select(n.alias("n")).agg(
        F.min("n").cast("bigint").alias("min_len"), F.max("n").cast("bigint").alias("max_len"),
        F.round(F.avg("n"), 6).alias("avg_len"), F.round(F.median("n"), 6).alias("median_len"))


def longest(docs: DataFrame, n: int = 20, col: str = "text") -> DataFrame:
    """A4: the ``n`` greatest token counts, ascending, with their place in that list."""
    from pyspark.sql import Window
    top = with_lengths(docs, col).select("n_tokens").orderBy(F.desc("n_tokens")).limit(n)
    # the window only ever sees the n rows of the top-n result
    return top.select((F.row_number().over(Window.orderBy("n_tokens")) - 1).cast("bigint").alias("pos"), "n_tokens")


def max_len(docs: DataFrame, col: str = "text") -> DataFrame:
    """A5: corpus-wide maximum token count (one row), taken before any split."""
    return docs.agg(F.max(token_count_single_space(col)).cast("bigint").alias("max_len"))


def _count_tokens(batches):
    held: Counter = Counter()

    def given():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"])
        held.clear()
        return out

    for b in _stretches(batches, "text"):
        held.update(chain.from_iterable(x.split() for x in b.column("text").to_pylist() if x))
        if len(held) > BATCH_VALUES:  # what a task counts is bounded, the sums are taken behind the shuffle
            yield given()
    yield given()


def token_counts(docs: DataFrame, col: str = "text") -> DataFrame:
    """Whitespace-token frequencies ``token, n``, counted by tasks as they read and summed by one shuffle."""
    counted = docs.select(F.col(col).alias("text")).mapInArrow(_count_tokens, "token string, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def _list_parts(column):
    """Flat values and offsets (from 0) of an Arrow list column; a null list counts as empty."""
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
    return pc.list_flatten(column), offsets


def _kept_lists(values, offsets, keep):
    """The lists again with only the values where ``keep`` holds."""
    counts = np.concatenate([[0], np.cumsum(keep)])
    return pa.ListArray.from_arrays(pa.array(counts[offsets], pa.int32()), values.filter(pa.array(keep)))


def _looked_up(flat, places: dict):
    """Place of every value in ``places`` (-1: none). The dictionary is built once a task; a batch
    asks it once for each of its different values."""
    coded = flat.dictionary_encode()
    found = np.array([places.get(x, -1) for x in coded.dictionary.to_pylist()] + [-1], np.int64)
    return found[pc.fill_null(coded.indices, len(found) - 1).to_numpy(zero_copy_only=False)]


def _sizes(column) -> np.ndarray:
    """Values of each list; of a text as many as it has tokens of three letters."""
    if pa.types.is_list(column.type):
        sizes = pc.list_value_length(column)
    else:
        sizes = pc.divide(pc.add(pc.binary_length(column), 3), 4)
    return pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _stretches(batches, values: str):
    """The batches cut into stretches of rows with at most ``BATCH_VALUES`` values in column ``values`` (or of one
    row), so that what is built from one at a time is bounded whatever the rows of a batch hold."""
    for b in batches:
        ends = np.cumsum(_sizes(b.column(values)))
        at = 0
        while at < b.num_rows:
            most = (int(ends[at - 1]) if at else 0) + BATCH_VALUES
            stop = max(int(np.searchsorted(ends, most, "right")), at + 1)
            yield b.slice(at, stop - at)
            at = stop
        pa.default_memory_pool().release_unused()


def _filter_tokens(tokens: list[str]):
    """Rows of a key and a list of tokens, or a text: the same with only ``tokens``. Of texts, those left with
    none are dropped."""
    def run(batches):
        places = {t: i for i, t in enumerate(tokens)}
        known = places.__contains__
        for b in _stretches(batches, "_toks"):
            column = b.column("_toks")
            if pa.types.is_list(column.type):
                flat, offsets = _list_parts(column)
                kept = _kept_lists(flat, offsets, _looked_up(flat, places) >= 0)
                yield pa.RecordBatch.from_arrays([b.column(0), kept], [b.schema.names[0], "_toks"])
                continue
            texts = [" ".join(filter(known, x.split())) if x else "" for x in column.to_pylist()]
            rows = pa.array([i for i, x in enumerate(texts) if x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([x for x in texts if x], pa.string())], [b.schema.names[0], "_toks"])

    return run


def reduce_vocab(docs: DataFrame, max_size: int = 65533, col: str = "text", key: str = "doc_id"):
    """Keep the ``max_size`` most frequent tokens (ties by token), drop the rest from rows.

    Returns ``(reduced_docs, kept)``; rows are rejoined with single spaces and rows left
    with no token (null texts too) disappear. The kept set is shipped to tasks when it
    measures under the session's byte cap; otherwise tokens are exploded under a row id,
    looked up (the most frequent ones by broadcast) and regrouped. Both give the same rows.
    """
    kept = durable(token_counts(docs, col).orderBy(F.desc("n"), F.asc("token")).limit(max_size))
    if measured_bytes(kept.select("token")) <= broadcast_cap():
        tokens = [r["token"] for r in kept.select("token").collect()]
        # texts are taken apart by the worker: their tokens would be many times as much to hand over
        left = docs.select(key, F.col(col).alias("_toks")).mapInArrow(_filter_tokens(tokens), T.StructType([docs.schema[key], T.StructField("_toks", T.StringType())]))
        return left.withColumnRenamed("_toks", col), kept
    toks = docs.select(F.col(key), whitespace_tokens(col).alias("_toks")).where(F.col("_toks").isNotNull())
    rows = toks.withColumn("_rid", F.monotonically_increasing_id()).select("_rid", key, F.posexplode("_toks").alias("pos", "token"))
    on = spread_lookup(rows, kept.select("token", F.lit(True).alias("_kept")), "token", "_kept").where("_kept")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    reduced = on.groupBy("_rid", key).agg(F.array_join(F.transform(ordered, lambda x: x["token"]), " ").alias(col))
    return reduced.drop("_rid"), kept


# ---------------------------------------------------------------- W3 vocabulary ids

def build_vocab(tokens: DataFrame, col: str = "token", specials: Sequence[str] = SPECIALS) -> DataFrame:
    """``token, id``: specials first (0, 1, 2), then the tokens in token order.

    Ids come from a range-partitioned dense index (no single-task sort). A token that
    repeats a special keeps its later index, as ``enumerate`` into a dict does.
    """
    spark = tokens.sparkSession
    distinct = tokens.select(F.col(col).alias("token")).distinct()
    ids = dense_index(distinct, ["token"], out="id", start=len(specials))
    sp = spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id long")
    both = sp.unionByName(ids.select("token", F.col("id").cast("long")))
    return both.groupBy("token").agg(F.max("id").alias("id"))


# ---------------------------------------------------------------- J4 / J5 encode, decode

def _one_id(vocab: DataFrame) -> DataFrame:
    """One id per token: of a repeated token the last (greatest) id wins."""
    return vocab.where(F.col("token").isNotNull()).groupBy("token").agg(F.max("id").cast("int").alias("id"))


def _one_token(vocab: DataFrame) -> DataFrame:
    """One token per id: of a repeated id the smallest token wins."""
    return vocab.where(F.col("id").isNotNull()).groupBy(F.col("id").cast("int").alias("id")).agg(F.min("token").alias("token"))


def _encode_join(toks: DataFrame, vocab: DataFrame, key: str, on_unknown: str, unk_id) -> DataFrame:
    rows = toks.withColumn("_rid", F.monotonically_increasing_id()).select("_rid", key, F.posexplode_outer("_toks").alias("pos", "token"))
    j = spread_lookup(rows, vocab, "token", "id")
    known = F.col("id")
    if on_unknown == "error":
        known = F.when(F.col("id").isNull() & F.col("pos").isNotNull(), F.raise_error(
            F.concat(F.lit("unknown token: '"), F.col("token"), F.lit("'")))).otherwise(F.col("id"))
    elif on_unknown == "unk":
        known = F.coalesce("id", F.lit(unk_id).cast("int"))
    # a row without tokens keeps its place; an unknown token that is dropped leaves no entry
    entry = F.when(F.col("pos").isNotNull() & known.isNotNull(), F.struct("pos", known.alias("id")))
    ids = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["id"])
    return j.groupBy("_rid", key).agg(ids.alias("ids")).drop("_rid")


class _Places(dict):
    """Ids of tokens, -1 of unknown ones."""

    def __missing__(self, token):
        return -1


def _encode_table(docs: DataFrame, vocab: DataFrame, key: str, col: str, on_unknown: str, unk_id) -> DataFrame:
    rows = vocab.select("token", "id").toArrow()

    def run(batches):
        places = _Places(zip(rows.column("token").to_pylist(), rows.column("id").to_pylist()))
        for b in _stretches(batches, "_text"):
            toks = [[] if x is None else x.split(" ") for x in b.column("_text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in toks], dtype=np.int64)])
            found = np.fromiter(map(places.__getitem__, chain.from_iterable(toks)), np.int64, int(offsets[-1]))
            missing = found < 0
            if missing.any() and on_unknown == "error":
                raise ValueError(f"unknown token: {next(islice(chain.from_iterable(toks), int(missing.argmax()), None))!r}")
            if on_unknown == "unk":
                found, missing = np.where(missing, unk_id, found), np.zeros(len(found), bool)
            yield pa.RecordBatch.from_arrays([b.column(0), _kept_lists(pa.array(found, pa.int32()), offsets, ~missing)], [b.schema.names[0], "ids"])

    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(key, F.col(col).alias("_text")).mapInArrow(run, schema)


def encode(docs: DataFrame, vocab: DataFrame, on_unknown: str = "error", col: str = "text",
           key: str = "doc_id", unk_token: str = "[UNK]", strategy: str = "auto") -> DataFrame:
    """Single-space tokens -> ids; ``ids ARRAY<INT>, len``. Unknown tokens raise by default.

    One contract for every size: one output row per input row (keys may repeat), a null
    text has no ids, and of a repeated vocabulary token the last id wins. ``table`` ships
    the vocabulary to tasks and maps Arrow batches in place (no shuffle); ``join``
    explodes tokens under a row id, looks them up (``lookups``: the most frequent ones by
    broadcast, the others by shuffle) and regroups. ``auto`` measures the vocabulary
    and ships it only under the session's byte cap.
    """
    if on_unknown not in ("error", "drop", "unk"):
        raise ValueError("on_unknown must be error, drop or unk")
    vocab = _one_id(vocab)
    unk_id = None
    if on_unknown == "unk":
        r = vocab.where(F.col("token") == unk_token).select("id").first()
        if r is None:
            raise ValueError(f"{unk_token} is not in the vocabulary")
        unk_id = int(r["id"])
    if strategy == "auto":
        strategy = "table" if measured_bytes(vocab) <= broadcast_cap() else "join"
    if strategy == "table":
        out = _encode_table(docs, vocab, key, col, on_unknown, unk_id)
    else:
        out = _encode_join(docs.select(key, single_space_tokens(col).alias("_toks")), vocab, key, on_unknown, unk_id)
    return out.withColumn("len", F.size("ids").cast("bigint"))


def decode(encoded: DataFrame, vocab: DataFrame, key: str = "doc_id", col: str = "ids",
           strategy: str = "auto") -> DataFrame:
    """Ids -> tokens through the real inverse of the vocabulary; ``tokens``, ``text``.

    One output row per input row, whatever the vocabulary's size: null or empty ids give
    no tokens and an empty text, an id that the vocabulary lacks gives a null token (left
    out of the text). ``table`` and ``join`` as for ``encode``.
    """
    inverse = _one_token(vocab)
    if strategy == "auto":
        strategy = "table" if measured_bytes(inverse) <= broadcast_cap() else "join"
    src = encoded.select(key, F.col(col).cast("array<int>").alias("_ids"))
    if strategy == "table":
        rows = inverse.select("id", "token").toArrow()

        def run(batches):
            places = {x: i for i, x in enumerate(rows.column("id").to_pylist())}
            tokens = rows.column("token").combine_chunks()
            for b in _stretches(batches, "_ids"):
                flat, offsets = _list_parts(b.column("_ids"))
                at = _looked_up(flat, places)
                found = pc.take(tokens, pa.array(at, mask=at < 0))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)], [b.schema.names[0], "tokens"])

        out = src.mapInArrow(run, T.StructType([src.schema[key], T.StructField("tokens", T.ArrayType(T.StringType()))]))
    else:
        rows = src.withColumn("_rid", F.monotonically_increasing_id()).select("_rid", key, F.posexplode_outer("_ids").alias("pos", "id"))
        entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "token"))
        toks = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["token"])
        out = spread_lookup(rows, inverse, "id", "token").groupBy("_rid", key).agg(toks.alias("tokens")).drop("_rid")
    return out.withColumn("text", F.array_join("tokens", " "))
