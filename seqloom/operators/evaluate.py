"""Evaluation: prediction metrics, corpus realism, continuation accuracy, operons."""

from __future__ import annotations

from binascii import hexlify
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.text import whitespace_tokens
from seqloom.operators.corpus import _stretches
from seqloom.operators.lookups import spread_lookup
from seqloom.operators.positions import islands
from seqloom.operators.scoring import successor_pairs, zipped_pairs
from seqloom.session import broadcast_cap, stored

try:  # twice as fast on short texts as OpenSSL's, which hashlib prefers
    from _md5 import md5
except ImportError:
    from hashlib import md5


def prediction_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       by: Sequence[str] | None = None) -> DataFrame:
    """Accuracy (exact match), MSE, RMSE and MAPE (zero actuals left out of MAPE only)."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    err = a - p
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n"),
            F.avg((a == p).cast("double")).alias("accuracy"),
            F.avg(err * err).alias("mse"),
            F.avg(F.when(a != 0, F.abs(err / a))).alias("mape")]
    g = df.groupBy(*by) if by else df
    out = g.agg(*aggs).withColumn("rmse", F.sqrt("mse"))
    return out


def _doc_tokens(docs: DataFrame, key: str, col: str) -> DataFrame:
    return docs.select(key, F.explode(whitespace_tokens(col)).alias("token")).distinct()


def _pair_strings(tokens_col: str):
    return F.transform(zipped_pairs(tokens_col), lambda x: F.concat(x["prev"], F.lit(" "), x["next"]))


def _pairs(docs: DataFrame, col: str) -> DataFrame:
    """Neighbouring-token pairs of every row, as ``pair`` strings (not de-duplicated)."""
    t = docs.select(whitespace_tokens(col).alias("_t"))
    return t.select(F.explode(_pair_strings("_t")).alias("pair"))


def _doc_pairs(docs: DataFrame, key: str, col: str) -> DataFrame:
    t = docs.select(key, whitespace_tokens(col).alias("_t"))
    return t.select(key, F.explode(_pair_strings("_t")).alias("pair")).distinct()


def corpus_similarity(generated: DataFrame, real: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """E2 per generated row: share of its distinct tokens and of its distinct neighbour pairs
    that also occur in the real corpus (left joins to distinct sets; linear, no all-pairs)."""
    rt = real.select(F.explode(whitespace_tokens(col)).alias("token")).distinct().withColumn("_in", F.lit(1))
    rp = _pairs(real, col).distinct().withColumn("_in", F.lit(1))
    gt = _doc_tokens(generated, key, col).join(rt, "token", "left").groupBy(key).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_tokens"), F.count("_in").cast("bigint").alias("n_tokens_real"))
    gp = _doc_pairs(generated, key, col).join(rp, "pair", "left").groupBy(key).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_pairs"), F.count("_in").cast("bigint").alias("n_pairs_real"))
    out = generated.select(key).join(gt, key, "left").join(gp, key, "left").fillna(0, subset=[
        "n_tokens", "n_tokens_real", "n_pairs", "n_pairs_real"])
    return (out.withColumn("token_share", F.when(F.col("n_tokens") > 0, F.col("n_tokens_real") / F.col("n_tokens")))
            .withColumn("pair_share", F.when(F.col("n_pairs") > 0, F.col("n_pairs_real") / F.col("n_pairs"))))


def corpus_jaccard(generated: DataFrame, real: DataFrame, col: str = "text") -> DataFrame:
    """E2 corpus level: distinct token sets of both corpora, their overlap and Jaccard index."""
    g = generated.select(F.explode(whitespace_tokens(col)).alias("token")).distinct().withColumn("g", F.lit(1))
    r = real.select(F.explode(whitespace_tokens(col)).alias("token")).distinct().withColumn("r", F.lit(1))
    both = g.join(r, "token", "full")
    return both.agg(F.count("g").cast("bigint").alias("n_generated"), F.count("r").cast("bigint").alias("n_real"),
                    F.count_if(F.col("g").isNotNull() & F.col("r").isNotNull()).cast("bigint").alias("n_common"),
                    F.count(F.lit(1)).cast("bigint").alias("n_union")) \
        .withColumn("jaccard", F.col("n_common") / F.col("n_union"))


ROUNDS = 2
SLOTS = 16  # bits that the filter of labels has for each of them, while it stays under the broadcast cap


def _digests(texts) -> np.ndarray:
    """The md5 of each text, a row of 16 bytes each."""
    return np.frombuffer(b"".join([md5(x).digest() for x in texts]), np.uint8).reshape(-1, 16)


def _forty_bits(held: np.ndarray, a: int) -> np.ndarray:
    """The five bytes from byte ``a`` of each row as a number."""
    value = held[:, a].astype(np.int64)
    for i in range(a + 1, a + 5):
        value = value << 8 | held[:, i]
    return value


def _fixed(held: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    """Bytes that lie ``width`` a value beside each other, as an Arrow array."""
    n = len(held) // width
    return pa.Array.from_buffers(kind, n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(held)])


def _refine(texts: list, rounds: int, passes=None):
    """The graphs of some rows refined beside each other: per round the row of each node and its label, 16 bytes
    (see ``refined_labels``). ``passes`` tells which labels are asked for: a label stands for those of the rounds
    before, so in the last round a node whose label did not pass is left out."""
    toks = [(x or "").split() for x in texts]
    sizes = [len(x) for x in toks]
    places = {x: i for i, x in enumerate(dict.fromkeys(chain.from_iterable(toks)))}
    if not places:
        return
    row = np.repeat(np.arange(len(texts)), sizes)
    codes = np.fromiter(map(places.__getitem__, chain.from_iterable(toks)), np.int64, len(row))
    nodes, at = np.unique(row * len(places) + codes, return_inverse=True)
    low, high = np.minimum(at[:-1], at[1:]), np.maximum(at[:-1], at[1:])
    edges = np.sort((low * len(nodes) + high)[(row[:-1] == row[1:]) & (low < high)])
    low, high = np.divmod(edges[np.diff(edges, prepend=-1) > 0], len(nodes))
    of, code = np.divmod(nodes, len(places))
    held = _digests(x.encode() for x in places)[code]  # a word of many rows is hashed once
    yield of, held
    for r in range(rounds):
        sums = []
        for a in (0, 5):
            value, around = _forty_bits(held, a), np.zeros(len(nodes), np.int64)
            np.add.at(around, low, value[high])
            np.add.at(around, high, value[low])
            sums.append(around)
        if passes and r == rounds - 1:
            keep = passes(held)
            of, held, sums = of[keep], held[keep], [x[keep] for x in sums]
        labels = _fixed(hexlify(held.tobytes()), 32, pa.string())
        texts = pc.binary_join_element_wise(labels, *[pa.array(x).cast(pa.string()) for x in sums], "|").cast(pa.binary())
        held = _digests(texts.to_numpy(zero_copy_only=False).tolist())  # several times faster than to_pylist
        yield of, held


def _labels(docs: DataFrame, rounds: int, key: str, col: str, wanted: np.ndarray | None = None, rest: bool = False) -> DataFrame:
    """``key, round, label, n`` of ``refined_labels``, labels as their 16 bytes. With ``wanted`` (``_places``) only labels that
    it may hold; with ``rest`` the others are counted under a null label and a null key."""
    texts = docs.select(F.col(key).alias("key"), F.col(col).alias("text"))  # taken apart by the worker: tokens are many times the text
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("round", T.IntegerType()),
                           T.StructField("label", T.BinaryType()), T.StructField("n", T.LongType())])
    names = [f.name for f in schema]
    passes = None if wanted is None else lambda held: _may_hold(wanted, held)

    def run(batches):
        for b in _stretches(batches, "text"):
            nodes = 0
            for r, (of, held) in enumerate(_refine(b.column(1).to_pylist(), rounds, passes)):
                nodes = nodes or len(of)
                if passes:
                    keep = passes(held)
                    of, held = of[keep], held[keep]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(np.full(len(of), r, np.int32)),
                                                  _fixed(held.tobytes(), 16, pa.binary()), pa.array(np.ones(len(of), np.int64))], names)
                if rest and nodes > len(of):
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, b.column(0).type), pa.array([r], pa.int32()),
                                                      pa.nulls(1, pa.binary()), pa.array([nodes - len(of)], pa.int64())], names)

    return texts.mapInArrow(run, schema).withColumnRenamed("key", key)


def refined_labels(docs: DataFrame, rounds: int = ROUNDS, key: str = "doc_id", col: str = "text") -> DataFrame:
    """E2, gene network: ``key, round, label, n``: the nodes of each row's graph with their label (``n`` is 1).

    A row's graph has its different tokens as nodes and an edge between tokens that stand next to
    each other somewhere (no loops, no direction, no repeats). Round 0 labels a node by its token;
    every further round hashes a node's label with those of its neighbours (as sums of 40-bit
    pieces, so their order doesn't matter), so a label of round r stands for everything within r
    steps. A genome's sequence is one row, so its graph needs no shuffle: rows are refined where
    they are read, a stretch of them at a time. Null and empty texts have no nodes; rows that share a key give
    rows of their own.
    """
    return _labels(docs, rounds, key, col).withColumn("label", F.lower(F.hex("label")))


def _place(held: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` bits (a power of two) stands for each label: what its first four bytes say."""
    return np.ascontiguousarray(held[:, :4]).view(">u4")[:, 0].astype(np.int64) & size - 1


def _may_hold(bits: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which labels (rows of 16 bytes) the filter may hold: false is certain."""
    at = _place(held, 64 * len(bits))
    return (bits[at >> 6] >> (at & 63) & 1).astype(bool)


def _places(labels: DataFrame):
    """A filter of the labels (binary): a bit for the place that a label's first bytes name, and whether it is
    used. It is put together by tasks and takes at most ``broadcast_cap`` bytes on driver and workers, whatever
    the labels: where they are more, it lets more of the others pass, which then are told apart by the shuffle."""
    most = 1 << (8 * broadcast_cap()).bit_length() - 1
    size = min(1 << max(SLOTS * labels.count(), 1 << 10).bit_length(), most, 1 << 32)

    part = min(size // 64, 1 << 13)  # words that travel together

    def run(batches):
        bits = np.zeros(size // 64, np.int64)
        for b in batches:
            fixed = b.column(0).cast(pa.binary(16))
            at = _place(np.frombuffer(fixed.buffers()[1], np.uint8)[16 * fixed.offset:][:16 * len(fixed)].reshape(-1, 16), size)
            np.bitwise_or.at(bits, at >> 6, np.int64(1) << (at & 63))
        for i in range(0, len(bits), part):
            if bits[i:i + part].any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([bits[i:i + part].tobytes()])], ["at", "held"])

    def together(found):
        held = np.bitwise_or.reduce([np.frombuffer(x, np.int64) for x in found.column("held").to_pylist()])
        return pa.table({"at": found.column("at").slice(0, 1), "held": pa.array([held.tobytes()])})

    # a task gives its whole filter on, so they are no more than run at once
    few = labels.select("label").coalesce(labels.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(run, "at long, held binary").groupBy("at").applyInArrow(together, "at long, held binary").toArrow()
    bits = np.zeros(size // 64, np.int64)
    for i, held in zip(*(x.to_pylist() for x in parts.columns)):
        bits[i:i + part] = np.frombuffer(held, np.int64)
    return bits, True


def network_similarity(generated: DataFrame, real: DataFrame, rounds: int = ROUNDS, key: str = "doc_id",
                       col: str = "text") -> DataFrame:
    """E2 per generated row and round: nodes of its graph, those whose label some real graph has, and
    their share (null without nodes). Keys of ``generated`` must be unique. A label that very many rows
    have is answered by broadcast (``lookups``), never by one task."""
    mine = stored(_labels(generated, rounds, key, col))
    wanted, small = _places(mine.select("label"))
    # most labels that no generated row has never leave the worker that makes them
    theirs = _labels(real, rounds, key, col, wanted if small else None).select("label")
    known = stored(theirs.distinct().select(F.hex("label").alias("label"), F.lit(True).alias("_in")))  # graphs are refined once, the lookup reads twice
    met = spread_lookup(mine.withColumn("label", F.hex("label")), known, "label", "_in").groupBy(key, "round").agg(
        F.sum("n").alias("n_nodes"), F.coalesce(F.sum(F.when(F.col("_in"), F.col("n"))), F.lit(0)).alias("n_nodes_real"))
    every = generated.select(key, F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"))
    out = every.join(met, [key, "round"], "left").fillna(0, subset=["n_nodes", "n_nodes_real"])
    return out.withColumn("share", F.when(F.col("n_nodes") > 0, F.col("n_nodes_real") / F.col("n_nodes")))


def network_overlap(generated: DataFrame, real: DataFrame, rounds: int = ROUNDS, key: str = "doc_id",
                    col: str = "text") -> DataFrame:
    """E2 per round: the label histograms of both corpora, ``n_common`` (sum of the smaller counts),
    ``n_union`` (of the larger ones) and their ratio. Two sums with map-side combination, no join."""
    def counts(labels, g, r):
        return labels.select("round", "label", (F.col("n") * g).alias("g"), (F.col("n") * r).alias("r"))

    mine = stored(_labels(generated, rounds, key, col).select("round", "label", "n"))
    wanted, small = _places(mine.select("label"))
    # labels that no generated row has are counted where they are made, under none: common to nothing, part of the union
    theirs = _labels(real, rounds, key, col, wanted if small else None, rest=True)
    both = counts(mine, 1, 0).unionByName(counts(theirs, 0, 1)).groupBy("round", "label").agg(F.sum("g").alias("g"), F.sum("r").alias("r"))
    return both.groupBy("round").agg(
        F.sum("g").alias("n_generated"), F.sum("r").alias("n_real"), F.sum(F.least("g", "r")).alias("n_common"),
        F.sum(F.greatest("g", "r")).alias("n_union")).withColumn("similarity", F.col("n_common") / F.col("n_union"))


def best_successor(model: DataFrame) -> DataFrame:
    """The top successor per context token (most frequent, then smallest token)."""
    first = F.min(F.struct((-F.col("n")).alias("_n"), F.col("next").isNull().alias("_none"), F.col("next").alias("_next")))
    return model.where(F.col("prev").isNotNull() & F.col("n").isNotNull()) \
        .groupBy("prev").agg(first.alias("_first")).select("prev", F.col("_first._next").alias("guess"))


def continuation_accuracy(docs: DataFrame, model: DataFrame, col: str = "text", key: str = "doc_id") -> DataFrame:
    """By position, how often the real next token equals the model's top successor."""
    pairs = successor_pairs(docs, col, key)
    j = pairs.join(best_successor(model), "prev", "left")
    hit = (F.col("guess") == F.col("next")) & F.col("guess").isNotNull()
    return j.groupBy("pos").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                F.count_if(hit).cast("bigint").alias("hits")) \
        .withColumn("accuracy", F.col("hits") / F.col("n"))


def operons(features: DataFrame, max_gap: int = 50, gene_col: str = "locus_tag", reach: str = "last") -> DataFrame:
    """Runs of neighbouring genes on the same genomic accession and strand, gap <= max_gap.

    Gaps and islands over a global order in one range pass (``positions.islands``), not a
    window per genome, so one genome holding a third of all genes still spreads out. With
    ``reach="last"`` the gap is taken from the end of the gene before in that order; with
    ``"max"`` from the largest end so far, so a gene inside a longer one does not part its
    neighbours. A gene without a start, or after one without an end ("last"), opens a run.
    """
    genes = features.where(F.col("feature") == "gene").select("genomic_accession", "strand", "start", "end", gene_col)
    order = ["genomic_accession", "strand", "start", "end", gene_col]
    runs = islands(genes, order, ["genomic_accession", "strand"], "start", "end", max_gap, out="operon_id", reach=reach)
    members = F.array_sort(F.collect_list(F.struct("start", F.col(gene_col).alias("g"))))
    g = runs.groupBy("operon_id", "genomic_accession", "strand").agg(
        members.alias("_m"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.count(F.lit(1)).cast("bigint").alias("n_genes"))
    names = F.transform("_m", lambda x: x["g"])
    return g.select("genomic_accession", "strand", "start", "end", "n_genes",
                    F.array_join(names, " ").alias("genes"),
                    F.to_json(F.struct("genomic_accession", "strand", "start", "end", names.alias("genes"))).alias("operon"))
