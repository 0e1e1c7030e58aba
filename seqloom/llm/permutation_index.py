"""Approximate nearest neighbours by a permutation index.

``PIVOTS`` different vectors of a length (a bounded, hash-ordered sample; copies count once) are the pivots. Every
vector is represented by its ``PREFIX`` nearest pivots in order of distance. A part of the
index posts its vectors in one inverted file per pivot, as (vector, position). A query adds
up, over the files of its own pivots, ``prefix - max(position in query, position in vector)``;
the footrule distance of the two permutations is a constant minus twice that sum, so the
largest sums are the smallest footrule distances. The best ``SHARE`` of a part is reranked by the
exact distance, and the parts' lists are merged.

Parts are random splits of at most about ``PART_ROWS`` vectors, queries come in blocks of about
``QUERY_ROWS``; one task handles one block against one part, so neither side is collected whole.
Equal vectors inside a part are one entry that keeps its ``k + 1`` smallest ids, which is all a
query can need, so a vector that a third of all rows share costs one posting.

Measured against brute force with a share of 0.2, the recall of the ten nearest was 0.97 over
51,282 vectors of 64 dimensions and 0.92 over 2,000 and over 10,256 (a third of them equal); the
share of 0.3 leaves a margin.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null id, take no part; vectors only meet vectors of the same length; equal
distances are ordered by id; a query's own id is never its neighbour, also where it repeats;
with fewer than ``k`` candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import maybe_broadcast, stored

PIVOTS = 256
PREFIX = 32
SHARE = 0.3
LEAST = 256  # candidates reranked in a part, if it has as many
PART_ROWS = 32_768
QUERY_ROWS = 4_096


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
                   & F.exists("v", lambda x: x != 0)))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, list[list[float]]]:
    """Up to ``pivots`` different vectors of each vector length, in hash order. Copies count once: only
    the hashes are made distinct, then the vectors of the few drawn hashes are fetched."""
    drawn = vectors.select(F.size("v").alias("d"), F.xxhash64(F.lit("pivot"), "v").alias("u"))
    first = stored(drawn.distinct().withColumn("k", F.row_number().over(W.partitionBy("d").orderBy("u")))
                   .where(F.col("k") <= pivots).select("d", "u"), "pivot-hashes")
    sample = (vectors.select("v", F.size("v").alias("d"), F.xxhash64(F.lit("pivot"), "v").alias("u"))
              .join(maybe_broadcast(first, 16), ["d", "u"], "left_semi").select("d", "u", "v").distinct().orderBy("d", "u").collect())
    out: dict[int, list[list[float]]] = {}
    for r in sample:
        have = out.setdefault(r["d"], [])
        if len(have) < pivots:
            have.append(r["v"])
    return out


def build_index(vectors: DataFrame, pivots: dict[int, list[list[float]]], prefix: int = PREFIX) -> DataFrame:
    """``(vec_id, v, perm)``: every vector with its nearest pivots, nearest first. Vectors of a
    length that no pivot has get an empty permutation (all of them tie)."""

    def run(batches):
        import numpy as np

        held = {d: np.asarray(p) for d, p in pivots.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = part.column(1).to_pylist()
                perms: list[list[int]] = [[] for _ in rows]
                for d in {len(r) for r in rows} & held.keys():
                    which = [i for i, r in enumerate(rows) if len(r) == d]
                    x = np.asarray([rows[i] for i in which])
                    p = held[d]
                    dist = (p * p).sum(1)[None] - 2 * x @ p.T
                    order = np.argsort(dist, axis=1, kind="stable")[:, :prefix]
                    for i, o in zip(which, order.tolist()):
                        perms[i] = o
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(perms, pa.list_(pa.int16()))], ["vec_id", "v", "perm"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, perm array<short>")


class Part:
    """Inverted files over the distinct vectors of one part."""

    def __init__(self, ids, x, perms, pivots: int, prefix: int, k: int):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        ids, x, perms = ids[order], x[order], perms[order]
        rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
        self.x, self.perms = x[first], perms[first]
        by = np.argsort(inverse, kind="stable")  # ids ascend inside every group of equal vectors
        starts = np.searchsorted(inverse[by], np.arange(len(first)))
        ends = np.append(starts[1:], len(by))
        self.ids = [np.unique(ids[by[a:b]])[:k + 1] for a, b in zip(starts, ends)]
        self.prefix, self.k = prefix, k
        flat, position = self.perms.ravel(), np.tile(np.arange(self.perms.shape[1]), len(first))
        vector = np.repeat(np.arange(len(first)), self.perms.shape[1])
        post = np.argsort(flat, kind="stable")
        bounds = np.searchsorted(flat[post], np.arange(pivots + 1))
        self.files = [(vector[post[a:b]], position[post[a:b]]) for a, b in zip(bounds, bounds[1:])]

    def search(self, query_id: int, q, perm, share: float, least: int) -> list[tuple[float, int]]:
        import numpy as np

        n = len(self.x)
        near = np.zeros(n, np.int32)
        for i, p in enumerate(perm):
            vectors, positions = self.files[p]
            near[vectors] += self.prefix - np.maximum(positions, i)
        take = min(n, max(least, int(share * n)))
        at = np.argpartition(-near, take - 1)[:take] if take < n else np.arange(n)
        diff = self.x[at] - q
        dist = np.sqrt((diff * diff).sum(1))
        cut = min(len(at), self.k + 1)  # one of them may be the query alone
        best = np.partition(dist, cut - 1)[cut - 1]
        found = [(d, int(v)) for j, d in zip(at[dist <= best].tolist(), dist[dist <= best].tolist())
                 for v in self.ids[j] if v != query_id]
        return sorted(found)[:self.k]


def search_index(index: DataFrame, queries: Column, k: int, pivots: int = PIVOTS, prefix: int = PREFIX,
                 share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every index row where ``queries`` holds, its
    ``k`` nearest rows found. ``index`` should be stored."""
    dims = index.groupBy(F.size("perm").alias("m"), F.size("v").alias("d")).agg(
        F.count("*").alias("n"), F.count_if(queries).alias("q")).collect()
    n, q = sum(r["n"] for r in dims), sum(r["q"] for r in dims)
    parts, blocks = max(1, -(-n // PART_ROWS)), max(1, -(-q // QUERY_ROWS))
    side = index.withColumn("dim", F.size("v"))
    rows = (side.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.lit(parts)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = (side.where(queries).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    keys = ["dim", "part", "block"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            def array(t, c, dtype):
                return np.asarray(t.column(c).combine_chunks().flatten()).astype(dtype).reshape(t.num_rows, -1)

            part = Part(left.column("vec_id").to_numpy(), array(left, "v", np.float64), array(left, "perm", np.int64),
                        pivots, prefix, k)
            for query_id, x, perm in zip(right.column("vec_id").to_pylist(), array(right, "v", np.float64),
                                         array(right, "perm", np.int64)):
                out += [(query_id, v, d) for d, v in part.search(query_id, x, perm.tolist(), share, least)]
        cols = list(zip(*out)) if out else ([], [], [])
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        run, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """Index the table and search it for the rows where ``queries`` (on ``vec_id``) holds."""
    rows = valid_vectors(vectors, id_col, vector_col)
    index = stored(build_index(rows, choose_pivots(rows)), "permutations")
    return search_index(index, queries, k, share=share)
