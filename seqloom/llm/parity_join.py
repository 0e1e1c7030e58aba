"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct 5-word shingles (words lower-cased A-Z; a
shorter text is one shingle). Documents with equal sets form a class, represented by the smallest
id, so copies cost nothing below. Two sets of sizes ``a`` and ``b`` reach Jaccard 0.8 exactly
when their symmetric difference ``d`` is at most ``(a + b) / 9``; then the smaller holds at
least 0.8 times the larger.

*Sketches.* XOR of element hashes is blind to common elements: what is left is the symmetric
difference. A set is cut by hash into ``m`` blocks, each the XOR of its elements' 64-bit hashes,
and into a bit sketch (bit = parity of the elements that fall on it). One changed element
changes at most one block and one bit, so the number of unequal blocks, and the Hamming distance
of the bit sketches, are lower bounds of ``d``.

*Pigeonhole join.* Size bands are powers of two. A band cuts its sets into more blocks than
``d`` can reach plus those that are empty, so two linked sets agree in a block that is not
empty: the join key is (band, block, value). A set near the lower end of its band also takes
the blocks of the band below, for smaller partners. Sets too small for the count of empty
blocks to fit also post their empty blocks.

*Verification.* Candidate pairs pass the Hamming bound, then the sets themselves are
intersected. Components are spread over verified links by minimum labels and pointer jumping.

*Frequent keys.* Keys of up to ``RUN`` sets give their pairs while the sorted keys stream by.
For keys of more sets: a set that has fewer frequent keys than spare agreements must agree with
any partner in another key too, so these keys can be left out for it, exactly (shared
boilerplate ends here). The other sets (large groups of near copies) meet in clusters, dealt to
buckets; a task compares the bit sketches of two buckets, intersects the pairs within the
bound that no link joins yet, and returns a spanning forest of links. Pairs are never emitted,
a row travels once a bucket, and no link between components is lost.

Defined cases: null and empty texts and texts without words have size 0, are linked with
nothing and are their own component; a null id gets a null component and links nothing; rows
that repeat an id are one document; ties go to the smaller id; other columns are passed by;
an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import maybe_broadcast, stored, text_bytes, tidied

SHINGLE = 5
RUN = 32
BUCKET_SETS = 2_048
BUCKET_ELEMENTS = 1_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX1, _MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x):
    """A bijective scrambler of 64-bit integers (arrays)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes):
    """Sorted distinct 64-bit shingle hashes of a text."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    k = min(SHINGLE, len(words))
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s += h[i:i + n]
    s = mix(s)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def block_count(band: int) -> int:
    """Blocks of a band that holds sizes from ``2**band`` up to twice that."""
    top = 2 << band
    share = 1.0 if top <= 32 else 0.5 if top <= 128 else 0.28
    return max(2, int(share * top + 0.999))


def bands(n: int) -> list[tuple[int, int]]:
    """``(band, largest symmetric difference)`` of the bands a set of size ``n`` posts in."""
    if n < 4:  # smaller sets link only with their equals
        return []
    own = n.bit_length() - 1
    out = [(own, n // 4)]
    if own > 2 and 4 * n <= 5 << own:
        out.append((own - 1, 2 * n // 9))
    return out


def _blocks(s, m: int):
    """Block of every element, and where the runs of equal blocks start: ``s`` is sorted and
    the block grows with an element's upper half."""
    import numpy as np

    block = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    return block, np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))


def spare_agreements(s, band: int, most: int) -> int:
    """Blocks that must agree with a linked set beyond the empty ones."""
    return len(_blocks(s, block_count(band))[1]) - most


def block_keys(s, band: int, most: int):
    """Join keys of a set in one band, and its spare agreements (posted empty blocks, if
    there are none to spare, come with the keys)."""
    import numpy as np

    m = block_count(band)
    block, starts = _blocks(s, m)
    value = np.bitwise_xor.reduceat(mix(s + np.uint64(1)), starts)
    at = block[starts]
    spare = len(starts) - most
    if spare <= 0:
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), at)
        at, value = np.concatenate([at, empty]), np.concatenate([value, np.zeros(len(empty), np.uint64)])
    key = mix(value ^ mix(at * np.uint64(64) + np.uint64(band + 1)))
    return key, spare


def bit_sketch(s) -> bytes:
    """Parity bits, at least as many as elements; a power of two, so that a longer sketch
    folds onto a shorter one."""
    import numpy as np

    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches, the longer one folded."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = 8 * len(a), 8 * len(b)
    while n > m:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def _class_hash(s) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(s.tobytes())


def _short(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def profiles(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, sig, s, spare, spare_low, sketch)`` per row: size, class identity (16
    bytes, and its first 8 as the join's short name), spare agreements per band, sketch."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for t in part.column(1).to_pylist():
                    s = shingle_set(t)
                    sig = _class_hash(s)
                    spare = [spare_agreements(s, *b) for b in bands(len(s))] + [0, 0]
                    rows.append((len(s), sig, _short(sig), spare[0], spare[1], bit_sketch(s)))
                cols = list(zip(*rows)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()),
                     pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()),
                     pa.array(cols[5], pa.binary())],
                    ["doc_id", "n", "sig", "s", "spare", "spare_low", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).mapInArrow(
        tidied(run), "doc_id long, n long, sig binary, s long, spare int, spare_low int, sketch binary")


def _post(batches):
    """Block keys of every class met in a task, once a task: ``(key, s, v)`` with ``v`` twice
    the size, plus 1 in the band below the set's own."""
    import numpy as np

    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            keys, names, sizes = [], [], []
            for t in batch.slice(at, 256).column(0).to_pylist():
                s = shingle_set(t)
                name = _short(_class_hash(s))
                if name in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
                for low, b in enumerate(bands(len(s))):
                    key, _ = block_keys(s, *b)
                    keys.append(key)
                    names.append(np.full(len(key), name, np.int64))
                    sizes.append(np.full(len(key), 2 * len(s) + low, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(names)),
                     pa.array(np.concatenate(sizes))], ["key", "s", "v"])


def _runs(batches):
    """Rows sorted by ``(key, s)`` to pairs of sets (kind 0: ``a, b``) for keys of up to ``RUN``
    sets and to rows of frequent keys (kind 1: ``a`` the first set of the key, ``b`` the set, ``v``
    as posted). One open key is carried from batch to batch; a frequent key is passed on as it
    comes."""
    import numpy as np

    def result(kind, a, b, v):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(v)],
                                          ["kind", "a", "b", "v"])

    def pairs(key, s, v):
        for k in range(1, RUN):
            if len(key) <= k:
                return
            eq = np.flatnonzero(key[k:] == key[:-k])
            if not len(eq):
                return
            na, nb = v[eq] >> 1, v[eq + k] >> 1
            ok = (10 * np.minimum(na, nb) >= 8 * np.maximum(na, nb)) & ~((v[eq] & v[eq + k] & 1) == 1)
            if ok.any():
                ab = np.unique(np.stack([s[eq[ok]], s[eq[ok] + k]], 1), axis=0)
                yield result(0, ab[:, 0].copy(), ab[:, 1].copy(), np.zeros(len(ab), np.int64))

    empty = np.zeros(0, np.int64)
    key, s, v = empty, empty, empty
    frequent = first = None  # key whose rows are passed on, and its first set
    last = (None, None)

    def flush(upto):
        """Handle the first ``upto`` carried rows, which hold whole keys."""
        k, x, w = key[:upto], s[:upto], v[:upto]
        edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if upto else empty
        size = np.diff(np.append(edges, upto))
        hot = np.repeat(size > RUN, size) if upto else np.zeros(0, bool)
        if hot.any():
            yield result(1, np.repeat(x[edges], size)[hot], x[hot], w[hot])
        few = np.repeat((size > 1) & (size <= RUN), size) if upto else hot
        yield from pairs(k[few], x[few], w[few])

    for batch in batches:
        bk, bs, bv = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(bk):
            continue
        new = np.concatenate([[(bk[0], bs[0]) != last], (bk[1:] != bk[:-1]) | (bs[1:] != bs[:-1])])
        last = (bk[-1], bs[-1])
        bk, bs, bv = bk[new], bs[new], bv[new]
        if frequent is not None:
            on = bk == frequent
            if on.any():
                yield result(1, np.full(int(on.sum()), first, np.int64), bs[on], bv[on])
                bk, bs, bv = bk[~on], bs[~on], bv[~on]
            if len(bk):
                frequent = None
        key, s, v = np.concatenate([key, bk]), np.concatenate([s, bs]), np.concatenate([v, bv])
        if not len(key):
            continue
        open_at = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        yield from flush(open_at)
        key, s, v = key[open_at:], s[open_at:], v[open_at:]
        if len(key) > RUN:
            yield result(1, np.full(len(key), s[0], np.int64), s, v)
            frequent, first = key[-1], s[0]
            key, s, v = empty, empty, empty
    yield from flush(len(key))


def _near(batches):
    """Pairs whose sketches are within the bound."""
    for batch in batches:
        na, nb, ka, kb = (batch.column(c).to_pylist() for c in ("na", "nb", "ka", "kb"))
        keep = [9 * hamming(a, b) <= x + y and 10 * min(x, y) >= 8 * max(x, y) for x, y, a, b in zip(na, nb, ka, kb)]
        out = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column(c) for c in ("a", "b", "sa", "sb")], ["a", "b", "sa", "sb"])


def _linked(batches):
    """Pairs whose sets reach the threshold."""
    import numpy as np

    for batch in batches:
        keep = []
        for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist()):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * common >= 80 * (len(a) + len(b) - common))
        out = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], ["a", "b"])


def _sets(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingle_set(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([_short(_class_hash(s)) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "s", "x"])


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between class representatives out of candidate pairs of short names."""
    side = classes.select("s", "rep", "n", "sketch")
    a = side.select(F.col("s").alias("sa"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    b = side.select(F.col("s").alias("sb"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    near = stored(pairs.join(a, "sa").join(b, "sb").where("a <> b").select("a", "b", "sa", "sb", "na", "nb", "ka", "kb")
                  .mapInArrow(tidied(_near), "a long, b long, sa long, sb long"), "near-pairs")
    wanted = stored(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), "wanted")
    sets = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).join(
        maybe_broadcast(wanted, 16), "doc_id", "left_semi").mapInArrow(tidied(_sets), "doc_id long, s long, x binary")
    sets = stored(sets.dropDuplicates(["doc_id", "s"]), "sets")
    xa = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"), F.col("x").alias("xa"))
    xb = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"), F.col("x").alias("xb"))
    return stored(near.join(xa, ["a", "sa"]).join(xb, ["b", "sb"]).select("a", "b", "xa", "xb")
                  .mapInArrow(tidied(_linked), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` over the linked nodes, ``component`` the smallest node reachable."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    label = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = edges.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(around, "node").select("node", F.least("component", "near").alias("low"), "component")
        jump = label.select(F.col("node").alias("low"), F.col("component").alias("far"))
        nxt = stored(step.join(jump, "low", "left").select(
            "node", F.least("low", F.coalesce("far", "low")).alias("component"),
            (F.least("low", F.coalesce("far", "low")) < F.col("component")).alias("moved")), "labels")
        label = nxt.select("node", "component")
        if not nxt.where("moved").head(1):
            return label


def _forest(rows: pa.Table) -> pa.Table:
    """Links that join the sets of two buckets of a cluster (or of one): pairs within the sketch
    bound are intersected unless links found before already join them, so at most one link
    fewer than sets leaves the task."""
    import numpy as np

    rows = rows.sort_by([("side", "ascending"), ("rep", "ascending")])
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("x").to_pylist()]
    reps, side = rows.column("rep").to_numpy(), rows.column("side").to_numpy()
    n = np.array([len(x) for x in sets])
    bits = max(64, 4 << int(n.max() - 1).bit_length())
    sketch = np.stack([np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1)
                                   .astype(np.uint8)).view(np.uint64) for x in sets])
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    two = rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py()
    for i in range(len(sets) - 1):
        start = max(i + 1, int(np.searchsorted(side, 1))) if two else i + 1
        if two and side[i]:
            break
        distance = np.bitwise_count(sketch[start:] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        total = n[start:] + n[i]
        near = np.flatnonzero((9 * distance <= total) & (10 * np.minimum(n[start:], n[i]) >= 8 * np.maximum(n[start:], n[i])))
        for k in near[np.argsort(distance[near], kind="stable")].tolist():
            a, b = find(i), find(start + k)
            if a == b:
                continue
            common = len(np.intersect1d(sets[i], sets[start + k], assume_unique=True))
            if 100 * common >= 80 * (int(total[k]) - common):
                parent[b] = a
                links.append((int(reps[i]), int(reps[start + k])))
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def frequent_links(docs: DataFrame, classes: DataFrame, hot: DataFrame) -> DataFrame:
    """Links among the sets that frequent keys cannot be left out for.

    Sets that share a frequent key meet in one cluster. A cluster is dealt to buckets of at
    most about ``BUCKET_SETS`` sets and ``BUCKET_ELEMENTS`` elements; a task takes two buckets,
    with their sets, and returns links that span what is linked."""
    # a class's spare agreements in its own band (low = 0) and in the band below (low = 1)
    spare = classes.select("s", "spare", "spare_low")
    count = hot.select(F.col("a").alias("first"), F.col("b").alias("s"), (F.col("v") % 2).alias("low")).groupBy("s", "low").agg(
        F.count("*").alias("h"), F.collect_set("first").alias("firsts")).join(spare, "s")
    bound = stored(count.where(F.col("h") >= F.when(F.col("low") == 1, F.col("spare_low")).otherwise(F.col("spare")))
                   .select("s", "firsts"), "bound-sets")
    # a set's keys join their first sets; one edge a set, and the few distinct ones among the firsts
    lead = bound.select("s", "firsts", F.array_min("firsts").alias("lead"))
    edges = lead.select(F.col("s").alias("a"), F.col("lead").alias("b")).union(
        lead.select(F.col("lead").alias("a"), F.explode("firsts").alias("b")).where("a <> b")).distinct()
    members = components(edges).withColumnRenamed("node", "s").withColumnRenamed("component", "cluster").join(
        bound.select("s").distinct(), "s", "left_semi").join(classes.select("s", "rep", "n"), "s")
    members = stored(members, "cluster-members")
    size = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum("n") / BUCKET_ELEMENTS), F.ceil(F.count("*") / BUCKET_SETS)).cast("int").alias("buckets"),
        F.count("*").alias("sets")).where("sets > 1").select("cluster", "buckets")
    wanted = stored(members.select(F.col("rep").alias("doc_id")).distinct(), "cluster-documents")
    sets = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).join(
        maybe_broadcast(wanted, 16), "doc_id", "left_semi").mapInArrow(tidied(_sets), "doc_id long, s long, x binary")
    sets = sets.dropDuplicates(["doc_id", "s"]).withColumnRenamed("doc_id", "rep")
    placed = members.join(size, "cluster").join(sets, ["rep", "s"]).withColumn(
        "own", F.pmod(F.xxhash64("s"), F.col("buckets")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).select(
        "cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "x")
    return stored(paired.groupBy("cluster", "lo", "hi").applyInArrow(_forest, "a long, b long"), "cluster-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row."""
    rows = stored(profiles(docs), "set-profiles")
    real = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    members = real.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    classes = stored(real.join(members, "sig").where("doc_id = rep")
                     .select("sig", "s", "rep", "last", "n", "spare", "spare_low", "sketch").dropDuplicates(["sig"]), "classes")

    posted = docs.where(F.col("doc_id").isNotNull()).select(text_bytes().alias("t")).mapInArrow(
        tidied(_post), "key long, s long, v long")
    runs = stored(posted.repartition("key").sortWithinPartitions("key", "s")
                  .mapInArrow(tidied(_runs), "kind byte, a long, b long, v long"), "runs")
    pairs = stored(runs.where("kind = 0").select(F.col("a").alias("sa"), F.col("b").alias("sb")).distinct(), "pairs")
    links = verified(docs, classes, pairs)
    hot = runs.where("kind = 1")
    if hot.head(1):
        links = links.union(frequent_links(docs, classes, hot))
    found = components(links)
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").where(
        "component is not null or last > rep").select("sig", F.coalesce("component", "rep").alias("component_id"))
    named = stored(named, "named-classes")
    return rows.select("doc_id", "n", "sig").join(maybe_broadcast(named, 48), "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
         .alias("component_id"))
