"""Global positions without a single-partition window (W3 machinery, also W5/W6/F1/E4).

A ``Window.orderBy`` with no ``partitionBy`` moves every row into one task. Instead:

1. range-partition on the (total) order key and sort inside each partition;
2. tag each row with its partition id and its position inside the partition;
3. store the tagged rows, so the counting pass and the numbering pass see the same ones;
4. count (or sum a weight) per partition: one small row per partition reaches the driver;
5. add the exclusive prefix of those totals, shipped back as a literal array.

The order key must be a total order (append a unique tie-break), otherwise the
numbering of equal keys is arbitrary.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.session import broadcast_if_small, durable, stored

_PID = "_sl_pid"
_LIDX = "_sl_lidx"
_LCUM = "_sl_lcum"


def _cols(cols: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return int(partitions)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _ranged(df: DataFrame, order_cols: Sequence, partitions: int | None) -> DataFrame:
    keys = _cols(order_cols)
    n = _partitions(df, partitions)
    pid = F.spark_partition_id().cast("long")
    return (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_PID, F.spark_partition_id())
        # monotonically_increasing_id = partition id << 33 | row number in partition
        .withColumn(_LIDX, F.monotonically_increasing_id() - F.shiftleft(pid, 33))
    )


def _offsets(totals: dict[int, int], n_parts: int) -> Column:
    """Exclusive prefix of per-partition totals as a literal lookup on the partition id.

    Written as one SQL expression (parsed once, folded into a single array literal), so
    thousands of partitions cost one call, not one per partition.
    """
    acc, offs = 0, []
    for p in range(max(n_parts, 1)):
        offs.append(acc)
        acc += int(totals.get(p, 0))
    arr = ", ".join(f"{o}L" for o in offs)
    return F.expr(f"element_at(array({arr}), {_PID} + 1)")


def dense_index(df: DataFrame, order_cols: Sequence, out: str = "idx", start: int = 0,
                partitions: int | None = None) -> DataFrame:
    """Add ``out``: the row's position in ``order_cols`` order, counted from ``start``."""
    ranged = stored(_ranged(df, order_cols, partitions))
    rows = ranged.groupBy(_PID).agg(F.count(F.lit(1)).alias("n")).collect()
    totals = {r[_PID]: r["n"] for r in rows}
    n_parts = max([p + 1 for p in totals], default=0)
    return ranged.withColumn(out, _offsets(totals, n_parts) + F.col(_LIDX) + F.lit(start).cast("long")).drop(_PID, _LIDX)


def dense_index_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, out: str = "ord",
                       start: int = 1, partitions: int | None = None) -> DataFrame:
    """Position inside each group (like ``row_number`` over ``partitionBy(group)``).

    Computed from the global index, so a group holding a third of all rows is still
    spread over many tasks; the per-group start joins back with AQE skew handling.
    """
    g = dense_index(df, list(group_cols) + list(order_cols), out="_sl_g", partitions=partitions)
    # derived from stored rows, so a recomputed block is identical: persist is enough
    firsts, _ = broadcast_if_small(g.groupBy(*group_cols).agg(F.min("_sl_g").alias("_sl_g0")))
    return (
        g.join(firsts, list(group_cols))
        .withColumn(out, F.col("_sl_g") - F.col("_sl_g0") + F.lit(start).cast("long"))
        .drop("_sl_g", "_sl_g0")
    )


def _local_cumsums(weights: Sequence[str]):
    def run(batches):
        acc = [0] * len(weights)
        for batch in batches:
            sums = []
            for i, weight in enumerate(weights):
                arr = pc.fill_null(batch.column(weight).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                cs = np.cumsum(arr) + acc[i]
                if len(cs):
                    acc[i] = int(cs[-1])
                sums.append(pa.array(cs, type=pa.int64()))
            yield pa.RecordBatch.from_arrays(list(batch.columns) + sums,
                                             names=list(batch.schema.names) + [f"{_LCUM}{i}" for i in range(len(weights))])
    return run


def running_sums(df: DataFrame, order_cols: Sequence, weights: dict[str, str], row_out: str | None = None,
                 partitions: int | None = None) -> DataFrame:
    """Add, for each ``out: weight``, the inclusive running sum of integer column ``weight`` in global
    order, and with ``row_out`` the row's position in that order (from 0).

    Inside a partition the running sums are one Arrow pass over the already sorted rows
    (narrow, no shuffle); across partitions the per-partition totals are prefixed. The rows
    carry their numbers, nothing is joined back: null and equal order keys keep every row
    once (equal keys in an order of their own, fixed where the rows are stored).
    """
    ranged = _ranged(df, order_cols, partitions)
    sums = [f"{_LCUM}{i}" for i in range(len(weights))]
    schema = T.StructType(ranged.schema.fields + [T.StructField(c, T.LongType(), False) for c in sums])
    local = stored(ranged.mapInArrow(_local_cumsums(list(weights.values())), schema))
    rows = local.groupBy(_PID).agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in sums]).collect()
    n_parts = max([r[_PID] + 1 for r in rows], default=0)
    summed = local
    for out, c in zip(weights, sums):
        summed = summed.withColumn(out, _offsets({r[_PID]: r[c] for r in rows}, n_parts) + F.col(c))
    if row_out:
        summed = summed.withColumn(row_out, _offsets({r[_PID]: r["n"] for r in rows}, n_parts) + F.col(_LIDX))
    return summed.drop(_PID, _LIDX, *sums)


def running_sum(df: DataFrame, order_cols: Sequence, weight: str, out: str = "cum", row_out: str | None = None,
                partitions: int | None = None) -> DataFrame:
    """``running_sums`` of one column."""
    return running_sums(df, order_cols, {out: weight}, row_out, partitions)


def _same_as_before(batch, same_cols: Sequence[str]):
    """For rows 1.. of a batch: whether all key columns equal the row before (nulls are equal)."""
    n = batch.num_rows
    same = np.ones(max(n - 1, 0), bool)
    for c in same_cols:
        col = batch.column(c)
        a, b = col.slice(0, n - 1), col.slice(1)
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        same = same & equal.to_numpy(zero_copy_only=False)
    return same


def _known(column):
    """Values of an integer column (0 for null) and which are there."""
    return (pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False),
            pc.is_valid(column).to_numpy(zero_copy_only=False))


def _near(start, has_start, end, has_end, max_gap: int):
    """Whether rows begin at most ``max_gap`` after the ends given for them; a null joins nothing."""
    return (start - end <= max_gap) & has_start & has_end


def _local_islands(same_cols: Sequence[str], start_col: str, end_col: str, max_gap: int):
    def run(batches):
        acc = 0
        prev = None  # (same values..., end) of the previous row in this partition
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            (start, has_start), (end, has_end) = _known(batch.column(start_col)), _known(batch.column(end_col))
            # each row against the row before it: all key columns equal and the gap small
            joined = _near(start[1:], has_start[1:], end[:-1], has_end[:-1], max_gap) & _same_as_before(batch, same_cols)
            new = np.concatenate([[1], 1 - joined.astype("int64")]).astype("int64")
            first, last = ([batch.column(c)[i].as_py() for c in same_cols] for i in (0, n - 1))
            if prev is not None and prev[0] == first and prev[1] is not None and has_start[0] and start[0] - prev[1] <= max_gap:
                new[0] = 0
            prev = (last, end[-1] if has_end[-1] else None)
            cs = np.cumsum(new) + acc
            acc = int(cs[-1])
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [pa.array(new), pa.array(cs)],
                                             names=list(batch.schema.names) + ["_sl_new", _LCUM])
    return run


def islands(df: DataFrame, order_cols: Sequence, same_cols: Sequence[str], start_col: str, end_col: str,
            max_gap: int, out: str = "island", partitions: int | None = None, reach: str = "last") -> DataFrame:
    """Gaps and islands over a global order in one range pass.

    A row opens a new island unless a row before it (in ``order_cols`` order) has the
    same ``same_cols`` and reaches to at most ``max_gap`` before this row's start: with
    ``reach="last"`` the row right before it, with ``"max"`` the largest end of all rows
    before it, so that a short row inside a long one closes nothing. A null start opens an
    island; a null end reaches nowhere (``"last"``: the next row opens one).

    Inside a sorted partition the comparison is an Arrow pass; across partitions one row
    per partition reaches the driver. ``out`` numbers islands from 1.
    """
    if reach == "max":
        return _covered_islands(df, order_cols, same_cols, start_col, end_col, max_gap, out, partitions)
    if reach != "last":
        raise ValueError(f"unknown reach {reach!r}")
    ranged = _ranged(df, order_cols, partitions)
    schema = T.StructType(ranged.schema.fields + [T.StructField("_sl_new", T.LongType(), False),
                                                  T.StructField(_LCUM, T.LongType(), False)])
    local = durable(ranged.mapInArrow(_local_islands(list(same_cols), start_col, end_col, int(max_gap)), schema))
    first = F.min_by(F.struct(*[F.col(c) for c in same_cols], F.col(start_col).alias("_s")), F.col(_LIDX))
    last = F.max_by(F.struct(*[F.col(c) for c in same_cols], F.col(end_col).alias("_e")), F.col(_LIDX))
    rows = local.groupBy(_PID).agg(first.alias("f"), last.alias("l"), F.max(_LCUM).alias("t")).collect()
    info = {r[_PID]: r for r in rows}
    n_parts = max([local.rdd.getNumPartitions()] + [p + 1 for p in info])
    k = len(same_cols)
    fix, totals, prev_last = {}, {}, None
    for p in sorted(info):
        f, l = tuple(info[p]["f"]), tuple(info[p]["l"])
        joined = (prev_last is not None and f[:k] == prev_last[:k] and None not in (f[k], prev_last[k])
                  and f[k] - prev_last[k] <= max_gap)
        fix[p] = 1 if joined else 0
        totals[p] = int(info[p]["t"]) - fix[p]
        prev_last = l
    correction = F.expr("element_at(array(" + ", ".join(f"{fix.get(p, 0)}L" for p in range(n_parts)) + f"), {_PID} + 1)")
    return local.withColumn(out, _offsets(totals, n_parts) + F.col(_LCUM) - correction).drop(_PID, _LIDX, _LCUM, "_sl_new")


def _segment_ends(same_cols: Sequence[str], end_col: str):
    """One row a partition: keys of its first and last segment, whether they are one, the last one's largest end."""
    def run(batches):
        pid = first = last = reached = None
        single = True
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            cut = np.flatnonzero(~_same_as_before(batch, same_cols)) + 1
            begin = int(cut[-1]) if len(cut) else 0
            head, tail = ([batch.column(c)[i].as_py() for c in same_cols] for i in (0, n - 1))
            if first is None:
                pid, first = batch.column(_PID)[0].as_py(), head
            elif head != last:
                single, reached = False, None
            if len(cut):
                single, reached = False, None
            end, has_end = _known(batch.column(end_col).slice(begin))
            if has_end.any():
                top = int(end[has_end].max())
                reached = top if reached is None else max(reached, top)
            last = tail
        if first is not None:
            columns = [pa.array([pid], pa.int32()), pa.array([single]), pa.array([reached], pa.int64())]
            for i, c in enumerate(same_cols):
                kind = batch.schema.field(c).type
                columns += [pa.array([first[i]], kind), pa.array([last[i]], kind)]
            names = [_PID, "single", "reached"] + [x for i in range(len(same_cols)) for x in (f"f{i}", f"l{i}")]
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def _local_cover(same_cols: Sequence[str], start_col: str, end_col: str, max_gap: int, carried: dict):
    """Running count of island openings, from the largest end so far in each segment; ``carried`` gives each
    partition the key and the largest end that it goes on from."""
    def run(batches):
        acc, last, reached, begun = 0, None, None, False
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            if not begun:
                last, reached = carried.get(batch.column(_PID)[0].as_py(), (None, None))
                begun = True
            (start, has_start), (end, has_end) = _known(batch.column(start_col)), _known(batch.column(end_col))
            same = _same_as_before(batch, same_cols)
            head, tail = ([batch.column(c)[i].as_py() for c in same_cols] for i in (0, n - 1))
            segment = np.concatenate([[0], np.cumsum(~same)])
            # running maximum per segment: ranks of the ends (0: none), lifted by the segment, never fall back
            values, rank = np.unique(end[has_end], return_inverse=True)
            level = np.zeros(n, np.int64)
            level[has_end] = rank + 1
            top = np.maximum.accumulate(level + segment * (len(values) + 1)) - segment * (len(values) + 1)
            before = np.concatenate([[0], top[:-1]])
            before[1:][~same] = 0
            far = np.concatenate([[0], values])[before]
            has = before > 0
            if last == head and reached is not None:  # the first segment goes on from what came before
                mine = segment == 0
                far = np.where(mine, np.where(has, np.maximum(far, reached), reached), far)
                has = has | mine
            opens = ~_near(start, has_start, far, has, max_gap)
            tops = top[-1]
            reached_now = int(values[tops - 1]) if tops else None
            if segment[-1] == 0 and last == head and reached is not None:
                reached_now = reached if reached_now is None else max(reached, reached_now)
            last, reached = tail, reached_now
            cs = np.cumsum(opens.astype(np.int64)) + acc
            acc = int(cs[-1])
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [pa.array(cs)], names=list(batch.schema.names) + [_LCUM])
    return run


def _covered_islands(df, order_cols, same_cols, start_col, end_col, max_gap, out, partitions) -> DataFrame:
    same_cols = list(same_cols)
    ranged = durable(_ranged(df, order_cols, partitions))
    kinds = [f"{x}{i} {ranged.schema[c].dataType.simpleString()}" for i, c in enumerate(same_cols) for x in ("f", "l")]
    ends = ranged.select(_PID, *same_cols, end_col).mapInArrow(
        _segment_ends(same_cols, end_col), ", ".join([f"{_PID} int", "single boolean", "reached long", *kinds])).collect()
    carried, last, reached = {}, None, None
    for r in sorted(ends, key=lambda r: r[_PID]):
        first = [r[f"f{i}"] for i in range(len(same_cols))]
        carried[r[_PID]] = (last, reached)
        onward = r["single"] and first == last  # the segment before this partition goes on after it
        reached = max((x for x in (r["reached"], reached if onward else None) if x is not None), default=None)
        last = [r[f"l{i}"] for i in range(len(same_cols))]
    schema = T.StructType(ranged.schema.fields + [T.StructField(_LCUM, T.LongType(), False)])
    local = ranged.mapInArrow(_local_cover(same_cols, start_col, end_col, int(max_gap), carried), schema)
    rows = local.groupBy(_PID).agg(F.max(_LCUM).alias("t")).collect()
    n_parts = max([ranged.rdd.getNumPartitions()] + [r[_PID] + 1 for r in rows])
    return local.withColumn(out, _offsets({r[_PID]: r["t"] for r in rows}, n_parts) + F.col(_LCUM)).drop(_PID, _LIDX, _LCUM)
