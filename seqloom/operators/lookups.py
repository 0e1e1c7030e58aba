"""Left joins whose key may be very frequent on the left: token and id lookups.

A token that makes a third of a corpus is one join key: a shuffled join would send a third of
all rows to one task. The most frequent keys are found by Spark's mergeable frequent-items sketch
(``approx_top_k``: a bounded summary a task, summaries merged), their few table rows are broadcast,
and only the other keys meet the table by shuffle. The rows stay one stream (they are not read
twice, so row ids made before hold): a row that was answered by the broadcast goes through the
shuffled join under a null key that matches nothing, dealt by a hash of the row itself.

What the sketch finds decides the plan only; the result is that of a plain left join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FREQUENT = 1000  # keys answered by broadcast, the most the sketch returns
TRACKED = 1 << 15  # keys a summary follows: a key above 1 in 20,000 or so cannot escape it
KEY_CHARS = 1024  # longer keys are never broadcast, so the broadcast table is bounded


def frequent_keys(rows: DataFrame, on: str, k: int = FREQUENT) -> list:
    """At most ``k`` of the most frequent values of ``on``: a bounded list, whatever the rows."""
    seen = rows.select(F.col(on).alias("v")).where("v IS NOT NULL")
    if isinstance(rows.schema[on].dataType, T.StringType):
        seen = seen.where(F.length("v") <= KEY_CHARS)
    found = seen.agg(F.expr(f"approx_top_k(v, {k}, {TRACKED})").alias("top")).first()["top"]
    return [x["item"] for x in found or []]


def spread_keys(rows: DataFrame, answered: DataFrame, on: str) -> DataFrame:
    """``rows`` with the columns of ``answered`` (few rows, one a key, ``_hot`` true) and the two columns
    to deal by: the key and its hash, or for answered and null keys null and a hash of the row."""
    near = rows.join(F.broadcast(answered), on, "left")
    far = F.col("_hot").isNull() & F.col(on).isNotNull()
    return near.withColumn("_t", F.when(far, F.col(on))).withColumn(
        "_s", F.when(far, F.xxhash64(on)).otherwise(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])))


def spread_lookup(rows: DataFrame, table: DataFrame, on: str, value: str, k: int = FREQUENT) -> DataFrame:
    """``rows`` with ``value`` of ``table`` (one row a key, no null key), null where the key is missing:
    the rows of ``rows.join(table, on, "left")``. The names ``_hot``, ``_near``, ``_t``, ``_s`` and ``_k`` are taken."""
    spark = rows.sparkSession
    key = T.StructField(on, rows.schema[on].dataType)
    hot = spark.createDataFrame([(x,) for x in frequent_keys(rows, on, k)], T.StructType([key]))
    known = {r[0]: r[1] for r in table.select(on, value).join(F.broadcast(hot), on, "left_semi").collect()}  # at most k rows
    answers = [(r[0], known.get(r[0]), True) for r in hot.collect()]
    answered = spark.createDataFrame(answers, T.StructType(
        [key, T.StructField("_near", table.schema[value].dataType), T.StructField("_hot", T.BooleanType())]))
    side = table.select(F.col(on).alias("_k"), F.xxhash64(on).alias("_s"), F.col(value))
    dealt = spread_keys(rows, answered, on)
    joined = dealt.alias("d").join(side.alias("t"), (F.col("d._t") == F.col("t._k")) & (F.col("d._s") == F.col("t._s")), "left")
    return joined.select(*[F.col(f"d.`{c}`") for c in rows.columns],
                         F.when(F.col("d._hot"), F.col("d._near")).otherwise(F.col(f"t.`{value}`")).alias(value))
