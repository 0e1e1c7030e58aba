"""Helpers shared by the operators: tables, scratch tables, checked broadcasts, words.

A *word* is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``; ``bytes.split()``
cuts exactly there. Text columns reach Python as UTF-8 bytes (``cast('binary')``), so no
character decoding happens unless an operator needs code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import measured_bytes, scratch_path

# A table is shipped whole to every task only when it measures at most this many bytes.
BROADCAST_BYTES = 32 << 20

ROW_GROUP_BYTES = 16 << 20

# fixed value: the white space of the word rule
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared scratch folder and read it back: a cut in the
    lineage that outlives any executor. Row groups are small, as a task holds one in memory."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows of ``row_bytes`` stay under
    ``limit``, else ``df`` as it is (Spark then shuffles). ``df`` should be stored."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def measured_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Like ``maybe_broadcast`` for rows of varying size: their bytes are summed."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null reads as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def sql_words(text: Column) -> Column:
    """The words of a text as a string array, JVM side."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores after it while the table has such a column (case does not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def once_per_worker(key, build):
    """``build()``, kept for the later tasks of the same Python worker. Functions travel to
    tasks by value, so the store hangs on a module of the interpreter."""
    import sys
    import types

    store = sys.modules.setdefault("_seqloom_worker", types.ModuleType("_seqloom_worker")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def tidied(run, keep: bool = False):
    """``run`` for a task, with what earlier stages left in its Python worker given back before it and what
    it leaves after it: kept models (unless ``keep``), freed but unreturned memory. Workers are reused from
    stage to stage, and idle ones count against their executor's memory."""
    def tidy():
        import ctypes
        import gc
        import sys

        import pyarrow

        if not keep:
            sys.modules.pop("_seqloom_worker", None)
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not every C library has it
            pass

    def inner(batches):
        tidy()
        try:
            yield from run(batches)
        finally:
            tidy()

    return inner


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled document ids of either class, in hash order:
    ``(doc_id, y, u)`` with ``u`` the rank hash. Rows with a null id or label take no part;
    an id with several labels counts once, with the largest."""
    ids = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
           .groupBy("doc_id").agg(F.max(label).alias("y"))
           .withColumn("u", F.xxhash64(F.lit("sample"), "doc_id")))
    one = ids.where("y = 1").orderBy("u", "doc_id").limit(per_class)
    return one.unionByName(ids.where("y = 0").orderBy("u", "doc_id").limit(per_class))


def fit_logistic(x, y, l2: float = 1e-3, steps: int = 50):
    """Weights (bias last) of a ridge logistic regression by Newton steps; balanced prior
    is left to the data. With one class only, the bias alone answers its frequency."""
    import numpy as np

    x = np.hstack([np.asarray(x, float), np.ones((len(x), 1))])
    y = np.asarray(y, float)
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    reg = np.full(x.shape[1], l2 * len(y))
    reg[-1] = 1e-6 * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + reg * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg + 1e-9)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w
