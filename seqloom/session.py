"""Session helpers: builder for local runs, checkpoint folder and durable cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "seqloom") -> SparkSession:
    """Local session used by tests and the bench (clusters bring their own)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SEQLOOM_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    Uses the cluster's ``spark.checkpoint.dir`` when the session has one; only when it
    is unset on a local master (tests) a folder is created under the system temp
    directory. On a cluster without one this raises: executors could not share it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="seqloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/seqloom-scratch/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder and cut its lineage.

    Used where two passes must see the same rows in the same partitions (range
    partitioning of shuffled input is not reproducible on recompute).
    """
    checkpoint_dir(df.sparkSession)
    # cached first, so writing the checkpoint files reads the cache instead of
    # recomputing the lineage a second time; the cache is dropped once the files exist
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def _columnar(kind) -> bool:
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        return len({f.name.lower() for f in kind}) == len(kind) and all(_columnar(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _columnar(kind.elementType)
    if isinstance(kind, T.MapType):
        return _columnar(kind.keyType) and _columnar(kind.valueType)
    return isinstance(kind, (T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once into the shared folder as compressed columns, and read back.

    Like ``durable`` (rows are computed once, the lineage is cut) for frames whose partitions and order nobody
    asks for again: nothing is cached beside it, later readers take only their columns, and the
    files are several times smaller than a checkpoint's. Types that Parquet lacks are checkpointed.
    """
    if not _columnar(df.schema):
        return durable(df)
    path = scratch_path(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Largest table (measured, in bytes) shipped whole to every task.
BROADCAST_MAX_BYTES = 64 << 20


def _approx_row_bytes(df: DataFrame):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + 8)
        elif isinstance(f.dataType, T.ArrayType):
            parts.append(F.coalesce(F.size(c), F.lit(0)) * 16 + 16)
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            parts.append(F.coalesce(F.length(F.to_json(c)), F.lit(0)) + 16)
        else:
            parts.append(F.lit(8))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def broadcast_cap() -> int:
    return BROADCAST_MAX_BYTES


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows of ``df`` (one job, nothing is kept)."""
    from pyspark.sql import functions as F

    return df.agg(F.sum(_approx_row_bytes(df)).alias("b")).first()["b"] or 0


# Small tables that broadcast hints were given for, cached until ``release``.
_HELD: list[DataFrame] = []


def release() -> None:
    """Drop the cached small tables. Frames built on them stay valid (they would be
    computed again); called before each registered query and after each micro-batch."""
    while _HELD:
        _HELD.pop().unpersist()


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None):
    """``(df, True)`` with a broadcast hint when the table measures at most ``max_bytes``,
    else ``(df, False)``. It is cached for the second read; a table that is too large is
    dropped from the cache at once, a small one by ``release``."""
    from pyspark.sql import functions as F

    df = df.persist()
    size = measured_bytes(df)
    if size <= (broadcast_cap() if max_bytes is None else max_bytes):
        _HELD.append(df)
        return F.broadcast(df), True
    df.unpersist()
    return df, False
