"""Portable hashing: md5 prefixes give the same integers in Spark and in other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed, *parts) -> Column:
    cols = [F.lit(str(seed))] + [p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts]
    return F.concat_ws(":", *cols)


def hash_int(seed, *parts, hex_digits: int = 15) -> Column:
    """Non-negative BIGINT from the first ``hex_digits`` hex digits of md5(seed:part1:part2..)."""
    return F.conv(F.substring(F.md5(_key(seed, *parts)), 1, hex_digits), 16, 10).cast("bigint")


def hash_unit(seed, *parts) -> Column:
    """Uniform double in [0, 1) from the first 8 hex digits of md5, divided by 2^32."""
    return hash_int(seed, *parts, hex_digits=8).cast("double") / F.lit(4294967296.0)
