"""Quality by compression: one zstandard dictionary built from good labelled texts, one from
bad ones. A text is cut into 2 KB blocks (so that a dictionary helps throughout), every block
is compressed with both. The difference of the two total sizes per text byte, together with
the size under the good dictionary per text byte (which tells looping text), is mapped to a
probability by a logistic curve.

Dictionaries and curve are fitted on the driver from at most ``PER_CLASS`` labelled rows and
``SAMPLE_BYTES`` of text of either class (documented bounds); half of the rows build the
dictionaries, the other half the curve. A text gives the fit at most one part in ``PARTS`` of
those bytes (its beginning), so no long text can end or empty the sample of its class. Every text of the table is scored whole, in tasks,
with the two dictionaries (``DICT_BYTES`` each) in the closure. Labels, language, source and
id are never inputs of a score.

Defined cases: null and empty texts have both numbers 0 and get the curve's value there; with
fewer than two classes in the labels every text scores the label frequency (0.5 without
labels); null labels and ids take no part in learning; an id with several labels counts once;
rows repeat and tie freely; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import fit_logistic, labelled_sample, stored, text_bytes

PER_CLASS = 4_000
SAMPLE_BYTES = 6 << 20
PARTS = 64
DICT_BYTES = 96 << 10
BLOCK = 2048
LEVEL = 3
SHORT = 64  # bytes added to the length that normalises, for the frame of very short texts


def blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


class Compressors:
    """Compresses with both dictionaries; a positive difference favours the good one."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        self._pair = [z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d), write_content_size=False,
                                       write_dict_id=False) for d in (good, bad)]

    def features(self, text: bytes) -> tuple[float, float]:
        """Percent size difference, and tenths of the text that stay under the good one."""
        if not text:
            return 0.0, 0.0
        good, bad = (sum(len(c.compress(b)) for b in blocks(text)) for c in self._pair)
        return 100 * (bad - good) / (len(text) + SHORT), 10 * good / len(text)


def train_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts' blocks; raw text stands in when there is too little."""
    import zstandard as z

    samples = [b for t in texts for b in blocks(t) if len(b) >= 8]
    try:
        return z.train_dictionary(DICT_BYTES, samples).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[:DICT_BYTES] or b"\n" * 8


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS,
                sample_bytes: int = SAMPLE_BYTES):
    """``(good dictionary, bad dictionary, [two slopes, intercept])``."""
    ids = stored(labelled_sample(labels, "quality", learn, per_class), "quality-ids")
    most = max(1, sample_bytes // PARTS)
    rows = docs.select("doc_id", F.substring(text_bytes(), 1, most).alias("t")).where(F.length("t") > 0).join(F.broadcast(ids), "doc_id")
    # at most 2 * per_class rows enter the window; it bounds the bytes that reach the driver
    size = F.sum(F.length("t")).over(W.partitionBy("y").orderBy("u", "doc_id", "t")
                                     .rowsBetween(W.unboundedPreceding, 0))
    sample = rows.withColumn("size", size).where(F.col("size") <= sample_bytes).select("y", "u", "t").collect()
    sample.sort(key=lambda r: (r["y"], r["u"], bytes(r["t"])))
    if len({r["y"] for r in sample}) < 2:
        share = sum(r["y"] for r in sample) / len(sample) if sample else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        import math
        return b"\n" * 8, b"\n" * 8, [0.0, 0.0, math.log(share / (1 - share))]
    halves = {(y, h): [bytes(r["t"]) for r in sample if r["y"] == y][h::2] for y in (0, 1) for h in (0, 1)}
    good, bad = (train_dictionary(halves[y, 0]) for y in (1, 0))
    pair = Compressors(good, bad)
    x, target = [], []
    for y in (0, 1):
        held = halves[y, 1] or halves[y, 0]
        x += [pair.features(t) for t in held]
        target += [y] * len(held)
    return good, bad, fit_logistic(x, target).tolist()


def score_quality(docs: DataFrame, model) -> DataFrame:
    """``(doc_id, size_difference, good_size, score)`` of every text; ``model`` from
    ``fit_quality``."""
    good, bad, (slope, ratio_slope, intercept) = model

    def run(batches):
        pair = Compressors(good, bad)
        for batch in batches:
            f = [pair.features(t) for t in batch.column(1).to_pylist()]
            diff, size = (list(c) for c in zip(*f)) if f else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(diff, pa.float64()), pa.array(size, pa.float64())],
                                             ["doc_id", "size_difference", "good_size"])

    f = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).mapInArrow(
        run, "doc_id long, size_difference double, good_size double")
    z = F.col("size_difference") * slope + F.col("good_size") * ratio_slope + intercept
    return f.withColumn("score", 1 / (1 + F.exp(-z)))
