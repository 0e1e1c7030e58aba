"""Quality rules: base counts of every document and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into two times 65,536 buckets. Two smoothed
multinomials over the buckets, one counted over the trusted target documents and one over
the whole raw corpus (both smoothed towards uniform by the same share, so that grams a small
target has not met weigh little), give each bucket the weight ``ln(p_target / p_raw)``, kept as whole
millionths so that sums are exact in any order. A document's ratio is the sum over its
n-grams divided by their number; the document is kept when the ratio reaches
``THRESHOLD_MICRO`` (and the base rules pass).

Every document is counted and scored; nothing is sampled. Counting is one pass that emits at
most 131,072 rows a task, scoring a second pass with the weights (1 MB, fixed) in the task.

Defined cases: null text counts as empty (no word: base failed); no trusted document (or an
empty corpus) makes all weights zero, so the base rules alone decide; null ``doc_id`` is
scored and never trusted; repeated ids are scored row by row; other columns are passed by.
"""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import maybe_broadcast, stored, text_bytes, tidied

BUCKETS = 1 << 16
ALPHA = 10.0  # added to every target bucket; raw buckets get the same share of their total
THRESHOLD_MICRO = -150_000  # mean log ratio of an n-gram, in millionths
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

SCORES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_grams long, llr_micro long")


class WordHashes(dict):
    """Word -> first 8 bytes of its md5; emptied when it holds ``limit`` words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        from hashlib import md5

        if len(self) >= self.limit:
            self.clear()
        self[word] = h = int.from_bytes(md5(word, usedforsecurity=False).digest()[:8], "big")
        return h


def word_hashes(words: list[bytes], cache: WordHashes):
    import numpy as np

    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def gram_buckets(h):
    """Bucket of every unigram, then of every bigram (second half of the bucket space)."""
    import numpy as np

    u = (h >> np.uint64(48)).astype(np.int64)
    return np.concatenate([u, BUCKETS + ((u[:-1] * 31 + u[1:] + 7) & (BUCKETS - 1))])


def repeat_words(words: list[bytes], h, window: int = WINDOW) -> int:
    """Words inside ``window``-word windows whose sequence occurs twice or more."""
    import numpy as np

    n = len(words) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
        key ^= key >> np.uint64(31)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    if not len(at):
        return 0
    seen: dict[tuple, int] = {}
    for i in at.tolist():  # the words themselves decide
        w = tuple(words[i:i + window])
        seen[w] = seen.get(w, 0) + 1
    edges = np.zeros(len(words) + 1, np.int64)
    for i in at.tolist():
        if seen[tuple(words[i:i + window])] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def gram_counts(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """``(bucket, raw, target)`` over the whole corpus; ``trusted_ids`` has one ``doc_id``
    column. Rows of either side may repeat; a document is trusted or not."""
    ids = stored(trusted_ids.select("doc_id").where("doc_id is not null").distinct(), "trusted")
    marked = docs.select("doc_id", text_bytes().alias("t")).join(
        maybe_broadcast(ids.withColumn("trusted", F.lit(True)), 16), "doc_id", "left"
    ).select("t", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def count(batches):
        import numpy as np

        cache = WordHashes()
        raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
        held: list[list] = [[], []]  # buckets not yet counted, of other and of trusted documents
        size = 0

        def flush():
            for good in (0, 1):
                if held[good]:
                    c = np.bincount(np.concatenate(held[good]), minlength=2 * BUCKETS)
                    raw[:] += c
                    if good:
                        target[:] += c
                    held[good] = []

        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split()
                if words:
                    held[good].append(gram_buckets(word_hashes(words, cache)))
                    size += len(words)
                    if size > 1 << 20:
                        flush()
                        size = 0
        flush()
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])],
                                         ["bucket", "raw", "target"])

    return (marked.mapInArrow(tidied(count), "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def gram_weights(counts: DataFrame, alpha: float = ALPHA):
    """Whole-millionth log ratios of all buckets: a fixed 131,072 numbers on the driver."""
    import numpy as np

    raw, target = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(2 * BUCKETS, np.int64)
    beta = alpha * raw.sum() / target.sum()
    ratio = np.log((target + alpha) / (target.sum() + alpha * 2 * BUCKETS)) \
        - np.log((raw + beta) / (raw.sum() + beta * 2 * BUCKETS))
    return np.round(ratio * 1e6).astype(np.int64)


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, threshold_micro: int = THRESHOLD_MICRO) -> DataFrame:
    """Per document the base counts, ``n_grams``, ``llr_micro`` (sum over n-grams),
    ``base_failed`` and ``kept``."""
    weights = gram_weights(gram_counts(docs, trusted_ids))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _scores(weights)(text_bytes()).alias("s"))
    out = scored.select("doc_id", "s.*")
    failed = base_failed(F.col)
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("llr_micro") >= threshold_micro * F.col("n_grams")))


def keep_good(docs: DataFrame, trusted_ids: DataFrame, threshold_micro: int = THRESHOLD_MICRO) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the rules and the ratio keep."""
    weights = gram_weights(gram_counts(docs, trusted_ids))
    at = docs.columns.index("text")
    names = [x.split()[0] for x in SCORES.split(", ")]

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            texts, keep = batch.column(at).cast(pa.binary()), []
            for i in range(0, batch.num_rows, 256):
                for t in texts.slice(i, 256).to_pylist():
                    r = dict(zip(names, score_text(t or b"", weights, cache)))
                    keep.append(not base_failed(r.__getitem__) and r["llr_micro"] >= threshold_micro * r["n_grams"])
            if any(keep):
                yield batch if all(keep) else batch.filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)


def base_failed(col):
    return (col("n_words") < MIN_WORDS) | (100 * col("n_repeat_words") > MAX_REPEAT_PERCENT * col("n_words"))


def score_text(text: bytes, weights, cache: WordHashes) -> tuple[int, ...]:
    """The columns of ``SCORES`` for one text."""
    words = text.split()
    h = word_hashes(words, cache)
    lines = [x for x in text.split(b"\n") if x.strip()]
    grams = gram_buckets(h) if words else []
    return (len(words), len(b"".join(words).decode("utf-8", "replace")),
            len(text) - len(text.translate(None, b"#*$%&|<>")),
            len(lines) - len(set(lines)), repeat_words(words, h), len(grams),
            int(weights[grams].sum()) if words else 0)


def _scores(weights):
    names = [x.split()[0] for x in SCORES.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ': ') for x in SCORES.split(', '))}>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for batch in texts:
            yield pd.DataFrame([score_text(t, weights, cache) for t in batch], columns=names)

    return score


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose every quality label is 1: the trusted target documents."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("q")).where("q = 1").select("doc_id")


# the same definition in DuckDB, shared by the registered query and the pipeline's first stage
WORDS_SQL = r"""
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '),
                     lambda x: x <> '') AS w
  FROM documents"""

SCORES_SQL = f"""
words AS ({WORDS_SQL}),
vocabulary AS (SELECT w, ('0x' || substr(md5(w), 1, 4))::BIGINT AS h FROM (SELECT DISTINCT unnest(w) AS w FROM words)),
tokens AS (SELECT doc_id, i, h FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words)
           JOIN vocabulary USING (w)),
grams AS (SELECT doc_id, h AS bucket FROM tokens
          UNION ALL
          SELECT a.doc_id, {BUCKETS} + ((a.h * 31 + b.h + 7) & {BUCKETS - 1}) FROM tokens a
          JOIN tokens b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
trusted AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
counts AS (SELECT bucket, count(*) AS raw, count(t.doc_id) AS target FROM grams g LEFT JOIN trusted t USING (doc_id) GROUP BY bucket),
totals AS (SELECT sum(raw)::DOUBLE AS r, sum(target)::DOUBLE AS t FROM counts),
weights AS (SELECT bucket, CASE WHEN t = 0 THEN 0 ELSE round((ln((target + {ALPHA}::DOUBLE) / (t + {ALPHA * 2 * BUCKETS}::DOUBLE))
                   - ln((raw + {ALPHA}::DOUBLE * r / t) / (r + {ALPHA}::DOUBLE * r / t * {2 * BUCKETS}))) * 1e6) END::BIGINT AS w FROM counts, totals),
ratios AS (SELECT doc_id, count(*) AS n_grams, sum(w)::BIGINT AS llr_micro FROM grams JOIN weights USING (bucket) GROUP BY doc_id),
windows AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS seq
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW})),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM
             (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, seq HAVING count(*) > 1),
             (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)),
                     lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS lines
  FROM words),
scored AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(r.n_grams, 0)::BIGINT AS n_grams,
         coalesce(r.llr_micro, 0)::BIGINT AS llr_micro
  FROM base b LEFT JOIN ratios r USING (doc_id) LEFT JOIN repeated p USING (doc_id)),
judged AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM scored),
verdicts AS (SELECT *, NOT base_failed AND llr_micro >= {THRESHOLD_MICRO} * n_grams AS kept FROM judged)"""

ORACLE_SQL = f"WITH {SCORES_SQL.strip()} SELECT * FROM verdicts"
