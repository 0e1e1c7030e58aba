"""Small corpora with the awkward cases every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, key long, n long, seq string, s string"
EMPTY = [None, "", "   \n\t ", "one", "x" * 5000, "a b c"]


def rows(texts, start=0):
    return [(start + i, t, "en", "src", None if t is None else len(t), "t", i, 7, "q", "z") for i, t in enumerate(texts)]


def frame(spark, texts, partitions=3, extra=()):
    """Documents with clashing further columns; ``extra`` are whole rows."""
    return spark.createDataFrame(rows(texts) + list(extra), SCHEMA).repartition(partitions)


def null_id(text):
    return (None, text, None, None, None, None, None, None, None, None)


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(words, seed, edits):
    r, out = random.Random(seed), list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10 ** 6)}"
    return out
