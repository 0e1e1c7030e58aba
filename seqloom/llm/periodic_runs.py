"""Runs of words that repeat with a period, found by seeds extended along diagonals.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal), of at least
``max(min_length, exponent * q)`` words, that no neighbouring word extends keeping that period. Such
a run overlaps itself, moved by ``q``, in at least that length less ``q`` words. Lags are taken in classes
``(lo, 2 lo]``; the smallest overlap a run of the class can have is the gram size ``k`` of the class.
All grams of ``k`` words are indexed per document, and occurrences of the same gram whose
distance lies in the class are the seeds. As ``k`` is at least the lag, an occurrence between the
two would give the run a smaller period; so neighbouring occurrences hold every run, and a gram
that occurs a million times costs a million pairs, not all pairs. A seed is extended to both
sides on its diagonal (fixed lag); a table of how far each lag is covered skips the
seeds of a stretch that is known already.

Grams are named exactly: names of 4-grams, then of twice as many words from pairs of
names, kept only where the name repeats inside its document. Work is about n log n in the words
of a document, also where one word or phrase fills it.

At scale: one narrow pass, no shuffle; texts are handled in slices of about ``SLICE_BYTES``. A document
is held as word numbers (8 bytes a word) beside its text.

Defined cases: null and empty texts have no words and no runs, their collapsed text is empty; rows are
independent, so null ids and repeated rows are kept as they are; columns other than id and text
are not read, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import sql_words, text_bytes

MIN_LENGTH = 6
EXPONENT = 4
SLICE_BYTES = 4 << 20
PIECE = 1 << 20


def lag_classes(longest: int, min_length: int = MIN_LENGTH, exponent: int = EXPONENT):
    """``(lo, hi, k)``: lags in ``(lo, hi]`` and the least overlap of a run with such a lag or a larger one."""
    lo, hi = 0, 1
    while exponent * (lo + 1) <= longest:
        turn = min_length // exponent  # up to here the least length is the same for all lags
        at = {lo + 1} | {q for q in (turn, turn + 1) if q > lo}
        yield lo, hi, min(max(min_length, exponent * q) - q for q in at)
        lo, hi = hi, 2 * hi


def _seeds(w, doc, longest, min_length, exponent):
    """``(k, positions, lags)`` for each class of lags; ``w`` holds word numbers, with a number of its own
    at the end of every document, ``doc`` the document of each position."""
    import numpy as np

    n = len(w)
    none = np.zeros(0, np.int64)

    def repeated(at, key):
        """Of ascending positions with keys: names, and which positions share theirs inside a document."""
        by = np.argsort(key, kind="stable")
        k, d = key[by], doc[at[by]]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        same = ~new[1:] & (d[1:] == d[:-1])
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        name, kept = np.empty(len(at), np.int64), np.empty(len(at), bool)
        name[by], kept[by] = np.cumsum(new) - 1, keep
        return name, kept

    def paired(at, name, gap):
        """Positions whose name has another ``gap`` words on, and the number of that pair of names."""
        to = np.searchsorted(at, at + gap)
        ok = to < len(at)
        ok[ok] = at[to[ok]] == at[ok] + gap
        return at[ok], name[ok] * (int(name.max()) + 1 if len(name) else 1) + name[to[ok]]

    # a hash thins out positions whose 4-gram cannot repeat; equal grams have equal hashes
    span = 4
    at = none
    if n >= span:
        mix = np.uint64(0x9E3779B97F4A7C15)
        u = w.astype(np.uint64)
        h = doc[:n - 3].astype(np.uint64)
        for j in range(span):
            h = (h ^ u[j:n - 3 + j]) * mix
            h ^= h >> np.uint64(29)
        s = np.sort(h)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
            at = np.flatnonzero(twice[place] == h)
    if len(at):
        size = int(w.max()) + 1
        _, front = np.unique(w[at] * size + w[at + 1], return_inverse=True)
        _, back = np.unique(w[at + 2] * size + w[at + 3], return_inverse=True)
        name, kept = repeated(at, front * (int(back.max()) + 1) + back)
        at, name = at[kept], name[kept]
    for lo, hi, k in lag_classes(longest, min_length, exponent):
        while len(at) and 2 * span <= k:
            at, key = paired(at, name, span)
            if not len(at):
                break
            name, kept = repeated(at, key)
            at, name, span = at[kept], name[kept], 2 * span
        if not len(at):
            return
        here, key = paired(at, name, k - span) if k > span else (at, name)
        if not len(here):
            continue
        by = np.argsort(key, kind="stable")
        p, same = here[by], key[by][1:] == key[by][:-1]
        lag = p[1:] - p[:-1]
        ok = same & (lag > lo) & (lag <= hi) & (doc[p[1:]] == doc[p[:-1]])
        p, lag = p[:-1][ok], lag[ok]
        order = np.lexsort((p, lag))
        yield k, p[order], lag[order]


def _agree(w, a: int, b: int, step: int) -> int:
    """How many positions from ``a`` and ``b`` on (``step`` 1) or before them (-1) agree."""
    import numpy as np

    n, width = 0, 64
    while True:
        if step > 0:
            x, y = w[a + n:a + n + width], w[b + n:b + n + width]
            x = x[:len(y)]
        else:
            x, y = w[max(a - n - width, 0):max(a - n, 0)][::-1], w[max(b - n - width, 0):b - n][::-1]
            y = y[:len(x)]
        differ = np.flatnonzero(x != y)
        if len(differ):
            return n + int(differ[0])
        if len(x) < width:
            return n + len(x)
        n, width = n + width, min(2 * width, 1 << 16)


def find_runs(words: list, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of every run of each document, sorted by start and period. ``words`` are
    arrays of word numbers from one numbering."""
    import numpy as np

    if exponent < 3 or min_length < 6:
        raise ValueError("an exponent of three and a length of six at least")
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    longest = max((len(x) for x in words), default=0)
    if longest < min_length:
        return out
    top = max(int(x.max()) for x in words if len(x)) + 1
    w = np.concatenate([part for i, x in enumerate(words) for part in (x, [top + i])]).astype(np.int64)
    sizes = np.array([len(x) + 1 for x in words])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(words)), sizes)
    for k, at, lags in _seeds(w, doc, longest, min_length, exponent):
        covered: dict[int, int] = {}
        # neighbouring seeds of one lag lie in one stretch: only the first of them is extended
        heads = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (lags[1:] != lags[:-1])]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(heads)
        last = np.append(first[1:], len(at)) - 1 if len(first) else first
        for i, j, q in zip(at[first].tolist(), at[last].tolist(), lags[first].tolist()):
            if i < covered.get(q, 0):
                continue
            begin = i - _agree(w, i, i + q, -1)
            end = j + k + _agree(w, j + k, j + k + q, 1)
            covered[q] = end
            length = end - begin + q
            if length >= max(min_length, exponent * q):
                d = int(doc[begin])
                out[d].append((begin - int(starts[d]), length, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _numbered(text: bytes, number: dict):
    """The word numbers of a text, taken piece by piece so that only different words are kept."""
    import re

    import numpy as np

    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = re.compile(rb"[\x20\x09-\x0d]").search(text, end)
            end = gap.start() if gap else len(text)
        words = text[at:end].split()
        for x in set(words).difference(number):
            number[x] = len(number)
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _detect(min_length: int, exponent: int, slice_bytes: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def slices(batch):
        import pyarrow.compute as pc

        sizes, at, held = pc.binary_length(batch.column("text")).to_pylist(), 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > slice_bytes:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        if at < batch.num_rows:
            yield batch.slice(at)

    def run(batches):
        import numpy as np

        for batch in batches:
            for part in slices(batch):
                number: dict[bytes, int] = {}
                words = [_numbered(t, number) for t in part.column("text").to_pylist()]
                spelt = list(number)
                found = find_runs(words, min_length, exponent)
                collapsed = []
                for x, runs in zip(words, found):
                    if runs:
                        change = np.zeros(len(x) + 1, np.int64)
                        for start, length, period in runs:
                            change[start + period] += 1
                            change[start + length] -= 1
                        x = x[np.cumsum(change[:-1]) == 0]
                    collapsed.append(b" ".join(map(spelt.__getitem__, x.tolist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x) for x in words], pa.int64()),
                     pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found], kind),
                     pa.array(collapsed, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  exponent: int = EXPONENT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per row the id, ``n_words``, ``runs`` (structs ``start, length, period``, sorted) and ``collapsed``: the
    words joined by a space, without those a run holds after its first period."""
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    schema = (f"id {dict(rows.dtypes)['id']}, n_words long, "
              "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return rows.mapInArrow(_detect(min_length, exponent, slice_bytes), schema).withColumnRenamed("id", id_col)


def planted(text: Column, doc_id: Column) -> Column:
    """The text in which one document in ten, chosen by the id's hash, goes on periodically from some word:
    the known runs that the query is held against."""
    h = F.coalesce(F.crc32(doc_id.cast("string")), F.lit(1))
    g = F.floor(h / 10)

    def go_on(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.get(
            words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    # a lambda holds the words, so that they are not split anew for every element
    longer = F.get(F.transform(F.array(sql_words(F.coalesce(text, F.lit("")))), lambda ws: F.when(F.size(ws) > 0, go_on(ws)).otherwise(F.lit(""))), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, longer).otherwise(text)


def runs_digest(docs: DataFrame) -> DataFrame:
    """``periodic_runs`` of the planted texts, with its longest run and digests of its results."""
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.l") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
