"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document. A word goes when a window that covers
it has a word sequence that also starts in a document with a smaller ``doc_id``.

1. *Copies.* Documents with equal word sequences form a class; all but the one with the
   smallest id go whole (if they hold a window) and need no further search.
2. *Anchors.* Of every ``WINDOW - GRAM + 1`` neighbouring ``GRAM``-word grams the one with the
   smallest hash is an anchor. Equal windows hold the same anchor, so only anchors that two
   documents share (found by one narrow aggregation) can lie in a recurring window.
3. *Confirmed passages.* The windows around shared anchors are hashed and aggregated to the
   smallest document that holds them, their owner; windows that a later document also holds are
   confirmed. Runs of an owner's confirmed windows are its recurring passages.
4. *Automata.* Passages are dealt to shards by owner and place (long ones in pieces). Each shard
   compiles the passages' aligned ``GRAM``-word blocks into Aho-Corasick automata over words (each
   distinct word is one letter; a shard with more words than letters takes several automata in turn) and
   streams the stretches of all documents that share an anchor with the shard. Around
   every hit the document's windows are looked up, word for word, among the passages' windows.
   Any window inside a passage holds an aligned block, so no occurrence is missed; each window
   of a text is looked up once, so text that repeats itself stays linear.

Every step is an aggregation or an equi-join of narrow rows; of the texts only the stretches around
shared anchors (every window that holds one) move to the automata. Shards with many words to stream are
dealt to several tasks (the automata are built in each), so a passage that a third of all documents share
is no single task.

Defined cases: null and empty texts have no words; texts under a window are kept; rows with a
null id are kept whole and count as no source; rows that repeat an id are judged by their own
words and never against each other; other columns are passed by; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import BROADCAST_BYTES, free_name, maybe_broadcast, measured_broadcast, stored, text_bytes, tidied

WINDOW = 50
GRAM = 25
SHARD_WORDS = 200_000
TASK_WORDS = 2_000_000
PIECE_WORDS = 50_000       # of a passage in one shard
AUTOMATON_WORDS = 800_000  # of the passages in one automaton


def word_hashes(words: list[bytes]):
    import numpy as np
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h, length: int):
    """Hash of every ``length``-word gram from the word hashes, by doubling."""
    import numpy as np

    n = len(h) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    power, size, out, done = h, 1, None, 0
    while True:
        if length & size:
            # append the block of ``size`` words that starts after the ``done`` words so far
            step = np.uint64(pow(base, size, 1 << 64))
            block = power[done:done + n]
            out = block.copy() if out is None else out * step + block
            done += size
        if done == length:
            break
        m = len(power) - size
        power = power[:m] * np.uint64(pow(base, size, 1 << 64)) + power[size:size + m]
        size *= 2
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    return out


def anchor_hashes(h, window: int = WINDOW, gram: int = GRAM):
    """Distinct anchors of a document with word hashes ``h``."""
    import numpy as np

    g = gram_hashes(h, gram)
    span = window - gram + 1
    if len(g) < span:
        return np.zeros(0, np.uint64)
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(g) - span + 1)
    return np.unique(g[np.unique(at)])


def _sequence(words: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def profiles(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, seq, sha, anchors)`` per row; ``seq`` identifies the word sequence."""

    def run(batches):
        from hashlib import sha256

        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, seq, sha, anchors = [], [], [], []
                for t in part.column(1).to_pylist():
                    words = t.split()
                    n.append(len(words))
                    seq.append(_sequence(words))
                    sha.append(sha256(b" ".join(words)).hexdigest())
                    anchors.append(anchor_hashes(word_hashes(words)).view(np.int64) if len(words) >= WINDOW else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(seq, pa.binary()), pa.array(sha),
                     pa.array(anchors, pa.list_(pa.int64()))], ["doc_id", "n_words", "seq", "sha", "anchors"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).mapInArrow(
        tidied(run), "doc_id long, n_words long, seq binary, sha string, anchors array<long>")


def _stretches(batches):
    """Of each row ``(doc_id, seq, text, anchors)`` the stretches of words whose windows hold one of the
    anchors, with the place of their first word and the anchors in them. A text that is a stretch
    itself comes with its own place and the shard it is cut for."""
    import numpy as np

    for batch in batches:
        cut = batch.num_columns > 4
        for at in range(0, batch.num_rows, 256):
            rows = []
            part = batch.slice(at, 256)
            for doc_id, seq, t, xs, *more in zip(*(c.to_pylist() for c in part.columns)):
                words = t.split()
                g = gram_hashes(word_hashes(words), GRAM).view(np.int64)
                places = np.flatnonzero(np.isin(g, np.asarray(xs, np.int64)))
                base, shard = more if cut else (0, None)
                for a, b in merged([(max(p - (WINDOW - GRAM), 0), min(p + WINDOW, len(words))) for p in places.tolist()]):
                    held = places[np.searchsorted(places, a):np.searchsorted(places, b - GRAM, "right")]
                    rows.append((doc_id, seq, base + a, b" ".join(words[a:b]), b - a, np.unique(g[held]), shard))
            cols = list(zip(*rows)) if rows else [()] * 7
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()),
                      pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.int64())]
            names = ["doc_id", "seq", "start", "part", "n_words", "xs", "shard"]
            yield pa.RecordBatch.from_arrays(arrays if cut else arrays[:6], names if cut else names[:6])


def _windows(batches):
    """Hashes of the different windows of every stretch."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            ids, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc_id, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = np.unique(gram_hashes(word_hashes(t.split()), WINDOW))
                hashes.append(found.view(np.int64))
                ids.append(np.full(len(found), doc_id, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(ids))],
                                             ["w", "doc_id"])


def _passages(shards: int):
    """Runs of an owner's confirmed windows, cut into pieces of at most ``PIECE_WORDS`` words (a window
    lies whole in one of them), each dealt to a shard of its own."""
    def run(batches):
        import numpy as np
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            rows = []
            for owner, t, owned in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = t.split()
                h = word_hashes(words)
                mine = np.isin(gram_hashes(h, WINDOW).view(np.int64), np.asarray(owned, np.int64))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    for a in range(first, last, PIECE_WORDS - WINDOW + 1):
                        b = min(last, a + PIECE_WORDS - WINDOW + 1) + WINDOW - 1  # the end of the last window's words
                        piece = a // PIECE_WORDS
                        rows.append((xxh3_64_intdigest(f"{owner} {piece}".encode()) % shards, owner, b" ".join(words[a:b]), b - a,
                                     anchor_hashes(h[a:b]).view(np.int64)))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.int64()))],
                ["shard", "owner", "passage", "n_words", "anchors"])

    return run


class PhraseAutomaton:
    """Aho-Corasick automaton over words for one shard's passages ``(owner, words)``."""

    def __init__(self, passages: list[tuple[int, list[bytes]]]):
        import ahocorasick

        letters: dict[bytes, str] = {}

        def letter(word: bytes) -> str:
            c = letters.get(word)
            if c is None:
                code = len(letters) + 1
                c = letters[word] = chr(code if code < 0xD800 else code + 0x800)
            return c

        self.letters = letters
        blocks: set[str] = set()
        # every window of the passages, as a string of letters, with its smallest owner
        self.windows: dict[str, int] = {}
        for owner, ws in passages:
            text = "".join(map(letter, ws))
            blocks.update(text[at:at + GRAM] for at in range(0, len(text) - GRAM + 1, GRAM))
            for at in range(len(text) - WINDOW + 1):
                w = text[at:at + WINDOW]
                self.windows[w] = min(owner, self.windows.get(w, owner))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for block in blocks:
            self.automaton.add_word(block)
        if blocks:
            self.automaton.make_automaton()
        self.empty = not blocks

    def spans(self, doc_id: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Stretches whose windows a smaller document owns. The automaton finds the places; the
        windows around each place are looked up whole, so every word is compared."""
        if self.empty or len(words) < WINDOW:
            return []
        get = self.letters.get
        text = "".join([get(w, "\0") for w in words])
        last, owner = len(text) - WINDOW, self.windows.get
        out, nxt = [], 0  # windows before ``nxt`` are done
        for end, _ in self.automaton.iter(text):
            start = end - GRAM + 1
            for s in range(max(nxt, start - (WINDOW - GRAM)), min(start, last) + 1):
                if owner(text[s:s + WINDOW], doc_id) < doc_id:
                    out.append((s, s + WINDOW))
            nxt = max(nxt, min(start, last) + 1)
        return merged(out)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(passages: list[tuple[int, bytes]], words: int):
    """Automata that hold at most ``words`` words of passages each, one after the other: letters are
    code points, of which there are about 1.1 million."""
    held, size = [], 0
    for owner, passage in passages:
        ws = passage.split()
        if held and size + len(ws) > words:
            yield PhraseAutomaton(held)
            held, size = [], 0
        held.append((owner, ws))
        size += len(ws)
    if held:
        yield PhraseAutomaton(held)


def _locate(passages: pa.Table, docs: pa.Table) -> pa.Table:
    ids, seqs, starts, ends = [], [], [], []
    if passages.num_rows and docs.num_rows:
        pairs = zip(passages.column("owner").to_pylist(), passages.column("passage").to_pylist())
        for automaton in automata(list(pairs), AUTOMATON_WORDS):
            for doc_id, seq, start, t in zip(*(docs.column(c) for c in ("doc_id", "seq", "start", "part"))):
                doc_id = doc_id.as_py()
                for a, b in automaton.spans(doc_id, t.as_py().split()):
                    ids.append(doc_id)
                    seqs.append(seq.as_py())
                    starts.append(start.as_py() + a)
                    ends.append(start.as_py() + b)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "seq": pa.array(seqs, pa.binary()),
                     "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64())})


class Repeats:
    """What one search finds: ``profile`` (every row), ``copies`` (rows that go whole),
    ``candidates`` (texts that share an anchor) and ``spans`` (stretches that go)."""

    def __init__(self, docs: DataFrame):
        self.profile = stored(profiles(docs), "profiles")
        long = self.profile.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
        firsts = long.groupBy("seq").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        firsts = stored(firsts.where("first < last").select("seq", "first"), "first-copies")
        self.copies = stored(long.select("doc_id", "seq", "n_words").join(maybe_broadcast(firsts, 40), "seq")
                             .where("doc_id > first").select("doc_id", "seq", "n_words").distinct(), "copies")

        rest = long.join(maybe_broadcast(self.copies, 40), ["doc_id", "seq"], "left_anti")
        anchors = rest.select("doc_id", "seq", F.explode("anchors").alias("x"))
        shared = anchors.groupBy("x").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        shared = stored(shared.where("a < b").select("x"), "shared-anchors")
        marks = stored(anchors.join(maybe_broadcast(shared, 16), "x", "left_semi"), "marks")
        # a row that repeats marks its anchors twice
        per_doc = stored(marks.groupBy("doc_id", "seq").agg(F.collect_set("x").alias("xs")), "marked-rows")
        ids = stored(marks.select("doc_id").distinct(), "marked-documents")
        texts = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).join(
            maybe_broadcast(ids, 16), "doc_id", "left_semi")
        with_seq = texts.mapInArrow(tidied(_add_sequence), "doc_id long, t binary, seq binary")
        self.candidates = stored(with_seq.join(measured_broadcast(per_doc), ["doc_id", "seq"]).select("doc_id", "t", "xs", "seq"), "candidates")

        stretches = stored(self.candidates.select("doc_id", "seq", "t", "xs").mapInArrow(
            tidied(_stretches), "doc_id long, seq binary, start long, part binary, n_words long, xs array<long>"), "stretches")

        owners = stretches.select("doc_id", "part").mapInArrow(tidied(_windows), "w long, doc_id long").groupBy("w").agg(
            F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("w", "owner")
        owners = stored(owners, "owned-windows")
        shards = max(1, -(-owners.count() // SHARD_WORDS))
        owned = owners.groupBy("owner").agg(F.collect_list("w").alias("owned"))
        passages = stored(stretches.select(F.col("doc_id").alias("owner"), "part").join(owned, "owner")
                          .select("owner", "part", "owned")
                          .mapInArrow(tidied(_passages(shards)), "shard long, owner long, passage binary, n_words long, anchors array<long>"),
                          "passages")

        routes = passages.select("shard", F.explode("anchors").alias("x")).distinct()
        places = ["doc_id", "seq", "start"]
        routed = stored(stretches.select(*places, "n_words", F.explode("xs").alias("x")).join(routes, "x")
                        .groupBy(*places, "n_words", "shard").agg(F.collect_set("x").alias("xs")), "routes")
        tasks = stored(routed.groupBy("shard").agg(F.ceil(F.sum("n_words") / TASK_WORDS).cast("int").alias("tasks")), "shard-tasks")
        left = passages.select("shard", "owner", "passage").join(tasks, "shard").withColumn(
            "task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
        # a shard gets of a stretch what lies around the anchors that its passages hold
        parts = (stretches.select(*places, "part").join(measured_broadcast(routed.drop("n_words")), places)
                 .select("doc_id", "seq", "part", "xs", "start", "shard")
                 .mapInArrow(tidied(_stretches), "doc_id long, seq binary, start long, part binary, n_words long, xs array<long>, shard long"))
        right = parts.join(tasks, "shard").withColumn("task", F.pmod(F.xxhash64("doc_id"), F.col("tasks")).cast("int"))
        found = left.select("shard", "task", "owner", "passage").groupBy("shard", "task").cogroup(
            right.select("shard", "task", *places, "part").groupBy("shard", "task")).applyInArrow(
            _locate, "doc_id long, seq binary, start long, end long")
        self.spans = stored(found.distinct().groupBy("doc_id", "seq").agg(
            F.collect_list(F.struct("start", "end")).alias("spans")), "spans")


def _add_sequence(batches):
    for batch in batches:
        seq = pa.array([_sequence(t.split()) for t in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), seq], ["doc_id", "t", "seq"])


def kept_words(words: list[bytes], spans) -> list[bytes]:
    out, at = [], 0
    for a, b in merged([(s["start"], s["end"]) for s in spans]):
        out += words[at:a]
        at = b
    return out + words[at:]


def removed_digest(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept_sha256``."""
    found = Repeats(docs)

    def digest(batches):
        from hashlib import sha256

        for batch in batches:
            sha, n = [], []
            for t, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = t.split()
                kept = kept_words(words, spans)
                sha.append(sha256(b" ".join(kept)).hexdigest())
                n.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha)],
                                             ["doc_id", "seq", "n_removed", "changed_sha"])

    changed = (found.candidates.select("doc_id", "seq", "t").join(measured_broadcast(found.spans), ["doc_id", "seq"])
               .select("doc_id", "seq", "t", "spans")
               .mapInArrow(tidied(digest), "doc_id long, seq binary, n_removed long, changed_sha string"))
    nothing = F.sha2(F.lit(b"").cast("binary"), 256)
    gone = found.copies.select("doc_id", "seq", F.col("n_words").alias("n_removed"), nothing.alias("changed_sha"))
    changes = stored(changed.unionByName(gone).distinct(), "changes")
    return (found.profile.select("doc_id", "n_words", "seq", "sha").join(maybe_broadcast(changes, 128), ["doc_id", "seq"], "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("changed_sha", "sha").alias("kept_sha256")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The table with the words of repeated windows removed from ``text`` (kept words joined by
    one space; texts without a repeat stay as they are) and ``n_removed`` added (an underscore after
    the name if the table has it already). Rows whose words all go keep an empty text."""
    found = Repeats(docs)
    whole = found.copies.select("doc_id", "seq", F.array(F.struct(
        F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))).alias("spans"))
    names = docs.columns
    key, new = free_name(names, "id_of_spans"), free_name(names, "new_text")
    by_seq = free_name(names, "by_seq")
    spans = stored(found.spans.unionByName(whole).groupBy(F.col("doc_id").alias(key)).agg(
        F.collect_list(F.struct("seq", "spans")).alias(by_seq)), "all-spans")

    @F.pandas_udf("struct<text string, n_removed long>")
    def apply(texts, by_seq):
        import pandas as pd

        out = []
        for t, found_in in zip(texts, by_seq):
            words = t.encode("utf-8").split()
            seq = _sequence(words)
            spans = next((x["spans"] for x in found_in if bytes(x["seq"]) == seq), None)
            kept = words if spans is None else kept_words(words, spans)
            gone = len(words) - len(kept)
            out.append((b" ".join(kept).decode("utf-8") if gone else t, gone))
        return pd.DataFrame(out, columns=["text", "n_removed"])

    size = spans.agg(F.sum(F.expr(f"aggregate({by_seq}, 64L, (a, x) -> a + 64 + 32 * size(x.spans))"))).first()[0] or 0
    side = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    joined = docs.join(side, F.col("doc_id") == F.col(key), "left")
    out = free_name(names, "n_removed")
    # only texts of documents that lose something leave the JVM
    same = joined.where(F.col(by_seq).isNull() | F.col("text").isNull()).select(
        *[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias(out))
    less = joined.where(F.col(by_seq).isNotNull() & F.col("text").isNotNull()).withColumn(new, apply("text", by_seq)).select(
        *[F.col(f"{new}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names], F.col(f"{new}.n_removed").alias(out))
    return same.unionByName(less)
