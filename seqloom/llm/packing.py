"""Hierarchical multi-length packing of tokenised documents.

Every document becomes its ids followed by one end id. Ids beyond the longest tier are cut
off in full windows; what is left of a document is routed to the smallest context tier that
holds it (256, 512, 1024 or 2048 ids). Tiers are packed from long to short: an item opens a
window of its tier, the gap is filled with the longest whole items of shorter tiers that
fit, and the last gap is closed by cutting one item. Windows are therefore full; only the
last window of a task may need padding. Full windows of a tier are collected into *step
groups* of equal token count; what is left at the end of a task is mixed across tiers.

Packing needs no shuffle: a task packs its own input partition in blocks of about two
million ids, and unfinished items move on to the next block, so memory is bounded by a block
plus one document. A lost task is repeated with the same result, since the order inside an
input partition is fixed.

Ids come from the ``tokenizers`` library; each distinct space-led unit is encoded once per
cache (a space after a non-space always starts a new match of a byte-level pre-tokenizer, so
units are independent of each other). A Python worker keeps its caches from task to task.

Defined cases: null text is empty (one end id); repeated rows and repeated or null ids are
packed as rows of their own; texts of any length are cut, never dropped; an empty table gives
no pieces; other columns are passed by. The word-unit rule holds for byte-level vocabularies
without a leading-space option.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import once_per_worker, stored, text_bytes, tidied

TIERS = (256, 512, 1024, 2048)
END_ID = 1
BLOCK_IDS = 1 << 21
STEP_IDS = 1 << 16

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long, tier int, step_group long")


class Learned(dict):
    """A cache that computes what it lacks; entries of the generation before are taken over."""

    def __init__(self, compute, before=None):
        super().__init__()
        self.compute, self.before = compute, before or {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.compute(key)
        self[key] = found
        return found

    def young(self, limit: int) -> "Learned":
        """This cache, or an empty one before which it comes when it holds over ``limit`` entries."""
        if len(self) <= limit:
            return self
        self.before = {}
        return Learned(self.compute, dict(self))


class UnitEncoder:
    """Texts to little-endian unsigned 32-bit ids, through caches: words that follow a single space, the
    matches of the byte-level pattern that words consist of, and strings that stand alone. A new word of
    plain letters, digits, marks and line breaks is cut into its matches, and each different match
    goes through the model once; other strings go through the whole tokenizer. Every cache has two
    generations of at most ``limit`` entries: when the young one is full it becomes the old one, and what is
    still in use comes back from there."""

    def __init__(self, path: str, limit: int = 500_000):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode = tokenizer.encode_batch_fast
        self._model = tokenizer.model.tokenize
        self._odd = re.compile(r"\s ").search
        self._cut = re.compile(r"(?<=\S)(?= )").split
        # characters whose classes are beyond doubt: ASCII but control characters, letters of Latin-1
        letters, marks = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-/:-@\[-`{-~"
        # a line break right after the word's space would be one match with it
        self._plain = re.compile(rf"[0-9{letters}{marks}][\n0-9{letters}{marks}]*").fullmatch
        self._plain_text = re.compile(rf"[ \n0-9{letters}{marks}]*").fullmatch
        # fixed value: the pattern of byte-level pre-tokenizers, over these characters
        self._pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[0-9]+| ?[{marks}]+|\n+(?!\S)|\n+").findall
        # byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(shown)]
        self._alphabet = {x: x for x in shown} | {x: 256 + i for i, x in enumerate(hidden)}
        self.limit = limit
        self._words, self._matches, self._strings = Learned(self._word), Learned(self._match), Learned(self._string)

    def _string(self, text: str) -> bytes:
        from array import array

        return array("I", self._encode([text], add_special_tokens=False)[0].ids).tobytes()

    def _match(self, match: str) -> bytes:
        from array import array

        spelt = match.encode().decode("latin-1").translate(self._alphabet)
        return array("I", [t.id for t in self._model(spelt)]).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of the word after a space."""
        if word.isalpha() and (word.isascii() or self._plain(word)):
            return self._matches[" " + word]
        if not self._plain(word) or "<|" in word:
            return self._strings[" " + word]
        matches = self._matches
        return b"".join([matches[m] for m in self._pattern(" " + word)])

    def encode(self, texts: list[str]) -> list[bytes]:
        self._words, self._matches, self._strings = (c.young(self.limit) for c in (self._words, self._matches, self._strings))
        word, string = self._words.__getitem__, self._strings.__getitem__
        out = []
        for t in texts:
            if ("  " in t or "\n " in t) if self._plain_text(t) else self._odd(t):
                out.append(b"".join(map(string, self._cut(t))))
            else:
                first, *rest = t.split(" ")
                out.append(string(first) + b"".join(map(word, rest)))
        return out


class Packer:
    """Windows and step groups of one task. An item is ``(row, start, length)``."""

    def __init__(self, tiers: tuple[int, ...], step_ids: int):
        self.tiers = tuple(sorted(tiers))
        self.step_ids = step_ids
        self.items: list[list[tuple]] = [[] for _ in self.tiers]  # ascending (length, row key, start)
        self.rows: dict[int, tuple] = {}  # row id, ids from a start on, that start, ids of the document
        self.held: dict[int, list] = {s: [] for s in self.tiers}
        self.next_key = self.next_sequence = self.next_group = 0

    def route(self, key: int, start: int, length: int) -> None:
        from bisect import insort

        if length:
            k = next(i for i, s in enumerate(self.tiers) if length <= s)
            insort(self.items[k], (length, key, start))

    def add(self, row_id, ids: bytes, emit) -> None:
        """Route one document; its full windows leave at once."""
        key, self.next_key = self.next_key, self.next_key + 1
        n, top, start = len(ids) // 4, self.tiers[-1], 0
        self.rows[key] = (row_id, ids, 0, n)
        while n - start >= top:
            self.close([(key, start, top)], top, emit)
            start += top
        self.route(key, start, n - start)

    def add_rest(self, row_id, ids: bytes, start: int, doc_tokens: int) -> None:
        """Route what an earlier pass left of a document."""
        key, self.next_key = self.next_key, self.next_key + 1
        self.rows[key] = (row_id, ids, start, doc_tokens)
        self.route(key, start, len(ids) // 4)

    def rest(self):
        """The unpacked items: row id, start, ids, ids of the document. They leave the packer."""
        for length, key, start in (x for tier in self.items for x in tier):
            row_id, ids, first, n = self.rows[key]
            yield row_id, start, ids[4 * (start - first):4 * (start - first + length)], n
        self.items = [[] for _ in self.tiers]

    def close(self, window: list[tuple], tier: int, emit) -> None:
        """A full window joins its tier's step group; full groups are emitted."""
        held = self.held[tier]
        held.append((tier, self.materialise(window)))
        if len(held) * tier >= self.step_ids:
            self.emit_group(held, emit)
            held.clear()

    def materialise(self, window: list[tuple]) -> list[tuple]:
        from zlib import crc32

        out, offset = [], 0
        for key, start, length in window:
            row_id, ids, first, n = self.rows[key]
            at = start - first
            out.append((row_id, start, length, crc32(ids[4 * at:4 * (at + length)]), n, offset))
            offset += length
        return out

    def emit_group(self, windows: list, emit) -> None:
        for tier, pieces in windows:
            for p in pieces:
                emit((*p[:5], self.next_sequence, p[5], tier, self.next_group))
            self.next_sequence += 1
        self.next_group += 1

    def take(self, room: int, below: int):
        """Longest item of at most ``room`` ids from tiers up to index ``below``."""
        from bisect import bisect_right

        for k in range(min(below, len(self.tiers) - 1), -1, -1):
            at = bisect_right(self.items[k], (room, float("inf"), 0))
            if at:
                return self.items[k].pop(at - 1)
        return None

    def pack(self, emit, last: bool) -> None:
        """Fill windows while the items hold enough ids; ``last`` also closes the rest."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[k]
            total = sum(x[0] for i in range(k + 1) for x in self.items[i])
            while self.items[k] and total >= tier:
                window, room = [], tier
                while room:
                    got = self.take(room, k)
                    if got is None:  # every item is longer than the gap: cut the shortest
                        j = next(i for i in range(k + 1) if self.items[i])
                        length, key, start = self.items[j].pop(0)
                        self.route(key, start + room, length - room)
                        got = (room, key, start)
                    length, key, start = got
                    window.append((key, start, length))
                    room -= length
                total -= tier
                self.close(window, tier, emit)
        if last:
            rest = [(key, start, length) for tier in self.items for length, key, start in tier]
            self.items = [[] for _ in self.tiers]
            window, room = [], self.tiers[-1]
            windows = []
            for key, start, length in sorted(rest, key=lambda x: -x[2]):
                while length:
                    part = min(length, room)
                    window.append((key, start, part))
                    start, length, room = start + part, length - part, room - part
                    if not room:
                        windows.append((self.tiers[-1], self.materialise(window)))
                        window, room = [], self.tiers[-1]
            if window:
                windows.append((self.tiers[-1], self.materialise(window)))
            windows += [w for held in self.held.values() for w in held]
            windows.sort(key=lambda w: -w[0])
            group, size = [], 0
            for w in windows:
                if size + w[0] > self.step_ids and group:
                    self.emit_group(group, emit)
                    group, size = [], 0
                group.append(w)
                size += w[0]
            if group:
                self.emit_group(group, emit)
            self.rows.clear()
            return
        live = {key for tier in self.items for _, key, _ in tier}
        self.rows = {key: row for key, row in self.rows.items() if key in live}


REST_SCHEMA = "doc_id long, start long, doc_tokens long, ids binary"
REST_NAMES = ["doc_id", "start", "doc_tokens", "ids"]
PIECE_NAMES = [c.split(" ")[0] for c in PIECE_SCHEMA.split(", ")]


def _pieces(rows: list[tuple], base: int):
    """Piece rows with the numbers of sequences and step groups counted on from ``base``."""
    cols = list(zip(*rows)) if rows else [()] * 9
    arrays = [pa.array(c, pa.int64()) for c in cols]
    arrays[5] = pa.array([base + x for x in cols[5]], pa.int64())
    arrays[7] = arrays[7].cast(pa.int32())
    arrays[8] = pa.array([base + x for x in cols[8]], pa.int64())
    return arrays


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS,
                   step_ids: int = STEP_IDS, end_id: int = END_ID, block_ids: int = BLOCK_IDS, cached: int = 500_000) -> DataFrame:
    """One row per piece: where it comes from (``doc_id, start, length, doc_tokens``), the
    checksum of its ids, and where it lies (``sequence_id, offset, tier, step_group``). ``cached`` bounds
    what a generation of the word caches holds: fewer words take less memory and more time."""

    def whole(batches):
        import numpy as np
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        coder = once_per_worker(("units", tokenizer_path, cached), lambda: UnitEncoder(tokenizer_path, cached))
        packer = Packer(tiers, step_ids)
        end = np.asarray([end_id], "<u4").tobytes()
        out: list[tuple] = []

        def result(ids=()):
            arrays = _pieces(out, base)
            out.clear()
            arrays.append(pa.array(ids or [None] * len(arrays[0]), pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, [*PIECE_NAMES, "ids"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [t.decode("utf-8", "replace") for t in part.column(1).to_pylist()]
                for row_id, ids in zip(part.column(0).to_pylist(), coder.encode(texts)):
                    packer.add(row_id, ids + end, out.append)
                    size += len(ids) // 4 + 1
                if size >= block_ids:
                    packer.pack(out.append, last=False)
                    size = 0
                    if out:
                        yield result()
        packer.pack(out.append, last=False)
        rest = list(packer.rest())
        packer.pack(out.append, last=True)  # no items any more: only the unfinished step groups
        yield result()
        out += [(row_id, start, len(ids) // 4, None, n, 0, None, None, 0) for row_id, start, ids, n in rest]
        yield result([ids for _, _, ids, _ in rest])

    def ends(batches):
        from pyspark import TaskContext

        base = (1 << 62) + (TaskContext.get().partitionId() << 36)  # beyond the numbers of the first pass
        packer = Packer(tiers, step_ids)
        out: list[tuple] = []
        for batch in batches:
            for row_id, start, n, ids in zip(*[batch.column(c).to_pylist() for c in REST_NAMES]):
                packer.add_rest(row_id, ids, start, n)
        packer.pack(out.append, last=True)
        yield pa.RecordBatch.from_arrays(_pieces(out, base), PIECE_NAMES)

    first = stored(docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).mapInArrow(tidied(whole, keep=True), PIECE_SCHEMA + ", ids binary"), "packed")
    left = first.where("ids is not null")
    total = left.agg(F.sum("length")).first()[0] or 0
    tail = left.select(*REST_NAMES).repartition(max(1, -(-total // block_ids))).mapInArrow(tidied(ends), PIECE_SCHEMA)
    return first.where("ids is null").drop("ids").unionByName(tail)
