"""Byte-level BPE by monoid tree reduction.

``encode`` halves a text until a leaf is short, encodes the leaves and joins neighbours. A
join re-encodes a window around the seam and splices it in; the tokens outside the window
are provably those of the whole text, by one of two rules:

* *Hard cuts.* Where a non-space is followed by white space, no match of the pattern spans
  the place, whatever stands around it, and a match starts there. If the window starts and
  ends at such cuts (or at the ends of the text), the matches outside are unchanged. The
  window grows until it does.
* *Compatible pairs*, inside one long match. A sequence of tokens is the BPE encoding of its
  bytes exactly when every two neighbours are (their joint bytes encode to these two).
  Neighbours inside either half or inside the window are; so only the two seams of the
  window need the test, and the window grows by doubling until both pass.

Halves of a long match are joined by the second rule, everything else by the first. Decoding
concatenates token bytes up the same tree.

Defined cases: null text encodes like the empty text, to no ids; lone white space, long runs
without a cut and texts of any length are encoded whole; rows are independent, so repeated
rows, ties and extra columns have no effect; special tokens do not exist here.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import text_bytes

LEAF_CHARS = 2048
LEAF_BYTES = 512  # of one match
WINDOW_TOKENS = 4


class TreeBPE:
    """Encoder over a rank file; ``pattern`` cuts text into matches."""

    def __init__(self, rank_path: str, pattern: str):
        import base64
        import re

        import regex
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the core's white space is the Unicode property; Python's adds four control characters
        self._pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._cut = re.compile(r"(?<=\S)(?=[ \t\n\r])")
        self._pairs: dict[tuple[int, int], bool] = {}

    # one match of the pattern, as bytes

    def _leaf(self, piece: bytes) -> list[int]:
        return self._core._encode_single_piece(piece) if piece else []

    def _compatible(self, a: int, b: int) -> bool:
        ok = self._pairs.get((a, b))
        if ok is None:
            if len(self._pairs) > 200_000:
                self._pairs.clear()
            ok = self._pairs[a, b] = self._leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of ``left`` followed by those of ``right`` as one match."""
        if not left or not right:
            return left + right
        if self._compatible(left[-1], right[0]):
            return left + right
        i = j = WINDOW_TOKENS
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = b"".join(self.bytes_of[t] for t in left[len(left) - i:] + right[:j])
            mid = self._leaf(window) if len(window) <= 4 * LEAF_BYTES else self.encode_piece(window, halves=False)
            left_ok = i == len(left) or self._compatible(left[len(left) - i - 1], mid[0])
            right_ok = j == len(right) or self._compatible(mid[-1], right[j])
            if left_ok and right_ok:
                return left[:len(left) - i] + mid + right[j:]
            i, j = (i if left_ok else 2 * i), (j if right_ok else 2 * j)

    def encode_piece(self, piece: bytes, halves: bool = True) -> list[int]:
        if len(piece) <= LEAF_BYTES or not halves:
            return self._leaf(piece)
        mid = len(piece) // 2
        return self.join_piece(self.encode_piece(piece[:mid]), self.encode_piece(piece[mid:]))

    # a text

    def _leaf_text(self, text: str) -> list[int]:
        """A stretch that is short or has no cut: match by match, long matches as trees."""
        if len(text) <= 2 * LEAF_CHARS:
            return self._core.encode_ordinary(text)
        ids: list[int] = []
        for m in self._pattern.finditer(text):
            ids += self.encode_piece(m.group().encode("utf-8"))
        return ids

    def _tail(self, ids: list[int], n_bytes: int) -> int:
        """Number of ids that hold the last ``n_bytes`` bytes."""
        k = 0
        while n_bytes > 0:
            k += 1
            n_bytes -= len(self.bytes_of[ids[-k]])
        return k

    def _head(self, ids: list[int], n_bytes: int) -> int:
        k = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[k]])
            k += 1
        return k

    def join_text(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of ``left + right`` from those of both halves."""
        if left[-1:].strip() and right[:1] in {" ", "\t", "\n", "\r"}:
            return left_ids + right_ids  # the seam is a hard cut
        w = 32
        while True:  # window grows to a cut on either side, or to the end of the half
            start = max((m.start() for m in self._cut.finditer(left, max(0, len(left) - w))), default=-1)
            if start <= 0 and w < len(left):
                w *= 2
                continue
            break
        start = max(start, 0)
        w = 32
        while True:
            hit = self._cut.search(right, 1, min(w, len(right)))
            if hit is None and w < len(right):
                w *= 2
                continue
            break
        end = hit.start() if hit else len(right)
        mid = self._leaf_text(left[start:] + right[:end])
        keep = len(left_ids) - self._tail(left_ids, len(left[start:].encode("utf-8")))
        drop = self._head(right_ids, len(right[:end].encode("utf-8")))
        return left_ids[:keep] + mid + right_ids[drop:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF_CHARS:
            return self._core.encode_ordinary(text)
        mid = len(text) // 2
        if self._cut.search(text, max(1, mid - LEAF_CHARS // 2), mid + LEAF_CHARS // 2) is None:
            return self._long_run(text, mid)
        left, right = text[:mid], text[mid:]
        return self.join_text(left, self.encode(left), right, self.encode(right))

    def _long_run(self, text: str, mid: int) -> list[int]:
        """The middle lies in a run without cuts: the run is one leaf (its long matches are
        halved as pieces), the two rests are trees of their own."""
        start = mid
        w = LEAF_CHARS
        while True:
            cuts = [m.start() for m in self._cut.finditer(text, max(0, mid - w), mid)]
            if cuts or w >= mid:
                start = cuts[-1] if cuts else 0
                break
            w *= 2
        hit = self._cut.search(text, mid + 1)
        end = hit.start() if hit else len(text)
        return self.encode(text[:start]) + self._leaf_text(text[start:end]) + self.encode(text[end:])

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, joined up a balanced tree."""
        if len(ids) <= 4 * LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def bpe_encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every text. ``rank_path`` must exist on the executors
    (an installed vocabulary file)."""

    def run(batches):
        coder = TreeBPE(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [coder.encode(t.decode("utf-8", "replace")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                                 ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).mapInArrow(
        run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``(doc_id, bytes binary)`` from ``(doc_id, ids)``; null ids decode to no bytes."""

    def run(batches):
        coder = TreeBPE(rank_path, pattern)
        for batch in batches:
            out = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def bpe_digest(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per document the number of ids, the digest of the ids (little-endian unsigned 32-bit)
    and that of the bytes they decode to; ids stay inside the task."""

    def run(batches):
        from hashlib import sha256

        import numpy as np

        coder = TreeBPE(rank_path, pattern)
        for batch in batches:
            n, enc, dec = [], [], []
            for t in batch.column(1).to_pylist():
                ids = coder.encode(t.decode("utf-8", "replace"))
                n.append(len(ids))
                enc.append(sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                dec.append(sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
