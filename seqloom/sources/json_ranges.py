"""One JSON object read by many tasks: the members of the top-level objects of a file, by byte ranges.

Where a byte range begins inside a JSON text, a reader cannot tell whether a quote opens or
closes a string. What a range does to the scanner's state can be told without knowing it,
though: for each of three states at its begin (outside strings, inside one, after a backslash in one) it
has one state at its end and one change of nesting depth. A first pass computes that small table
for every range; composed in file order (one row a range, on the driver) the tables give each
range the state and depth it begins with. A second pass then finds the members that begin in
each range, reading on past its end until the last of them is complete.

Several objects in one file, one a line included, are read alike. Compressed files are one range each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.rawfiles import list_files, open_fs

RANGE_BYTES = 32 << 20
CHUNK = 1 << 20
OUTSIDE, INSIDE, ESCAPE = 0, 1, 2


def scan(data: bytes, state: int):
    """``(state after, depth change before each byte's end, structural mask)`` of ``data`` begun in ``state``:
    ``depth[i]`` is the change up to and with byte i, ``outside[i]`` whether byte i stands outside strings."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    if not n:
        return state, np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.arange(n)
    slash = b == 92
    quote = b == 34
    if slash.any() or state == ESCAPE:
        # how many backslashes stand right before each byte; one that was pending counts too
        last_other = np.maximum.accumulate(np.where(slash, -1, at))
        run = np.concatenate([[0], (at - last_other)[:-1]]) if n > 1 else np.zeros(1, np.int64)
        lead = np.concatenate([[True], np.logical_and.accumulate(slash)[:-1]])
        run = np.where(lead, at, run) + (lead & (state == ESCAPE))
        quote &= run % 2 == 0
        tail = n - 1 - int(last_other[-1]) if last_other[-1] >= 0 else n + (state == ESCAPE)
    else:
        tail = 0
    inside = state != OUTSIDE
    parity = np.cumsum(quote)
    outside = (parity - quote + inside) % 2 == 0  # the state before the byte; an opening quote counts as outside
    change = np.where(outside, ((b == 123) | (b == 91)).astype(np.int64) - ((b == 125) | (b == 93)), 0)
    now_inside = (int(parity[-1]) + inside) % 2 == 1
    after = (ESCAPE if tail % 2 else INSIDE) if now_inside else OUTSIDE
    return after, np.cumsum(change), outside


def _files(path: str) -> list[tuple[str, int]]:
    """``(full name, bytes)`` of a file, or of the files below a folder."""
    from pyarrow import fs

    system, root = open_fs(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    return [(f"{path.rstrip('/')}/{n}", b) for n, b in list_files(path) if b]


def _reader(name: str, begin: int):
    system, inner = open_fs(name)
    if name.endswith((".gz", ".bz2")):
        return system.open_input_stream(inner, compression="detect")
    f = system.open_input_file(inner)
    f.seek(begin)
    return f


def _chunks(name: str, begin: int, end: int, chunk: int):
    """The bytes from ``begin`` to ``end`` (None: to the end of the file)."""
    with _reader(name, begin) as f:
        while end is None or begin < end:
            data = f.read(chunk if end is None else min(chunk, end - begin))
            if not data:
                return
            begin += len(data)
            yield data


def json_members(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, chunk: int = CHUNK) -> DataFrame:
    """``file, at, member``: the text ``"key": value`` of every member of the top-level objects below
    ``path`` and the place of the bracket or comma before it. An unclosed text raises."""
    files = _files(path)
    whole = [n.endswith((".gz", ".bz2")) for n, _ in files]
    counts = [1 if w else -(-b // range_bytes) for (_, b), w in zip(files, whole)]
    firsts = np.concatenate([[0], np.cumsum(counts)]).astype(int).tolist()
    total = firsts[-1]
    ranges = spark.range(0, total, 1, max(1, total)) if total else spark.range(0)

    def bounds(i):
        f = int(np.searchsorted(firsts, i, "right")) - 1
        begin = (i - firsts[f]) * range_bytes
        return files[f][0], begin, None if whole[f] else min(begin + range_bytes, files[f][1])

    def tables(batches):
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                name, begin, end = bounds(i)
                states, depths = [OUTSIDE, INSIDE, ESCAPE], [0, 0, 0]
                for data in _chunks(name, begin, end, chunk):
                    for s in range(3):
                        states[s], change, _ = scan(data, states[s])
                        depths[s] += int(change[-1])
                rows.append((i, states, depths))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                                              pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["i", "states", "depths"])

    found = {r["i"]: r for r in ranges.mapInArrow(tables, "i long, states array<int>, depths array<long>").collect()}
    begins = []
    for f, (name, _) in enumerate(files):
        state, depth = OUTSIDE, 0
        for i in range(firsts[f], firsts[f + 1]):
            begins.append((state, depth))
            depth += found[i]["depths"][state]
            state = found[i]["states"][state]
        if state != OUTSIDE or depth:
            raise ValueError(f"{name}: the JSON text is not closed")

    def members(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                name, begin, end = bounds(i)
                state, depth = begins[i]
                held, since, at = [], None, begin  # pieces of the open member, and where it was opened
                out: list[tuple[int, str]] = []
                size = 0
                for data in _chunks(name, begin, None, chunk):
                    if end is not None and at >= end and since is None:
                        break
                    state, change, outside = scan(data, state)
                    b = np.frombuffer(data, np.uint8)
                    level = depth + change
                    opens = outside & (b == 123) & (level == 1)
                    cuts = np.flatnonzero(outside & (((b == 44) & (level == 1)) | ((b == 125) & (level == 0)) | opens))
                    done, last = False, 0
                    for p, is_open, is_comma in zip(cuts.tolist(), opens[cuts].tolist(), (b[cuts] == 44).tolist()):
                        if since is not None:
                            text = (b"".join(held) + data[last:p]).decode()
                            if text.strip():
                                out.append((since, text))
                                size += len(text)
                        held, since = [], None
                        if end is not None and at + p >= end:
                            done = True
                            break
                        if is_open or is_comma:
                            since, last = at + p, p + 1
                        if size > 8 << 20:
                            yield _member_rows(name, out)
                            out, size = [], 0
                    if done:
                        break
                    if since is not None:
                        held.append(data[last:] if since >= at else data)
                    depth = int(level[-1])
                    at += len(data)
                if out:
                    yield _member_rows(name, out)

    return ranges.mapInArrow(members, "file string, at long, member string")


def _member_rows(name, out):
    return pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array([a for a, _ in out], pa.int64()), pa.array([t for _, t in out])],
                                      ["file", "at", "member"])


def read_json_map(spark: SparkSession, path: str, value: str, range_bytes: int = RANGE_BYTES, chunk: int = CHUNK) -> DataFrame:
    """``key, value`` of the top-level members below ``path``, values as Spark type ``value``. A member that
    is no such value raises; of a repeated key the last member (by file name, then place) counts."""
    parts = json_members(spark, path, range_bytes, chunk)
    parsed = F.from_json(F.concat(F.lit("{"), "member", F.lit("}")), f"map<string,{value}>", {"mode": "FAILFAST"})
    rows = parts.select("file", "at", F.explode(parsed).alias("key", "value"))
    return rows.groupBy("key").agg(F.max_by("value", F.struct("file", "at")).alias("value"))
