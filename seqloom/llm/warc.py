"""WARC archives of captures, and a capture index merged from locally sorted runs.

``write_archives`` writes one WARC record per row, each its own gzip member, through the
committed raw file sink. Payloads of at least ``least`` bytes that several rows share are
stored once: the rows with the smallest page id are ``response`` records, the others
``revisit`` records that name it and hold only headers. ``read_archives`` reads archives back,
one file a task, checks every stored payload against its digest, and returns each file's
captures as a run sorted by URL key, timestamp, page id and place. ``merge_runs`` brings the
runs into one order: the key space is cut into ranges of about ``MERGE_ROWS`` captures (on the
whole key, so a URL that a third of all captures share is cut too), and a task merges its slices
of the runs with a loser tree. Positions run on over the ranges, so every capture gets its place in the whole order and in its URL's history.

At scale: page texts never shuffle while the table of shared payloads measures under 32 MiB. Above it
only payloads with ``HOT`` copies and more are shipped (at most one in ``HOT`` rows) and the other rows meet
theirs by digest. Index rows are narrow. The driver holds file names and one row per merge range.

Defined cases: a null text is an empty payload; a null page id never makes or becomes a
revisit; rows that repeat the smallest page id are all responses; a null URL has the empty key and no
target header; control characters and blanks of a URL are percent-encoded in the record; captures
without a time count as second 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import BROADCAST_BYTES, maybe_broadcast, stored
from seqloom.session import scratch_path
from seqloom.sources.rawfiles import open_fs, write_raw

LEAST = 100          # smaller payloads are always stored
ARCHIVE_BYTES = 64 << 20
MERGE_ROWS = 65_536  # captures of one merge range
HOT = 50_000         # copies of a payload that is shipped to the rows rather than met by digest
LEVEL = 1            # gzip

# fixed values: names of the WARC 1.1 format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = ("url_key string, ts long, page_id long, url string, record_type string, payload_bytes long, "
            "payload_digest string, refers_to long, file string, offset long, length long")
KEYS = ["url_key", "ts", "page_id", "file", "offset"]


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, ``)``, path and query: captures of a site are neighbours.
    Scheme, a leading ``www.``, default ports and the fragment do not count."""
    import re

    if not url:
        return ""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)", url, re.S)
    host = re.sub(r":(80|443)$", "", m.group(1).lower()).removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m.group(2) or "/")


def with_originals(pages: DataFrame, url_col: str, text_col: str, id_col: str, seconds: Column, least: int = LEAST) -> DataFrame:
    """``page_id, url, ts, payload, digest, first_id, first_url, first_ts``: rows to write, the last three null for
    rows that are stored themselves."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(seconds.cast("long"), F.lit(0)).alias("ts"),
                        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    named = rows.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least))
    first = F.min(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"), "ts")).alias("f")
    shared = stored(named.groupBy("digest").agg(F.count("*").alias("n"), first, F.max("page_id").alias("last"))
                    .where(F.col("last") > F.col("f.page_id"))
                    .select("digest", "n", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"), F.col("f.ts").alias("first_ts")),
                    "shared-payloads")
    size = shared.agg(F.sum(F.octet_length("first_url") + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        out = rows.join(F.broadcast(shared.drop("n")), "digest", "left")
    else:
        hot = shared.where(F.col("n") >= HOT)
        tagged = rows.join(maybe_broadcast(hot.select("digest", F.lit(True).alias("hot")), 100), "digest", "left")
        out = (tagged.where("hot").join(maybe_broadcast(hot.drop("n"), 2_000), "digest", "left")
               .unionByName(tagged.where("hot is null").join(shared.where(F.col("n") < HOT).drop("n"), "digest", "left"))).drop("hot")
    again = (F.col("page_id") > F.col("first_id")) & (F.octet_length("payload") >= least)
    return out.select("page_id", "url", "ts", "payload", "digest",
                      *[F.when(again, F.col(c)).alias(c) for c in ("first_id", "first_url", "first_ts")])


def _records(archive_bytes: int):
    def run(batches):
        import gzip
        import hashlib
        import re
        from datetime import datetime, timedelta

        from pyspark import TaskContext

        def uri(url):
            return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m.group()[0], (url or "").encode())

        def name(page_id, url, digest):
            mark = hashlib.md5(uri(url) + b" " + digest.encode()).hexdigest()
            return f"<urn:capture:{'' if page_id is None else page_id}:{mark}>".encode()

        def date(ts):
            return (datetime(1970, 1, 1) + timedelta(seconds=ts)).strftime("%Y-%m-%dT%H:%M:%SZ").encode()

        def record(page_id, url, ts, payload, digest, first_id, first_url, first_ts):
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
            head = [VERSION.encode(), b"WARC-Type: " + (b"response" if first_id is None else b"revisit"),
                    b"WARC-Record-ID: " + name(page_id, url, digest), b"WARC-Date: " + date(ts)]
            if url is not None:
                head.append(b"WARC-Target-URI: " + uri(url))
            head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"Content-Type: application/http;msgtype=response"]
            if first_id is None:
                http += payload
            else:
                head += [b"WARC-Profile: " + REVISIT_PROFILE.encode(), b"WARC-Refers-To: " + name(first_id, first_url, digest),
                         b"WARC-Refers-To-Target-URI: " + uri(first_url), b"WARC-Refers-To-Date: " + date(first_ts)]
            head.append(b"Content-Length: %d" % len(http))
            return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + http + b"\r\n\r\n", LEVEL, mtime=0)

        part, number, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "ts", "payload", "digest", "first_id", "first_url", "first_ts")]
            files, data, held = [], [], 0
            for i in range(batch.num_rows):
                made = record(*[c[i].as_py() for c in columns])
                if size and size + len(made) > archive_bytes:
                    number, size = number + 1, 0
                files.append(f"capture-{part:06d}-{number:05d}.warc.gz")
                data.append(made)
                size += len(made)
                held += len(made)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(data, pa.binary())], ["file", "data"])
                    files, data, held = [], [], 0
            if files:
                yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(data, pa.binary())], ["file", "data"])
    return run


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> list[tuple[str, int]]:
    """Rows of ``with_originals`` as WARC files of about ``archive_bytes``; returns ``(file, bytes)``."""
    return write_raw(rows.mapInArrow(_records(archive_bytes), "file string, data binary"), path)


def parse_records(stream):
    """``(offset, length, headers, block)`` of every record of an open gzip file of one-member records
    or of an uncompressed WARC file."""
    import zlib

    raw, at, ended = b"", 0, False

    def more(least=1 << 16):
        nonlocal raw, ended
        got = stream.read(least)
        raw += got
        ended = not got

    while True:
        while len(raw) < 2 and not ended:
            more()
        if not raw:
            return
        if raw[:2] == b"\x1f\x8b":
            d, out, used = zlib.decompressobj(31), [], 0
            while not d.eof:
                if not raw:
                    more()
                    if ended:
                        raise ValueError(f"archive ends inside the record at {at}")
                used += len(raw)
                out.append(d.decompress(raw))
                raw = d.unused_data if d.eof else b""
            length = used - len(raw)
            body = b"".join(out)
            head, _, block = body.partition(b"\r\n\r\n")
        else:
            while b"\r\n\r\n" not in raw and not ended:
                more()
            head, _, rest = raw.partition(b"\r\n\r\n")
            need = int(_headers(head).get("content-length", 0)) + 4
            while len(rest) < need and not ended:
                more(need - len(rest))
                rest = raw[len(head) + 4:]
            if len(rest) < need:
                raise ValueError(f"archive ends inside the record at {at}")
            length, block, raw = len(head) + 4 + need, rest[:need], rest[need:]
        headers = _headers(head)
        size = int(headers.get("content-length", -1))
        if not 0 <= size <= len(block) or block[size:] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has not the length it states")
        yield at, length, headers, block[:size]
        at += length


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _captures(path: str):
    def run(batches):
        import calendar
        import hashlib
        import time

        def page_of(urn):
            found = urn.removeprefix("<urn:capture:").partition(":")[0] if urn else ""
            return int(found) if found else None

        system, root = open_fs(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for offset, length, h, block in parse_records(stream):
                        kind = h.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = h.get("warc-payload-digest", "").rpartition(":")[2]
                        if kind == "response":
                            size = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{file}: the payload at {offset} has not the digest it states")
                        else:
                            size = int(dict(x.lower().split(b":", 1) for x in http.split(b"\r\n")[1:])[b"content-length"])
                        url = h.get("warc-target-uri")
                        ts = calendar.timegm(time.strptime(h["warc-date"], "%Y-%m-%dT%H:%M:%SZ"))
                        rows.append((url_key(url), ts, page_of(h.get("warc-record-id")), url, kind, size, digest,
                                     page_of(h.get("warc-refers-to")), file, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[9]))
                for i in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 8192]), TYPES)], NAMES)
    return run


NAMES = [c.split(" ")[0] for c in CAPTURES.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64()}[c.split(" ")[1]] for c in CAPTURES.split(", ")]


def read_archives(spark: SparkSession, path: str, files: list[tuple[str, int]]) -> DataFrame:
    """The captures of WARC files below ``path``: each file is one sorted run."""
    names = spark.createDataFrame([(f,) for f, _ in files], "file string")
    return names.repartition(max(1, len(files))).mapInArrow(_captures(path), CAPTURES)


def loser_tree(runs: list[list]):
    """Merge sorted lists of ``(key, ...)`` tuples. Inner nodes keep the loser of their match, so each
    step replays one path of about log2(runs) matches."""
    k = len(runs)
    if k == 0:
        return
    heads = [r[0] if r else None for r in runs]
    place = [0] * k

    def beats(a, b):  # an exhausted run loses, equal entries go by run
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return x is not None
        return x < y or (x == y and a < b)

    tree = [0] * k  # tree[1:] are losers, tree[0] the winner; leaf i sits below node (i + k) // 2
    wins = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = wins[2 * node], wins[2 * node + 1]
        wins[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    tree[0] = wins[1] if k > 1 else 0
    while True:
        w = tree[0]
        if heads[w] is None:
            return
        yield heads[w]
        place[w] += 1
        heads[w] = runs[w][place[w]] if place[w] < len(runs[w]) else None
        node = (w + k) // 2
        while node > 0:
            if beats(tree[node], w):
                tree[node], w = w, tree[node]
            node //= 2
        tree[0] = w


def _merge(batches):
    from pyspark import TaskContext

    held = list(batches)
    rows = pa.Table.from_batches(held) if held else None
    if rows is None or not rows.num_rows:
        return
    runs: dict[str, list] = {}
    for i, (key, ts, page, file, offset) in enumerate(zip(*[rows.column(c).to_pylist() for c in KEYS])):
        runs.setdefault(file, []).append((key, ts, page is not None, page or 0, file, offset, i))
    for run in runs.values():
        run.sort()  # a slice arrives in order; one that was fetched in pieces out of order is mended in linear time
    order, number, last, n = [], [], None, 0
    for entry in loser_tree([runs[f] for f in sorted(runs)]):
        n = n + 1 if entry[0] == last else 1
        last = entry[0]
        order.append(entry[-1])
        number.append(n)
    merged = rows.take(pa.array(order))
    part = pa.array([TaskContext.get().partitionId()] * len(order), pa.int64())
    columns = [*merged.columns, part, pa.array(range(len(order)), pa.int64()), pa.array(number, pa.int64())]
    yield from pa.table(columns, names=[*merged.column_names, "part", "at", "in_part"]).to_batches(max_chunksize=16_384)


def merge_runs(captures: DataFrame, merge_rows: int | None = None) -> DataFrame:
    """Captures (sorted runs) in one order: adds ``position`` (from 0, over all) and ``capture_no`` (from 1,
    in the history of its URL key)."""
    ranges = max(1, -(-captures.count() // (merge_rows or MERGE_ROWS)))
    merged = stored(captures.repartitionByRange(ranges, *KEYS).mapInArrow(_merge, CAPTURES + ", part long, at long, in_part long"), "merged")
    ends = merged.groupBy("part").agg(F.count("*").alias("n"), F.min_by("url_key", "at").alias("first"),
                                      F.max_by("url_key", "at").alias("last"), F.max_by("in_part", "at").alias("tail")).orderBy("part").collect()
    before, carried, last, offsets = 0, 0, None, []
    for e in ends:
        carry = carried if e["first"] == last else 0
        offsets.append((e["part"], before, e["first"], carry))
        before += e["n"]
        # a range that is one URL's from begin to end hands on what it was handed
        carried, last = e["tail"] + (carry if e["tail"] == e["n"] else 0), e["last"]
    shift = captures.sparkSession.createDataFrame(offsets, "part long, before long, first string, carry long")
    number = F.col("in_part") + F.when(F.col("url_key") == F.col("first"), F.col("carry")).otherwise(0)
    return merged.join(maybe_broadcast(shift, 2_000), "part").select(*NAMES, (F.col("before") + F.col("at")).alias("position"), number.alias("capture_no"))


def capture_history(pages: DataFrame, path: str | None = None, url_col: str = "url", text_col: str = "html", id_col: str = "page_id",
                    seconds: Column | None = None, archive_bytes: int = ARCHIVE_BYTES, merge_rows: int | None = None) -> DataFrame:
    """Archive ``pages`` below ``path`` (a fresh scratch folder if none), read the archives back and merge
    their capture runs. ``seconds`` is the time of capture since 1970; without it the page id counts them."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    seconds = F.pmod(F.col(id_col).cast("long"), F.lit(1 << 31)) if seconds is None else seconds
    files = write_archives(with_originals(pages, url_col, text_col, id_col, seconds), path, archive_bytes)
    return merge_runs(stored(read_archives(spark, path, files), "runs"), merge_rows)


# The same rows in DuckDB: digests, the smallest page id of a payload, and the order of the merged history.
ORACLE_SQL = r"""
with rows as (
  select page_id, coalesce(html, '') as body, url, coalesce(page_id % 2147483648, 0) as ts from pages),
keyed as (
  select *, sha256(body) as payload_digest, octet_length(encode(body)) as payload_bytes,
    regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1)), ':(80|443)$', ''), '^www\.', '') as host,
    regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^#]*)', 1) as rest
  from rows),
surt as (
  select *, case when coalesce(url, '') = '' then '' else array_to_string(list_reverse(string_split(host, '.')), ',') || ')' ||
    case when rest = '' then '/' else rest end end as url_key from keyed),
firsts as (
  select *, min(page_id) over (partition by payload_digest) as first_id,
    row_number() over (order by url_key, ts, page_id) - 1 as "position",
    row_number() over (partition by url_key order by ts, page_id) as capture_no
  from surt)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to,
  "position", capture_no
from firsts
"""
