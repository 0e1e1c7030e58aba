import gzip
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from seqloom.llm import warc as W

SCHEMA = "page_id long, url string, html string, file string, n long, digest string"


def pages(spark, rows, partitions=3):
    return spark.createDataFrame([(i, u, h, "f", 1, "d") for i, u, h in rows], SCHEMA).repartition(partitions)


def brute(rows):
    """Digests, revisits and the merged order, from the rows alone."""
    out, first = [], {}
    for i, _, h in rows:
        body = (h or "").encode()
        if i is not None and len(body) >= 100:
            first[body] = min(i, first.get(body, i))
    for i, u, h in rows:
        body = (h or "").encode()
        again = i is not None and len(body) >= 100 and i > first[body]
        out.append((W.url_key(u), (i or 0) % (1 << 31), i is not None, i or 0, len(body), hashlib.sha256(body).hexdigest(),
                    "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=lambda r: r[:4])


def check(got, rows):
    want = brute(rows)
    got = sorted(got, key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(len(rows)))
    seen = {}
    for r, w in zip(got, want):
        assert (r["url_key"], r["ts"], r["page_id"] or 0) == (w[0], w[1], w[3])
        seen[w[0]] = seen.get(w[0], 0) + 1
        assert r["capture_no"] == seen[w[0]]
    # rows that tie on URL key, time and page id may stand in either order
    assert sorted((r["page_id"] is not None, r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1) for r in got) == \
        sorted((w[2], w[3], w[4], w[5], w[6], w[7] or -1) for w in want)


def case():
    r = random.Random(3)
    big = ["<p>" + "wört " * (30 + i) + "</p>\r\n\r\nx" for i in range(4)]
    rows = []
    for i in range(600):
        url = "http://www.hot.example.org/" if i % 3 == 0 else f"https://{r.choice('abc')}.example.com:443/p{r.randrange(20)}?q={i % 2}#f"
        rows.append((i + 5, url, r.choice(big) if r.random() < 0.5 else f"page {i} " * r.randrange(40)))
    rows += [(None, "http://x", big[0]), (None, None, None), (2, "", big[0]), (2, "http://a b\r\nX: y/\x00", big[0]), (900, None, "short"), (901, "u", "short"),
             (902, "noscheme/path", "é" * 50), (903, "http://big/", "z" * 3_000_000), (904, "http://big/", "z" * 3_000_000), (7, "http://again/", big[1])]
    return rows


@pytest.mark.parametrize("shipped", [True, False])
def test_round_trip_revisits_and_history(spark, monkeypatch, shipped):
    rows = case()
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 4000)
    if not shipped:
        monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(W, "HOT", 60)
    check(W.capture_history(pages(spark, rows), archive_bytes=4000, merge_rows=100).collect(),
          [(i, None if u is None else u.replace(" ", "%20").replace("\r\n", "%0D%0A").replace("\x00", "%00"), h) for i, u, h in rows])


class Drip(io.BytesIO):
    def __init__(self, data, step):
        super().__init__(data)
        self.step = step

    def read(self, n=-1):
        return super().read(self.step)


def test_archives_are_warc_files(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200), (3, "http://c/", "x")]
    files = W.write_archives(W.with_originals(pages(spark, rows, 1), "url", "html", "page_id", F.lit(86400)), str(tmp_path / "w"))
    assert [f for f, _ in files] == [f for f in sorted(os.listdir(tmp_path / "w")) if not f.startswith("_")]
    data = b"".join((tmp_path / "w" / f).read_bytes() for f, _ in files)
    records = list(W.parse_records(io.BytesIO(data)))
    assert [data[o:o + n][:2] for o, n, _, _ in records] == [b"\x1f\x8b"] * 3 and sum(n for _, n, _, _ in records) == len(data)
    by = {h["warc-target-uri"]: (h, b) for _, _, h, b in records}
    assert by["http://a/"][1].endswith(b"\r\n\r\n" + b"x" * 200) and by["http://b/"][1].endswith(b"\r\n\r\n")
    assert by["http://b/"][0]["warc-refers-to"] == by["http://a/"][0]["warc-record-id"]
    assert by["http://a/"][0]["warc-date"] == "1970-01-02T00:00:00Z" and by["http://c/"][0]["warc-type"] == "response"
    # the same records without compression
    plain = list(W.parse_records(io.BytesIO(gzip.decompress(data))))
    assert [(h, b) for _, _, h, b in plain] == [(h, b) for _, _, h, b in records]
    for step in (1, 2, 7):  # reads may end anywhere in a record
        for whole, want in ((data, records), (gzip.decompress(data), plain)):
            assert list(W.parse_records(Drip(whole, step))) == want
    with pytest.raises(ValueError):
        list(W.parse_records(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError):
        list(W.parse_records(io.BytesIO(gzip.decompress(data)[:-5])))


def test_empty_table(spark):
    assert W.capture_history(pages(spark, []).where("false")).collect() == []


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((r.randrange(50), i) for _ in range(r.randrange(30))) for i in range(k)]
        assert list(W.loser_tree(runs)) == sorted(x for run in runs for x in run)


def test_url_keys():
    assert W.url_key("HTTPS://www.Example.com:443/A?b=1#c") == "com,example)/A?b=1"
    assert W.url_key("http://example.com") == "com,example)/" and W.url_key(None) == W.url_key("") == ""
