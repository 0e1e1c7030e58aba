"""ST1's keyed state: what a batch reads does not grow with the batches before, replays add nothing."""

import os
import shutil

from seqloom.session import scratch_path
from seqloom.streaming import ingest as ST
from tests.test_io_streaming import _local, _write_text


def genome(i, body="abc"):
    return f">x [gene={body}] [x]\nAC\n>x [db_xref=GeneID:1] [y]\nG{'ACGT'[i % 4]}{'T' * i}\n"


def lines(spark, out):
    return sorted(r["value"] for r in ST.read_ingested(spark, out).collect())


def test_many_batches_read_a_bounded_amount(spark):
    landing, out, ckpt = (scratch_path(spark, n) for n in ("ls", "os", "cs"))
    gi = spark.createDataFrame([("1", "symA", 1)], "gene_id string, symbol string, ord long")
    read, state, looked_up = [], [], []
    for i in range(8):
        _write_text(landing, f"GCF_{i:09d}.1_cds_from_genomic.fna", genome(i))
        if i:  # a copy of an earlier file, under another name, in every batch
            _write_text(landing, f"GCF_{i - 1:09d}.1_copy{i}_cds_from_genomic.fna", genome(i - 1))
        q = ST.ingest_stream(spark, landing, gi, out, ckpt)
        progress = [p for p in q.recentProgress if p["numInputRows"]]
        read.append(sum(p["numInputRows"] for p in progress))
        ops = [o for p in progress for o in p["stateOperators"]]
        state.append(max(o["numRowsTotal"] for o in ops))
        looked_up.append(sum(o["numRowsUpdated"] for o in ops))
        assert "RocksDB" in str(ops[0]["customMetrics"]) or any("rocksdb" in k for k in ops[0]["customMetrics"])
    assert read == [1] + [2] * 7       # the arrivals of the batch, not the manifest so far
    assert state == list(range(1, 9)) and looked_up == [1] * 8
    assert lines(spark, out) == [f"GCF_{i:09d}.1: abc symA" for i in range(8)]
    assert ST.PROVIDER not in dict(spark.sparkContext.getConf().getAll())


def test_replays_add_nothing(spark):
    landing, out, ckpt = (scratch_path(spark, n) for n in ("lr", "or", "cr"))
    gi = spark.createDataFrame([("1", "symA", 1)], "gene_id string, symbol string, ord long")
    for i in range(3):
        _write_text(landing, f"GCF_{i:09d}.1_cds_from_genomic.fna", genome(i))
        ST.ingest_stream(spark, landing, gi, out, ckpt)
    want = lines(spark, out)
    assert want == [f"GCF_{i:09d}.1: abc symA" for i in range(3)]
    # the last batch of either query ended before its commit was logged
    for query in ("arrivals", "lines"):
        commits = _local(f"{ckpt}/{query}/commits")
        last = max(int(f) for f in os.listdir(commits) if f.isdigit())
        os.unlink(f"{commits}/{last}")
        crc = f"{commits}/.{last}.crc"
        if os.path.exists(crc):
            os.unlink(crc)
    ST.ingest_stream(spark, landing, gi, out, ckpt)
    assert lines(spark, out) == want
    # the arrivals query starts anew and names every file again
    shutil.move(_local(f"{ckpt}/arrivals"), _local(f"{ckpt}/arrivals-lost"))
    ST.ingest_stream(spark, landing, gi, out, ckpt)
    assert lines(spark, out) == want


def test_nothing_landed(spark):
    landing, out, ckpt = (scratch_path(spark, n) for n in ("le", "oe", "ce"))
    gi = spark.createDataFrame([], "gene_id string, symbol string, ord long")
    os.makedirs(_local(landing))
    ST.ingest_stream(spark, landing, gi, out, ckpt)
    assert not os.path.exists(_local(f"{out}/corpus"))


def test_a_name_that_is_a_pattern(spark):
    landing, out, ckpt = (scratch_path(spark, n) for n in ("lp", "op", "cp"))
    gi = spark.createDataFrame([("1", "symA", 1)], "gene_id string, symbol string, ord long")
    _write_text(landing, "GCF_000000003.1_[v1] {a,b}* cds_from_genomic.fna", genome(3))
    ST.ingest_stream(spark, landing, gi, out, ckpt)
    assert lines(spark, out) == ["GCF_000000003.1: abc symA"]
