"""Catalog: version choice, file pick, resume, progress."""

from seqloom.operators import catalog as C


def test_latest_version_cases(spark):
    cat = spark.createDataFrame([(a,) for a in ["GCF_000000001.2", "GCF_000000002.2", "GCF_000000003.2",
                                                "GCF_000000004.2", "GCF_000000005.2"]], "accession string")
    lst = spark.createDataFrame([
        ("GCF_000000001.2", 0, "GCF_000000001.1_ASM1v1"),                       # one entry, other version
        ("GCF_000000002.2", 0, "GCF_000000002.1_ASMv1"), ("GCF_000000002.2", 1, "GCF_000000002.2_ASMv2"),
        ("GCF_000000003.2", 0, "GCF_000000003.2_Av2"), ("GCF_000000003.2", 1, "GCF_000000003.5_Bv2"),
        ("GCF_000000003.2", 2, "GCF_000000003.5_Cv2"),                           # two best: first wins
        ("GCF_000000004.2", 0, "GCF_000000004.1_Av1"), ("GCF_000000004.2", 1, "GCF_000000004.3_Av3"),
    ], "accession string, pos int, entry string")
    got = {r["accession"]: (r["subdir"], r["status"]) for r in C.latest_version(cat, lst).collect()}
    assert got["GCF_000000001.2"] == ("GCF_000000001.1_ASM1v1", "ok")
    assert got["GCF_000000002.2"] == ("GCF_000000002.2_ASMv2", "ok")
    assert got["GCF_000000003.2"] == ("GCF_000000003.5_Bv2", "ok")
    assert got["GCF_000000004.2"] == (None, "no_match")
    assert got["GCF_000000005.2"] == (None, "no_entries")


def test_pick_file_needs_a_character_before_suffix(spark):
    files = spark.createDataFrame([("a", "d", 0, "_cds_from_genomic.fna.gz"), ("a", "d", 1, "x_genomic.fna.gz"),
                                   ("a", "d", 2, "x_cds_from_genomic.fna.gz"), ("a", "d", 3, "y_cds_from_genomic.fna.gz")],
                                  "accession string, dir string, pos int, entry string")
    assert C.pick_file(files).first()["file"] == "x_cds_from_genomic.fna.gz"


def test_manifest_url_and_pending_and_progress(spark):
    located = spark.createDataFrame([("GCF_000195955.2", "GCF_000195955.2_ASM19595v2", "f.gz")],
                                    "accession string, subdir string, file string")
    r = C.fetch_manifest(located).first()
    assert r["dir_path"] == "000/195/955"
    assert r["url"].endswith("/000/195/955/GCF_000195955.2_ASM19595v2/f.gz")
    work = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "accession string, k int")
    done = spark.createDataFrame([("a",)], "accession string")
    assert [x["accession"] for x in C.pending(work, done).collect()] == ["b", "b"]
    res = spark.createDataFrame([("b", 7)], "accession string, missed int")
    prog = {x["accession"]: (x["position"], x["missed"]) for x in C.progress(work, ["k"], res).collect()}
    assert prog == {"b": (0, 7), "a": (1, None)}


def test_refseq_and_shuffle_is_a_permutation(spark):
    cat = spark.createDataFrame([("GCF_1",), ("GCA_2",), ("xGCF_3",)], "accession string")
    assert C.refseq_only(cat).count() == 1
    assert C.refseq_only(cat, mode="contains").count() == 2
    s = C.shuffle(spark.range(50).selectExpr("cast(id as string) as accession"), "accession", seed=3)
    assert sorted(r["idx"] for r in s.collect()) == list(range(50))
