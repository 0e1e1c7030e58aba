"""Results that must not depend on size, column order, file names or repetition."""

import pytest
from pyspark.sql import functions as F

from seqloom import session
from seqloom.operators import catalog as C
from seqloom.operators import corpus as K
from seqloom.operators import evaluate as E
from seqloom.operators import positions as P
from seqloom.operators import scoring as N
from seqloom.plans import fixtures as X
from seqloom.sources import readers as R
from seqloom.sources import sinks as S
from seqloom.session import scratch_path
from seqloom.streaming import ingest as ST
from tests.test_io_streaming import _write_text

AWKWARD = [(1, "a b"), (1, "b"), (2, None), (3, ""), (4, "zz"), (5, "zz a zz  b"), (None, "a"), (6, "a b")]


def _awkward(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string").repartition(3)
    vocab = spark.createDataFrame([("a", 3), ("a", 5), ("b", 4), ("", 6), ("[UNK]", 7), ("dup", 4)], "token string, id long")
    return docs, vocab


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("on_unknown", ["drop", "unk"])
def test_encode_and_decode_do_not_depend_on_the_strategy(spark, on_unknown):
    docs, vocab = _awkward(spark)
    table, join = (K.encode(docs, vocab, on_unknown=on_unknown, strategy=s) for s in ("table", "join"))
    want = _rows(table, "doc_id", "ids", "len")
    assert want == _rows(join, "doc_id", "ids", "len") and len(want) == len(AWKWARD)
    assert (1, [5, 4], 2) in want and (1, [4], 1) in want and (2, [], 0) in want
    assert (4, [] if on_unknown == "drop" else [7], int(on_unknown == "unk")) in want
    ids = table.select("doc_id", F.when(F.col("doc_id") != 3, F.concat("ids", F.array(F.lit(99)))).alias("ids"))
    back = [_rows(K.decode(ids, vocab, strategy=s), "doc_id", "tokens", "text") for s in ("table", "join")]
    assert back[0] == back[1] and len(back[0]) == len(AWKWARD) and (2, [None], "") in back[0] and (3, [], "") in back[0]


def test_encode_raises_alike_on_unknown_tokens(spark):
    docs, vocab = _awkward(spark)
    for strategy in ("table", "join"):
        with pytest.raises(Exception, match="unknown token: 'zz'"):
            K.encode(docs, vocab, strategy=strategy).collect()


def test_strategy_follows_the_measured_size(spark, monkeypatch):
    docs, vocab = _awkward(spark)
    want = _rows(K.encode(docs, vocab, on_unknown="drop"), "doc_id", "ids")
    reduced = _rows(K.reduce_vocab(docs, 2)[0], "doc_id", "text")
    monkeypatch.setattr(session, "BROADCAST_MAX_BYTES", 0)
    assert _rows(K.encode(docs, vocab, on_unknown="drop"), "doc_id", "ids") == want
    assert _rows(K.reduce_vocab(docs, 2)[0], "doc_id", "text") == reduced


def test_version_wins_at_any_listing_position(spark):
    cat = spark.createDataFrame([("GCF_000000001.2",)], "accession string")
    rows = [("GCF_000000001.2", 0, "GCF_000000001.1_ASM1v2"), ("GCF_000000001.2", 1_500_000, "GCF_000000001.2_ASM1v2")]
    got = C.latest_version(cat, spark.createDataFrame(rows, "accession string, pos int, entry string")).first()
    assert got["subdir"] == "GCF_000000001.2_ASM1v2"


def test_fixture_keys_are_never_cut(spark):
    df = spark.createDataFrame([(7,), (1_000_000,), (12_345_678_901,)], "k long")
    assert [r[0] for r in df.select(X._padded("k", 6)).collect()] == ["000007", "1000000", "12345678901"]


def test_catalog_and_feature_table_by_name(spark):
    d = scratch_path(spark, "t_by_name")
    _write_text(d, "c.tsv", "Annotation Count Gene Total\tX\tAssembly Name\tAssembly Accession\tOrganism Name\n"
                            "4k\tx\tASM1\tGCF_1.1\t\"E. coli \"\"K\"\"\"\n17\tx\tASM2\tGCF_2.1\tB\n")
    got = _rows(R.read_catalog(spark, d), "accession", "assembly_name", "organism", "gene_total", "bad_fields")
    assert got == [("GCF_1.1", "ASM1", 'E. coli "K"', None, ["gene_total"]), ("GCF_2.1", "ASM2", "B", 17, [])]
    ft = scratch_path(spark, "t_ft_by_name")
    head = ["locus_tag", *[h for h in reversed(R.FEATURE_TABLE_HEADER) if h != "locus_tag"], "new"]
    _write_text(ft, "f.tsv", "\t".join(head) + "\n" + "\t".join(f"v{i}" if h not in ("start", "end") else "12" for i, h in enumerate(head)) + "\n")
    r = R.read_feature_table(spark, ft).first()
    assert r["locus_tag"] == "v0" and r["start"] == 12 and r["symbol"] == f"v{head.index('symbol')}"
    assert r["bad_fields"] == ["feature_interval_length", "product_length"]
    with pytest.raises(ValueError, match="no column"):
        _write_text(scratch_path(spark, "x"), "y", "")
        bad = scratch_path(spark, "t_no_column")
        _write_text(bad, "c.tsv", "Assembly Accession\tAssembly Name\nGCF_1.1\tA\n")
        R.read_catalog(spark, bad)


def test_gff_takes_a_malformed_number(spark):
    d = scratch_path(spark, "t_gff_bad")
    _write_text(d, "a.gff", "NC_1\tRefSeq\tgene\tone\t90\t.\t+\t.\tID=a\n")
    r = R.read_gff(spark, d).first()
    assert r["start"] is None and r["end"] == 90


def test_text_corpus_honours_split_and_numbers_over_files(spark):
    d = scratch_path(spark, "t_text_split")
    _write_text(f"{d}/split=train", "a.txt", "one\ntwo\n")
    _write_text(f"{d}/split=val", "a.txt", "three\n")
    _write_text(f"{d}/split=val", "b.txt", "four\nfive\n")
    assert _rows(R.read_corpus(spark, d, split="val", fmt="text"), "doc_id", "text") == [(0, "three"), (1, "four"), (2, "five")]
    assert R.read_corpus(spark, d, fmt="text").count() == 5


def test_second_file_of_a_genome_is_ingested(spark):
    landing, out, ckpt = (scratch_path(spark, n) for n in ("l2", "o2", "c2"))
    gi = spark.createDataFrame([("1", "symA", 1)], "gene_id string, symbol string, ord long")
    one = ">x [gene=abc] [x]\nAC\n>x [db_xref=GeneID:1] [y]\nGG\n"
    _write_text(landing, "GCF_000000009.1_a_cds_from_genomic.fna", one)
    _write_text(landing, "GCF_000000009.1_b_cds_from_genomic.fna", ">x [gene=zzz] [x]\nTT\n")
    _write_text(landing, "GCF_000000009.1_c_cds_from_genomic.fna", one)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    ST.ingest_stream(spark, landing, gi, out, ckpt, max_files_per_trigger=1)
    assert sorted(r["value"] for r in ST.read_ingested(spark, out).collect()) == \
        ["GCF_000000009.1: abc symA", "GCF_000000009.1: zzz"]
    assert sorted(r["value"] for r in ST.read_ingested(spark, out, "nucleotides").collect()) == \
        ["GCF_000000009.1:  AC GG", "GCF_000000009.1:  TT"]
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_ingest_in_go_mode(spark):
    landing, out, ckpt = (scratch_path(spark, n) for n in ("l3", "o3", "c3"))
    go = spark.createDataFrame([("1", ["GO:1", "GO:2"])], "gene_id string, go_terms array<string>")
    gi = spark.createDataFrame([], "gene_id string, symbol string, ord long")
    _write_text(landing, "GCF_000000009.1_a_cds_from_genomic.fna",
                ">x [gene=abc] [x]\nAC\n>x [db_xref=GeneID:1] [y]\nGG\n>x [db_xref=GeneID:2] [y]\nTT\n")
    ST.ingest_stream(spark, landing, gi, out, ckpt, gene_go=go)
    assert [r["value"] for r in ST.read_ingested(spark, out).collect()] == ["GCF_000000009.1: GO:1:GO:2"]
    assert [r["value"] for r in ST.read_ingested(spark, out, "nucleotides").collect()] == ["GCF_000000009.1:  GGTT"]


def test_vocabulary_json_round_trip(spark):
    v = K.build_vocab(spark.createDataFrame([("b",), ("a",), ("c",)], "token string"))
    path = scratch_path(spark, "t_vocab_json")
    S.write_vocab_json(v, path)
    assert _rows(R.read_vocab(spark, path), "token", "id") == _rows(v, "token", "id")


def test_uint16_buffers_round_trip(spark):
    rows = [("train", 0, 3, [0, 65535, 7]), ("train", 1, 0, []), ("val", 0, 2, [256, 1])]
    blocks = spark.createDataFrame(rows, "split string, block_id long, n long, ids array<int>")
    path = scratch_path(spark, "t_u16")
    S.write_shards(blocks, path)
    assert _rows(R.read_shards(spark, path), "split", "block_id", "n", "ids") == sorted(rows, key=str)


def test_empty_sequences_stay(spark):
    model = spark.createDataFrame([("a", "b", 1, 0.0), ("b", "c", 1, 0.0)], "prev string, next string, n long, logp double")
    seqs = spark.createDataFrame([(1, []), (2, ["x", "a"]), (3, None), (4, ["c"])], "seq_id long, tokens array<string>")
    got = {r["seq_id"]: (r["tokens"], r["new"]) for r in N.continue_sequences(seqs, model, 3).collect()}
    assert got == {1: ([], []), 2: (["x", "a", "b", "c"], ["b", "c"]), 3: ([], []), 4: (["c"], [])}


def test_hot_context_token(spark):
    """One token is the context of a third of all pairs: totals and the best successor."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("the w"), F.col("id") % 50, F.lit(" x"), F.col("id"), F.lit(" y")).alias("text"))
    model = N.next_token_counts(docs)
    the = model.where("prev = 'the'").collect()
    assert len(the) == 50 and all(r["n"] == 60 and abs(r["logp"] + 3.912023) < 1e-5 for r in the)
    assert E.best_successor(model).where("prev = 'the'").first()["guess"] == "w0"
    plan = model._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_large_integers_sum_exactly(spark):
    df = spark.createDataFrame([(i, 2 ** 53 + i if i % 3 else None) for i in range(20)], "k long, w long")
    got = {r["k"]: r["cum"] for r in P.running_sum(df, ["k"], "w", partitions=4).collect()}
    acc = 0
    for i in range(20):
        acc += 2 ** 53 + i if i % 3 else 0
        assert got[i] == acc


def test_repeated_queries_keep_nothing(spark):
    from seqloom.plans.queries import REGISTRY
    from tests.conftest import SF0001

    def held():
        return len(spark.sparkContext._jsc.getPersistentRDDs())

    fn = REGISTRY["f3_label_records"][0] if "f3_label_records" in REGISTRY else REGISTRY["genome_sentences"][0]
    fn(spark, SF0001).collect()
    first = held()
    for _ in range(2):
        fn(spark, SF0001).collect()
    assert held() <= first


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
