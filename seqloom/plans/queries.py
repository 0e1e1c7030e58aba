"""Registered queries: one per inventory operator, each with its DuckDB oracle.

Each entry maps a name to ``(callable(spark, sf_dir) -> DataFrame, oracle SQL or None)``.
Every query reads the driver tables (through the fixture views) in full.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.hashing import hash_int as _hash_int
from seqloom.functions.text import PY_WHITESPACE_CLASS
from seqloom.operators import annotations as A
from seqloom.operators import catalog as C
from seqloom.operators import contexts as X7
from seqloom.operators import corpus as K
from seqloom.operators import evaluate as E
from seqloom.operators import layout as L
from seqloom.operators import scoring as N
from seqloom.plans import fixtures as X
from seqloom.session import release, scratch_path
from seqloom.sources import readers as R
from seqloom.sources import sinks as S
from seqloom.sources.rawfiles import write_raw
from seqloom.streaming import ingest as ST
from seqloom.plans.oracle_views import with_views as V

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release()  # small tables that earlier queries cached
            return fn(spark, sf_dir)

        REGISTRY[name] = (run, sql)
        return fn
    return deco


# ============================================================== genome side

def labelled(spark, sf):
    return A.label_records(X.cds_records(spark, sf), X.gene_info(spark, sf))


@register("genome_sentences", V("""
SELECT s.accession, s.genes, s.n_genes, m.missed FROM
 (SELECT accession, string_agg(label, ' ' ORDER BY ord) AS genes, count(*) AS n_genes
  FROM labelled WHERE label IS NOT NULL GROUP BY accession) s
JOIN (SELECT accession, count(*) FILTER (WHERE label_source = 'missed') AS missed
      FROM labelled GROUP BY accession) m ON s.accession = m.accession"""))
def q_genome_sentences(spark, sf):
    """Flagship: label every CDS record, per genome the gene sentence, count and missed."""
    return A.genome_summary(labelled(spark, sf))


@register("f1_fasta_records", V("""
SELECT accession, min(line_no) AS ord, max(CASE WHEN h = 1 THEN line END) AS header,
       coalesce(string_agg(CASE WHEN h = 0 THEN line END, '' ORDER BY line_no), '') AS seq
FROM (SELECT *, sum(h) OVER (PARTITION BY accession ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS rec
      FROM (SELECT *, CASE WHEN starts_with(line, '>') THEN 1 ELSE 0 END AS h FROM cds_lines))
GROUP BY accession, rec"""))
def q_f1(spark, sf):
    return A.fasta_records(X.cds_lines(spark, sf))


@register("f2_header_fields", V("SELECT accession, ord, gene, gid, locus FROM fields"))
def q_f2(spark, sf):
    return A.header_fields(X.cds_records(spark, sf)).select("accession", "ord", "gene", "gid", "locus")


@register("f3_label_records", V("SELECT accession, ord, label, label_source FROM labelled"))
def q_f3(spark, sf):
    return labelled(spark, sf).select("accession", "ord", "label", "label_source")


@register("f4_missed_genes", V("""
SELECT accession, count(*) FILTER (WHERE label_source = 'missed') AS missed FROM labelled GROUP BY accession"""))
def q_f4(spark, sf):
    return A.missed_genes(labelled(spark, sf))


@register("f5_go_tokens", V("SELECT accession, ord, label AS go_token FROM go_labelled"))
def q_f5(spark, sf):
    t = A.go_tokens(X.cds_records(spark, sf), A.gene2go_map(X.gene2go(spark, sf)))
    return t.select("accession", "ord", F.col("label").alias("go_token"))


@register("f5_go_sentence", V("""
SELECT accession, string_agg(label, ' ' ORDER BY ord) AS genes, count(*) AS n_genes
FROM go_labelled WHERE label IS NOT NULL GROUP BY accession"""))
def q_f5_sentence(spark, sf):
    t = A.go_tokens(X.cds_records(spark, sf), A.gene2go_map(X.gene2go(spark, sf)))
    return A.gene_sentence(t)


@register("f6_genome_len", V("SELECT accession, count(*) AS genome_len FROM cds GROUP BY accession"))
def q_f6(spark, sf):
    return A.genome_len(X.cds_records(spark, sf))


@register("f7_gene_sentence", V("""
SELECT accession, string_agg(label, ' ' ORDER BY ord) AS genes, count(*) AS n_genes
FROM labelled WHERE label IS NOT NULL GROUP BY accession"""))
def q_f7(spark, sf):
    return A.gene_sentence(labelled(spark, sf))


@register("f8_nt_sentence", V("""
SELECT accession, nt FROM (
  SELECT accession, string_agg(CASE WHEN label IS NOT NULL THEN ' ' ELSE '' END || seq, '' ORDER BY ord) AS nt
  FROM labelled GROUP BY accession) WHERE length(nt) > 0"""))
def q_f8(spark, sf):
    return A.nt_sentence(labelled(spark, sf), mode="symbol")


@register("f9_nt_sentence_go", V("""
SELECT accession, nt FROM (
  SELECT accession, string_agg(CASE WHEN label IS NOT NULL THEN ' ' || seq ELSE seq END, '' ORDER BY ord) AS nt
  FROM go_labelled WHERE gid IS NOT NULL GROUP BY accession) WHERE length(nt) > 0"""))
def q_f9(spark, sf):
    t = A.go_tokens(X.cds_records(spark, sf), A.gene2go_map(X.gene2go(spark, sf)))
    return A.nt_sentence(t, mode="go")


@register("f10_genome_records", V("""
SELECT c.accession,
       CAST(to_json(struct_pack(genes := coalesce(string_split(s.genes, ' '), []::VARCHAR[]),
                                organism := c.organism, gene_total := c.gene_total)) AS VARCHAR) AS record,
       CAST(coalesce(len(string_split(s.genes, ' ')), 0) AS BIGINT) AS found,
       CAST(c.gene_total AS BIGINT) AS declared
FROM catalog c LEFT JOIN (SELECT accession, string_agg(label, ' ' ORDER BY ord) AS genes
                          FROM labelled WHERE label IS NOT NULL GROUP BY accession) s
  ON c.accession = s.accession"""))
def q_f10(spark, sf):
    return A.genome_records(X.catalog(spark, sf), A.gene_sentence(labelled(spark, sf)))


@register("j1_lookup_symbol", V("SELECT accession, ord, symbol FROM labelled"))
def q_j1(spark, sf):
    f = A.header_fields(X.cds_records(spark, sf))
    return A.lookup_symbol(f, X.gene_info(spark, sf)).select("accession", "ord", "symbol")


@register("j2_lookup_go", V("SELECT accession, ord, array_to_string(go_terms, ':') AS go FROM go_labelled"))
def q_j2(spark, sf):
    f = A.header_fields(X.cds_records(spark, sf))
    j = A.lookup_go(f, A.gene2go_map(X.gene2go(spark, sf)))
    return j.select("accession", "ord", F.array_join("go_terms", ":").alias("go"))


@register("j3_gene2go_map", V("""
SELECT gene_id, array_to_string(go_terms, ':') AS go, CAST(len(go_terms) AS BIGINT) AS n_terms FROM gene_go"""))
def q_j3(spark, sf):
    m = A.gene2go_map(X.gene2go(spark, sf))
    return m.select("gene_id", F.array_join("go_terms", ":").alias("go"), F.size("go_terms").cast("bigint").alias("n_terms"))


@register("p4_feature_rows_cds", V("""
SELECT genomic_accession, start, product_accession FROM feature_table WHERE feature = 'CDS'"""))
def q_p4_cds(spark, sf):
    return A.feature_rows(X.feature_table(spark, sf), "CDS")


@register("p4_feature_rows_gene", V("""
SELECT genomic_accession, start, symbol, gene_id FROM feature_table WHERE feature = 'gene'"""))
def q_p4_gene(spark, sf):
    return A.feature_rows(X.feature_table(spark, sf), "gene")


@register("p5_drop_missing", V("""
SELECT genomic_accession, start, product_accession FROM feature_table
WHERE feature = 'CDS' AND product_accession IS NOT NULL"""))
def q_p5(spark, sf):
    return A.drop_missing(A.feature_rows(X.feature_table(spark, sf), "CDS"), "product_accession")


@register("p6_missing_rows", V("""
SELECT genomic_accession, start, product_accession FROM feature_table
WHERE feature = 'CDS' AND product_accession IS NULL"""))
def q_p6(spark, sf):
    return A.missing_rows(A.feature_rows(X.feature_table(spark, sf), "CDS"), "product_accession")


@register("p7_stringify", V("""
SELECT genomic_accession, start, coalesce(symbol, 'nan') AS symbol, gene_id FROM feature_table
WHERE feature = 'gene'"""))
def q_p7(spark, sf):
    return A.stringify(A.feature_rows(X.feature_table(spark, sf), "gene"), "symbol")


@register("p8_gff_rows", V("SELECT seqid, start, \"end\", strand, attributes FROM gff WHERE type = 'gene'"))
def q_p8(spark, sf):
    return A.gff_rows(X.gff(spark, sf), "gene").select("seqid", "start", "end", "strand", "attributes")


_GFF_SQL = ",\n".join(
    f"CASE WHEN regexp_matches(attributes, '(^|;){k}=') THEN regexp_extract(attributes, '(^|;){k}=([^;]*)', 2) END AS {k}"
    for k in A.GFF_KEYS)


@register("p9_gff_attributes", V(f"SELECT seqid, start, {_GFF_SQL} FROM gff WHERE type = 'gene'"))
def q_p9(spark, sf):
    g = A.gff_attributes(A.gff_rows(X.gff(spark, sf), "gene"))
    return g.select("seqid", "start", *A.GFF_KEYS)


@register("p10_count_prefix", V(f"""
SELECT count(*) AS n FROM (SELECT {_GFF_SQL} FROM gff WHERE type = 'gene') WHERE starts_with(Name, 'BHR')"""))
def q_p10(spark, sf):
    g = A.gff_attributes(A.gff_rows(X.gff(spark, sf), "gene"))
    return A.count_prefix(g, "Name", "BHR")


# ============================================================== catalog side

_LATEST_SQL = """
SELECT a.accession,
  CASE WHEN g.n_entries = 1 THEN g.only_entry WHEN g.n_match >= 1 THEN g.best END AS subdir,
  CASE WHEN g.n_entries IS NULL THEN 'no_entries'
       WHEN (CASE WHEN g.n_entries = 1 THEN g.only_entry WHEN g.n_match >= 1 THEN g.best END) IS NULL THEN 'no_match'
       ELSE 'ok' END AS status
FROM (SELECT DISTINCT accession FROM catalog) a LEFT JOIN (
  SELECT accession, count(*) AS n_entries, arg_min(entry, pos) AS only_entry,
         count(*) FILTER (WHERE m) AS n_match,
         arg_max(entry, CASE WHEN m THEN {'d': dgt, 'p': -pos} END) AS best
  FROM (SELECT l.*, (contains(entry, 'v' || right(accession, 1)) OR contains(entry, '.' || right(accession, 1))) AS m,
               coalesce(CAST(NULLIF(regexp_extract(entry, '^GCF_[0-9]+\\.([0-9])_.+$', 1), '') AS BIGINT), -1) AS dgt
        FROM listing l)
  GROUP BY accession) g ON a.accession = g.accession"""


@register("p1_refseq_only", V("SELECT accession, assembly_name FROM catalog WHERE starts_with(accession, 'GCF')"))
def q_p1(spark, sf):
    return C.refseq_only(X.catalog(spark, sf)).select("accession", "assembly_name")


@register("p1_refseq_contains", V("SELECT accession FROM catalog WHERE contains(accession, 'GCF_')"))
def q_p1b(spark, sf):
    return C.refseq_only(X.catalog(spark, sf), mode="contains").select("accession")


@register("p2_latest_version", V(_LATEST_SQL))
def q_p2(spark, sf):
    return C.latest_version(X.catalog(spark, sf), X.listing(spark, sf))


_PICK_SQL = """
SELECT accession, dir, arg_min(entry, pos) FILTER (WHERE ok) AS file FROM (
  SELECT *, ends_with(entry, '{suffix}') AND length(entry) > {n} AS ok FROM files) GROUP BY accession, dir"""


@register("p3_pick_file", V(_PICK_SQL.format(suffix=C.CDS_SUFFIX, n=len(C.CDS_SUFFIX))))
def q_p3(spark, sf):
    return C.pick_file(X.files(spark, sf), C.CDS_SUFFIX)


@register("k5_fetch_manifest", V(f"""
SELECT lt.accession, lt.subdir, p.file,
       CASE WHEN lt.status = 'ok' AND p.file IS NULL THEN 'no_file' ELSE lt.status END AS status,
       concat_ws('/', substr(lt.accession, 5, 3), substr(lt.accession, 8, 3), substr(lt.accession, 11, 3)) AS dir_path,
       CASE WHEN lt.subdir IS NOT NULL AND p.file IS NOT NULL THEN concat_ws('/', '{C.DEFAULT_BASE_URL}',
            substr(lt.accession, 5, 3), substr(lt.accession, 8, 3), substr(lt.accession, 11, 3), lt.subdir, p.file) END AS url
FROM ({_LATEST_SQL}) lt LEFT JOIN ({_PICK_SQL.format(suffix=C.CDS_SUFFIX, n=len(C.CDS_SUFFIX))}) p
  ON lt.accession = p.accession AND lt.subdir = p.dir"""))
def q_k5(spark, sf):
    return C.locate(X.catalog(spark, sf), X.listing(spark, sf), X.files(spark, sf))


@register("k4_pending", V(f"""
SELECT accession FROM catalog WHERE starts_with(accession, 'GCF') AND accession NOT IN (
  SELECT lt.accession FROM ({_LATEST_SQL}) lt
  JOIN ({_PICK_SQL.format(suffix=C.CDS_SUFFIX, n=len(C.CDS_SUFFIX))}) p
    ON lt.accession = p.accession AND lt.subdir = p.dir
  WHERE lt.status = 'ok' AND p.file IS NOT NULL)"""))
def q_k4(spark, sf):
    """Genomes still to fetch: the RefSeq work list minus the ones located successfully."""
    done = C.locate(X.catalog(spark, sf), X.listing(spark, sf), X.files(spark, sf)).where(F.col("status") == "ok")
    return C.pending(C.refseq_only(X.catalog(spark, sf)).select("accession"), done)


@register("k6_progress", V("""
SELECT w.accession, w.position, m.missed FROM
 (SELECT accession, min(position) AS position FROM
   (SELECT accession, row_number() OVER (ORDER BY suppkey) - 1 AS position
    FROM catalog WHERE starts_with(accession, 'GCF')) GROUP BY accession) w
LEFT JOIN (SELECT accession, count(*) FILTER (WHERE label_source = 'missed') AS missed
           FROM labelled GROUP BY accession) m ON w.accession = m.accession"""))
def q_k6(spark, sf):
    work = C.refseq_only(X.catalog(spark, sf))
    return C.progress(work, ["suppkey"], A.missed_genes(labelled(spark, sf)))


@register("w1_shuffle", V("""
SELECT accession, row_number() OVER (ORDER BY ('0x' || substr(md5(concat('42', ':', accession)), 1, 15))::BIGINT,
                                     accession) - 1 AS idx
FROM catalog WHERE starts_with(accession, 'GCF')"""))
def q_w1(spark, sf):
    return C.shuffle(C.refseq_only(X.catalog(spark, sf)).select("accession"), "accession", seed=42)


# ============================================================== corpus side


WS = PY_WHITESPACE_CLASS + "+"
MAX_VOCAB = 65533
SPLIT_SEED = 42
VAL_FRAC = 0.03
BLOCK = 1024
PLACES = 1000003  # places are weights modulo this


class CorpusFlow:
    """The corpus chain of one (session, folder): reduce, vocabulary, encode, split, frame, pack.

    Every link is made when it is first asked for, so a query pays for what it reads. Links that
    several actions share are persisted; each is a deterministic function of its inputs (ordered
    regroups, total-order top-k, checkpointed ids), so a lost cached block is recomputed identically.
    """

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        self.docs = X.corpus(spark, sf)

    @cached_property
    def _reduction(self):
        reduced, kept = K.reduce_vocab(self.docs, MAX_VOCAB)
        return reduced.persist(), kept.persist()

    @property
    def reduced(self):
        return self._reduction[0]

    @property
    def kept(self):
        return self._reduction[1]

    @cached_property
    def vocab(self):
        return K.build_vocab(self.kept).persist()

    @cached_property
    def encoded(self):
        return K.encode(self.reduced, self.vocab).persist()

    @cached_property
    def max_len(self):
        return int(K.max_len(self.reduced).first()["max_len"])

    @cached_property
    def splits(self):
        return L.split_exact(self.reduced.select("doc_id"), "doc_id", VAL_FRAC, SPLIT_SEED)

    @cached_property
    def framed(self):
        return L.frame_and_pad(self.encoded.join(self.splits, "doc_id"), self.max_len)

    @cached_property
    def compact(self):
        return L.frame(self.encoded.join(self.splits, "doc_id"), self.max_len)  # ids and a pad count

    @cached_property
    def blocks(self):
        return L.pack(self.compact, BLOCK, ["order_key"])

    @cached_property
    def padded_blocks(self):
        return L.pack(self.compact, BLOCK, ["order_key"], zeros=S.ZEROS)  # the same blocks, their padding a count


def flow(spark, sf) -> CorpusFlow:
    return X._cached(spark, sf, "corpus_flow", lambda: CorpusFlow(spark, sf))


def _ids_str(col="ids"):
    return F.array_join(F.col(col), " ")


_CORPUS_CTES = [
    ("toks", f"""SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '') AS l FROM corpus)"""),
    ("counts", "SELECT token, count(*) AS n FROM toks GROUP BY token"),
    ("kept", f"SELECT token, n FROM counts ORDER BY n DESC, token LIMIT {MAX_VOCAB}"),
    ("reduced", """SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM toks
  WHERE token IN (SELECT token FROM kept) GROUP BY doc_id"""),
    ("vocab", """SELECT token, max(id) AS id FROM (
  SELECT '[PAD]' AS token, 0 AS id UNION ALL SELECT '[EOS]', 1 UNION ALL SELECT '[SOS]', 2
  UNION ALL SELECT token, row_number() OVER (ORDER BY token) + 2 FROM kept) GROUP BY token"""),
    ("enc_toks", """SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM (
  SELECT doc_id, string_split(text, ' ') AS l FROM reduced)"""),
    ("encoded", """SELECT e.doc_id, list(v.id ORDER BY e.pos) AS ids FROM enc_toks e JOIN vocab v ON e.token = v.token
  GROUP BY e.doc_id"""),
    ("splits", f"""SELECT doc_id, order_key, CASE WHEN order_key < k THEN 'val' ELSE 'train' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5(concat('{SPLIT_SEED}', ':', CAST(doc_id AS VARCHAR))), 1, 15))::BIGINT,
                                    doc_id) - 1 AS order_key,
         ceil({VAL_FRAC}::DOUBLE * count(*) OVER ()) AS k FROM reduced)"""),
    ("maxlen", "SELECT max(length(text) - length(replace(text, ' ', '')) + 1) AS m FROM reduced"),
    ("framed", """SELECT e.doc_id, s.split, s.order_key,
       list_concat([2], e.ids, [1], list_transform(range(greatest((SELECT m FROM maxlen) - len(e.ids) - 2, 0)), lambda x: 0)) AS ids
  FROM encoded e JOIN splits s ON e.doc_id = s.doc_id"""),
    ("stream", """SELECT split, CAST(off + i - 1 AS BIGINT) AS pos, ids[i] AS id FROM (
  SELECT split, ids, coalesce(sum(len(ids)) OVER (PARTITION BY split ORDER BY order_key
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
         unnest(generate_series(1, len(ids))) AS i FROM framed)"""),
]
_CORPUS_NAMES = [n for n, _ in _CORPUS_CTES]


def CV(body: str) -> str:
    """Oracle SQL over the corpus chain: includes the corpus CTEs the body needs."""
    import re as _re
    need = set()
    stack = [n for n in _CORPUS_NAMES if _re.search(rf"\b{n}\b", body)]
    sql = dict(_CORPUS_CTES)
    while stack:
        n = stack.pop()
        if n in need:
            continue
        need.add(n)
        stack += [m for m in _CORPUS_NAMES if m != n and _re.search(rf"\b{m}\b", sql[n])]
    return V(body, extra=[(n, sql[n]) for n in _CORPUS_NAMES if n in need])


@register("p11_row_slice", V("""
SELECT genomic_accession, start, product_accession FROM feature_table WHERE feature = 'CDS'
ORDER BY genomic_accession, start LIMIT 4 OFFSET 20"""))
def q_p11(spark, sf):
    cds = A.feature_rows(X.feature_table(spark, sf), "CDS")
    return K.row_slice(cds, 20, 24, ["genomic_accession", "start"])


@register("p11_first_rows_of_split", CV("""
SELECT r.doc_id, r.text FROM reduced r JOIN splits s ON r.doc_id = s.doc_id
WHERE s.split = 'val' ORDER BY s.order_key LIMIT 3"""))
def q_p11_split(spark, sf):
    f = flow(spark, sf)
    val = f.reduced.join(f.splits.where(F.col("split") == "val"), "doc_id")
    return K.row_slice(val, 0, 3, ["order_key"]).select("doc_id", "text")


@register("p12_clean_tokens", V("""
SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda t: NOT contains(t, '_')), ' ') AS text
FROM token_clean_input"""))
def q_p12(spark, sf):
    return K.clean_tokens(X.token_clean_input(spark, sf))


@register("p12_clean_gene_lines", V("""
SELECT accession, array_to_string(list_filter(string_split(accession || ': ' || genes, ' '),
                                              lambda t: NOT contains(t, '_')), ' ') AS text
FROM (SELECT accession, string_agg(label, ' ' ORDER BY ord) AS genes FROM labelled WHERE label IS NOT NULL
      GROUP BY accession)"""))
def q_p12_lines(spark, sf):
    s = A.gene_sentence(labelled(spark, sf))
    lines = s.select("accession", F.concat("accession", F.lit(": "), "genes").alias("text"))
    return K.clean_tokens(lines)


@register("p13_drop_text", CV("""
SELECT doc_id, CAST(len(ids) AS BIGINT) AS len FROM encoded"""))
def q_p13(spark, sf):
    f = flow(spark, sf)
    enc = K.encode(f.reduced, f.vocab)
    return K.drop_columns(enc.join(f.reduced, "doc_id"), "text", "ids")


@register("a1_unique_tokens", CV("SELECT DISTINCT token FROM toks"))
def q_a1(spark, sf):
    return K.unique_tokens(X.corpus(spark, sf))


@register("a2_vocab_size", CV("SELECT count(DISTINCT token) AS vocab_size FROM toks"))
def q_a2(spark, sf):
    return K.vocab_size(X.corpus(spark, sf))


_LEN = "(length(text) - length(replace(text, ' ', '')) + 1)"


@register("a3_length_stats", V(f"""
SELECT min({_LEN}) AS min_len, max({_LEN}) AS max_len, round(avg({_LEN}), 6) AS avg_len,
       round(median({_LEN}), 6) AS median_len FROM corpus"""))
def q_a3(spark, sf):
    return K.length_stats(X.corpus(spark, sf))


@register("a4_longest", V(f"""
SELECT row_number() OVER (ORDER BY n_tokens) - 1 AS pos, n_tokens FROM (
  SELECT {_LEN} AS n_tokens FROM corpus ORDER BY n_tokens DESC LIMIT 20)"""))
def q_a4(spark, sf):
    return K.longest(X.corpus(spark, sf), 20)


@register("a5_max_len", CV("SELECT m AS max_len FROM maxlen"))
def q_a5(spark, sf):
    return K.max_len(flow(spark, sf).reduced)


@register("a6_split_sizes", CV("SELECT split, count(*) AS n FROM splits GROUP BY split"))
def q_a6(spark, sf):
    return L.split_sizes(flow(spark, sf).splits)


@register("a7_packed_length", CV("SELECT split, CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM framed GROUP BY split"))
def q_a7(spark, sf):
    return L.packed_length(flow(spark, sf).framed)


@register("a8_reduce_vocab", CV("SELECT doc_id, text FROM reduced"))
def q_a8(spark, sf):
    return flow(spark, sf).reduced


@register("a8_kept_tokens", CV("SELECT token, n FROM kept"))
def q_a8_kept(spark, sf):
    return flow(spark, sf).kept


@register("w3_dense_index", CV("SELECT token, CAST(id AS BIGINT) AS id FROM vocab"))
def q_w3(spark, sf):
    return flow(spark, sf).vocab


@register("j4_encode", CV("""
SELECT doc_id, array_to_string(ids, ' ') AS ids, CAST(len(ids) AS BIGINT) AS len FROM encoded"""))
def q_j4(spark, sf):
    f = flow(spark, sf)
    return f.encoded.select("doc_id", _ids_str().alias("ids"), "len")


@register("j4_encode_join", CV("""
SELECT doc_id, array_to_string(ids, ' ') AS ids, CAST(len(ids) AS BIGINT) AS len FROM encoded"""))
def q_j4_join(spark, sf):
    f = flow(spark, sf)
    return K.encode(f.reduced, f.vocab, strategy="join").select("doc_id", _ids_str().alias("ids"), "len")


@register("j5_decode", CV("SELECT doc_id, text FROM reduced"))
def q_j5(spark, sf):
    f = flow(spark, sf)
    return K.decode(f.encoded, f.vocab).select("doc_id", "text")


@register("j5_decode_join", CV("SELECT doc_id, text FROM reduced"))
def q_j5_join(spark, sf):
    f = flow(spark, sf)
    return K.decode(f.encoded, f.vocab, strategy="join").select("doc_id", "text")


@register("w2_split_exact", CV("SELECT doc_id, split, order_key FROM splits"))
def q_w2(spark, sf):
    return flow(spark, sf).splits


@register("w4_frame_and_pad", CV("""
SELECT doc_id, split, CAST(len(ids) AS BIGINT) AS len, md5(array_to_string(ids, ' ')) AS ids_md5 FROM framed"""))
def q_w4(spark, sf):
    f = flow(spark, sf)
    return f.framed.select("doc_id", "split", "len", F.md5(_ids_str()).alias("ids_md5"))


@register("w5_pack", CV(f"""
SELECT split, pos // {BLOCK} AS block_id, count(*) AS n,
       md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos)) AS ids_md5
FROM stream GROUP BY split, pos // {BLOCK}"""))
def q_w5(spark, sf):
    b = flow(spark, sf).blocks
    return b.select("split", "block_id", "n", F.md5(_ids_str()).alias("ids_md5"))


@register("w6_contiguous_shards", CV("""
SELECT split, shard, min(row) AS first_row, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_tokens FROM (
  SELECT split, row, n, CASE WHEN row < (d + 1) * md THEN row // (d + 1) ELSE md + (row - (d + 1) * md) // d END AS shard
  FROM (SELECT split, row, n, cnt // least(1024, cnt) AS d, cnt % least(1024, cnt) AS md FROM (
    SELECT split, row_number() OVER (PARTITION BY split ORDER BY order_key) - 1 AS row, len(ids) AS n,
           count(*) OVER (PARTITION BY split) AS cnt FROM framed)))
GROUP BY split, shard"""))
def q_w6(spark, sf):
    f = flow(spark, sf)
    sh = L.contiguous_shards(f.compact, ["order_key"], 1024)
    return sh.groupBy("split", "shard").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n_rows"),
                                            F.sum("len").cast("bigint").alias("n_tokens"))


W7_DRAWS, W7_SEED = 64, 7


@register("w7_sample_blocks", CV(f"""
SELECT d.draw_id, d.start,
       md5(string_agg(CAST(s.id AS VARCHAR), ' ' ORDER BY s.pos) FILTER (WHERE s.pos < d.start + {BLOCK})) AS x_md5,
       md5(string_agg(CAST(s.id AS VARCHAR), ' ' ORDER BY s.pos) FILTER (WHERE s.pos > d.start)) AS y_md5
FROM (SELECT draw_id, ('0x' || substr(md5(concat('{W7_SEED}', ':', 'train', ':', CAST(draw_id AS VARCHAR))), 1, 15))::BIGINT
                      % ((SELECT count(*) FROM stream WHERE split = 'train') - {BLOCK}) AS start
      FROM range(0, {W7_DRAWS}) t(draw_id)) d
JOIN stream s ON s.split = 'train' AND s.pos BETWEEN d.start AND d.start + {BLOCK}
GROUP BY d.draw_id, d.start"""))
def q_w7(spark, sf):
    f = flow(spark, sf)
    total = f.compact.where("split = 'train'").agg(F.sum("len")).first()[0] or 0
    s = L.sample_blocks(f.blocks, "train", W7_DRAWS, BLOCK, W7_SEED, total=total)
    return s.select("draw_id", "start", F.md5(_ids_str("x")).alias("x_md5"), F.md5(_ids_str("y")).alias("y_md5"))


@register("w8_crop_tail", CV("""
SELECT doc_id, array_to_string(CASE WHEN len(ids) <= 16 THEN ids ELSE ids[len(ids) - 15:] END, ' ') AS tail
FROM encoded"""))
def q_w8(spark, sf):
    e = L.crop_tail(flow(spark, sf).encoded, 16, out="tail")
    return e.select("doc_id", _ids_str("tail").alias("tail"))


# ============================================================== scoring and evaluation



def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


def logits_table(spark, sf):
    """Logits from the embeddings table: one row per (vector, dimension), scaled by 10."""
    e = X.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token_id", "v")).select(
        "row_id", F.col("token_id").cast("bigint").alias("token_id"), (F.col("v").cast("double") * 10).alias("logit"))


def targets_table(spark, sf):
    e = X.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"),
                    F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).cast("bigint").alias("target"))


_SCORE_CTES = [
    ("logits", """SELECT vec_id AS row_id, CAST(i - 1 AS BIGINT) AS token_id, CAST(embedding[i] AS DOUBLE) * 10 AS logit
FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)"""),
    ("targets", "SELECT vec_id AS row_id, CAST(CASE WHEN label = 0 THEN -1 ELSE label END AS BIGINT) AS target FROM embeddings"),
    ("row_loss", """SELECT t.row_id, m.lse - l.logit AS loss FROM targets t
JOIN (SELECT row_id, max(logit) + ln(sum(exp(logit - mx))) AS lse FROM
      (SELECT *, max(logit) OVER (PARTITION BY row_id) AS mx FROM logits) GROUP BY row_id) m ON t.row_id = m.row_id
LEFT JOIN logits l ON l.row_id = t.row_id AND l.token_id = t.target
WHERE t.target <> -1"""),
]


def SV(body: str) -> str:
    import re as _re
    used = [n for n, _ in _SCORE_CTES if _re.search(rf"\b{n}\b", body) or n in ("logits", "targets")]
    return V(body, extra=[(n, s) for n, s in _SCORE_CTES if n in used])


@register("n2_cross_entropy", SV("SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM row_loss"))
def q_n2(spark, sf):
    ce = N.cross_entropy(logits_table(spark, sf), targets_table(spark, sf), ignore_index=-1)
    return ce.select(_r("loss"), "n")


@register("n3_split_loss", SV("""
SELECT split, round(avg(loss), 6) AS loss, count(*) AS n FROM (
  SELECT *, CASE WHEN ('0x' || substr(md5(concat('3', ':', CAST(row_id AS VARCHAR))), 1, 15))::BIGINT % 5 = 0
                 THEN 'val' ELSE 'train' END AS split FROM row_loss) GROUP BY split"""))
def q_n3(spark, sf):
    rows = N.cross_entropy_rows(logits_table(spark, sf), targets_table(spark, sf))
    rows = rows.withColumn("split", F.when(_hash_int(3, "row_id") % 5 == 0, "val").otherwise("train"))
    return N.split_loss(rows).select("split", _r("loss"), "n")


@register("n4_softmax", SV("""
SELECT row_id, token_id, round(e / sum(e) OVER (PARTITION BY row_id), 6) AS p FROM (
  SELECT row_id, token_id, exp((logit - max(logit) OVER (PARTITION BY row_id)) / 0.8) AS e FROM logits)"""))
def q_n4(spark, sf):
    return N.softmax(logits_table(spark, sf), temperature=0.8).select("row_id", "token_id", _r("p"))


@register("n5_top_k", SV("""
SELECT row_id, token_id, CASE WHEN r <= 5 THEN round(logit, 6) ELSE '-inf'::DOUBLE END AS logit,
       CAST(r <= 5 AS INTEGER) AS kept
FROM (SELECT *, rank() OVER (PARTITION BY row_id ORDER BY logit DESC) AS r FROM logits)"""))
def q_n5(spark, sf):
    t = N.top_k(logits_table(spark, sf), 5)
    cropped = F.when(F.col("logit") == N.NEG_INF, F.col("logit")).otherwise(F.round("logit", 6))
    return t.select("row_id", "token_id", cropped.alias("logit"), F.col("kept").cast("int").alias("kept"))


@register("n6_sample_token", SV("""
SELECT row_id, coalesce(min(token_id) FILTER (WHERE cum > u), max(token_id)) AS token_id FROM (
  SELECT row_id, token_id, sum(p) OVER (PARTITION BY row_id ORDER BY token_id ROWS UNBOUNDED PRECEDING) AS cum,
         ('0x' || substr(md5(concat('5', ':', CAST(row_id AS VARCHAR), ':', '0')), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM (SELECT row_id, token_id, e / sum(e) OVER (PARTITION BY row_id) AS p FROM (
        SELECT row_id, token_id, exp(logit - max(logit) OVER (PARTITION BY row_id)) AS e FROM logits)))
GROUP BY row_id"""))
def q_n6(spark, sf):
    return N.sample_token(N.softmax(logits_table(spark, sf)), seed=5, step=0)


def _train_val(spark, sf):
    f = flow(spark, sf)
    docs = f.reduced.join(f.splits, "doc_id")
    return docs.where(F.col("split") == "train"), docs.where(F.col("split") == "val")


_MODEL_CTES = """
pairs_all AS (SELECT doc_id, i AS pos, l[i] AS prev, l[i + 1] AS next FROM (
  SELECT doc_id, l, unnest(generate_series(1, len(l) - 1)) AS i FROM (
    SELECT doc_id, string_split(text, ' ') AS l FROM reduced) WHERE len(l) >= 2)),
pairs_tr AS (SELECT p.* FROM pairs_all p JOIN splits s ON p.doc_id = s.doc_id WHERE s.split = 'train'),
pairs_val AS (SELECT p.* FROM pairs_all p JOIN splits s ON p.doc_id = s.doc_id WHERE s.split = 'val'),
model_all AS (SELECT prev, next, count(*) AS n, ln(count(*) / sum(count(*)) OVER (PARTITION BY prev)) AS logp
              FROM pairs_all GROUP BY prev, next),
model_tr AS (SELECT prev, next, count(*) AS n, ln(count(*) / sum(count(*)) OVER (PARTITION BY prev)) AS logp
             FROM pairs_tr GROUP BY prev, next)"""


def MV(body: str) -> str:
    """Corpus-chain SQL plus the count-model CTEs."""
    full = CV("SELECT 1 FROM reduced, splits")
    head = full[:full.rindex("SELECT 1 FROM reduced, splits")].rstrip()
    return head + ",\n" + _MODEL_CTES.strip() + "\n" + body.strip()


@register("n1_next_token_counts", MV("SELECT prev, next, n, round(logp, 6) AS logp FROM model_all"))
def q_n1(spark, sf):
    m = N.next_token_counts(flow(spark, sf).reduced)
    return m.select("prev", "next", "n", _r("logp"))


N7_SEED = 11
_U = "('0x' || substr(md5(concat('{seed}', ':', CAST(seq_id AS VARCHAR), ':', '{step}')), 1, 8))::BIGINT / 4294967296.0"


@register("n7_continue_sequences", MV(f"""
, c2 AS (SELECT prev, next, logp AS logit, rank() OVER (PARTITION BY prev ORDER BY logp DESC) AS rk FROM model_tr),
c3 AS (SELECT prev, next, exp(logit - max(logit) OVER (PARTITION BY prev)) AS e FROM c2 WHERE rk <= 1),
c4 AS (SELECT prev, next, e / sum(e) OVER (PARTITION BY prev) AS p FROM c3),
c5 AS (SELECT prev, next, sum(p) OVER (PARTITION BY prev ORDER BY next ROWS UNBOUNDED PRECEDING) AS cum,
              lead(next) OVER (PARTITION BY prev ORDER BY next) IS NULL AS last,
              lag(1) OVER (PARTITION BY prev ORDER BY next) IS NULL AS first FROM c4),
cand AS (SELECT prev, next,
                coalesce(lag(cum) OVER (PARTITION BY prev ORDER BY next), 0.0) AS lo,
                CASE WHEN last THEN 'inf'::DOUBLE ELSE cum END AS hi FROM c5),
s0 AS (SELECT doc_id AS seq_id, string_split(text, ' ') AS l FROM reduced),
s1 AS (SELECT seq_id, l, {_U.format(seed=N7_SEED, step=0)} AS u1, {_U.format(seed=N7_SEED, step=1)} AS u2 FROM s0),
s2 AS (SELECT s1.*, (SELECT min(next) FROM cand c WHERE c.prev = s1.l[-1] AND c.lo <= s1.u1 AND s1.u1 < c.hi) AS t1 FROM s1),
s3 AS (SELECT s2.*, (SELECT min(next) FROM cand c WHERE c.prev = s2.t1 AND c.lo <= s2.u2 AND s2.u2 < c.hi) AS t2 FROM s2)
SELECT seq_id, coalesce(concat_ws(' ', t1, CASE WHEN t1 IS NOT NULL THEN t2 END), '') AS new,
       CAST((t1 IS NOT NULL)::INT + (t1 IS NOT NULL AND t2 IS NOT NULL)::INT AS BIGINT) AS n_new FROM s3"""))
def q_n7(spark, sf):
    train, _ = _train_val(spark, sf)
    model = N.next_token_counts(train)
    seqs = flow(spark, sf).reduced.select(F.col("doc_id").alias("seq_id"), F.split("text", " ", -1).alias("tokens"))
    out = N.continue_sequences(seqs, model, steps=2, temperature=1.0, k=1, seed=N7_SEED)
    return out.select("seq_id", F.array_join("new", " ").alias("new"), F.size("new").cast("bigint").alias("n_new"))


N7_ORDER, N7_K = 3, 4
_N7_STEP = """
a{i} AS (SELECT seq_id, l, new, lvl, array_to_string(l[len(l) - lvl + 1:], ' ') AS ctx FROM s{i}, lvls WHERE lvl <= len(l)),
b{i} AS (SELECT a.seq_id, arg_max(a.ctx, a.lvl) AS ctx, max(a.lvl) AS lvl, arg_max(t.total, a.lvl) AS total
  FROM a{i} a JOIN tot t ON t.lvl = a.lvl AND t.ctx = a.ctx GROUP BY a.seq_id),
d{i} AS (SELECT b.seq_id, c.next FROM (SELECT *,
  ('0x' || substr(md5(concat('{seed}', ':', CAST(seq_id AS VARCHAR), ':', '{i}')), 1, 15))::BIGINT % total AS r FROM b{i}) b
  JOIN ivs c ON c.lvl = b.lvl AND c.ctx = b.ctx AND c.lo <= b.r AND b.r < c.hi),
s{j} AS (SELECT s.seq_id, CASE WHEN d.next IS NULL THEN [] ELSE list_append(s.l, d.next)[-{order}:] END AS l,
  CASE WHEN d.next IS NULL THEN s.new ELSE list_append(s.new, d.next) END AS new FROM s{i} s LEFT JOIN d{i} d USING (seq_id)),"""


@register("n7_contexts", MV(f"""
, lvls AS (SELECT unnest(range(1, {N7_ORDER} + 1)) AS lvl),
tr AS (SELECT string_split(r.text, ' ') AS l FROM reduced r JOIN splits s ON r.doc_id = s.doc_id WHERE s.split = 'train'),
cts AS (SELECT lvl, ctx, next, count(*) AS n FROM (
  SELECT lvl, array_to_string(l[i - lvl:i - 1], ' ') AS ctx, l[i] AS next FROM (
    SELECT l, unnest(generate_series(2, len(l))) AS i FROM tr WHERE len(l) >= 2), lvls WHERE lvl < i) GROUP BY lvl, ctx, next),
top AS (SELECT lvl, ctx, next, n FROM (SELECT *, rank() OVER (PARTITION BY lvl, ctx ORDER BY n DESC) AS rk FROM cts) WHERE rk <= {N7_K}),
ivs AS (SELECT lvl, ctx, next, CAST(sum(n) OVER w - n AS BIGINT) AS lo, CAST(sum(n) OVER w AS BIGINT) AS hi FROM top
  WINDOW w AS (PARTITION BY lvl, ctx ORDER BY next ROWS UNBOUNDED PRECEDING)),
tot AS (SELECT lvl, ctx, CAST(sum(n) AS BIGINT) AS total FROM top GROUP BY lvl, ctx),
s0 AS (SELECT doc_id AS seq_id, string_split(text, ' ')[-{N7_ORDER}:] AS l, []::VARCHAR[] AS new FROM reduced),
""" + "".join(_N7_STEP.format(i=i, j=i + 1, seed=N7_SEED, order=N7_ORDER) for i in range(3)).rstrip(",") + """
SELECT seq_id, array_to_string(new, ' ') AS new, CAST(len(new) AS BIGINT) AS n_new FROM s3"""))
def q_n7_contexts(spark, sf):
    """Contexts of up to three tokens with back-off, the four most frequent successors, three draws."""
    train, _ = _train_val(spark, sf)
    seqs = flow(spark, sf).reduced.select(F.col("doc_id").alias("seq_id"), F.split("text", " ", -1).alias("tokens"))
    out = X7.continue_in_context(seqs, X7.context_counts(train, N7_ORDER), steps=3, block_size=BLOCK, k=N7_K, seed=N7_SEED)
    return out.select("seq_id", F.array_join("new", " ").alias("new"), F.size("new").cast("bigint").alias("n_new"))


@register("n7_context_counts", MV(f"""
SELECT level, ctx, next, count(*) AS n FROM (
  SELECT lvl AS level, array_to_string(l[i - lvl:i - 1], ' ') AS ctx, l[i] AS next FROM (
    SELECT l, unnest(generate_series(2, len(l))) AS i FROM (SELECT string_split(text, ' ') AS l FROM reduced) WHERE len(l) >= 2),
    (SELECT CAST(unnest(range(1, {N7_ORDER} + 1)) AS INTEGER) AS lvl) WHERE lvl < i) GROUP BY level, ctx, next"""))
def q_n7_counts(spark, sf):
    return X7.context_counts(flow(spark, sf).reduced, N7_ORDER)


_E1_BODY = """
SELECT {by} count(*) AS n, round(avg(CASE WHEN a = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg((a - p) * (a - p)), 2) AS mse, round(sqrt(avg((a - p) * (a - p))), 2) AS rmse,
       round(avg(CASE WHEN a <> 0 THEN abs((a - p) / a) END), 6) AS mape
FROM ({src}) {group}"""


@register("e1_prediction_metrics", V(_E1_BODY.format(
    by="l_returnflag,", src="SELECT l_returnflag, l_extendedprice AS a, l_quantity * 1000 AS p FROM lineitem",
    group="GROUP BY l_returnflag")))
def q_e1(spark, sf):
    li = X.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("actual"),
                                               (F.col("l_quantity") * 1000).alias("predicted"))
    m = E.prediction_metrics(li, by=["l_returnflag"])
    return m.select("l_returnflag", "n", _r("accuracy"), _r("mse", 2), _r("rmse", 2), _r("mape"))


@register("e1_label_metrics", V(_E1_BODY.format(
    by="", src="SELECT CAST(quality AS DOUBLE) AS a, CAST(1 - toxic AS DOUBLE) AS p FROM labels", group="")))
def q_e1_labels(spark, sf):
    lb = X.table(spark, sf, "labels").select(F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("predicted"))
    m = E.prediction_metrics(lb)
    return m.select("n", _r("accuracy"), _r("mse", 2), _r("rmse", 2), _r("mape"))


_WS_LIST = f"list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '')"
_E2_CTES = [
    ("g_tok", f"SELECT DISTINCT doc_id, unnest({_WS_LIST}) AS token FROM generated_corpus"),
    ("r_tok", f"SELECT DISTINCT unnest({_WS_LIST}) AS token FROM real_corpus"),
    ("g_pair", f"""SELECT DISTINCT doc_id, l[i] || ' ' || l[i + 1] AS pair FROM (
  SELECT doc_id, l, unnest(generate_series(1, len(l) - 1)) AS i FROM (SELECT doc_id, {_WS_LIST} AS l FROM generated_corpus)
  WHERE len(l) >= 2)"""),
    ("r_pair", f"""SELECT DISTINCT l[i] || ' ' || l[i + 1] AS pair FROM (
  SELECT l, unnest(generate_series(1, len(l) - 1)) AS i FROM (SELECT {_WS_LIST} AS l FROM real_corpus) WHERE len(l) >= 2)"""),
]


@register("e2_corpus_similarity", V("""
SELECT g.doc_id, coalesce(t.n_tokens, 0) AS n_tokens, coalesce(t.n_tokens_real, 0) AS n_tokens_real,
       coalesce(p.n_pairs, 0) AS n_pairs, coalesce(p.n_pairs_real, 0) AS n_pairs_real,
       round(CASE WHEN t.n_tokens > 0 THEN t.n_tokens_real / t.n_tokens END, 6) AS token_share,
       round(CASE WHEN p.n_pairs > 0 THEN p.n_pairs_real / p.n_pairs END, 6) AS pair_share
FROM (SELECT doc_id FROM generated_corpus) g
LEFT JOIN (SELECT doc_id, count(*) AS n_tokens, count(r.token) AS n_tokens_real FROM g_tok
           LEFT JOIN r_tok r USING (token) GROUP BY doc_id) t ON g.doc_id = t.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n_pairs, count(r.pair) AS n_pairs_real FROM g_pair
           LEFT JOIN r_pair r USING (pair) GROUP BY doc_id) p ON g.doc_id = p.doc_id""", extra=_E2_CTES))
def q_e2(spark, sf):
    s = E.corpus_similarity(X.generated_corpus(spark, sf), X.real_corpus(spark, sf))
    return s.select("doc_id", "n_tokens", "n_tokens_real", "n_pairs", "n_pairs_real", _r("token_share"), _r("pair_share"))


@register("e2_corpus_jaccard", V("""
SELECT count(g.token) AS n_generated, count(r.token) AS n_real,
       count(*) FILTER (WHERE g.token IS NOT NULL AND r.token IS NOT NULL) AS n_common, count(*) AS n_union,
       round(count(*) FILTER (WHERE g.token IS NOT NULL AND r.token IS NOT NULL) / count(*), 6) AS jaccard
FROM (SELECT DISTINCT token FROM g_tok) g FULL JOIN r_tok r ON g.token = r.token""", extra=_E2_CTES))
def q_e2_jaccard(spark, sf):
    j = E.corpus_jaccard(X.generated_corpus(spark, sf), X.real_corpus(spark, sf))
    return j.select("n_generated", "n_real", "n_common", "n_union", _r("jaccard"))


def _network_ctes(side: str) -> list[tuple[str, str]]:
    """Node labels of rounds 0 to 2 of one corpus, each round a join of nodes with their neighbours."""
    s = side[0]
    out = [(f"{s}_seq", f"SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, {_WS_LIST} AS l FROM {side}_corpus)"),
           (f"{s}_next", f"SELECT DISTINCT doc_id, l[i] AS a, l[i + 1] AS b FROM {s}_seq WHERE i < len(l) AND l[i] <> l[i + 1]"),
           (f"{s}_edge", f"SELECT doc_id, a, b FROM {s}_next UNION SELECT doc_id, b AS a, a AS b FROM {s}_next"),
           (f"{s}_lab0", f"SELECT DISTINCT doc_id, l[i] AS token, md5(l[i]) AS h FROM {s}_seq")]
    for r in (1, 2):
        near = [f"coalesce(sum(('0x' || substr(m.h, {at}, 10))::BIGINT), 0)::VARCHAR" for at in (1, 11)]
        out.append((f"{s}_lab{r}", f"""SELECT n.doc_id, n.token, md5(n.h || '|' || {near[0]} || '|' || {near[1]}) AS h
  FROM {s}_lab{r - 1} n LEFT JOIN {s}_edge e ON e.doc_id = n.doc_id AND e.a = n.token
  LEFT JOIN {s}_lab{r - 1} m ON m.doc_id = e.doc_id AND m.token = e.b GROUP BY n.doc_id, n.token, n.h"""))
    union = " UNION ALL ".join(f"SELECT {r} AS round, doc_id, h FROM {s}_lab{r}" for r in range(3))
    return out + [(f"{s}_lab", union)]


_NETWORK_CTES = _network_ctes("generated") + _network_ctes("real")


@register("e2_network_similarity", V("""
SELECT g.doc_id, g.round, count(l.h) AS n_nodes, count(k.h) AS n_nodes_real,
       round(CASE WHEN count(l.h) > 0 THEN count(k.h) / count(l.h) END, 6) AS share
FROM (SELECT doc_id, unnest([0, 1, 2]) AS round FROM generated_corpus) g
LEFT JOIN g_lab l ON l.doc_id = g.doc_id AND l.round = g.round
LEFT JOIN (SELECT DISTINCT h FROM r_lab) k ON k.h = l.h GROUP BY g.doc_id, g.round""", extra=_NETWORK_CTES))
def q_e2_network(spark, sf):
    s = E.network_similarity(X.generated_corpus(spark, sf), X.real_corpus(spark, sf))
    return s.select("doc_id", "round", "n_nodes", "n_nodes_real", _r("share"))


@register("e2_network_overlap", V("""
SELECT round, sum(g)::BIGINT AS n_generated, sum(r)::BIGINT AS n_real, sum(least(g, r))::BIGINT AS n_common,
       sum(greatest(g, r))::BIGINT AS n_union, round(sum(least(g, r)) / sum(greatest(g, r)), 6) AS similarity
FROM (SELECT round, h, sum(g) AS g, sum(r) AS r FROM (
  SELECT round, h, 1 AS g, 0 AS r FROM g_lab UNION ALL SELECT round, h, 0, 1 FROM r_lab) GROUP BY round, h) GROUP BY round""", extra=_NETWORK_CTES))
def q_e2_overlap(spark, sf):
    o = E.network_overlap(X.generated_corpus(spark, sf), X.real_corpus(spark, sf))
    return o.select("round", "n_generated", "n_real", "n_common", "n_union", _r("similarity"))


@register("e3_continuation_accuracy", MV("""
, best AS (SELECT prev, next AS guess FROM (
  SELECT prev, next, row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) AS rn FROM model_tr) WHERE rn = 1)
SELECT p.pos, count(*) AS n, count(*) FILTER (WHERE b.guess = p.next) AS hits,
       round(count(*) FILTER (WHERE b.guess = p.next) / count(*), 6) AS accuracy
FROM pairs_val p LEFT JOIN best b ON p.prev = b.prev GROUP BY p.pos"""))
def q_e3(spark, sf):
    train, val = _train_val(spark, sf)
    acc = E.continuation_accuracy(val, N.next_token_counts(train))
    return acc.select(F.col("pos").cast("bigint").alias("pos"), "n", "hits", _r("accuracy"))


@register("e4_operons", V("""
SELECT genomic_accession, strand, min(start) AS start, max("end") AS "end", count(*) AS n_genes,
       string_agg(locus_tag, ' ' ORDER BY start) AS genes,
       CAST(to_json(struct_pack(genomic_accession := genomic_accession, strand := strand, start := min(start),
                                "end" := max("end"), genes := list(locus_tag ORDER BY start))) AS VARCHAR) AS operon
FROM (SELECT *, sum(nr) OVER (PARTITION BY genomic_accession, strand ORDER BY start, "end", locus_tag
                              ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN lag("end") OVER w IS NULL OR start - lag("end") OVER w > 50 THEN 1 ELSE 0 END AS nr
  FROM feature_table WHERE feature = 'gene'
  WINDOW w AS (PARTITION BY genomic_accession, strand ORDER BY start, "end", locus_tag)))
GROUP BY genomic_accession, strand, run"""))
def q_e4(spark, sf):
    return E.operons(X.feature_table(spark, sf), max_gap=50)


_OVERLAPPING = """SELECT genomic_accession, strand, locus_tag, CASE WHEN CAST(gene_id AS BIGINT) % 23 = 0 THEN NULL ELSE start // 4 END AS start,
  CASE WHEN CAST(gene_id AS BIGINT) % 17 = 0 THEN NULL
       ELSE start // 4 + CASE WHEN CAST(gene_id AS BIGINT) % 7 = 0 THEN 900 ELSE product_length END END AS "end"
FROM feature_table WHERE feature = 'gene'"""


@register("e4_operons_covering", V(f"""
SELECT genomic_accession, strand, min(start) AS start, max("end") AS "end", count(*) AS n_genes,
       string_agg(locus_tag, ' ' ORDER BY start NULLS FIRST, locus_tag) AS genes
FROM (SELECT *, sum(nr) OVER (PARTITION BY genomic_accession, strand ORDER BY start NULLS FIRST, "end" NULLS FIRST, locus_tag
                              ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN start - max("end") OVER w <= 50 THEN 0 ELSE 1 END AS nr FROM ({_OVERLAPPING})
  WINDOW w AS (PARTITION BY genomic_accession, strand ORDER BY start NULLS FIRST, "end" NULLS FIRST, locus_tag
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
GROUP BY genomic_accession, strand, run"""))
def q_e4_covering(spark, sf):
    """Genes inside longer ones, without start or without end; gaps from the largest end so far."""
    ft, gene = X.feature_table(spark, sf), F.col("gene_id").cast("bigint")
    start = F.floor(F.col("start") / 4)
    ft = ft.withColumns({"start": F.when(gene % 23 != 0, start),
                         "end": F.when(gene % 17 != 0, start + F.when(gene % 7 == 0, 900).otherwise(F.col("product_length")))})
    return E.operons(ft, max_gap=50, reach="max").drop("operon")


# ============================================================== sources, sinks, streaming (round trips)



@register("s1_read_catalog", V("SELECT accession, assembly_name, organism, gene_total FROM catalog"))
def q_s1(spark, sf):
    path = scratch_path(spark, "catalog")
    cat = X.catalog(spark, sf).select(*[F.col(c).alias(h) for c, h in zip(
        ["accession", "assembly_name", "organism", "gene_total"], R.CATALOG_HEADER)])
    # columns in another order, and one that the reader does not know
    mixed = cat.select(F.lit("x").alias("Assembly Level"), *reversed(cat.columns))
    mixed.write.option("sep", "\t").option("header", True).csv(path)
    return R.read_catalog(spark, path).drop("bad_fields")


@register("s2_read_gene_info", V("SELECT gene_id, symbol FROM symtab"))
def q_s2(spark, sf):
    path = scratch_path(spark, "gene_info")
    gi = X.gene_info(spark, sf).select(F.lit("9606").alias("#tax_id"), F.col("gene_id").alias("GeneID"),
                                       F.coalesce("symbol", F.lit("NA")).alias("Symbol"),
                                       F.lit("-").alias("LocusTag"), "ord")
    gi.repartitionByRange("ord").sortWithinPartitions("ord").drop("ord") \
        .write.option("sep", "\t").option("header", True).csv(path)
    back = R.read_gene_info(spark, path)
    return A.symbol_table(back).select("gene_id", F.nullif("symbol", F.lit("")).alias("symbol"))


@register("s3_read_gene_go", V("SELECT gene_id, array_to_string(go_terms, ':') AS go FROM gene_go"))
def q_s3(spark, sf):
    path = scratch_path(spark, "gene_go")
    m = A.gene2go_map(X.gene2go(spark, sf))
    m.select(F.to_json(F.create_map("gene_id", "go_terms")).alias("value")).write.text(path)
    return R.read_gene_go(spark, path).select("gene_id", F.array_join("go_terms", ":").alias("go"))


@register("s3_read_one_object", V("""
SELECT gene_id || '"}] {' AS gene_id, array_to_string(list_transform(go_terms, lambda t: t || ' \\ "' || chr(10) || '[,'), ':') AS go FROM gene_go"""))
def q_s3_one(spark, sf):
    """One pretty-printed object with brackets, escapes and line breaks in its strings, read by byte ranges."""
    path = scratch_path(spark, "gene_go_object")
    m = A.gene2go_map(X.gene2go(spark, sf)).select(
        F.concat("gene_id", F.lit('"}] {')).alias("k"), F.transform("go_terms", lambda t: F.concat(t, F.lit(' \\ "\n[,'))).alias("v"))
    entry = F.to_json(F.create_map("k", "v"))
    first = m.agg(F.min("k")).first()[0]
    body = F.concat(F.when(F.col("k") == first, "{\n  ").otherwise(",\n  "), F.expr("substring(e, 2, length(e) - 2)"))
    rows = m.withColumn("e", entry).select(F.lit(1).alias("o"), "k", body.alias("value"))
    ends = spark.createDataFrame([(2, "", "\n}" if first is not None else "{}")], rows.schema)
    # the members are streamed into one file in key order
    named = rows.unionByName(ends).select(F.lit("map.json").alias("file"), "o", "k", F.col("value").cast("binary").alias("data"))
    write_raw(named.repartition("file").sortWithinPartitions("file", "o", "k").select("file", "data"), path)
    back = R.read_gene_go(spark, path, whole_file=True, range_bytes=20_000)
    return back.select("gene_id", F.array_join("go_terms", ":").alias("go"))


@register("j3_read_gene2go", V("""
SELECT gene_id, array_to_string(go_terms, ':') AS go, CAST(len(go_terms) AS BIGINT) AS n_terms FROM gene_go"""))
def q_j3_file(spark, sf):
    """The map built from a gzip gene2go file, whose rows are in another order than the genes."""
    path = scratch_path(spark, "gene2go")
    rows = X.gene2go(spark, sf).select(F.lit("9606").alias("#tax_id"), F.col("gene_id").alias("GeneID"), F.lit("GO:0").alias("GO_ID"),
                                       F.lit("IEA").alias("Evidence"), F.lit("-").alias("Qualifier"), F.col("go_term").alias("GO_term"), "ord")
    rows.repartitionByRange(4, "ord", "GeneID").sortWithinPartitions("ord", "GeneID").drop("ord") \
        .write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    m = A.gene2go_map(R.read_gene2go(spark, path))
    return m.select("gene_id", F.array_join("go_terms", ":").alias("go"), F.size("go_terms").cast("bigint").alias("n_terms"))


@register("s4_read_cds_fasta", V("SELECT accession, ord, header, seq FROM cds"))
def q_s4(spark, sf):
    path = scratch_path(spark, "cds_fasta")
    S.write_fasta(X.cds_records(spark, sf), path)
    return R.read_cds_fasta(spark, path)


_FT_COLS = ", ".join(f'"{n}"' if n == "end" else n for n, _ in R.FEATURE_TABLE_FIELDS)


@register("s5_read_feature_table", V(f"SELECT {_FT_COLS} FROM feature_table"))
def q_s5(spark, sf):
    path = scratch_path(spark, "feature_table")
    ft = X.feature_table(spark, sf)
    ft.select(*[F.col(n).alias(h) for (n, _), h in zip(R.FEATURE_TABLE_FIELDS, R.FEATURE_TABLE_HEADER)]) \
        .write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return R.read_feature_table(spark, path).drop("bad_fields")


@register("s6_read_gff", V('SELECT seqid, source, type, start, "end", score, strand, phase, attributes FROM gff'))
def q_s6(spark, sf):
    path = scratch_path(spark, "gff")
    X.gff(spark, sf).write.option("sep", "\t").option("header", False).csv(path)
    return R.read_gff(spark, path)


@register("s7_read_corpus", CV("""
SELECT r.doc_id, r.text FROM reduced r JOIN splits s ON r.doc_id = s.doc_id WHERE s.split = 'val'"""))
def q_s7(spark, sf):
    path = scratch_path(spark, "corpus")
    f = flow(spark, sf)
    f.reduced.join(f.splits, "doc_id").select("doc_id", "text", "split").write.partitionBy("split").parquet(path)
    return R.read_corpus(spark, path, split="val")


@register("s8_read_vocab", CV("SELECT token, CAST(id AS BIGINT) AS id FROM vocab"))
def q_s8(spark, sf):
    path = scratch_path(spark, "vocab_json")
    kept = flow(spark, sf).kept  # bounded by MAX_VOCAB rows
    kept.agg(F.sort_array(F.collect_list("token")).alias("id_vocab"),
             F.count(F.lit(1)).alias("vocab_size")).coalesce(1).write.json(path)
    return R.read_vocab(spark, path, fmt="json")


@register("k1_write_corpus", V("""
SELECT accession || ': ' || string_agg(label, ' ' ORDER BY ord) AS value
FROM labelled WHERE label IS NOT NULL GROUP BY accession"""))
def q_k1(spark, sf):
    path = scratch_path(spark, "gene_lines")
    S.write_corpus(A.gene_sentence(labelled(spark, sf)), path)
    return spark.read.text(path)


def _joined_lines(spark, path):
    """Lines of any length as rows, only to be compared."""
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    return R.read_line_pieces(spark, path).groupBy("line").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("value"))


@register("k1_write_line_pieces", V("""
SELECT row_number() OVER (ORDER BY accession) - 1 AS line, accession || ': ' || string_agg(label, ' ' ORDER BY ord) AS value
FROM labelled WHERE label IS NOT NULL GROUP BY accession"""))
def q_k1_pieces(spark, sf):
    path = scratch_path(spark, "gene_line_pieces")
    S.write_line_pieces(A.gene_pieces(labelled(spark, sf), 64), path)
    return _joined_lines(spark, path)


@register("k1_write_nt_pieces", V("""
SELECT row_number() OVER (ORDER BY accession) - 1 AS line, accession || ': ' || nt AS value FROM (
  SELECT accession, string_agg(CASE WHEN label IS NOT NULL THEN ' ' ELSE '' END || seq, '' ORDER BY ord) AS nt
  FROM labelled GROUP BY accession) WHERE length(nt) > 0"""))
def q_k1_nt_pieces(spark, sf):
    path = scratch_path(spark, "nt_line_pieces")
    S.write_line_pieces(A.nt_pieces(labelled(spark, sf), size=64), path, sep="")
    return _joined_lines(spark, path)


@register("k2_write_vocab", CV("SELECT token, CAST(id AS BIGINT) AS id FROM vocab"))
def q_k2(spark, sf):
    path = scratch_path(spark, "vocab")
    S.write_vocab(flow(spark, sf).vocab, path)
    return R.read_vocab(spark, f"{path}/table", fmt="parquet")


_W5_SQL = f"""
SELECT split, pos // {BLOCK} AS block_id, count(*) AS n,
       md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos)) AS ids_md5
FROM stream GROUP BY split, pos // {BLOCK}"""


def _ids_md5(batches):
    """The md5 of each block's ids, joined by spaces."""
    from hashlib import md5

    names, blank = [str(i) for i in range(S.U16_MAX + 1)], {}
    for b in batches:
        ids = pc.list_flatten(b.column("ids")).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64))])
        some, out = np.diff(np.searchsorted(np.flatnonzero(ids), ends)), []
        for held, begin, end in zip(some.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            if held:
                out.append(md5(" ".join([names[i] for i in ids[begin:end].tolist()]).encode()).hexdigest())
            else:  # padding alone: told by its length
                if end - begin not in blank:
                    blank[end - begin] = md5(" ".join(["0"] * (end - begin)).encode()).hexdigest()
                out.append(blank[end - begin])
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], ["split", "block_id", "n", "ids_md5"])


def _ids_held(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("split"), b.column("block_id"), pc.list_value_length(b.column("ids")).cast(pa.int64())], ["split", "block_id", "n"])


@register("k3_write_shards", CV(_W5_SQL))
def q_k3(spark, sf):
    path = scratch_path(spark, "shards")
    S.write_shards(flow(spark, sf).padded_blocks, path)
    return R.read_shards(spark, path, _ids_md5, "split string, block_id long, n long, ids_md5 string")


@register("s9_read_shards", CV(f"""
SELECT split, pos // {BLOCK} AS block_id, CAST(count(*) AS BIGINT) AS n FROM stream GROUP BY split, pos // {BLOCK}"""))
def q_s9(spark, sf):
    path = scratch_path(spark, "shards")
    S.write_shards(flow(spark, sf).padded_blocks, path)
    return R.read_shards(spark, path, _ids_held, "split string, block_id long, n long")


@register("st1_ingest_stream", V("""
SELECT accession || ': ' || string_agg(label, ' ' ORDER BY ord) AS value
FROM labelled WHERE label IS NOT NULL GROUP BY accession"""))
def q_st1(spark, sf):
    return ST.read_ingested(spark, _ingested(spark, sf))


def _ingested(spark, sf, **mode):
    """Land RefSeq genomes, ingest; land GenBank genomes, ingest again; the output folder."""
    landing, out, ckpt = (scratch_path(spark, n) for n in ("landing", "ingest_out", "ingest_ckpt"))
    recs = X.cds_records(spark, sf)
    gi = X.gene_info(spark, sf)
    S.write_fasta(recs.where(F.col("accession").startswith("GCF")), landing)
    ST.ingest_stream(spark, landing, gi, out, ckpt, nested=True, **mode)
    S.write_fasta(recs.where(~F.col("accession").startswith("GCF")), landing, mode="append")
    ST.ingest_stream(spark, landing, gi, out, ckpt, nested=True, **mode)
    return out


@register("st1_ingest_nucleotides", V("""
SELECT accession || ': ' || nt AS value FROM (
  SELECT accession, string_agg(CASE WHEN label IS NOT NULL THEN ' ' ELSE '' END || seq, '' ORDER BY ord) AS nt
  FROM labelled GROUP BY accession) WHERE length(nt) > 0"""))
def q_st1_nt(spark, sf):
    return ST.read_ingested(spark, _ingested(spark, sf), "nucleotides")


@register("st1_ingest_go", V("""
SELECT 'genes' AS kind, accession || ': ' || string_agg(label, ' ' ORDER BY ord) AS value
FROM go_labelled WHERE label IS NOT NULL GROUP BY accession
UNION ALL
SELECT 'nt', accession || ': ' || nt FROM (
  SELECT accession, string_agg(CASE WHEN label IS NOT NULL THEN ' ' || seq ELSE seq END, '' ORDER BY ord) AS nt
  FROM go_labelled WHERE gid IS NOT NULL GROUP BY accession) WHERE length(nt) > 0"""))
def q_st1_go(spark, sf):
    out = _ingested(spark, sf, gene_go=A.gene2go_map(X.gene2go(spark, sf)))
    return ST.read_ingested(spark, out).select(F.lit("genes").alias("kind"), "value").unionByName(
        ST.read_ingested(spark, out, "nucleotides").select(F.lit("nt").alias("kind"), "value"))


def _awkward_docs(spark, sf):
    """The reduced corpus with null and unknown-only texts and repeated keys."""
    d = flow(spark, sf).reduced
    text = F.when(F.col("doc_id") % 17 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 19 == 0, F.lit("§ §")).otherwise(F.col("text"))
    return d.select(F.floor(F.col("doc_id") / 2).cast("bigint").alias("doc_id"), text.alias("text"))


_AWKWARD = """(SELECT doc_id // 2 AS doc_id, doc_id AS r,
  CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '§ §' ELSE text END AS text FROM reduced)"""


def _awkward_sql(what: str, name: str) -> str:
    return CV(f"""
SELECT a.doc_id, md5(coalesce(e.{what}, '')) AS {name} FROM {_AWKWARD} a LEFT JOIN (
  SELECT r, string_agg(CAST(v.id AS VARCHAR), ' ' ORDER BY i) AS ids, string_agg(v.token, ' ' ORDER BY i) AS back
  FROM (SELECT r, l[i] AS token, i FROM (SELECT r, l, unnest(generate_series(1, len(l))) AS i
        FROM (SELECT r, string_split(text, ' ') AS l FROM {_AWKWARD} WHERE text IS NOT NULL))) t
  JOIN vocab v ON v.token = t.token GROUP BY r) e USING (r)""")


def _register_awkward(strategy):
    @register(f"j4_encode_awkward_{strategy}", _awkward_sql("ids", "ids_md5"))
    def q(spark, sf):
        v = flow(spark, sf).vocab
        doubled = v.unionByName(v.where("id > 2").select("token", F.lit(0).cast("bigint").alias("id")))
        enc = K.encode(_awkward_docs(spark, sf), doubled, on_unknown="drop", strategy=strategy)
        return enc.select("doc_id", F.md5(_ids_str()).alias("ids_md5"))

    @register(f"j5_decode_awkward_{strategy}", _awkward_sql("back", "text_md5"))
    def r(spark, sf):
        v = flow(spark, sf).vocab
        enc = K.encode(_awkward_docs(spark, sf), v, on_unknown="drop", strategy="table")
        return K.decode(enc, v, strategy=strategy).select("doc_id", F.md5("text").alias("text_md5"))


for _strategy in ("table", "join"):
    _register_awkward(_strategy)


# ---------------------------------------------------------------- raw shard files

def _write_stream(spark, sf, n_max):
    """Shard files of the corpus: written from framed rows, no blocks are packed."""
    f = flow(spark, sf)
    path = scratch_path(spark, "stream")
    S.write_stream(L.stream_shards(f.compact, ["order_key"], n_max), path)
    return path


def _checksums(spark, path, by, block=None, **ranges):
    """Of the stream files: count of ids (``n``), their sum and their sum weighted by place per group (of ``by`` and, with
    ``block``, of ``block`` ids of the stream): sums of whole numbers, order-independent. An id has no row of its own, every one
    is read and summed in the worker."""
    def run(batches):
        for b in batches:
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(b.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
            flat = pc.list_flatten(b.column("ids")).to_numpy(zero_copy_only=False)
            rows, found = [], []
            for i, first in enumerate(b.column("offset").to_pylist()):
                ids = flat[ends[i]:ends[i + 1]]
                if not len(ids):
                    continue
                size = block or first + len(ids)
                blocks = np.arange(first // size, (first + len(ids) - 1) // size + 1)
                cuts = np.clip(np.append(blocks, blocks[-1] + 1) * size - first, 0, len(ids))
                at = np.flatnonzero(ids)  # zeros add nothing to a sum
                held, place, sums = ids[at].astype(np.int64), (first + at) % PLACES, np.zeros((2, len(blocks)), np.int64)
                np.add.at(sums[0], (first + at) // size - blocks[0], held)
                np.add.at(sums[1], (first + at) // size - blocks[0], held * place)
                rows.append(np.full(len(blocks), i))
                found.append(np.stack([blocks, np.diff(cuts), *sums]))
            if rows:
                of, found = pa.array(np.concatenate(rows)), np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([b.column(c).take(of) for c in by] + [pa.array(x) for x in found], names)

    names = [*by, "block_id", "n", "id_sum", "place_sum"]
    schema = ", ".join(f"{c} {'string' if c == 'split' else 'long'}" for c in names)
    groups = [*by, "block_id"] if block else by
    return R.read_stream(spark, path, each=run, schema=schema, **ranges).groupBy(*groups).agg(*[F.sum(c).alias(c) for c in names[len(by) + 1:]])


@register("k3_shard_files", CV("""
SELECT split, shard, min(pos) AS first_offset, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum,
       CAST(sum(id * (pos % 1000003)) AS BIGINT) AS place_sum FROM (
  SELECT split, CASE WHEN row < (d + 1) * md THEN row // (d + 1) ELSE md + (row - (d + 1) * md) // d END AS shard,
         CAST(off + i - 1 AS BIGINT) AS pos, ids[i] AS id
  FROM (SELECT split, ids, row, off, cnt // least(1024, cnt) AS d, cnt % least(1024, cnt) AS md,
               unnest(generate_series(1, len(ids))) AS i FROM (
    SELECT split, ids, row_number() OVER (PARTITION BY split ORDER BY order_key) - 1 AS row, count(*) OVER (PARTITION BY split) AS cnt,
           coalesce(sum(len(ids)) OVER (PARTITION BY split ORDER BY order_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
    FROM framed)))
GROUP BY split, shard"""))
def q_k3_files(spark, sf):
    """One uint16 file a shard: the manifest, beside sums over the bytes that were written."""
    path = _write_stream(spark, sf, 1024)
    found = _checksums(spark, path, ["split", "shard"]).withColumnRenamed("n", "held")
    return R.stream_manifest(spark, path).join(found, ["split", "shard"], "left").where("held = n").drop("held")


@register("s9_stream_ranges", CV(f"""
SELECT split, pos // {BLOCK} AS block_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum,
       CAST(sum(id * (pos % 1000003)) AS BIGINT) AS place_sum FROM stream GROUP BY split, pos // {BLOCK}"""))
def q_s9_ranges(spark, sf):
    """Few large files, each read by several tasks."""
    return _checksums(spark, _write_stream(spark, sf, 4), ["split"], BLOCK, range_bytes=1 << 20)


@register("w7_random_access", REGISTRY["w7_sample_blocks"][1])
def q_w7_files(spark, sf):
    """The windows of ``w7_sample_blocks``, read from the shard files by offset."""
    s = R.sample_stream(spark, _write_stream(spark, sf, 1024), "train", W7_DRAWS, BLOCK, W7_SEED)
    return s.select("draw_id", "start", F.md5(_ids_str("x")).alias("x_md5"), F.md5(_ids_str("y")).alias("y_md5"))
