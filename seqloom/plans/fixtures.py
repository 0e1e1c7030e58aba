"""Input views of the genome pipeline, derived from the driver's TPC-H-like tables.

Each view has a twin in ``seqloom.plans.oracle_views`` written for DuckDB; both use only
expressions that mean the same in the two engines (md5, translate, lpad, integer %).
Views are cached per (session, folder) so several queries of one run share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.positions import dense_index_within

_CACHE: dict[tuple, DataFrame] = {}

CONV_ID_BASE = 1_000_000_000_000
TURNS = 1_000_000  # ids of one conversation's turns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread ``df`` on ``key`` when it arrives in fewer partitions than the session
    can run at once (e.g. one small file with one row group); a no-op for wide inputs."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < n:
        return df.repartition(n, key)
    return df


def _cached(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, name)
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _padded(c: str, width: int) -> F.Column:
    """Zero-padded to at least ``width`` digits; longer numbers stay whole."""
    s = _s(c)
    return F.lpad(s, F.greatest(F.length(s), F.lit(width)), F.lit("0"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genome catalog: one assembly per supplier, every tenth a GenBank (GCA) one."""
    s = table(spark, sf_dir, "supplier")
    version = (F.col("s_nationkey") % 3 + 1).cast("string")
    return s.select(
        F.concat(F.lit("GC"), F.when(F.col("s_suppkey") % 10 == 0, "A").otherwise("F"), F.lit("_"),
                 _padded("s_suppkey", 9), F.lit("."), version).alias("accession"),
        F.concat(F.lit("ASM"), _s("s_suppkey"), F.lit("v"), version).alias("assembly_name"),
        F.col("s_name").alias("organism"),
        (F.col("s_nationkey") * 10 + 550).cast("int").alias("gene_total"),
        F.col("s_suppkey").alias("suppkey"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory listing per accession: versioned subdirectories plus decoys."""
    c = catalog(spark, sf_dir)
    d = F.substring("accession", -1, 1)
    digits = _padded("suppkey", 9)
    m = (F.col("suppkey") % 3 + 1).cast("int")
    versions = c.select("accession", "suppkey", F.explode(F.sequence(F.lit(1), m)).alias("k")).select(
        "accession", (F.col("k") - 1).cast("int").alias("pos"),
        F.concat(F.lit("GCF_"), digits, F.lit("."), _s("k"), F.lit("_ASM"), _s("suppkey"), F.lit("v"),
                 _s("k")).alias("entry"))
    alt = c.where(F.col("suppkey") % 4 == 0).select(
        "accession", m.alias("pos"),
        F.concat(F.lit("GCF_"), digits, F.lit("."), _s(F.col("suppkey") % 9 + 1), F.lit("_ASM"),
                 _s("suppkey"), F.lit("v"), d, F.lit("x")).alias("entry"))
    nodigit = c.where(F.col("suppkey") % 11 == 0).select(
        "accession", (m + 1).cast("int").alias("pos"), F.concat(F.lit("annotation_v"), d).alias("entry"))
    return versions.unionByName(alt).unionByName(nodigit)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing inside every subdirectory: genome, CDS FASTA, feature table."""
    lst = listing(spark, sf_dir).withColumn("suppkey", F.regexp_extract("accession", r"_([0-9]+)\.", 1).cast("bigint"))
    cds_name = F.when(F.col("suppkey") % 13 == 0, F.lit("_cds_from_genomic.fna.gz")) \
        .otherwise(F.concat("entry", F.lit("_cds_from_genomic.fna.gz")))
    return lst.select(
        "accession", F.col("entry").alias("dir"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("pos"), F.concat("entry", F.lit("_genomic.fna.gz")).alias("entry")),
            F.struct(F.lit(1).alias("pos"), cds_name.alias("entry")),
            F.struct(F.lit(2).alias("pos"), F.concat("entry", F.lit("_feature_table.txt.gz")).alias("entry")),
        )).alias("f")).select("accession", "dir", "f.pos", "f.entry")


def _cds_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as CDS records of their supplier's genome, with the record's file order."""
    def build():
        li = table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_returnflag", "l_linestatus")
        cat = catalog(spark, sf_dir).select("accession", "suppkey")
        joined = li.join(cat, li.l_suppkey == cat.suppkey).drop("suppkey")
        return dense_index_within(
            joined, ["l_suppkey"],
            ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"], out="ord", start=1)
    return _cached(spark, sf_dir, "cds_base", build)


def cds_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``accession, ord, header, seq``: one FASTA record per line item."""
    b = _cds_base(spark, sf_dir)
    pk = F.col("l_partkey")
    gene = (F.when(pk % 3 == 0, F.concat(F.lit("[gene="), F.translate(F.substring(F.md5(_s(pk)), 1, 4),
                                                                        "0123456789", "ghijklmnop"), F.lit("] ")))
            .when(pk % 12 == 4, F.lit("[gene=ab1] ")).otherwise(F.lit("")))
    locus = F.when(pk % 11 == 0, F.lit("[locus_tag=b_c_d] ")).otherwise(
        F.concat(F.lit("[locus_tag=LT_"), _s(pk), F.lit("] ")))
    xref = F.when(pk % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("[db_xref=GeneID:"), _s(pk), F.lit("] ")))
    header = F.concat(F.lit(">lcl|"), _s("l_orderkey"), F.lit(" "), gene, locus, xref, F.lit("[gbkey=CDS]"))
    seq = F.translate(F.md5(F.concat(_s("l_orderkey"), F.lit(":"), _s("l_linenumber"))),
                      "0123456789abcdef", "ACGTACGTACGTACGT")
    return b.select("accession", "ord", header.alias("header"), seq.alias("seq"))


def cds_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as a FASTA line table ``accession, line_no, line`` (header + 2 sequence lines)."""
    r = cds_records(spark, sf_dir)
    return r.select("accession", F.posexplode(F.array(
        F.col("header"), F.substring("seq", 1, 16), F.substring("seq", 17, 16))).alias("i", "line"),
        "ord").select("accession", (F.col("ord") * 3 + F.col("i")).alias("line_no"), "line")


def gene_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gene_id, symbol, ord``; some ids absent, some repeated (the later row wins)."""
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 7 != 0)
    base = p.select(_s("p_partkey").alias("gene_id"),
                    F.when(F.col("p_partkey") % 17 == 0, F.lit(None).cast("string"))
                    .otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit(""))).alias("symbol"),
                    F.col("p_partkey").alias("ord"))
    dup = p.where(F.col("p_partkey") % 13 == 0).select(
        _s("p_partkey").alias("gene_id"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")).alias("symbol"),
        (F.col("p_partkey") + 1_000_000_000).alias("ord"))
    return base.unionByName(dup)


def gene2go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene2go rows ``gene_id, go_term, ord``."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_partkey") % 4 != 0) \
        .select("l_partkey", "l_linenumber").distinct()
    return li.select(_s("l_partkey").alias("gene_id"),
                     F.concat(F.lit("GO:"), F.lpad(_s("l_linenumber"), 7, "0")).alias("go_term"),
                     F.col("l_linenumber").cast("bigint").alias("ord"))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20-column feature table rows (typed), one per line item."""
    b = _cds_base(spark, sf_dir)
    pk = F.col("l_partkey")
    start = F.col("ord") * 200
    length = (F.col("l_quantity") * 5).cast("bigint")
    null_s = F.lit(None).cast("string")
    return b.select(
        F.when(F.col("l_returnflag") == "N", "CDS").when(F.col("l_returnflag") == "R", "gene")
        .otherwise("tRNA").alias("feature"),
        F.lit("with_protein").alias("class"),
        F.col("accession").alias("assembly"),
        F.lit("Primary Assembly").alias("assembly_unit"),
        F.lit("chromosome").alias("seq_type"),
        null_s.alias("chromosome"),
        F.concat(F.lit("NC_"), _padded("l_suppkey", 6)).alias("genomic_accession"),
        start.alias("start"),
        (start + length).alias("end"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.when(pk % 6 == 0, null_s).otherwise(F.concat(F.lit("WP_"), _s(pk))).alias("product_accession"),
        null_s.alias("nonredundant_refseq"),
        null_s.alias("related_accession"),
        F.concat(F.lit("protein "), _s(pk)).alias("name"),
        F.when(pk % 9 == 0, null_s).otherwise(F.concat(F.lit("sym"), _s(pk))).alias("symbol"),
        _s(pk).alias("gene_id"),
        F.concat(F.lit("LT_"), _s(pk)).alias("locus_tag"),
        (length + 1).cast("int").alias("feature_interval_length"),
        F.col("l_quantity").cast("int").alias("product_length"),
        null_s.alias("attributes"),
    )


def gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """9-column GFF rows with attributes in the three layouts."""
    ft = feature_table(spark, sf_dir).withColumn("pk", F.col("gene_id"))
    pk = F.col("pk")
    name = F.concat(F.when(pk.cast("bigint") % 4 == 0, F.lit("BHR")).otherwise(F.lit("gen")), pk)
    head = F.concat(F.lit("ID=gene-LT_"), pk, F.lit(";Name="), name, F.lit(";gbkey=Gene;"))
    layout = pk.cast("bigint") % 3
    attrs = (F.when(layout == 0, F.concat(head, F.lit("gene="), name, F.lit(";gene_biotype=protein_coding;locus_tag=LT_"),
                                          pk, F.lit(";old_locus_tag=OLD"), pk))
             .when(layout == 1, F.concat(head, F.lit("gene_biotype=protein_coding;locus_tag=LT_"), pk,
                                         F.lit(";old_locus_tag=OLD"), pk))
             .otherwise(F.concat(head, F.lit("gene_biotype=pseudogene;pseudogene=true;locus_tag=LT_"), pk)))
    return ft.select(
        F.col("genomic_accession").alias("seqid"), F.lit("RefSeq").alias("source"), F.col("feature").alias("type"),
        "start", "end", F.lit(".").alias("score"), "strand",
        F.when(F.col("feature") == "CDS", "0").otherwise(".").alias("phase"), attrs.alias("attributes"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: documents and conversation turns, newlines replaced by one space."""
    nl = F.lit("\n")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.replace(F.col("text"), nl, F.lit(" ")).alias("text"))
    c = table(spark, sf_dir, "conversations").select(
        (F.lit(CONV_ID_BASE) + F.col("conv_id") * TURNS + F.col("turn")).alias("doc_id"),
        F.replace(F.col("text"), nl, F.lit(" ")).alias("text"))
    return spread(d.unionByName(c), "doc_id")


def real_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(
        "doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("text")), "doc_id")


def generated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("doc_id"),
        F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("text")), "doc_id")


def token_clean_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus with ``_x`` appended to every single-space token whose length is a multiple of 5."""
    c = corpus(spark, sf_dir)
    toks = F.split(F.col("text"), " ", -1)
    marked = F.transform(toks, lambda t: F.when(F.length(t) % 5 == 0, F.concat(t, F.lit("_x"))).otherwise(t))
    return c.select("doc_id", F.array_join(marked, " ").alias("text"))
