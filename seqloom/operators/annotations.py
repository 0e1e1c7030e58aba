"""FASTA records, feature tables and GFF: labelling genes and assembling sentences.

F1-F10, J1-J3, P4-P10. Every "in file order" result is ordered by an explicit
``ord`` key; assembly of one genome's line is two-level (chunks of ``CHUNK``
records first) so a very large genome is sorted by many tasks, not one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.operators.positions import _same_as_before, running_sum
from seqloom.session import broadcast_if_small

CHUNK = 4096

# The header patterns of CDS FASTA records.
GENE_NAME_RE = r"\[gene=([a-zA-Z]+)\] \["
GENE_ID_RE = r"GeneID:([0-9]+)"
LOCUS_TAG_RE = r"\[locus_tag=([a-zA-Z0-9]+_[a-zA-Z0-9]+)\] \["

# The 7 GFF attribute keys the gene table keeps.
GFF_KEYS = ["ID", "Name", "gbkey", "gene", "gene_biotype", "locus_tag", "old_locus_tag"]


def _first(col: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.col(col), pattern, 1), F.lit(""))


# ---------------------------------------------------------------- F1 records from lines

def fasta_records(lines: DataFrame) -> DataFrame:
    """``accession, line_no, line`` -> ``accession, ord, header, seq``.

    A line starting with ``>`` opens a record; later lines append to its sequence.
    The record number is a running count of headers over the global order
    ``(accession, line_no)`` (no per-genome window); ``ord`` is the header's line
    number. Lines before a genome's first header form a record with a null header; lines with
    one number stand in text order.
    """
    flagged = lines.select("accession", "line_no", "line", F.col("line").startswith(">").cast("long").alias("_h"))
    # the lines carry their record number out of one range pass, so a repeated line number repeats nothing
    numbered = running_sum(flagged, ["accession", "line_no", "line"], "_h", out="_rec")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line", "_h")))
    grouped = numbered.groupBy("accession", "_rec").agg(parts.alias("_p"), F.min("line_no").alias("ord"))
    head = F.filter("_p", lambda x: x["_h"] == 1)
    body = F.filter("_p", lambda x: x["_h"] == 0)
    return grouped.select(
        "accession", "ord",
        F.try_element_at(head, F.lit(1))["line"].alias("header"),
        F.array_join(F.transform(body, lambda x: x["line"]), "").alias("seq"),
    )


# ---------------------------------------------------------------- F2 header fields

def header_fields(records: DataFrame, header: str = "header") -> DataFrame:
    """first gene name, GeneID and locus tag of each header (null when absent)."""
    return records.withColumn("gene", _first(header, GENE_NAME_RE)) \
        .withColumn("gid", _first(header, GENE_ID_RE)) \
        .withColumn("locus", _first(header, LOCUS_TAG_RE))


# ---------------------------------------------------------------- J1 / J2 / J3 lookups

def symbol_table(gene_info: DataFrame) -> DataFrame:
    """J1 build side: one symbol per GeneID, the last row (largest ``ord``) wins."""
    return gene_info.groupBy("gene_id").agg(F.max_by("symbol", "ord").alias("symbol"))


def _lookup(records: DataFrame, table: DataFrame, need) -> DataFrame:
    """Left lookup on ``gid`` for rows where ``need`` holds.

    Small table (measured, see ``broadcast_if_small``): one pass, broadcast hash join on a key that is null for rows
    that need no lookup. Large table: one shuffled join, where rows that need no lookup get one
    of 1,024 keys that match nothing, so they never pile up in one partition.
    """
    table, small = broadcast_if_small(table)
    if small:
        keyed = records.withColumn("_sl_k", F.when(need, F.col("gid")))
        t = F.broadcast(table.withColumnRenamed("gid", "_sl_k"))
        return keyed.join(t, "_sl_k", "left").drop("_sl_k")
    # the place of a record tells enough; hashing every column would keep them all from being pruned
    by = [c for c in ("accession", "ord") if c in records.columns] or records.columns
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*by), F.lit(1024)).cast("string"))
    keyed = records.withColumn("_sl_k", F.coalesce(F.when(need, F.col("gid")), spread))
    return keyed.join(table.withColumnRenamed("gid", "_sl_k"), "_sl_k", "left").drop("_sl_k")


def lookup_symbol(records: DataFrame, gene_info: DataFrame) -> DataFrame:
    """Add ``symbol`` for records that need one (no gene name, GeneID present).

    An empty symbol counts as missing.
    """
    need = F.col("gene").isNull() & F.col("gid").isNotNull()
    table = symbol_table(gene_info).select(F.col("gene_id").alias("gid"), F.nullif("symbol", F.lit("")).alias("symbol"))
    return _lookup(records, table, need)


def gene2go_map(gene2go: DataFrame) -> DataFrame:
    """``gene_id -> go_terms`` (distinct, in ``ord`` order) from gene2go rows."""
    terms = F.array_sort(F.collect_list(F.struct("ord", "go_term")))
    return gene2go.groupBy("gene_id").agg(
        F.array_distinct(F.transform(terms, lambda x: x["go_term"])).alias("go_terms"))


def lookup_go(records: DataFrame, gene_go: DataFrame, *also: str) -> DataFrame:
    """Add ``go_terms`` (and the columns ``also``) by GeneID (left join; rows without GeneID skip the join)."""
    table = gene_go.select(F.col("gene_id").alias("gid"), "go_terms", *also)
    return _lookup(records, table, F.col("gid").isNotNull())


# ---------------------------------------------------------------- F3 / F4 / F5 / F6

def label_records(records: DataFrame, gene_info: DataFrame) -> DataFrame:
    """label cascade gene name -> (GeneID: symbol -> locus tag) -> none.

    A header with neither gene name nor GeneID is dropped without trying the locus
    tag. ``label_source`` is one of gene, symbol, locus_tag, missed, dropped.
    """
    f = header_fields(records)
    looked = lookup_symbol(f, gene_info)
    source = (F.when(F.col("gene").isNotNull(), "gene")
              .when(F.col("gid").isNull(), "dropped")
              .when(F.col("symbol").isNotNull(), "symbol")
              .when(F.col("locus").isNotNull(), "locus_tag")
              .otherwise("missed"))
    label = F.coalesce(F.col("gene"), F.when(F.col("gid").isNotNull(), F.coalesce("symbol", "locus")))
    return looked.withColumn("label", label).withColumn("label_source", source)


def missed_genes(labelled: DataFrame) -> DataFrame:
    """per genome, records with a GeneID but neither symbol nor locus tag."""
    return labelled.groupBy("accession").agg(
        F.count_if(F.col("label_source") == "missed").cast("bigint").alias("missed"))


def go_tokens(records: DataFrame, gene_go: DataFrame) -> DataFrame:
    """GO token per record: its GeneID's terms joined by ':'; none when no terms."""
    # the token is put together once a gene, not once a record
    tok = F.when(F.size("go_terms") > 0, F.array_join("go_terms", ":"))
    return lookup_go(header_fields(records), gene_go.select("gene_id", "go_terms", tok.alias("label")), "label")


def genome_len(records: DataFrame) -> DataFrame:
    """number of records (headers) per genome."""
    return records.groupBy("accession").agg(F.count(F.lit(1)).cast("bigint").alias("genome_len"))


# ---------------------------------------------------------------- F7 / F8 / F9 assembly

def _joined_runs(keys: list[str], sep: str):
    """Sorted rows ``*keys, _piece, _flag`` -> per run of equal keys its pieces joined (null ones left out),
    how many there are and how many rows are flagged. A run may go on in the next batch."""
    def joined(parts):
        run = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        starts = np.concatenate([[0], np.flatnonzero(~_same_as_before(run, keys)) + 1])
        piece, flag = run.column("_piece"), run.column("_flag").to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.is_valid(piece).to_numpy(zero_copy_only=False))])
        ends = ends[np.concatenate([starts, [run.num_rows]])]
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), piece.drop_null()), sep)
        return pa.RecordBatch.from_arrays(
            [run.column(k).take(pa.array(starts)) for k in keys]
            + [text, pa.array(np.diff(ends), pa.int64()), pa.array(np.add.reduceat(flag.astype(np.int64), starts))],
            names=[*keys, "_part", "_n", "_flagged"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            first, end = ([batch.column(k)[i].as_py() for k in keys] for i in (0, n - 1))
            if held and first != last:
                yield joined(held)
                held = []
            begun = np.flatnonzero(~_same_as_before(batch, keys))
            if len(begun):  # all but the last run are whole
                cut = int(begun[-1]) + 1
                yield joined([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
            last = end
        if held:
            yield joined(held)
    return run


def _places(df: DataFrame) -> list[str]:
    """What tells the chunks of ``df`` apart, in order: where ``ord`` counts within blocks of a file, the block too."""
    return ["accession", *(["_block"] if "_block" in df.columns else []), "_chunk"]


def dealt_records(labelled: DataFrame, size: int = CHUNK) -> DataFrame:
    """``labelled`` with ``_chunk``, dealt by chunk and sorted in record order. Kept (``persist``), it saves the
    sentences made of it a shuffle and a sort each; they keep its chunks, whatever their ``size``."""
    rows = labelled.withColumn("_chunk", F.floor(F.col("ord") / F.lit(size)).cast("long"))
    keys = _places(rows)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "ord")


def _chunk_runs(df: DataFrame, piece: Column, sep: str, size: int, flag: Column | None = None) -> DataFrame:
    """``accession, _chunk, _part, _n, _flagged`` (and ``_block``, see ``_places``): of every ``size`` records of a
    genome the pieces joined in record order, how many there are and how many records are flagged.

    The records are dealt by chunk and sorted once, then joined run by run: collecting them
    in an aggregation sorts every record's own buffer as soon as a task has more than 128 chunks. Null pieces
    are left out only here: a filter below would be pushed under the lookups, where it takes
    every record's header apart several times more. Rows of ``dealt_records`` are taken as they lie.
    """
    lie = "_chunk" in df.columns
    chunk = F.col("_chunk") if lie else F.floor(F.col("ord") / F.lit(size)).cast("long")
    keys = _places(df) if lie else _places(df.withColumn("_chunk", chunk))
    rows = df.select(*keys[:-1], chunk.alias("_chunk"), "ord", piece.alias("_piece"), (F.lit(False) if flag is None else flag).alias("_flag"))
    dealt = rows if lie else rows.repartition(*keys).sortWithinPartitions(*keys, "ord", "_piece")
    schema = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys),
                           T.StructField("_part", T.StringType()), T.StructField("_n", T.LongType()), T.StructField("_flagged", T.LongType())])
    return dealt.select(*keys, "_piece", "_flag").mapInArrow(_joined_runs(keys, sep), schema)


def _chunk_parts(df: DataFrame, piece: Column, sep: str, size: int) -> DataFrame:
    """``accession, _chunk, _part, _n``: the pieces of every ``size`` records of a genome joined in
    record order, and how many there are."""
    return _chunk_runs(df, piece, sep, size).where("_n > 0").drop("_flagged")


def _assemble(df: DataFrame, piece: Column, sep: str, out: str) -> DataFrame:
    """Ordered concatenation per genome in two levels: chunks of CHUNK records, then chunks."""
    parts = _chunk_parts(df, piece, sep, CHUNK)
    return parts.groupBy("accession").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_places(parts)[1:], "_part"))),
                                 lambda x: x["_part"]), sep).alias(out),
        F.sum("_n").cast("bigint").alias("n_pieces"))


def gene_pieces(labelled: DataFrame, size: int | None = None) -> DataFrame:
    """F7 in pieces: ``accession, piece, text``, the labels of ``size`` records a row. The pieces of a
    genome in order, joined by one space, are its gene sentence; no row holds the whole
    (``sinks.write_line_pieces`` writes them as one line)."""
    return _pieces(labelled, F.col("label"), " ", size)


def nt_pieces(labelled: DataFrame, mode: str = "symbol", size: int | None = None) -> DataFrame:
    """F8 / F9 in pieces, like ``gene_pieces``; joined by nothing they are the nucleotide sentence."""
    return _pieces(labelled, _nt_piece(mode), "", size)


def _pieces(labelled: DataFrame, piece: Column, sep: str, size: int | None) -> DataFrame:
    # pieces are numbered by ord alone
    parts = _chunk_parts(labelled.drop("_block", "_chunk"), piece, sep, size or CHUNK)
    return parts.select("accession", F.col("_chunk").alias("piece"), F.col("_part").alias("text"))


def gene_sentence(labelled: DataFrame) -> DataFrame:
    """labels in record order joined by one space; genomes without labels are absent."""
    return _assemble(labelled, F.col("label"), " ", "genes").withColumnRenamed("n_pieces", "n_genes")


def genome_summary(labelled: DataFrame) -> DataFrame:
    """F7 + F4 in one pass: per genome ``genes`` (F7), ``n_genes`` and ``missed``.

    Genomes without any label are absent, as in F7.
    """
    missed = F.coalesce(F.col("label_source") == "missed", F.lit(False))
    first = _chunk_runs(labelled, F.col("label"), " ", CHUNK, missed).withColumnRenamed("_flagged", "_missed")
    parts = F.filter(F.array_sort(F.collect_list(F.struct(*_places(first)[1:], "_part"))), lambda x: F.length(x["_part"]) > 0)
    out = first.groupBy("accession").agg(
        F.array_join(F.transform(parts, lambda x: x["_part"]), " ").alias("genes"),
        F.sum("_n").cast("bigint").alias("n_genes"), F.sum("_missed").cast("bigint").alias("missed"))
    return out.where(F.col("n_genes") > 0)


def _nt_piece(mode: str) -> Column:
    """What a record adds to its genome's nucleotides (null: nothing, not even a place)."""
    lab = F.col("label").isNotNull()
    if mode == "symbol":
        return F.concat(F.when(lab, F.lit(" ")).otherwise(F.lit("")), F.coalesce("seq", F.lit("")))
    if mode == "go":
        return (F.when(F.col("gid").isNull(), F.lit(None).cast("string"))
                .when(lab, F.concat(F.lit(" "), F.coalesce("seq", F.lit(""))))
                .otherwise(F.coalesce("seq", F.lit(""))))
    raise ValueError(f"unknown mode {mode!r}")


def nt_sentence(labelled: DataFrame, mode: str = "symbol") -> DataFrame:
    """F8 (mode symbol) / F9 (mode go): the genome's nucleotides, a space before each labelled gene.

    symbol: an unlabelled record's sequence runs on into the previous chunk.
    go: a record without GeneID is void (its sequence skipped); with GeneID but no
    GO terms it runs on; with terms it gets the space.
    """
    out = _assemble(labelled, _nt_piece(mode), "", "nt").drop("n_pieces")
    return out.where(F.length("nt") > 0)


def genome_records(catalog: DataFrame, sentences: DataFrame) -> DataFrame:
    """``accession -> {genes[], organism, gene_total}`` as JSON, found vs declared."""
    genes = sentences.select("accession", F.split("genes", " ", -1).alias("gene_list"))
    j = catalog.join(genes, "accession", "left")
    found = F.coalesce(F.size("gene_list"), F.lit(0)).cast("bigint")
    return j.select(
        "accession",
        F.to_json(F.struct(F.coalesce("gene_list", F.array().cast("array<string>")).alias("genes"),
                           "organism", "gene_total")).alias("record"),
        found.alias("found"), F.col("gene_total").cast("bigint").alias("declared"))


# ---------------------------------------------------------------- P4-P10 feature tables and GFF

def feature_rows(ft: DataFrame, kind: str) -> DataFrame:
    """CDS rows -> product accession; gene rows -> symbol and GeneID."""
    if kind == "CDS":
        return ft.where(F.col("feature") == "CDS").select("genomic_accession", "start", "product_accession")
    if kind == "gene":
        return ft.where(F.col("feature") == "gene").select("genomic_accession", "start", "symbol", "gene_id")
    raise ValueError(f"unknown kind {kind!r}")


def drop_missing(df: DataFrame, col: str) -> DataFrame:
    """P5: keep rows whose ``col`` is present."""
    return df.where(F.col(col).isNotNull())


def missing_rows(df: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` is missing."""
    return df.where(F.col(col).isNull())


def stringify(df: DataFrame, col: str, missing: str = "nan") -> DataFrame:
    """Cast to string, a missing value written as ``missing``."""
    return df.withColumn(col, F.coalesce(F.col(col).cast("string"), F.lit(missing)))


def gff_rows(gff: DataFrame, kind: str) -> DataFrame:
    """GFF rows of one type (``gene`` / ``CDS``)."""
    return gff.where(F.col("type") == kind)


def gff_attributes(gff: DataFrame, keys=GFF_KEYS) -> DataFrame:
    """Attribute values by key (first occurrence; value runs to the next ';').

    Keys are matched whole, so ``pseudogene=`` never reads as ``gene=``; an absent key
    gives null.
    """
    out = gff
    for k in keys:
        pat = "(^|;)" + k + "="
        out = out.withColumn(k, F.when(F.col("attributes").rlike(pat),
                                       F.regexp_extract("attributes", pat + "([^;]*)", 2)))
    return out


def count_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """P10: number of rows whose ``col`` starts with ``prefix`` (one row)."""
    return df.where(F.col(col).startswith(prefix)).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
