"""Readers for the pipeline's inputs (S1-S9). Schemas are fixed ``StructType``s.

Text formats are read by Spark's own file sources (split and decompressed by the
reader; gzip chosen by extension). Where a result depends on the order of records
in a file, the order key comes from the file path, the split's start offset and the
row's place inside its split, never from arrival order.
"""

from __future__ import annotations

from contextlib import contextmanager
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.operators.corpus import SPECIALS
from seqloom.operators.positions import running_sum
from seqloom.session import broadcast_cap, broadcast_if_small
from seqloom.sources.json_ranges import read_json_map
from seqloom.sources.rawfiles import RANGE_BYTES, NULL_SPLIT, U16, list_files, map_u16, open_fs, read_u16

# Strings pandas reads as missing by default (its documented NA list).
PANDAS_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Catalog header names.
CATALOG_HEADER = ["Assembly Accession", "Assembly Name", "Organism Name", "Annotation Count Gene Total"]

# The 20 feature-table columns in file order (the file's first header is "# feature").
FEATURE_TABLE_FIELDS = [
    ("feature", "string"), ("class", "string"), ("assembly", "string"), ("assembly_unit", "string"),
    ("seq_type", "string"), ("chromosome", "string"), ("genomic_accession", "string"), ("start", "bigint"),
    ("end", "bigint"), ("strand", "string"), ("product_accession", "string"), ("nonredundant_refseq", "string"),
    ("related_accession", "string"), ("name", "string"), ("symbol", "string"), ("gene_id", "string"),
    ("locus_tag", "string"), ("feature_interval_length", "int"), ("product_length", "int"), ("attributes", "string"),
]
FEATURE_TABLE_HEADER = ["# feature", "class", "assembly", "assembly_unit", "seq_type", "chromosome",
                        "genomic_accession", "start", "end", "strand", "product_accession", "non-redundant_refseq",
                        "related_accession", "name", "symbol", "GeneID", "locus_tag", "feature_interval_length",
                        "product_length", "attributes"]

# The 9 GFF column names.
GFF_FIELDS = [("seqid", "string"), ("source", "string"), ("type", "string"), ("start", "bigint"), ("end", "bigint"),
              ("score", "string"), ("strand", "string"), ("phase", "string"), ("attributes", "string")]

# The gene2go columns that are read.
GENE2GO_HEADER = ["GeneID", "GO_ID", "GO_term"]

# Fixed value: an assembly accession in a path.
ACCESSION_RE = r"(GC[AF]_[0-9]+\.[0-9]+)"
# Fixed value: start of the marker line that a run of the ingest writes.
SESSION_MARKER = "################"

BOM = b"\xef\xbb\xbf"  # a byte order mark; Hadoop's line reader drops it, too


def _na(col: str) -> Column:
    c = F.col(col)
    return F.when(c.isin(PANDAS_NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def _all_string_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def _tsv(spark: SparkSession, path: str, names, header: bool, comment: str | None = None) -> DataFrame:
    r = (spark.read.schema(_all_string_schema(names)).option("sep", "\t").option("header", header)
         .option("quote", "\u0000").option("mode", "PERMISSIVE"))
    if comment:
        r = r.option("comment", comment)
    return r.csv(path)


def _by_name(spark: SparkSession, path: str, fields, header) -> DataFrame:
    """A tab-separated file with a header: the columns named in ``header`` under their names
    and types in ``fields``, whatever their place and whatever else the file holds. A column
    the file lacks raises. Quoted fields are read as one; a value that is no number becomes
    null and its column is listed in ``bad_fields``."""
    df = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    missing = [h for h in header if h not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {missing}; it has {df.columns}")
    raw = df.select(*[F.col(f"`{h}`").alias(n) for (n, _), h in zip(fields, header)])
    out = [_na(n) if t == "string" else _na(n).try_cast(t) for n, t in fields]
    bad = [F.when(_na(n).isNotNull() & _na(n).try_cast(t).isNull(), F.lit(n)) for n, t in fields if t != "string"]
    return raw.select(*[c.alias(n) for c, (n, _) in zip(out, fields)], F.array_compact(F.array(*bad)).alias("bad_fields"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Genome catalog TSV, columns found by header name -> ``accession, assembly_name,
    organism, gene_total, bad_fields``."""
    fields = [("accession", "string"), ("assembly_name", "string"), ("organism", "string"), ("gene_total", "int")]
    return _by_name(spark, path, fields, CATALOG_HEADER)


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
FOLDER_TYPES = "spark.sql.sources.partitionColumnTypeInference.enabled"


@contextmanager
def listing(spark: SparkSession):
    """Many folders are listed by a few tasks a core, each taking its share, instead of by up to 10,000; the
    driver does not try every type on the name of every folder (the values of folder names are not read here)."""
    own = {k: spark.conf.get(k, None) for k in (LISTING, FOLDER_TYPES)}
    spark.conf.set(LISTING, min(int(own[LISTING] or 10_000), 4 * spark.sparkContext.defaultParallelism))
    spark.conf.set(FOLDER_TYPES, "false")
    try:
        yield
    finally:
        for k, v in own.items():
            if v:
                spark.conf.set(k, v)
            else:
                spark.conf.unset(k)


def file_order(df: DataFrame) -> DataFrame:
    """Add ``_file``, ``_block`` and ``_row``: with them, rows sort in file order."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_row"))


def read_gene_info(spark: SparkSession, path: str) -> DataFrame:
    """Gene info TSV (header ``#tax_id GeneID Symbol ...``): 2 columns, id as string,
    plus ``ord`` (file order: later rows win in J1)."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "\u0000") \
        .option("inferSchema", False).csv(path)
    df = file_order(df.select("GeneID", "Symbol"))
    return df.select(_na("GeneID").alias("gene_id"), _na("Symbol").alias("symbol"),
                     F.struct("_file", "_block", "_row").alias("ord"))


def read_gene_go(spark: SparkSession, path: str, whole_file: bool = False, range_bytes: int | None = None) -> DataFrame:
    """S3: JSON object(s) mapping GeneID -> ordered GO terms -> ``gene_id, go_terms``.

    One object per line by default; with ``whole_file`` each file is one object, as a single (perhaps
    pretty-printed) dump is written, and is read by many tasks (``json_ranges``): line breaks,
    braces and escapes may stand anywhere, and of a repeated GeneID the last entry counts.
    """
    if whole_file:
        rows = read_json_map(spark, path, "array<string>", **({"range_bytes": range_bytes} if range_bytes else {}))
        return rows.select(F.col("key").alias("gene_id"), F.col("value").alias("go_terms"))
    df = spark.read.text(path)
    m = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    return df.where(F.length(F.trim("value")) > 0).select(F.explode(m).alias("gene_id", "go_terms"))


def read_gene2go(spark: SparkSession, path: str) -> DataFrame:
    """J3's input: the gene2go TSV (header ``#tax_id GeneID GO_ID Evidence Qualifier GO_term ...``, gzip by
    extension) -> ``gene_id, go_id, go_term, ord``, found by header name; ``ord`` is the file order.

    Rows without a GeneID are left out; ``-`` as a term is missing like an empty one.
    """
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "\u0000").option("inferSchema", False).csv(path)
    missing = [h for h in GENE2GO_HEADER if h not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {missing}; it has {df.columns}")
    rows = file_order(df.select(*GENE2GO_HEADER)).where(F.col("GeneID").isNotNull())
    term = F.when(F.col("GO_term") != "-", F.col("GO_term"))
    return rows.select(F.col("GeneID").alias("gene_id"), F.col("GO_ID").alias("go_id"), term.alias("go_term"),
                       F.struct("_file", "_block", "_row").alias("ord"))


def parse_fasta_records(df: DataFrame) -> DataFrame:
    """Split ``value`` (one record per row, read with lineSep ``\\n>``) into header and sequence.

    Only a file's first record keeps its ``>``; the header is the first line, the
    sequence is the rest with line breaks removed.
    """
    value = F.col("value")
    body = F.when(value.startswith(">"), F.substring(value, 2, 2147483647)).otherwise(value)
    head = F.substring_index("_sl_body", "\n", 1)
    rest = F.expr("substring(_sl_body, char_length(substring_index(_sl_body, '\\n', 1)) + 2)")
    return (df.withColumn("_sl_body", body)
            .withColumn("header", F.concat(F.lit(">"), head))
            .withColumn("seq", F.replace(F.replace(rest, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")))
            .drop("_sl_body"))


def file_ordinal(df: DataFrame, out: str = "ord", **of_file: Column) -> DataFrame:
    """1-based position of each row inside its file, from ``_file, _block, _row``.

    A file split is read by one task, so its rows are contiguous in one partition and
    ``_row`` (monotonically increasing id) counts them. Per split: first ``_row`` and row
    count (a table of one row per split), the count of earlier splits of the same file
    (ordered by start offset), then ``ord = offset + (_row - first) + 1``. The records
    themselves are never shuffled. ``of_file``: more columns that follow from ``_file``, worked out once a split.
    """
    from pyspark.sql import Window

    splits = df.groupBy("_file", "_block").agg(F.min("_row").alias("_r0"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n").withColumns(of_file)
    splits, _ = broadcast_if_small(splits, 4 * broadcast_cap())  # a row a file, against a shuffle of every record by its path
    j = df.drop(*of_file).join(splits, ["_file", "_block"])
    return j.withColumn(out, F.col("_off") + F.col("_row") - F.col("_r0") + 1).drop("_r0", "_off")


def dealt_names(names: DataFrame, col: str, files: int) -> DataFrame:
    """The names of at most ``files`` files dealt over a given number of partitions (their bytes say nothing of the
    files'), in name order."""
    sc = names.sparkSession.sparkContext
    n = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * sc.defaultParallelism)
    return names.repartition(max(min(n, files), 1), col).sortWithinPartitions(col)


def _packed_values(path: str, chunk: int):
    """The stretches between ``\\n>`` of a gzip file, as lists, and whether one may hold a ``\\r``; a byte order
    mark and an empty end are none."""
    rest, first = b"", True
    with pa.input_stream(path, compression="gzip") as f:
        while data := f.read(chunk):
            data = rest + data
            values = data.split(b"\n>")
            rest = values.pop()
            if values:
                if first:
                    values[0], first = values[0].removeprefix(BOM), False
                yield values, b"\r" in data
    rest = rest.removeprefix(BOM) if first else rest
    if rest:
        yield [rest], b"\r" in rest


def _parsed(values: list[bytes], returns: bool):
    """Which of ``values`` are records, their headers and sequences, as ``parse_fasta_records`` makes them."""
    text = pa.array(values, pa.binary()).view(pa.string())
    kept = np.flatnonzero(pc.binary_length(pc.ascii_trim(text, " ")).to_numpy(zero_copy_only=False))
    body = text if len(kept) == len(text) else text.take(pa.array(kept))
    marked = pc.starts_with(body, ">")
    if pc.any(marked).as_py():
        body = pc.if_else(marked, pc.binary_replace_slice(body.view(pa.binary()), 0, 1, b"").view(pa.string()), body)
    lines = pc.split_pattern(body, "\n", max_splits=1)
    begins, flat = lines.offsets.to_numpy(), lines.flatten()
    after = pa.array(begins[:-1] + 1, mask=np.diff(begins) < 2)
    seq = pc.replace_substring(pc.fill_null(flat.take(after), ""), "\n", "")
    return kept, pc.binary_join_element_wise(">", flat.take(pa.array(begins[:-1])), ""), pc.replace_substring(seq, "\r", "") if returns else seq


def _packed_batches(chunk: int):
    def run(batches):
        for batch in batches:
            kind = batch.schema.field("_key").type
            for file, key in zip(batch.column("_file").to_pylist(), batch.column("_key").to_pylist()):
                at, begin = 0, None
                for values, returns in _packed_values(open_fs(unquote(file))[1], chunk):
                    kept, header, seq = _parsed(values, returns)
                    n = len(kept)
                    if n:
                        name = pa.nulls(n, pa.string()) if begin is not None else pa.concat_arrays([pa.array([file]), pa.nulls(n - 1, pa.string())])
                        begin = at + int(kept[0]) if begin is None else begin
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(pa.scalar(key, kind), n), name, pa.array(kept + (at - begin + 1), pa.int64()), header, seq],
                            ["_key", "_file", "ord", "header", "seq"])
                    at += len(values)
    return run


def packed_records(names: DataFrame, chunk: int = 1 << 22) -> DataFrame:
    """``_key, _file, ord, header, seq``: the records of the gzip files named by ``_file, _key``, as
    ``parse_fasta_records`` and ``file_ordinal`` make them of Spark's text reader.

    A task unpacks its files one after the other, ``chunk`` bytes at a time. Spark's reader copies its
    configuration for every file and looks for the record ends byte by byte; here a file is opened and split.
    ``_file`` stands at a file's first record only.
    """
    kind = names.schema["_key"].dataType.simpleString()
    return names.select("_file", "_key").mapInArrow(_packed_batches(chunk), f"_key {kind}, _file string, ord long, header string, seq string")


def read_cds_fasta(spark: SparkSession, path: str) -> DataFrame:
    """CDS FASTA files (gzip or plain) -> ``accession, ord, header, seq``.

    One row per record straight from the reader (``lineSep`` = newline + ``>``), no
    line window and no shuffle of records. The accession comes from the file path;
    ``ord`` is the record's 1-based place in its file.
    """
    with listing(spark):
        raw = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    recs = parse_fasta_records(file_order(raw))
    return file_ordinal(recs, accession=F.regexp_extract("_file", ACCESSION_RE, 1)).select("accession", "ord", "header", "seq")


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Feature table TSV (header row, gzip by extension): the 20 columns found by header
    name, typed, and ``bad_fields``."""
    return _by_name(spark, path, FEATURE_TABLE_FIELDS, FEATURE_TABLE_HEADER)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """9-column GFF without header; ``#`` comment lines skipped."""
    names = [n for n, _ in GFF_FIELDS]
    df = _tsv(spark, path, names, header=False, comment="#")
    return df.select(*[F.col(n).try_cast(t).alias(n) for n, t in GFF_FIELDS])


def read_corpus(spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Corpus ``doc_id, text``; parquet with a ``split=`` directory per split, or text lines.

    Text lines get ``doc_id`` = their file-order position (from 0, over the files read);
    session marker lines are dropped. ``split`` picks a ``split=`` folder in either form.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
        if split is not None:
            df = df.where(F.col("split") == split)
        return df.select("doc_id", "text")
    raw = spark.read.text(path)
    if split is not None:
        if "split" not in raw.columns:
            raise ValueError(f"{path} has no split= folders")
        raw = raw.where(F.col("split") == split)
    df = file_ordinal(file_order(raw.where(~F.col("value").startswith(SESSION_MARKER))), out="_in_file")
    # rows of the files before: one row per file is ranked, no line is moved
    sizes = df.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = running_sum(sizes, ["_file"], "_n", out="_end").select("_file", (F.col("_end") - F.col("_n")).alias("_before"))
    out = df.join(broadcast_if_small(before)[0], "_file")
    return out.select((F.col("_before") + F.col("_in_file") - 1).alias("doc_id"), F.col("value").alias("text"))


def read_line_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``line, part, text``: the stretches of every line of ``sinks.write_line_pieces``, lines counted from 0
    and ``part`` rising with the file. A line in several files gives a row for each; joined by nothing they
    are the line. A part file is one row here, as large as the writer's partitions, whatever the lines."""
    files = spark.read.option("pathGlobFilter", "part-*.txt").text(path, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"), F.split("value", "\n", -1).alias("lines"))
    ends = running_sum(files.select("part", (F.size("lines") - 1).cast("long").alias("ends")), ["part"], "ends", out="upto")
    known, _ = broadcast_if_small(ends.select("part", (F.col("upto") - F.col("ends")).alias("before")))
    rows = files.join(known, "part").select("part", "before", F.posexplode("lines").alias("i", "text"))
    return rows.where(F.length("text") > 0).select((F.col("before") + F.col("i")).alias("line"), "part", "text")


def read_vocab(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Vocabulary -> ``token, id`` with ``[PAD] [EOS] [SOS]`` as 0, 1, 2 first.

    ``json``: the object ``{"id_vocab" | "reduced_vocab": [...], "vocab_size": n}``; token i
    of the list gets id i + 3 and a repeated token keeps its last id. ``parquet``: the
    ``token, id`` table written by ``write_vocab``.
    """
    if fmt == "parquet":
        return spark.read.parquet(path).select("token", F.col("id").cast("long"))
    schema = T.StructType([T.StructField("id_vocab", T.ArrayType(T.StringType())),
                           T.StructField("reduced_vocab", T.ArrayType(T.StringType())),
                           T.StructField("vocab_size", T.LongType())])
    j = spark.read.schema(schema).option("multiLine", True).json(path)
    toks = j.select(F.posexplode(F.coalesce("reduced_vocab", "id_vocab")).alias("pos", "token"))
    ids = toks.select("token", (F.col("pos") + len(SPECIALS)).cast("long").alias("id"))
    sp = spark.createDataFrame([(t, i) for i, t in enumerate(SPECIALS)], "token string, id long")
    return sp.unionByName(ids).groupBy("token").agg(F.max("id").alias("id"))


def _decode_u16(batches):
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column("data")), 0).to_numpy(zero_copy_only=False)
        ids = np.frombuffer(b"".join(pc.fill_null(b.column("data"), b"").to_numpy(zero_copy_only=False)), dtype="<u2").astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes // 2)]).astype(np.int32)
        keep = [n for n in b.schema.names if n != "data"]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=keep + ["ids"])


def read_shards(spark: SparkSession, path: str, each=None, schema=None) -> DataFrame:
    """Packed shards written by ``write_shards`` -> ``split, block_id, n, ids``.

    With ``each`` (Arrow batches of these rows -> batches of ``schema``) the rows are given on as they are decoded, in the
    same worker, and only its batches are returned."""
    df = spark.read.parquet(path).select("split", "block_id", "n", "data")
    if each is not None:
        return df.mapInArrow(lambda batches: each(_decode_u16(batches)), schema)
    rows = T.StructType([T.StructField("split", T.StringType()), T.StructField("block_id", T.LongType()),
                         T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(_decode_u16, rows)


def _stream_files(path: str) -> list[tuple[str, str | None, int, int, int]]:
    """``(file, split, shard, first_offset, n)`` of the uint16 files below ``path``: the shard files of
    ``write_stream``, or one ``<split>.bin`` a split. One entry a file, in stream order."""
    import re
    from urllib.parse import unquote_plus

    out, ends = [], {}
    for name, size in list_files(path, ".bin"):
        m = re.fullmatch(r"split=([^/]*)/shard-([0-9]+)\.bin", name)
        split = (None if m[1] == NULL_SPLIT else unquote_plus(m[1])) if m else name[:-4]
        out.append((name, split, int(m[2]) if m else 0, size // U16))
    out.sort(key=lambda f: (f[1] is not None, f[1] or "", f[2]))
    files = []
    for name, split, shard, n in out:
        files.append((name, split, shard, ends.get(split, 0), n))
        ends[split] = ends.get(split, 0) + n
    return files


def stream_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``split, shard, first_offset, n`` (in ids) of the uint16 files below ``path``."""
    return spark.createDataFrame(_stream_files(path), "file string, split string, shard long, first_offset long, n long").drop("file")


def read_stream(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, row_ids: int | None = None,
                each=None, schema=None) -> DataFrame:
    """S9, raw form: flat uint16 files (of ``write_stream`` with its manifest, or found as ``<split>.bin``)
    -> ``split, shard, offset, ids``; ``offset`` counts the split's ids before the row.

    Files are cut into byte ranges of whole records that are dealt to tasks, so a file of any size is read in parallel.
    With ``each`` (Arrow batches of these rows -> batches of ``schema``) the rows are given on as they are read, in the
    same worker, and only its batches are returned: most of a stream is padding, which costs nothing until it travels.
    """
    rows = {"row_ids": row_ids} if row_ids else {}
    if each is None:
        files = spark.createDataFrame(_stream_files(path), "file string, split string, shard long, first_offset long, n long")
        raw = read_u16(spark, path, ".bin", range_bytes, **rows)
        return raw.join(broadcast_if_small(files)[0], "file").select("split", "shard", (F.col("first_offset") + F.col("first")).alias("offset"), "ids")
    known = {name: (split, shard, first) for name, split, shard, first, _ in _stream_files(path)}

    def placed(batches):
        for b in batches:
            split, shard, begin = zip(*(known[x] for x in b.column("file").to_pylist()))
            offset = pc.add(b.column("first"), pa.array(begin, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(split, pa.string()), pa.array(shard, pa.int64()), offset, b.column("ids")],
                                             ["split", "shard", "offset", "ids"])

    return map_u16(spark, path, lambda batches: each(placed(batches)), schema, ".bin", range_bytes, **rows)


def sample_stream(spark: SparkSession, path: str, split: str, n_draws: int, block_size: int, seed: int = 0) -> DataFrame:
    """W7 over raw files: ``draw_id, start, x, y, bytes_read``, the windows of ``sample_blocks``.

    A draw is looked up in the offset index (one entry a file) and only its ``block_size + 1`` ids are
    read, also where they lie in several files; nothing is scanned or packed. Draws are read in the order of
    their places within a task.
    """
    from seqloom.functions.hashing import hash_int

    B = int(block_size)
    mine = [(name, first, n) for name, s, _, first, n in _stream_files(path) if s == split and n]
    total = sum(n for _, _, n in mine)
    if total <= B:
        raise ValueError(f"split {split!r} holds {total} ids, need more than block_size={B}")
    names, firsts = [f[0] for f in mine], [f[1] for f in mine]

    def run(batches):
        system, root = open_fs(path)
        held: dict = {}

        def ids_at(at, n):
            i = int(np.searchsorted(firsts, at, "right")) - 1
            parts, used = [], 0
            while used < U16 * n:
                if i not in held:
                    for f in held.values():
                        f.close()
                    held.clear()
                    held[i] = system.open_input_file(f"{root}/{names[i]}")
                held[i].seek(U16 * (at - firsts[i]) if not parts else 0)
                data = held[i].read(U16 * n - used)
                if not data or len(data) % U16:
                    raise ValueError(f"{names[i]} ends inside a record")
                parts.append(np.frombuffer(data, "<u2"))
                used += len(data)
                i += 1
            return np.concatenate(parts).astype(np.int32), used

        for b in batches:
            draw, start = (b.column(c).to_numpy() for c in ("draw_id", "start"))
            order = np.argsort(start, kind="stable")
            found = [ids_at(int(start[i]), B + 1) for i in order]
            ends = pa.array(np.arange(len(found) + 1) * B, pa.int32())
            x, y = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([ids[k:k + B] for ids, _ in found]) if found else np.zeros(0, np.int32)))
                    for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(draw[order]), pa.array(start[order]), x, y, pa.array([u for _, u in found], pa.int64())],
                                             ["draw_id", "start", "x", "y", "bytes_read"])
        for f in held.values():
            f.close()

    draws = spark.range(n_draws).select(F.col("id").alias("draw_id"), (hash_int(seed, F.lit(split), F.col("id")) % F.lit(total - B)).alias("start"))
    return draws.mapInArrow(run, "draw_id long, start long, x array<int>, y array<int>, bytes_read long")
