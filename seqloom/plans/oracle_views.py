"""DuckDB twins of ``seqloom.plans.fixtures`` views, as composable CTEs.

``with_views(body, "labelled", ...)`` prepends the named views and everything they
depend on, in dependency order.
"""

from __future__ import annotations

import re

# (name, sql) in dependency order; a view may use any view above it.
VIEWS: list[tuple[str, str]] = [
    ("catalog", """
SELECT concat('GC', CASE WHEN s_suppkey % 10 = 0 THEN 'A' ELSE 'F' END, '_',
              lpad(CAST(s_suppkey AS VARCHAR), greatest(9, length(CAST(s_suppkey AS VARCHAR)))::INTEGER, '0'), '.', CAST(s_nationkey % 3 + 1 AS VARCHAR)) AS accession,
       concat('ASM', CAST(s_suppkey AS VARCHAR), 'v', CAST(s_nationkey % 3 + 1 AS VARCHAR)) AS assembly_name,
       s_name AS organism, CAST(s_nationkey * 10 + 550 AS INTEGER) AS gene_total, s_suppkey AS suppkey
FROM supplier"""),
    ("listing", """
SELECT accession, CAST(k - 1 AS INTEGER) AS pos,
       concat('GCF_', lpad(CAST(suppkey AS VARCHAR), greatest(9, length(CAST(suppkey AS VARCHAR)))::INTEGER, '0'), '.', CAST(k AS VARCHAR), '_ASM',
              CAST(suppkey AS VARCHAR), 'v', CAST(k AS VARCHAR)) AS entry
FROM (SELECT accession, suppkey, unnest(range(1, CAST(suppkey % 3 + 2 AS BIGINT))) AS k FROM catalog)
UNION ALL
SELECT accession, CAST(suppkey % 3 + 1 AS INTEGER),
       concat('GCF_', lpad(CAST(suppkey AS VARCHAR), greatest(9, length(CAST(suppkey AS VARCHAR)))::INTEGER, '0'), '.', CAST(suppkey % 9 + 1 AS VARCHAR), '_ASM',
              CAST(suppkey AS VARCHAR), 'v', right(accession, 1), 'x')
FROM catalog WHERE suppkey % 4 = 0
UNION ALL
SELECT accession, CAST(suppkey % 3 + 2 AS INTEGER), concat('annotation_v', right(accession, 1))
FROM catalog WHERE suppkey % 11 = 0"""),
    ("files", """
SELECT l.accession, l.entry AS dir, f.pos,
       CASE WHEN f.pos = 0 THEN concat(l.entry, '_genomic.fna.gz')
            WHEN f.pos = 1 THEN CASE WHEN CAST(substr(l.accession, 5, 9) AS BIGINT) % 13 = 0
                                     THEN '_cds_from_genomic.fna.gz'
                                     ELSE concat(l.entry, '_cds_from_genomic.fna.gz') END
            ELSE concat(l.entry, '_feature_table.txt.gz') END AS entry
FROM listing l CROSS JOIN (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS pos) f"""),
    ("cds_base", """
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
       l.l_returnflag, l.l_linestatus, c.accession,
       row_number() OVER (PARTITION BY l.l_suppkey
                          ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice, l.l_quantity) AS ord
FROM lineitem l JOIN catalog c ON l.l_suppkey = c.suppkey"""),
    ("cds", """
SELECT accession, ord,
  concat('>lcl|', CAST(l_orderkey AS VARCHAR), ' ',
    CASE WHEN l_partkey % 3 = 0 THEN concat('[gene=', translate(substr(md5(CAST(l_partkey AS VARCHAR)), 1, 4),
                                                                '0123456789', 'ghijklmnop'), '] ')
         WHEN l_partkey % 12 = 4 THEN '[gene=ab1] ' ELSE '' END,
    CASE WHEN l_partkey % 11 = 0 THEN '[locus_tag=b_c_d] '
         ELSE concat('[locus_tag=LT_', CAST(l_partkey AS VARCHAR), '] ') END,
    CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('[db_xref=GeneID:', CAST(l_partkey AS VARCHAR), '] ') END,
    '[gbkey=CDS]') AS header,
  translate(md5(concat(CAST(l_orderkey AS VARCHAR), ':', CAST(l_linenumber AS VARCHAR))),
            '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq
FROM cds_base"""),
    ("cds_lines", """
SELECT accession, ord * 3 + i AS line_no,
       CASE i WHEN 0 THEN header WHEN 1 THEN substr(seq, 1, 16) ELSE substr(seq, 17, 16) END AS line
FROM cds CROSS JOIN (SELECT unnest(range(0, 3)) AS i) t"""),
    ("gene_info", """
SELECT CAST(p_partkey AS VARCHAR) AS gene_id,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE replace(p_name, ' ', '') END AS symbol, p_partkey AS ord
FROM part WHERE p_partkey % 7 <> 0
UNION ALL
SELECT CAST(p_partkey AS VARCHAR), replace(p_brand, '#', ''), p_partkey + 1000000000
FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 13 = 0"""),
    ("symtab", """
SELECT gene_id, NULLIF(symbol, '') AS symbol FROM (
  SELECT gene_id, symbol, row_number() OVER (PARTITION BY gene_id ORDER BY ord DESC) AS rn FROM gene_info)
WHERE rn = 1"""),
    ("fields", r"""
SELECT *, NULLIF(regexp_extract(header, '\[gene=([a-zA-Z]+)\] \[', 1), '') AS gene,
          NULLIF(regexp_extract(header, 'GeneID:([0-9]+)', 1), '') AS gid,
          NULLIF(regexp_extract(header, '\[locus_tag=([a-zA-Z0-9]+_[a-zA-Z0-9]+)\] \[', 1), '') AS locus
FROM cds"""),
    ("labelled", """
SELECT f.*, s.symbol,
  COALESCE(f.gene, CASE WHEN f.gid IS NOT NULL THEN COALESCE(s.symbol, f.locus) END) AS label,
  CASE WHEN f.gene IS NOT NULL THEN 'gene' WHEN f.gid IS NULL THEN 'dropped'
       WHEN s.symbol IS NOT NULL THEN 'symbol' WHEN f.locus IS NOT NULL THEN 'locus_tag'
       ELSE 'missed' END AS label_source
FROM fields f LEFT JOIN symtab s ON f.gene IS NULL AND f.gid = s.gene_id"""),
    ("gene2go", """
SELECT CAST(l_partkey AS VARCHAR) AS gene_id, concat('GO:', lpad(CAST(l_linenumber AS VARCHAR), 7, '0')) AS go_term,
       CAST(l_linenumber AS BIGINT) AS ord
FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_partkey % 4 <> 0)"""),
    ("gene_go", """
SELECT gene_id, list(go_term ORDER BY ord) AS go_terms FROM gene2go GROUP BY gene_id"""),
    ("go_labelled", """
SELECT f.*, g.go_terms, CASE WHEN len(g.go_terms) > 0 THEN array_to_string(g.go_terms, ':') END AS label
FROM fields f LEFT JOIN gene_go g ON f.gid = g.gene_id"""),
    ("feature_table", """
SELECT CASE WHEN l_returnflag = 'N' THEN 'CDS' WHEN l_returnflag = 'R' THEN 'gene' ELSE 'tRNA' END AS feature,
       'with_protein' AS class, accession AS assembly, 'Primary Assembly' AS assembly_unit,
       'chromosome' AS seq_type, CAST(NULL AS VARCHAR) AS chromosome,
       concat('NC_', lpad(CAST(l_suppkey AS VARCHAR), greatest(6, length(CAST(l_suppkey AS VARCHAR)))::INTEGER, '0')) AS genomic_accession,
       ord * 200 AS start, ord * 200 + CAST(l_quantity * 5 AS BIGINT) AS "end",
       CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
       CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE concat('WP_', CAST(l_partkey AS VARCHAR)) END AS product_accession,
       CAST(NULL AS VARCHAR) AS nonredundant_refseq, CAST(NULL AS VARCHAR) AS related_accession,
       concat('protein ', CAST(l_partkey AS VARCHAR)) AS name,
       CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE concat('sym', CAST(l_partkey AS VARCHAR)) END AS symbol,
       CAST(l_partkey AS VARCHAR) AS gene_id, concat('LT_', CAST(l_partkey AS VARCHAR)) AS locus_tag,
       CAST(CAST(l_quantity * 5 AS BIGINT) + 1 AS INTEGER) AS feature_interval_length,
       CAST(l_quantity AS INTEGER) AS product_length, CAST(NULL AS VARCHAR) AS attributes
FROM cds_base"""),
    ("gff", """
SELECT genomic_accession AS seqid, 'RefSeq' AS source, feature AS type, start, "end", '.' AS score, strand,
       CASE WHEN feature = 'CDS' THEN '0' ELSE '.' END AS phase,
       CASE CAST(gene_id AS BIGINT) % 3
         WHEN 0 THEN concat('ID=gene-LT_', gene_id, ';Name=', nm, ';gbkey=Gene;', 'gene=', nm,
                            ';gene_biotype=protein_coding;locus_tag=LT_', gene_id, ';old_locus_tag=OLD', gene_id)
         WHEN 1 THEN concat('ID=gene-LT_', gene_id, ';Name=', nm, ';gbkey=Gene;',
                            'gene_biotype=protein_coding;locus_tag=LT_', gene_id, ';old_locus_tag=OLD', gene_id)
         ELSE concat('ID=gene-LT_', gene_id, ';Name=', nm, ';gbkey=Gene;',
                     'gene_biotype=pseudogene;pseudogene=true;locus_tag=LT_', gene_id) END AS attributes
FROM (SELECT *, concat(CASE WHEN CAST(gene_id AS BIGINT) % 4 = 0 THEN 'BHR' ELSE 'gen' END, gene_id) AS nm
      FROM feature_table)"""),
    ("corpus", """
SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents
UNION ALL
SELECT 1000000000000 + conv_id * 1000000 + turn, replace(text, chr(10), ' ') FROM conversations"""),
    ("real_corpus", """
SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents"""),
    ("generated_corpus", """
SELECT conv_id * 1000000 + turn AS doc_id, replace(text, chr(10), ' ') AS text FROM conversations"""),
    ("token_clean_input", """
SELECT doc_id, array_to_string(list_transform(string_split(text, ' '),
         lambda t: CASE WHEN length(t) % 5 = 0 THEN concat(t, '_x') ELSE t END), ' ') AS text
FROM corpus"""),
]

_NAMES = [n for n, _ in VIEWS]
_SQL = dict(VIEWS)


def _deps(name: str) -> set[str]:
    body = _SQL[name]
    return {n for n in _NAMES if n != name and re.search(rf"\b{n}\b", body)}


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <views needed> , <extra ctes> <body>``; views are pulled in transitively."""
    need: set[str] = set()
    stack = list(names)
    extra = extra or []
    for _, sql in extra:
        stack += [n for n in _NAMES if re.search(rf"\b{n}\b", sql)]
    stack += [n for n in _NAMES if re.search(rf"\b{n}\b", body)]
    while stack:
        n = stack.pop()
        if n in need:
            continue
        need.add(n)
        stack.extend(_deps(n))
    ctes = [f"{n} AS ({_SQL[n].strip()})" for n in _NAMES if n in need]
    ctes += [f"{n} AS ({sql.strip()})" for n, sql in extra]
    return ("WITH " + ",\n".join(ctes) + "\n" + body.strip()) if ctes else body.strip()
