"""S3's one-object form by byte ranges, and the gene2go file reader."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators.annotations import gene2go_map
from seqloom.sources import json_ranges as J
from seqloom.sources import readers as R

NASTY = ["", " ", '"', "\\", '\\"', "\\\\", '{"a": [1, 2]}', "}],[{", ",", ":", "é ü", "tab\tnewline\n", "\\u0041", "x" * 50, "/*"]


def scan_by_byte(data, state):
    depth, states, depths = 0, [], []
    for c in data:
        if state == J.ESCAPE:
            state = J.INSIDE
        elif state == J.INSIDE:
            state = J.ESCAPE if c == 92 else J.OUTSIDE if c == 34 else J.INSIDE
        else:
            state = J.INSIDE if c == 34 else state
            depth += (c in b"{[") - (c in b"}]")
        states.append(state)
        depths.append(depth)
    return state, depths


def test_state_tables_match_a_scan_by_byte():
    r = random.Random(1)
    for _ in range(3000):
        data = bytes(r.choice(b'"\\{}[],ab') for _ in range(r.randrange(1, 14)))
        for state in (J.OUTSIDE, J.INSIDE, J.ESCAPE):
            # a backslash outside strings is no JSON: such texts are left out
            if any(c == 92 and s == J.OUTSIDE for c, s in zip(data, [state] + [scan_by_byte(data[:i], state)[0] for i in range(1, len(data))])):
                continue
            after, change, _ = J.scan(data, state)
            want, depths = scan_by_byte(data, state)
            assert (after, change.tolist()) == (want, depths), (data, state)


def gene_map(n, seed=0):
    r = random.Random(seed)
    return {r.choice(NASTY) + str(i): [r.choice(NASTY) for _ in range(r.randrange(5))] for i in range(n)}


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (2, False), ("\n\t ", False)])
def test_one_object_over_many_ranges(spark, tmp_path, indent, ascii_only):
    want = gene_map(150)
    (tmp_path / "m.json").write_text(json.dumps(want, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    size = (tmp_path / "m.json").stat().st_size
    for range_bytes, chunk in ((size // 25, 7), (size // 3, 1 << 20), (1 << 30, 64)):
        rows = J.read_json_map(spark, str(tmp_path), "array<string>", range_bytes, chunk).collect()
        assert {r["key"]: r["value"] for r in rows} == want and len(rows) == len(want)
    got = R.read_gene_go(spark, str(tmp_path / "m.json"), whole_file=True, range_bytes=100)
    assert {r["gene_id"]: r["go_terms"] for r in got.collect()} == want


def test_long_members_empty_objects_and_repeats(spark, tmp_path):
    (tmp_path / "a.json").write_text('{ }\n{"1": ["x"], "2" : null,"3":[]}{"1": ["y"]}\n\n{"4": [' + ", ".join('"t"' for _ in range(3000)) + "]}")
    (tmp_path / "b.json").write_text("")
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        f.write('{"5": ["z"],\n "1": ["w"]}')
    got = {r["gene_id"]: r["go_terms"] for r in R.read_gene_go(spark, str(tmp_path), whole_file=True, range_bytes=10).collect()}
    assert got == {"1": ["w"], "2": None, "3": [], "4": ["t"] * 3000, "5": ["z"]}


@pytest.mark.parametrize("text,message", [('{"1": ["x"]', "not closed"), ('{"1": ["x', "not closed"), ('{"1": "x"}', "MALFORMED"), ('{"1": [x]}', "MALFORMED"), ('{"1": [x}]}', "not closed")])
def test_broken_texts_raise(spark, tmp_path, text, message):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=message):
        R.read_gene_go(spark, str(tmp_path), whole_file=True, range_bytes=4).collect()


def test_no_files(spark, tmp_path):
    assert R.read_gene_go(spark, str(tmp_path), whole_file=True).collect() == []


def test_read_gene2go(spark, tmp_path):
    head = "#tax_id\tGeneID\tGO_ID\tEvidence\tQualifier\tGO_term\tPubMed\tCategory\n"
    with gzip.open(tmp_path / "gene2go.gz", "wt") as f:
        f.write(head + '9\t1\tGO:2\tIEA\t-\tb "quoted\t-\tP\n9\t2\tGO:1\tIEA\t-\ta\t-\tP\n9\t1\tGO:1\tIEA\t-\ta\t-\tP\n'
                '9\t1\tGO:2\tIDA\t-\tb "quoted\t-\tP\n9\t3\tGO:9\tIEA\t-\t-\t-\tP\n9\t\tGO:9\tIEA\t-\tq\t-\tP\n')
    rows = R.read_gene2go(spark, str(tmp_path))
    assert rows.count() == 5 and {r["go_id"] for r in rows.where(F.col("gene_id") == "1").collect()} == {"GO:1", "GO:2"}
    got = {r["gene_id"]: r["go_terms"] for r in gene2go_map(rows.where("go_term is not null")).collect()}
    assert got == {"1": ['b "quoted', "a"], "2": ["a"]}
    (tmp_path / "gene2go.gz").unlink()
    (tmp_path / "x.tsv").write_text("GeneID\tGO_ID\n1\tGO:1\n")
    with pytest.raises(ValueError, match="GO_term"):
        R.read_gene2go(spark, str(tmp_path))
