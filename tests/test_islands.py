"""E4 on genes that overlap or lack an end, over any number of partitions."""

import random

import pytest

from seqloom.operators import evaluate as E
from seqloom.operators.positions import islands

SCHEMA = "acc string, strand string, start long, end long, g string"


def brute(rows, gap, reach):
    """Walk the rows in order, nulls first."""
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:4]) + (r[4],)
    out, run, last, ends = {}, 0, None, []
    for r in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or ""), key(r)[2], key(r)[3], r[4])):
        if last != r[:2]:
            ends = []
        known = [e for e in ends if e is not None]
        far = (ends[-1] if ends else None) if reach == "last" else max(known, default=None)
        if r[2] is None or far is None or r[2] - far > gap:
            run += 1
        out[r[4]] = run
        last = r[:2]
        ends.append(r[3])
    return out


@pytest.mark.parametrize("reach", ["last", "max"])
@pytest.mark.parametrize("parts", [1, 5, 40])
def test_islands_match_a_walk(spark, reach, parts):
    rnd = random.Random(parts)
    rows = []
    for i in range(1500):
        start = rnd.randrange(60_000) if rnd.random() < 0.97 else None
        end = (start or 0) + rnd.choice([5, 40, 40, 40, 900]) if rnd.random() < 0.95 else None
        rows.append((rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice(["+", "+", "-", None]), start, end, f"g{i}"))
    rows += [("huge", "+", 2 ** 60 + i, 2 ** 60 + i + (10 ** 9 if i == 0 else 1), f"h{i}") for i in range(50)]  # one gene covers many partitions
    rows += [("long", "+", 10 * i, 9000 if i == 0 else 10 * i + 1, f"l{i}") for i in range(0, 1200, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["g"]: r["island"] for r in islands(df, ["acc", "strand", "start", "end", "g"], ["acc", "strand"], "start", "end", 50,
                                                partitions=parts, reach=reach).collect()}
    assert got == brute(rows, 50, reach)


def test_gene_inside_a_longer_one(spark):
    rows = [("gene", "NC_1", "+", 0, 1000, "g1"), ("gene", "NC_1", "+", 100, 200, "g2"), ("gene", "NC_1", "+", 1010, 1100, "g3")]
    ft = spark.createDataFrame(rows, "feature string, genomic_accession string, strand string, start long, end long, locus_tag string")
    assert [r["genes"] for r in E.operons(ft, reach="max").collect()] == ["g1 g2 g3"]
    assert sorted(r["genes"] for r in E.operons(ft).collect()) == ["g1 g2", "g3"]
    with pytest.raises(ValueError):
        E.operons(ft, reach="other")
    assert E.operons(ft.where("false"), reach="max").collect() == []
