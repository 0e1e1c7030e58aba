"""K1 in pieces: lines longer than any row, written over several files."""

import os

import pytest
from pyspark.sql import functions as F

from seqloom.operators import annotations as A
from seqloom.sources import readers as R
from seqloom.sources import sinks as S


def genome_rows(spark):
    rows = [("hot", i, f"g{i}", "ACGT"[i % 4]) for i in range(500)] + [("b", 1, None, "AC"), ("b", 2, "x", None), ("c", 1, None, None)]
    return spark.createDataFrame(rows, "accession string, ord long, label string, seq string")


def written(path):
    return b"".join(open(os.path.join(path, n), "rb").read() for n in sorted(os.listdir(path)) if n.startswith("part-")).decode()


@pytest.mark.parametrize("size,parts", [(3, 7), (64, 1), (1, 40)])
def test_same_bytes_as_whole_lines(spark, tmp_path, size, parts):
    rows = genome_rows(spark)
    S.write_line_pieces(A.gene_pieces(rows, size), str(tmp_path / "g"), partitions=parts)
    whole = S.corpus_lines(A.gene_sentence(rows)).collect()
    assert written(tmp_path / "g") == "".join(sorted(r["value"] + "\n" for r in whole))
    S.write_line_pieces(A.nt_pieces(rows, size=size), str(tmp_path / "n"), sep="", partitions=parts)
    whole = S.corpus_lines(A.nt_sentence(rows), col="nt").collect()
    assert written(tmp_path / "n") == "".join(sorted(r["value"] + "\n" for r in whole))
    if parts > 1:  # the long line lies in several files, and comes back whole
        names = [n for n in os.listdir(tmp_path / "g") if n.startswith("part-")]
        assert len(names) > 2
        parts_of = R.read_line_pieces(spark, str(tmp_path / "g")).where("line = 1").orderBy("part").collect()
        assert len(parts_of) > 2 and "".join(r["text"] for r in parts_of) == "hot: " + " ".join(f"g{i}" for i in range(500))


def test_no_row_is_longer_than_a_piece(spark):
    assert A.gene_pieces(genome_rows(spark), 3).agg(F.max(F.length("text"))).first()[0] == len("g100 g101 g102")


def test_awkward_pieces(spark, tmp_path):
    rows = [(None, 0, "lost"), ("é", 1, "b"), ("é", 0, "a"), ("e", 0, ""), ("e", 1, None), ("f", 5, "ü"), ("f", 7, "")]
    df = spark.createDataFrame(rows, "accession string, piece int, text string")
    S.write_line_pieces(df, str(tmp_path / "x"))
    assert written(tmp_path / "x") == "f: ü\né: a b\n"
    got = sorted(tuple(r) for r in R.read_line_pieces(spark, str(tmp_path / "x")).select("line", "text").collect())
    assert [i for i, _ in got] == sorted(i for i, _ in got) and "".join(t for i, t in got if i == 0) == "f: ü"
    with pytest.raises(ValueError):
        S.write_line_pieces(df, str(tmp_path / "y"), sep=",")
    S.write_line_pieces(df.limit(0), str(tmp_path / "z"))
    assert written(tmp_path / "z") == ""
