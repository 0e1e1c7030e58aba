import pytest
from pyspark.sql import functions as F

from seqloom.llm import quality_classifier, quality_rules, toxicity
from seqloom.llm.common import held_out
from seqloom.llm.queries import REGISTRY
from tests.llm.helpers import EMPTY, frame, null_id, prose

SF01 = "/root/testdata/sf0.1"


def accuracy(spark, name, label):
    labels = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", label)
    rows = REGISTRY[name][0](spark, SF01).where("held_out").join(labels, "doc_id").collect()
    ranks = sorted(rows, key=lambda r: r["score"])
    ones = [i for i, r in enumerate(ranks) if r[label] == 1]
    n1, n0 = len(ones), len(rows) - len(ones)
    auc = (sum(ones) - n1 * (n1 - 1) / 2) / (n1 * n0)
    return auc, sum(r["predicted"] == r[label] for r in rows) / len(rows), rows


@pytest.mark.parametrize("name,label", [("op1_toxicity", "toxic"), ("op7_quality_classifier", "quality")])
def test_held_out_accuracy(spark, name, label):
    auc, right, rows = accuracy(spark, name, label)
    assert auc > 0.9 and right > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def labels_of(spark, n, label):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)] + [(None, 1, 1), (1, None, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("labelled", [True, False])
def test_classifiers_take_awkward_rows(spark, labelled):
    texts = [" ".join(prose(k, 60) + (["idiot", "scum"] * 3 if k % 2 else [])) for k in range(60)] + EMPTY
    df = frame(spark, texts, 3, [null_id("x"), (3, "twice", *[None] * 8)])
    labels = labels_of(spark, 60, "toxic").where(F.lit(labelled))
    learn = ~held_out(F.col("doc_id"), 5, 0)
    for scored in (toxicity.score_toxicity(df, *toxicity.fit_toxicity(df, labels, learn)),
                   quality_classifier.score_quality(df, quality_classifier.fit_quality(df, labels, learn))):
        rows = scored.collect()
        assert len(rows) == len(texts) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    none = df.where("false")
    assert toxicity.score_toxicity(none, *toxicity.fit_toxicity(none, labels, learn)).count() == 0


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idiot$": 4.0, "scum": 3.0})
    plain, aimed = g.features("such an idiot here."), g.features("you are an idiot.")
    negated, quoted = g.features("this is not an idiot."), g.features("somebody said idiot.")
    assert aimed[0] > plain[0] > quoted[0] > negated[0] > 0 == g.features("nothing here.")[0]
    assert g.features("i will kill you.")[0] > g.features("kill the process.")[0] > 0
    assert g.features("an idiot. scummy, idiot")[2] > plain[2]  # clauses, and a word beginning


def brute_repeat(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i:i + k]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(k)})


def test_rules_on_awkward_rows(spark):
    loop = " ".join(prose(1, 12) * 4)
    texts = EMPTY + [loop, " ".join(prose(2, 300)), "a # b\n\nx y\nx y\n  \nx y\n" + "é " * 30]
    df = frame(spark, texts, 2, [null_id("x y")])
    labels = labels_of(spark, len(texts), "quality")
    for lab in (labels, labels.where("false")):
        rows = {r["doc_id"]: r for r in quality_rules.quality_rules(df, quality_rules.trusted_ids(lab)).collect()}
        for i, t in enumerate(texts):
            words = (t or "").encode().split()
            assert rows[i]["n_words"] == len(words) and rows[i]["n_repeat_words"] == brute_repeat(words)
            assert rows[i]["word_chars"] == sum(len(w.decode()) for w in words)
            assert not (rows[i]["base_failed"] and rows[i]["kept"])
        assert rows[8]["n_dup_lines"] == 2 and rows[8]["n_symbols"] == 1 and len(rows) == len(texts) + 1
    assert all(r["llr_micro"] == 0 for r in rows.values())  # nothing trusted: the base rules alone
    kept = quality_rules.keep_good(df, quality_rules.trusted_ids(labels))
    assert kept.columns == df.columns
    assert quality_rules.keep_good(df.where("false"), quality_rules.trusted_ids(labels)).count() == 0
