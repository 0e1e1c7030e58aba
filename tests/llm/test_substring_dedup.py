import hashlib

from seqloom.llm import substring_dedup as S
from tests.llm.helpers import EMPTY, edited, frame, null_id, prose


def brute(texts):
    first = {}
    words = [(t or "").encode().split() for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i:i + 50]), d)
    out = []
    for d, w in enumerate(words):
        gone = {k for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < d for k in range(i, i + 50)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    shared = prose(1, 64)
    texts = list(EMPTY)
    texts += [" ".join(prose(10 + k, 20 + k) + shared[:50 + k % 12] + prose(60 + k, 25)) for k in range(40)]
    base = prose(2, 400)
    texts += [" ".join(edited(base, k, k)) for k in range(8)] + [" ".join(base)] * 4
    loop = prose(3, 7) * 30  # repeats inside one document
    texts += [" ".join(loop), " ".join(loop[3:150]), " ".join(prose(4, 30) + loop[:49]), " ".join(loop[:50])]
    texts += ["é\xa0" + " ".join(shared[:49]), "\n".join(shared), " ".join(prose(5, 3000))]
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    assert sorted(tuple(r) for r in S.removed_digest(frame(spark, texts, 4)).collect()) == brute(texts)


def test_many_shards_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_WORDS", 40)
    monkeypatch.setattr(S, "TASK_WORDS", 500)
    monkeypatch.setattr(S, "PIECE_WORDS", 60)
    monkeypatch.setattr(S, "AUTOMATON_WORDS", 130)
    texts = corpus()
    assert sorted(tuple(r) for r in S.removed_digest(frame(spark, texts, 3)).collect()) == brute(texts)


def test_texts_without_their_repeats(spark):
    texts = corpus()
    out = S.remove_repeats(frame(spark, texts, 2))
    assert out.columns[:10] == ["doc_id", "text", "lang", "source", "n_chars", "t", "key", "n", "seq", "s"]
    got = {r["doc_id"]: r for r in out.collect()}
    for d, n, gone, sha in brute(texts):
        words = (got[d]["text"] or "").encode().split()
        assert got[d]["n_removed"] == gone and hashlib.sha256(b" ".join(words)).hexdigest() == sha
        assert gone or got[d]["text"] == texts[d]


def test_null_and_repeated_ids(spark):
    text = " ".join(prose(9, 80))
    df = frame(spark, [text], 1, [null_id(text), (0, text, *[None] * 8), (5, text, *[None] * 8), (5, "b", *[None] * 8)])
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_removed"]) for r in S.removed_digest(df).collect())
    assert got == [(False, 0, 80, 0), (False, 0, 80, 0), (False, 5, 1, 0), (False, 5, 80, 80), (True, None, 80, 0)]
    assert S.removed_digest(df.where("false")).collect() == []


def test_gram_hashes_depend_on_the_words_alone():
    h = S.word_hashes([b"%d" % (i % 13) for i in range(120)])
    for length in (1, 5, 25, 50):
        g = S.gram_hashes(h, length)
        assert len(g) == 121 - length and (g[:13] == g[13:26]).all() and len(set(g.tolist())) == 13


def test_more_different_words_than_letters():
    words = [b"%d" % i for i in range(1_200_000)]
    passages = [(1, b" ".join(words[i:i + S.PIECE_WORDS])) for i in range(0, len(words), S.PIECE_WORDS - S.WINDOW + 1)]
    found, count = [], 0
    for automaton in S.automata(passages, S.AUTOMATON_WORDS):
        count += 1
        found += automaton.spans(2, [b"x"] + words[1_000_000:1_000_080] + [b"y"])
    assert count == 2 and S.merged(found) == [(1, 81)]


def test_names_that_the_table_has_already(spark):
    texts = corpus()
    df = frame(spark, texts, 2).selectExpr("doc_id", "text", "1 as n_removed", "2 as id_of_spans", "3 as new_text", "4 as by_seq", "5 as __id", "6 as __new", "7 as N_removed_")
    out = S.remove_repeats(df)
    assert out.columns == [*df.columns, "n_removed__"]
    got = {r["doc_id"]: r["n_removed__"] for r in out.collect()}
    assert got == {d: gone for d, _, gone, _ in brute(texts)}
