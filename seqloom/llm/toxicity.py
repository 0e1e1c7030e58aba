"""Toxicity by a weighted finite-state pattern grammar.

Four small transducers are composed and run over the clauses of a text:

* the *lexicon* reads a word letter by letter and writes a class: insult or threat with a
  weight, target, negation, reported speech, or nothing. Insult arcs (word beginnings and
  whole words) and their weights are learned from labelled texts; the closed classes are
  fixed word lists.
* *negation* opens a scope of three words in which matches weigh a quarter;
* *reported speech* halves matches up to the end of the clause;
* *target* raises insults by a quarter and lets threats count in full.

A clause scores the sum of its matches; the document's features are the largest clause
score, the sum over clauses, and the number of matching clauses. A logistic curve, fitted on
labelled rows scored by a lexicon that has not seen them, maps them to a probability. Labels, language,
source and id are never inputs of a score.

The lexicon is learned from at most ``PER_CLASS`` labelled rows of either class, counted in
tasks; it keeps at most ``MAX_ARCS`` arcs. Every text is
scored whole.

Defined cases: null and empty texts have no match and score like any text without one;
rows repeat and tie freely; without toxic labels nothing is learned and the fixed lists score
alone; null labels and ids take no part in learning; an empty table gives no rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import fit_logistic, labelled_sample, stored, text_bytes

PER_CLASS = 20_000
MAX_ARCS = 20_000
MIN_DOCS = 3
MIN_WEIGHT = 1.0
PREFIXES = range(3, 9)
STRIP = ".,;:!?\"'()[]{}#$%&*|<>«»¿¡…-_"
CLAUSE_END = ".,;:!?"

# closed classes of the grammar (fixed values)
THREATS = "kill murder hurt destroy beat shoot stab strangle töten umbringen tuer frapper matar golpear"
TARGETS = "you your yours u he she they him her them dich dir euch toi vous tu te usted ustedes"
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie pas jamais nunca jamás"
REPORTS = "said says say told wrote writes quoted claimed sagte sagt schrieb dit écrit dijo dice escribió"

NONE, END, NEGATION, REPORT, TARGET, HIT = 0, 1, 2, 3, 4, 16


def arcs(word: str) -> list[str]:
    """Lexicon inputs that a word offers: its beginnings, and itself with an end mark."""
    return [word[:k] for k in PREFIXES if len(word) >= k] + ([word + "$"] if word else [])


class Grammar:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.matches: list[tuple[float, bool, bool]] = []  # weight, is a threat, ends the clause
        self._threats = set(THREATS.split())
        self._closed = {w: c for c, ws in ((NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS))
                        for w in ws.split()}
        grammar = self

        class Codes(dict):
            def __missing__(self, raw: str) -> int:
                if len(self) > 300_000:
                    self.clear()
                self[raw] = c = grammar.code(raw)
                return c

        self.codes = Codes()

    def code(self, raw: str) -> int:
        """Lexicon: word to class code; +8 marks a word that ends its clause."""
        word, ends = raw.strip(STRIP), raw[-1] in CLAUSE_END
        weight = max((self.weights[a] for a in arcs(word) if a in self.weights), default=0.0)
        threat = word in self._threats
        if weight or threat:
            m = (max(weight, 2.0 * threat), threat and not weight, ends)
            if m not in self.matches:
                self.matches.append(m)
            return HIT + self.matches.index(m)
        return self._closed.get(word, NONE) + 8 * ends

    def features(self, text: str) -> tuple[float, float, float]:
        codes = list(map(self.codes.__getitem__, text.lower().split()))
        if max(codes, default=0) < HIT:
            return 0.0, 0.0, 0.0
        best = total = clauses = 0.0
        score, negated, reported, target, position = 0.0, -9, False, False, 0
        pending = 0.0  # threats wait for a target of their clause
        for position, c in enumerate(codes):
            if c == NONE:
                continue
            ends = bool(c & 8) if c < HIT else False
            if c >= HIT:
                weight, threat, ends = self.matches[c - HIT]
                weight *= (0.25 if position - negated <= 3 else 1.0) * (0.5 if reported else 1.0)
                if threat:
                    pending += weight
                else:
                    score += weight
            else:
                kind = c & 7
                if kind == NEGATION:
                    negated = position
                elif kind == REPORT:
                    reported = True
                elif kind == TARGET:
                    target = True
            if ends or position == len(codes) - 1:
                score = score * (1.25 if target else 1.0) + pending * (1.0 if target else 0.25)
                if score:
                    best, total, clauses = max(best, score), total + score, clauses + 1
                score, negated, reported, target, pending = 0.0, -9, False, False, 0.0
        score = score * (1.25 if target else 1.0) + pending * (1.0 if target else 0.25)
        if score:
            best, total, clauses = max(best, score), total + score, clauses + 1
        return math.log1p(best), math.log1p(total), math.log1p(clauses)


def learn_lexicon(texts: DataFrame, max_arcs: int = MAX_ARCS) -> dict[str, float]:
    """Insult arcs from ``(t, y)``: an arc's weight is the lower confidence bound of its
    document log odds between toxic and other texts."""

    def count(batches):
        from collections import Counter

        n: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def rows():
            keys = list(n[1].keys() | n[0].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()),
                 pa.array([n[0][k] for k in keys], pa.int64())], ["arc", "toxic", "other"])
            n[0].clear()
            n[1].clear()
            return out

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w.strip(STRIP) for w in t.decode("utf-8", "replace").lower().split()}
                n[y].update({a for w in words for a in arcs(w)} | {""})  # "" counts the texts
                if len(n[0]) + len(n[1]) > 500_000:
                    yield rows()
        yield rows()

    arcs_seen = texts.mapInArrow(count, "arc string, toxic long, other long").groupBy("arc").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = stored(arcs_seen.where(f"toxic >= {MIN_DOCS} or arc = ''"), "arcs")
    total = counts.where("arc = ''").first()
    if total is None or not total["toxic"]:
        return {}
    t, o = F.col("toxic") + 0.5, F.col("other") + 0.5
    weight = (F.log(t / (total["toxic"] + 1)) - F.log(o / (total["other"] + 1))
              - 1.64 * F.sqrt(1 / t + 1 / o))
    best = (counts.where("arc <> ''").withColumn("w", weight).where(F.col("w") >= MIN_WEIGHT)
            .orderBy(F.desc("w"), "arc").limit(max_arcs).collect())
    return {r["arc"]: r["w"] for r in best}


def _features_of(grammar_weights: dict[str, float]):
    def run(batches):
        grammar = Grammar(grammar_weights)
        for batch in batches:
            f = [grammar.features(t.decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            best, total, clauses = (list(c) for c in zip(*f)) if f else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.float64()) for c in (best, total, clauses))],
                ["doc_id", "best_clause", "log_total", "log_clauses"])

    return run


def toxicity_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).mapInArrow(
        _features_of(lexicon), "doc_id long, best_clause double, log_total double, log_clauses double")


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS):
    """``(lexicon, weights)`` learned from labelled rows where ``learn`` (a condition on
    ``doc_id``) holds. The curve is fitted on features that each half of the rows gets from
    the lexicon of the other half; the lexicon returned is learned from all of them."""
    ids = stored(labelled_sample(labels, "toxic", learn, per_class), "toxic-ids")
    rows = docs.select("doc_id", text_bytes().alias("t")).join(F.broadcast(ids), "doc_id")
    half = F.pmod("u", F.lit(2))
    seen = []
    for h in (0, 1):
        part = learn_lexicon(rows.where(half == h).select("t", F.col("y").cast("int")))
        other = rows.where(half != h)
        seen += toxicity_features(other.select("doc_id", F.col("t").alias("text")), part).join(
            F.broadcast(ids), "doc_id").select("best_clause", "log_total", "log_clauses", "y").collect()
    lexicon = learn_lexicon(rows.select("t", F.col("y").cast("int")))
    if len({r["y"] for r in seen}) < 2:
        return lexicon, [0.5, 0.5, 0.0, -3.0]
    return lexicon, fit_logistic([r[:3] for r in seen], [r["y"] for r in seen]).tolist()


def score_toxicity(docs: DataFrame, lexicon: dict[str, float], weights: list[float]) -> DataFrame:
    """Per document the grammar's features and ``score``, the probability of label 1."""
    f = toxicity_features(docs, lexicon)
    z = (F.col("best_clause") * weights[0] + F.col("log_total") * weights[1]
         + F.col("log_clauses") * weights[2] + weights[3])
    return f.withColumn("score", 1 / (1 + F.exp(-z)))
