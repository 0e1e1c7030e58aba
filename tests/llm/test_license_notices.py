import random
import re
import textwrap

import pytest

from seqloom.llm import license_notices as N
from seqloom.llm import licenses
from tests.llm.helpers import EMPTY, frame, null_id, prose


def brute(texts, templates, percent=80):
    """Every run of pieces against every template, without any pruning."""
    out = []
    for doc, text in enumerate(texts):
        pieces = [re.sub(r"[\W_]+", " ", p).split() for p in re.split(r"\n|(?<=[.!?;:])[ \t]+", (text or "").lower())]
        pieces = [p for p in pieces if p]
        for name, body in templates.items():
            t, words = N.Template(name, body, percent), re.sub(r"[\W_]+", " ", body.lower()).split()
            want, runs = set(zip(words, words[1:])), {}
            for i in range(len(pieces)):
                run = []
                for j in range(i, len(pieces)):
                    run += pieces[j]
                    if len(run) > t.span:
                        break
                    have = set(zip(run, run[1:]))
                    common = len(have & want)
                    if have and 200 * common >= percent * (len(have) + len(want)):
                        runs[i, j] = (2.0 * common / (len(have) + len(want)), len(run), len(have), common)
            for (i, j), (dice, size, n, common) in runs.items():
                rival = [(-d, k) for (a, b), (d, k, *_) in runs.items() if a == i or b == j]
                if min(rival) == (-dice, size):
                    out.append((doc, sum(map(len, pieces[:i])), size, name, n, common, dice))
    return sorted(out)


def corpus():
    rnd = random.Random(3)

    def noise(k, n=40):
        return textwrap.fill(" ".join(prose(k, n)), 70)

    texts = [f"{noise(k)}\n{textwrap.fill(N.NOTICES[name], 60 + k)}\n\n{noise(90 + k)}" for k, name in enumerate(N.NOTICES)]
    texts += [f"{noise(7)}. {' '.join(N.NOTICES[name].split())} {noise(8)}" for name in ("mit-text", "bsd-3-text", "gpl-3.0-header")]
    texts += ["The code is old. Released under the MIT License. Ask before use.", "# " + N.NOTICES["mit-text"].replace("\n", "\n# "),
              "All rights reserved. All rights reserved.\nall rights reserved", "licensed software\nthe rights of copyright"]
    for k in range(10):  # edited notices around the threshold
        words = N.NOTICES["apache-2.0-header"].split()
        for _ in range(3 + k):
            words[rnd.randrange(len(words))] = "changed"
        texts.append(f"{noise(k)}\n{textwrap.fill(' '.join(words), 50)}\n{noise(k + 1)}")
    return texts + EMPTY


def test_notices_equal_brute_force(spark):
    texts = corpus()
    got = sorted(tuple(r) for r in N.scan_notices(frame(spark, texts, 3)).collect())
    assert got == brute(texts, N.NOTICES)
    assert {r[3] for r in got} == set(N.NOTICES)


def test_wrapped_and_inner_notices_are_found(spark):
    mit = textwrap.fill(N.NOTICES["mit-text"], 72)
    texts = [" ".join(prose(1, 50)) + "\nMIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit + "\n" + " ".join(prose(2, 50)),
             "Some words come first. Released under the MIT License. Other words follow here."]
    df = frame(spark, texts, 2, [null_id(mit)])
    rows = N.scan_notices(df).collect()
    assert {(0, "mit-text"), (1, "mit"), (None, "mit-text")} <= {(r["doc_id"], r["template"]) for r in rows}
    assert licenses.scan_licenses(df.where("doc_id is not null")).collect() == []  # single lines are not enough
    assert N.scan_notices(df.where("false")).collect() == []


def test_every_match_has_a_needed_word():
    known = [N.Template(n, t, 80) for n, t in N.NOTICES.items()]
    words = set(N.needed_words(known))
    for t in known:
        assert sum(words.isdisjoint(g.split()) for g in t.grams) < t.least


@pytest.mark.parametrize("rows", ["true", "false"])
def test_notices_are_native(spark, rows):
    plan = N.scan_notices(frame(spark, corpus()[:3]).where(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
