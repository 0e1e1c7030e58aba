"""Licence notices anywhere in a text: runs of neighbouring pieces against whole licence texts and
headers, by the Dice coefficient over sets of word bigrams (as ``licenses``, whose result is held
to its SQL and whose units are single lines and whole texts).

A text is cut into pieces at newlines and after ``. ! ? ; :`` before a blank. A unit is any run
of neighbouring pieces (a line, a sentence, a wrapped notice, a paragraph, the whole text) of at most
as many words as the template's size bound allows. Of the runs that reach the threshold for
a template, those are returned that no run with the same first or the same last piece beats
(equal scores: the shorter run).

Plan, DataFrame expressions: a run with Dice ``t`` holds at least ``t / (2 - t)`` of the
template's bigrams, so (1) one text search a word keeps the texts with any word of a set that
no match can do without; (2) the bigrams of the text must hold that share of a template;
(3) only runs that start where so many of them lie in reach are built and scored. None of
the three can lose a match. Only matches are shuffled (narrow rows).

Bounded list: short licences whole (MIT, BSD, ISC, zlib, Boost, Unlicense), long ones (Apache, GPL,
LGPL, AGPL, MPL) by the notices they tell users to attach, which the full texts of Apache 2.0, GPL
and MPL also contain; the full text of LGPL 3 is not found. A notice that shares its sentence with
other words is found only if the whole run still reaches the threshold.

Defined cases: null and empty texts match nothing; a run that several templates match gives one row
for each; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.licenses import TEMPLATES, THRESHOLD_PERCENT
from seqloom.llm.line_dedup import _let

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""


def _gnu(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the
GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


NOTICES = TEMPLATES | {
    "mit-sentence": "Licensed under the MIT License.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "bsd-2-text": _BSD + _BSD_END,
    "bsd-3-text": _BSD + _BSD_3 + _BSD_END,
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
not be removed or altered from any source distribution.""",
    "boost-notice": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "gpl-2.0-header": _gnu("General Public License", "2"),
    "gpl-3.0-header": _gnu("General Public License", "3"),
    "lgpl-header": _gnu("Lesser General Public License", "2.1"),
    "agpl-header": _gnu("Affero General Public License", "3"),
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


class Template:
    """Bigrams of a template, the least number a match has in common, and the most words of a run."""

    def __init__(self, name: str, text: str, percent: int):
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        self.name, self.grams = name, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
        self.m = len(self.grams)
        self.least = -(-self.m * percent // (200 - percent))
        self.span = self.m * (200 - percent) // percent + 1 + (len(words) - 1 - self.m)


def needed_words(templates: list[Template]) -> list[str]:
    """Words of which every match has at least one: without all of them a text has too few of any
    template's bigrams. Long words first, as they are rare."""
    chosen: set[str] = set()
    for t in templates:
        pairs = [g.split() for g in t.grams]
        for word in [None, *sorted({w for p in pairs for w in p} - chosen, key=lambda w: (-len(w), w))]:
            if word:
                chosen.add(word)
            if sum(not chosen.isdisjoint(p) for p in pairs) > t.m - t.least:
                break
    return sorted(chosen, key=lambda w: (-len(w), w))


def _words(text: Column) -> Column:
    """``(w, first)``: the words of a text; ``first`` starts a piece."""
    cut = F.regexp_replace(F.lower(text), r"\n|(?<=[.!?;:])[ \t]+", "\u0001")
    pieces = F.split(F.regexp_replace(cut, "[^\\p{L}\\p{N}\u0001]+", " "), "\u0001")
    return F.flatten(F.transform(pieces, lambda p: F.transform(
        F.array_remove(F.split(p, " "), ""), lambda w, k: F.struct(w.alias("w"), (k == 0).alias("first")))))


def _bigrams(words: Column) -> Column:
    """Bigram ``i`` at index ``i``."""
    return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def scan_notices(docs: DataFrame, templates: dict[str, str] = NOTICES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``(doc_id, first_word, n_words, template, n_bigrams, common, dice)`` of the best runs."""
    known = [Template(n, t, percent) for n, t in templates.items()]

    def strings(xs):
        return F.array(*[F.lit(x) for x in xs])

    every = strings(sorted({g for t in known for g in t.grams}))
    of = F.array(*[F.struct(F.lit(t.name).alias("name"), strings(t.grams).alias("grams"), F.lit(t.m).alias("m"),
                            F.lit(t.least).alias("least"), F.lit(t.span).alias("span")) for t in known])

    def any_word(text):
        hit = F.lit(False)
        for w in needed_words(known):
            hit = hit | F.contains(text, F.lit(w))
        return hit

    texts = (docs.where(F.col("text").isNotNull() & _let(F.lower("text"), any_word))
             .select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), _words(F.col("text")).alias("z")))

    def near(grams):  # templates of which the text holds enough bigrams
        return F.array_compact(F.array(*[F.when(F.size(F.array_intersect(grams, strings(t.grams))) >= t.least, F.lit(i + 1))
                                         for i, t in enumerate(known)]))

    some = F.when(F.size("z") > 1, _let(F.array_intersect(every, _bigrams(F.col("z.w"))), near))
    hits = texts.select("doc_id", "row", "z", F.explode(some).alias("at"))

    def windows(w, grams, t):
        """The start of every piece with enough of the template's bigrams in reach, with the words
        in reach and the lengths of the runs."""
        def of_places(inside, starts, ends):
            live = F.filter(starts, lambda s: F.size(F.filter(inside, lambda a: (a >= s) & (a < s + t["span"] - 1))) >= t["least"])
            return F.transform(live, lambda s: F.struct(
                s.alias("s"), F.slice(w, s, t["span"]).alias("words"),
                F.transform(F.filter(ends, lambda e: (e > s) & (e < s + t["span"])), lambda e: e - s + 1).alias("lengths")))

        return _let(F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i + 1)), lambda i: i.isNotNull()),
                    lambda inside: _let(F.filter(F.transform(F.col("z.first"), lambda f, i: F.when(f, i + 1)), lambda i: i.isNotNull()),
                                        lambda starts: _let(F.concat(F.transform(F.slice(starts, F.lit(2), F.size(w)), lambda s: s - 1),
                                                                     F.array(F.size(w))),
                                                            lambda ends: of_places(inside, starts, ends))))

    reach = _let(F.col("z.w"), lambda w: _let(_bigrams(w), lambda grams: _let(
        F.element_at(of, F.col("at")), lambda t: windows(w, grams, t))))
    runs = (hits.select("doc_id", "row", "at", F.explode(reach).alias("r"))
            .select("doc_id", "row", "at", F.col("r.s").alias("s"), F.col("r.words").alias("words"), F.explode("r.lengths").alias("n_words")))
    score = _let(F.array_distinct(_bigrams(F.slice("words", F.lit(1), F.col("n_words")))), lambda g: _let(
        F.element_at(of, F.col("at")), lambda t: F.struct(
            F.size(g).alias("n"), t["m"].alias("m"), F.size(F.array_intersect(g, t["grams"])).alias("common"), t["name"].alias("name"))))
    scored = (runs.select("doc_id", "row", "at", "s", "n_words", F.explode(F.array(score)).alias("x"))
              .where(200 * F.col("x.common") >= percent * (F.col("x.n") + F.col("x.m")))
              .withColumn("dice", 2.0 * F.col("x.common") / (F.col("x.n") + F.col("x.m"))).withColumn("e", F.col("s") + F.col("n_words")))
    best = (scored.withColumn("by_start", F.row_number().over(W.partitionBy("row", "at", "s").orderBy(F.desc("dice"), "n_words")))
            .withColumn("by_end", F.row_number().over(W.partitionBy("row", "at", "e").orderBy(F.desc("dice"), "n_words")))
            .where("by_start = 1 AND by_end = 1"))
    return best.select("doc_id", (F.col("s") - 1).cast("long").alias("first_word"), F.col("n_words").cast("long").alias("n_words"),
                       F.col("x.name").alias("template"), F.col("x.n").cast("long").alias("n_bigrams"),
                       F.col("x.common").cast("long").alias("common"), "dice")
