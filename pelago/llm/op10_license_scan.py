"""License scan: template markup compiled into token automata, besides fixed phrases.

A template is a text with `<<optional>> ... <</optional>>` regions, which may be absent, and
`<<any:m:n>>` regions, which stand for m to n words of any kind. It compiles into a
non-deterministic automaton over words; a place is accepted only if all mandatory wording follows
exactly. Word hashes of the whole batch find the places where a template's first two words stand;
the automaton runs from there over the whole rest of the text if it has to.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are
scanned alike; an empty table gives an empty table; other columns are not read. The score is 1
where a template is accepted, at least 0.5 where a phrase stands, and otherwise half the share of
the mandatory words that the best attempt has reached.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .textvec import ALNUM, Texts

#: The phrases of the base rule and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_NO_WARRANTY = """
as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
particular purpose are disclaimed in no event shall <<any:1:12>> be liable for any direct indirect incidental special exemplary or
consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business
interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
arising in any way out of the use of this software even if advised of the possibility of such damage
"""
_BSD = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following
disclaimer <<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and
the following disclaimer in the documentation and or other materials provided with the distribution
"""
#: Wording of public licences and licence notices; every template starts with two plain words.
TEMPLATES = {
    "mit-license": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
        software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>>
        shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
        express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
        noninfringement in no event shall <<any:1:12>> be liable for any claim damages or other liability whether in an action of contract
        tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "bsd-2-clause": f"{_BSD} this software is provided by <<any:1:12>> {_NO_WARRANTY}",
    "bsd-3-clause": f"""{_BSD} <<optional>>3<</optional>> neither the name of <<any:1:12>> nor the names of <<any:1:3>> contributors may be used
        to endorse or promote products derived from this software without specific prior written permission
        this software is provided by <<any:1:12>> {_NO_WARRANTY}""",
    "isc": """
        permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
        <<any:1:6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in
        no event shall <<any:1:6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting
        from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in
        connection with the use or performance of this software""",
    "zlib": """
        this software is provided as is without any express or implied warranty in no event will <<any:1:4>> be held liable for any damages
        arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely subject to the following restrictions <<optional>>1<</optional>> the origin
        of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a
        product an <<any:1:1>> in the product documentation would be appreciated but is not required <<optional>>2<</optional>> altered source
        versions must be plainly marked as such and must not be misrepresented as being the original software <<optional>>3<</optional>> this
        notice may not be removed or altered from any source distribution""",
    "unlicense": """
        this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
        means""",
    "apache-2.0-notice": """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
        obtain a copy of the license at <<any:4:10>> unless required by applicable law or agreed to in writing software distributed under
        the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license
        for the specific language governing permissions and limitations under the license""",
    "mpl-2.0-notice": """
        this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
        file you can obtain one at""",
    "gpl-notice": """
        this program is free software you can redistribute it and or modify it under the terms of the gnu <<optional>>lesser<</optional>>
        <<optional>>affero<</optional>> general public license as published by the free software foundation either version <<any:1:2>> of the
        license or at your option any later version <<optional>>this program is distributed in the hope that it will be useful but without
        any warranty without even the implied warranty of merchantability or fitness for a particular purpose<</optional>>""",
    "cc-deed": """
        this work is licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> creative commons attribution
        <<optional>>noncommercial<</optional>> <<optional>>non commercial<</optional>> <<optional>>sharealike<</optional>>
        <<optional>>share alike<</optional>> <<optional>>noderivatives<</optional>> <<optional>>noderivs<</optional>>
        <<optional>><<any:1:2>><</optional>> <<optional>>international<</optional>> <<optional>>unported<</optional>>
        <<optional>>generic<</optional>> license""",
    "apache-2.0": "licensed under <<optional>>the<</optional>> apache license <<optional>>version<</optional>> 2 0",
    "mit": "released under the mit license",
    "mit-licensed": "licensed under <<optional>>the<</optional>> mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "gpl": "licensed under the gnu <<optional>>lesser<</optional>> <<optional>>affero<</optional>> general public license <<optional>>version <<any:1:2>><</optional>>",
    "cc-by-nc": "licensed under cc by nc <<optional>><<any:1:2>><</optional>>",
    "cc-by-sa": "licensed under cc by sa <<optional>><<any:1:2>><</optional>>",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "copyright-notice": "copyright c <<any:1:8>> all rights reserved",
    "spdx": "spdx license identifier <<any:1:4>>",
}


class Automaton:
    """States are places in a list of steps: ("word", w), ("any",), ("jump", targets)."""

    def __init__(self, template: str):
        self.steps: list[tuple] = []
        open_at: list[int] = []
        for part in re.findall(r"<<[^<>]*>>|[^\s<>]+", template):
            if part == "<<optional>>":
                open_at.append(len(self.steps))
                self.steps.append(("jump", []))
            elif part == "<</optional>>":
                at = open_at.pop()
                self.steps[at] = ("jump", [at + 1, len(self.steps)])
            elif part.startswith("<<any:"):
                least, most = map(int, part[6:-2].split(":"))
                self.steps += [("any",)] * least
                end = len(self.steps) + 2 * (most - least)
                for _ in range(most - least):
                    self.steps += [("jump", [len(self.steps) + 1, end]), ("any",)]
            else:
                self.steps.append(("word", part))
        depth, mandatory = 0, 0
        for part in re.findall(r"<<[^<>]*>>|[^\s<>]+", template):
            depth += (part == "<<optional>>") - (part == "<</optional>>")
            mandatory += depth == 0 and not part.startswith("<<")
        self.mandatory = mandatory
        self.plain = list(accumulate(kind == "word" for kind, *_ in self.steps))  # plain words up to each step
        self.head = tuple(w for kind, *rest in self.steps[:2] for w in rest if kind == "word")
        if len(self.head) < 2:
            raise ValueError("a template starts with two plain words")

    def closure(self, states) -> set[int]:
        seen, open_ = set(), list(states)
        while open_:
            s = open_.pop()
            if s in seen:
                continue
            seen.add(s)
            if s < len(self.steps) and self.steps[s][0] == "jump":
                open_ += self.steps[s][1]
        return seen

    def run(self, words, at: int) -> tuple[bool, int]:
        """Whether the text from word `at` on is accepted, and the plain words that it reached."""
        states, reached, n = self.closure([0]), 0, 0
        while True:
            if len(self.steps) in states:
                return True, self.mandatory
            if at + n >= len(words):
                return False, reached
            word, after = words[at + n], set()
            for s in states:
                kind = self.steps[s]
                if kind[0] == "any" or kind[0] == "word" and kind[1] == word:
                    after.add(s + 1)
                    if kind[0] == "word":
                        reached = max(reached, self.plain[s])
            if not after:
                return False, min(reached, self.mandatory)
            states, n = self.closure(after), n + 1


def _hashes(words: list[str]) -> dict[str, np.uint64]:
    t = Texts([w.encode() for w in words], ALNUM, fold=True)
    return dict(zip(words, t.words(), strict=True))


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(documents: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document; phrases and templates default to the fixed lists above."""
    phrases = {tuple(p.split()): label for p, label in (phrases or PHRASES).items()}
    automata = {label: Automaton(t) for label, t in (templates or TEMPLATES).items()}

    def run(batches):
        known = _hashes(sorted({w for p in phrases for w in p} | {w for a in automata.values() for w in a.head}))
        heads: dict[tuple, list[str]] = {}
        for label, a in automata.items():
            heads.setdefault(a.head, []).append(label)
        for batch, texts in slices(batches, "text"):
            t = Texts(texts, ALNUM, fold=True)
            h = t.words()

            def places(words, t=t, h=h):
                m = len(h) - len(words) + 1
                if m <= 0:
                    return np.zeros(0, np.int64)
                at = np.flatnonzero(h[:m] == known[words[0]])
                for j, w in enumerate(words[1:], 1):
                    at = at[h[at + j] == known[w]]
                return at[t.doc_of_words(at) == t.doc_of_words(at + len(words) - 1)]

            n_base = np.zeros(t.n, np.int64)
            first, last = np.full(t.n, -1, np.int64), np.full(t.n, -1, np.int64)
            base: list[set] = [set() for _ in range(t.n)]
            found: list[set] = [set() for _ in range(t.n)]
            score = np.zeros(t.n)
            for words, label in phrases.items():
                at = places(words)
                doc = t.doc_of_words(at)
                n_base += np.bincount(doc, minlength=t.n)
                for d, place in zip(doc.tolist(), (at - t.first[doc]).tolist(), strict=True):
                    first[d] = place if first[d] < 0 else min(first[d], place)
                    last[d] = max(last[d], place)
                    base[d].add(label)
                    score[d] = max(score[d], 0.5)
            split: dict[int, list[str]] = {}
            for head, labels in heads.items():
                at = places(head)
                for d, place in zip(t.doc_of_words(at).tolist(), (at - t.first[t.doc_of_words(at)]).tolist(), strict=True):
                    if d not in split:
                        split[d] = [w.decode() for w in _WORD.findall(texts[d].lower())]
                    for label in labels:
                        ok, reached = automata[label].run(split[d], place)
                        score[d] = max(score[d], 1.0 if ok else round(0.5 * reached / automata[label].mandatory, 6))
                        if ok:
                            found[d].add(label)
            none = first < 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(t.n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x | y)) for x, y in zip(base, found, strict=True)]), pa.array(score),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))
