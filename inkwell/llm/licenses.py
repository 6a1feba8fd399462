"""License scans by template-markup matching.

A template is mandatory wording with optional regions ``<<optional>> ... <<end>>`` (which nest) and replaceable ones
``<<var least-most>>`` of so many arbitrary words. Each compiles to an automaton over word tokens; a text is accepted
where its mandatory words match exactly. Base phrases are reported beside the templates' labels.

One Arrow pass without shuffle; word counts are vectorised, and only texts that hold an anchor (a string without which
no template or phrase can match) are split into words, so nothing is skipped.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, table, texts

#: Base phrases and their labels.
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

# Public licence texts and notices as markup over lower-case words. A text or notice has the licence's
# label; mere mentions of a licence have labels that end in -reference.
AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
BSD_TAIL = (
    "this software is provided by <<var 1-8>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 1-8>> be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
GNU = (
    "this <<var 1-3>> is free software you can redistribute it and or modify it under the terms of the gnu {0} general public license as published by the "
    "free software foundation either version {1} of the license or at your option any later version <<var 1-4>> is distributed in the hope that it will "
    "be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} general "
    "public license for more details"
)
TEMPLATES = [
    ("mit",
     "<<optional>>mit license<<end>> <<optional>>copyright <<optional>>c<<end>> <<var 1-12>><<end>> permission is hereby granted free of charge to any person "
     "obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without "
     "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
     "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the "
     f"next paragraph<<end>> shall be included in all copies or substantial portions of the software {AS_IS} and noninfringement in no event shall "
     "<<var 1-8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
     "connection with the software or the use or other dealings in the software"),
    ("bsd-2-clause", BSD_HEAD + BSD_TAIL),
    ("bsd-3-clause", BSD_HEAD + "<<optional>>3<<end>> neither the name of <<var 1-12>> nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission " + BSD_TAIL),
    ("isc",
     "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that "
     "the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var 1-8>> disclaims all warranties "
     "with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var 1-8>> be liable for any special "
     "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
     "negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsl-1.0",
     "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by "
     "this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and "
     "to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this "
     "entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in "
     "whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object "
     f"code generated by a source language processor {AS_IS} title and non infringement in no event shall <<var 1-8>> be liable for any damages or other "
     "liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("zlib",
     "this software is provided as is without any express or implied warranty in no event will <<var 1-8>> be held liable for any damages arising from the "
     "use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
     "redistribute it freely subject to the following restrictions <<optional>>1<<end>> the origin of this software must not be misrepresented you must not "
     "claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated "
     "but is not required <<optional>>2<<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original "
     "software <<optional>>3<<end>> this notice may not be removed or altered from any source distribution"),
    ("apache-2.0",
     "licensed under the apache license version 2 0 the license you may not use <<var 1-4>> except in compliance with the license you may obtain a copy of "
     "the license at <<var 0-1>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
     "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
     "language governing permissions and limitations under the license"),
    ("mpl-2.0",
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can "
     "obtain one at <<var 0-1>> mozilla org mpl 2 0"),
    *[(f"{name}-{version}.0-or-later".replace(".1.0", ".1"), GNU.format(kind, version.replace(".", " ")).replace("  ", " "))
      for name, kind, version in (("gpl", "", "2"), ("gpl", "", "3"), ("lgpl", "lesser", "2.1"), ("lgpl", "lesser", "3"), ("agpl", "affero", "3"))],
    ("gpl-reference", "gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general public license <<optional>><<optional>>version<<end>> <<optional>>v<<end>> <<var 1-1>><<end>>"),
    ("mit-reference", "under the <<optional>>terms of the<<end>> mit license"),
    ("apache-2.0-reference", "apache license <<optional>>version<<end>> 2 <<optional>>0<<end>>"),
    ("bsd-reference", "under the <<optional>>terms of the<<end>> <<optional>><<var 1-2>> clause<<end>> bsd license"),
    ("mpl-2.0-reference", "mozilla public license <<optional>>v<<end>> <<optional>>version<<end>> 2 <<optional>>0<<end>>"),
    ("cc-by-4.0-reference", "cc by <<optional>>license<<end>> 4 0"),
    ("cc-by-nc-4.0-reference", "cc by nc <<optional>>license<<end>> 4 0"),
    ("cc-by-sa-4.0-reference", "cc by sa <<optional>>license<<end>> 4 0"),
    ("cc-reference", "creative commons attribution <<var 0-3>> license"),
    ("copyright-notice", "copyright <<optional>>c<<end>> <<var 1-8>> all rights reserved"),
]
#: Every template and phrase holds one of these byte strings in its mandatory words.
ANCHORS = (b"licen", b"reserved", b"cc", b"permission", b"redistribution")
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """Token automaton of one template: literal and any-word edges between states, empty edges resolved.

    `mandatory` are the words outside of optional and replaceable regions; an accepted run holds all of them in order.
    """

    def __init__(self, label: str, markup: str):
        self.label, self.edges, self.empty = label, [{}], [set()]
        self.any: list[set[int]] = [set()]
        at, opened, self.mandatory = 0, [], []
        for token in re.findall(r"<<optional>>|<<end>>|<<var \d+-\d+>>|\w+", markup):
            if token == "<<optional>>":
                opened.append(at)
            elif token == "<<end>>":
                self.empty[opened.pop()].add(at)
            elif token.startswith("<<var"):
                least, most = map(int, re.findall(r"\d+", token))
                skips = []
                for k in range(most):
                    if k >= least:
                        skips.append(at)
                    self.any[at].add(self._state())
                    at = len(self.edges) - 1
                for s in skips:
                    self.empty[s].add(at)
            else:
                self.mandatory += [] if opened else [token.encode()]
                self.edges[at].setdefault(token.encode(), set()).add(self._state())
                at = len(self.edges) - 1
        self.final = at
        self.closures = [self._closure(s) for s in range(len(self.edges))]
        self.first = {w for s in self.closures[0] for w in self.edges[s]}
        if any(self.any[s] for s in self.closures[0]):
            raise ValueError(f"{label}: a template begins with a word of its own")

    def _state(self) -> int:
        self.edges.append({})
        self.empty.append(set())
        self.any.append(set())
        return len(self.edges) - 1

    def _closure(self, state: int) -> frozenset[int]:
        out, todo = {state}, [state]
        while todo:
            for t in self.empty[todo.pop()] - out:
                out.add(t)
                todo.append(t)
        return frozenset(out)

    def match(self, words: list[bytes], start: int) -> int:
        """One past the last word of the longest accepted run from start, or start."""
        states, best = self.closures[0], start
        for i in range(start, len(words)):
            reached = {t for s in states for t in self.edges[s].get(words[i], ())} | {t for s in states for t in self.any[s]}
            if not reached:
                break
            states = frozenset().union(*(self.closures[t] for t in reached))
            if self.final in states:
                best = i + 1
        return best


@lru_cache(maxsize=1)
def automata() -> dict[bytes, list[Automaton]]:
    """Automata by the words that an accepted run can begin with."""
    out: dict[bytes, list[Automaton]] = {}
    for label, markup in TEMPLATES:
        made = Automaton(label, markup)
        for w in made.first:
            out.setdefault(w, []).append(made)
    return out


def word_counts(raw: list[bytes]) -> np.ndarray:
    """Words of each text, from byte classes: ASCII letters and digits and all bytes above 127 make words."""
    is_word = np.zeros(256, bool)
    is_word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    joined = is_word[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    begun = np.concatenate([[0], np.cumsum(joined[1:] & ~joined[:-1])])
    ends = np.cumsum([len(r) + 1 for r in raw])
    return np.diff(np.concatenate([[0], begun[ends]])) if raw else np.zeros(0, np.int64)


def matches(words: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, label) of base phrases and of accepted templates; a word is lower-case bytes."""
    base, own, by_first = [], [], automata()
    firsts: dict[bytes, list[tuple]] = {}
    for phrase in PHRASES:
        firsts.setdefault(phrase[0].encode(), []).append((tuple(p.encode() for p in phrase), PHRASES[phrase]))
    for i, w in enumerate(words):
        for phrase, label in firsts.get(w, ()):
            if tuple(words[i : i + len(phrase)]) == phrase:
                base.append((i, i + len(phrase), label))
        for auto in by_first.get(w, ()):
            if (end := auto.match(words, i)) > i:
                own.append((i, end, auto.label))
    return base, own


RESULT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def licenses(docs: DataFrame) -> DataFrame:
    """RESULT for every row of docs (doc_id, text).

    score is the share of the text's words that lie in base phrases or accepted templates. A null or empty text has no
    words, labels "" and score 0; a very long text is a step of its own; repeated rows are kept; an empty table gives an
    empty one; other columns are ignored. Base labels stand beside the templates' own, also where both cover a place.
    """

    def step(batch):
        raw = texts(batch.column(1))
        rows = []
        for n, text in zip(word_counts(raw).tolist(), raw):
            low = text.lower()
            base, own = matches(WORD.findall(low)) if any(a in low for a in ANCHORS) else ([], [])
            covered = len({i for a, b, _ in base + own for i in range(a, b)})
            named, all_named = {x[2] for x in base}, {x[2] for x in base + own}
            rows.append((n, len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None), ",".join(sorted(named)), ",".join(sorted(all_named)), covered / n if n else 0.0))
        return {"doc_id": batch.column(0)} | dict(zip(["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"], zip(*rows)))

    return arrow_pass(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), step, RESULT)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
