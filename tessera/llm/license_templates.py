"""License scans by template-markup matching.

A template is a license's wording with two kinds of markup:

* ``<<opt>> ... <<end>>`` may be left out, also nested;
* ``<<var>>`` or ``<<var:N>>`` stands for 0 to N words (8 if not said) that may be anything.

Each template is compiled into a token automaton, with an edge for each mandatory
word, an empty edge around each optional region and bounded any-word edges for each replaceable
one.  A text is scanned for places where an automaton accepts: the wording outside markup
has to match word for word.  Automata start only at words that can begin them, in
texts that hold all their mandatory words.

Templates of licenses that are given by their text hold the whole wording, one for each variant.  A text with
the opening sentence alone, or one whose rest differs, is an excerpt, with a label and a lower score of its own.

Beside the templates, fixed base phrases are located: all places where a phrase's
words stand consecutively.

Defined results: a null text is an empty text; no words give no places, empty labels and
score 0; overlapping places all count; a label is listed once; repeated rows are scanned each;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Openings that several wordings share, and their disclaimers.
_HOLDER = "<<opt>>copyright <<var:24>><<end>>"
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
<<opt>>(the "Software")<<end>> to deal in the Software without restriction"""
_MIT_RIGHTS = """including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so"""
_MIT_NOTICE = """subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<<end>>
shall be included in all copies or substantial portions of the Software."""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:12>> BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_ENDS = [_MIT_END, _MIT_END.replace("NONINFRINGEMENT", "NON-INFRINGEMENT")]
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"""
_BSD_1_2 = """<<opt>>1<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<opt>>2<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """Neither the name of <<var:12>> nor the names of <<opt>>its<<end>> <<opt>>any<<end>> <<opt>>other<<end>> contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var:12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:12>> BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_BSD_TITLE = "<<opt>><<opt>>the<<end>> <<opt>>new<<end>> <<opt>>modified<<end>> <<opt>>simplified<<end>> bsd <<opt>>2<<end>> <<opt>>3<<end>> <<opt>>4<<end>> <<opt>>clause<<end>> license<<end>>"
_ISC_GRANT = """Permission to use, copy, modify, and <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var:8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE_GRANT = "This is free and unencumbered software released into the public domain"

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 <<opt>>(the "License")<<end>> you may not use this file except in compliance with the License. You may obtain a copy
of the License at <<opt>>http<<opt>>s<<end>><<end>> <<opt>>www<<end>> apache org licenses LICENSE-2.0 <<opt>>txt<<end>> <<opt>>html<<end>> Unless required by applicable law or agreed to in writing, software distributed under the License
is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GPL_NOTICE = """<<var:8>> is free software <<opt>>you can redistribute it<<end>> <<opt>>and/or<<end>> <<opt>>and<<end>> modify it under the terms of the GNU General Public License
as published by the Free Software Foundation {version} <<var:8>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_GPL_VERSIONS = {
    "gpl-{n}.0-only": "<<opt>>either<<end>> version {n} of the License",
    "gpl-{n}.0-or-later": "<<opt>>either<<end>> version {n} of the License, or <<opt>>at your option<<end>> any later version",
}

#: Labels and wordings. Words are compared in lower case without punctuation.
TEMPLATES = [
    ("gpl-2.0", "<<opt>>this <<var:3>> is<<end>> <<opt>>licensed under<<end>> the gnu general public license <<opt>>as published by the free software foundation either<<end>> version 2"),
    ("gpl-3.0", "<<opt>>this <<var:3>> is<<end>> <<opt>>licensed under<<end>> the gnu general public license <<opt>>as published by the free software foundation either<<end>> version 3"),
    ("lgpl", "the gnu <<opt>>lesser<<end>> <<opt>>library<<end>> general public license <<var:2>> lgpl"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license <<opt>>version<<end>> 2 0"),
    ("apache-2.0", "apache license version 2 0"),
    ("mit", "<<opt>>released<<end>> <<opt>>licensed<<end>> <<opt>>distributed<<end>> under the <<opt>>terms of the<<end>> mit license"),
    *[("mit", f"<<opt>><<opt>>the<<end>> mit license <<opt>>mit<<end>><<end>> {_HOLDER} {_MIT_GRANT} {_MIT_RIGHTS} {_MIT_NOTICE} {end}") for end in _MIT_ENDS],
    *[("mit-0", f"<<opt>>mit no attribution<<end>> {_HOLDER} {_MIT_GRANT} {_MIT_RIGHTS} {end}") for end in _MIT_ENDS],
    ("bsd-2-clause", f"{_BSD_TITLE} {_HOLDER} {_BSD_GRANT} {_BSD_1_2} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD_TITLE} {_HOLDER} {_BSD_GRANT} {_BSD_1_2} <<opt>>3<<end>> {_BSD_NAMES} {_BSD_END}"),
    ("bsd-4-clause", f"{_BSD_TITLE} {_HOLDER} {_BSD_GRANT} {_BSD_1_2} <<opt>>3<<end>> All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by <<var:20>> <<opt>>4<<end>> {_BSD_NAMES} {_BSD_END}"),
    ("bsd", "bsd <<opt>>2<<end>> <<opt>>3<<end>> <<opt>>clause<<end>> license"),
    ("isc", f"<<opt>><<opt>>the<<end>> isc license <<opt>>isc<<end>><<end>> {_HOLDER} {_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0bsd", f"{_HOLDER} {_ISC_GRANT} {_ISC_END}"),
    ("mpl-2.0", "mozilla public license <<opt>>v<<end>> <<opt>>version<<end>> 2 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-4.0", "cc by 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 <<opt>>international<<end>> <<opt>>public<<end>> license"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 <<opt>>international<<end>> <<opt>>public<<end>> license"),
    ("cc-by-4.0", "creative commons attribution 4 0 <<opt>>international<<end>> <<opt>>public<<end>> license"),
    ("cc0-1.0", "cc0 1 0 <<opt>>universal<<end>>"),
    ("unlicense", f"""{_UNLICENSE_GRANT}. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author
or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. <<opt>>For more information, please refer to http<<opt>>s<<end>> <<opt>>unlicense org<<end>><<end>>"""),
    ("all-rights-reserved", "copyright <<var:8>> all rights reserved"),
    ("apache-2.0-notice", f"{_HOLDER} {_APACHE_NOTICE}"),
    *[(label.format(n=n), "this program " + _GPL_NOTICE.removeprefix("<<var:8>> ").format(version=version.format(n=n)).replace("<<var:8>>", "<<var:4>>")) for label, version in _GPL_VERSIONS.items() for n in (2, 3)],
]
#: Mandatory words from which on a template is a whole wording and not a mention.
WHOLE = 30

#: Openings of the wordings above: alone, or with a rest that is no wording here, they are excerpts.
EXCERPTS = [("mit-excerpt", _MIT_GRANT), ("bsd-excerpt", _BSD_GRANT), ("isc-excerpt", _ISC_GRANT), ("unlicense-excerpt", _UNLICENSE_GRANT)]

_TO_SPACE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)
_MARK = re.compile(r"<<(opt|end|var(?::(\d+))?)>>|([^\s<]+)")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of digits, letters and anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


class Automaton:
    """A nondeterministic token automaton: ``steps[s]`` has (word or None for any, next) edges, ``free[s]`` empty ones."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.mandatory: set[bytes] = set()
        self.length = 0
        opened: list[int] = []
        at = 0
        for m in _MARK.finditer(template):
            kind = m[1] or ""
            if kind == "opt":
                opened.append(at)
            elif kind == "end":
                self.free[opened.pop()].append(at)
            elif kind:
                first, most = at, int(m[2] or 8)
                ends = [first]
                for _ in range(most):
                    nxt = self._state()
                    self.steps[at].append((None, nxt))
                    ends.append(nxt)
                    at = nxt
                for e in ends[:-1]:
                    self.free[e].append(at)
            else:
                for word in words_of(m[3]):
                    nxt = self._state()
                    self.steps[at].append((word, nxt))
                    at = nxt
                    if not opened:
                        self.mandatory.add(word)
                        self.length += 1
        if opened or not self.mandatory:
            raise ValueError(f"template of {label}: markup isn't closed or nothing is mandatory")
        self.final = at
        #: Words that can begin a match (a template begins with a word or an optional region).
        self.first = {w for s in self.closure({0}) for w, _ in self.steps[s] if w is not None}
        self.any_first = any(w is None for s in self.closure({0}) for w, _ in self.steps[s])

    def _state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    def accepts_at(self, words: list[bytes], start: int) -> int | None:
        """Where the longest match that begins at a word ends, or None."""
        now, best, at = self.closure({0}), None, start
        while now and at < len(words):
            w = words[at]
            now = self.closure({n for s in now for e, n in self.steps[s] if e is None or e == w})
            at += 1
            if self.final in now:
                best = at
        return best

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, end) of the matches, each begun behind the one before."""
        found, at = [], 0
        while at < len(words):
            if (self.any_first or words[at] in self.first) and (end := self.accepts_at(words, at)) is not None:
                found.append((at, end))
                at = end
            else:
                at += 1
        return found


@cache
def compiled() -> tuple[Automaton, ...]:
    return tuple(Automaton(label, template) for label, template in [*TEMPLATES, *EXCERPTS])


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which a phrase begins; ``joined`` has a space before and after each word."""
    found, at, words, seen = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        found.append(words)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return found


def scan(text: str | None) -> dict:
    """Places, labels and score of a text; ``templates`` has (label, start, end) of the accepted wordings."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = {label: phrase_places(joined, phrase.encode()) for phrase, label in PHRASES.items()}
    starts = sorted(s for found in base.values() for s in found)
    held: set[bytes] | None = None
    accepted, whole_wording = [], False
    for a in compiled():
        rarest = max(a.mandatory, key=len)
        if b" " + rarest + b" " not in joined:
            continue
        held = set(words) if held is None else held
        if a.mandatory <= held:
            own = a.places(words)
            accepted += [(a.label, s, e) for s, e in own]
            whole_wording |= bool(own) and a.length >= WHOLE
    partial = {label for label, _ in EXCERPTS}
    whole = [(s, e) for label, s, e in accepted if label not in partial]
    accepted = [(label, s, e) for label, s, e in accepted if label not in partial or not any(a <= s and e <= b for a, b in whole)]
    base_labels = sorted(label for label, found in base.items() if found)
    labels = sorted({*base_labels, *(label for label, _, _ in accepted)})
    named = len({k for s, e in whole for k in range(s, e)}) / max(1, len(words))
    score = 1.0 if whole_wording else 0.8 + 0.15 * named if whole else 0.75 if accepted else 0.5 if starts else 0.0
    return {"n_words": len(words), "starts": starts, "base_labels": base_labels, "labels": labels, "score": score, "templates": accepted}


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, templates array<struct<label:string,start:long,end:long>>"


def scanned(docs: DataFrame) -> DataFrame:
    """Per document: its words, base places, labels, score (1 a whole wording; 0.8 to 0.95 a mention, more for a text that says little else; 0.75 an excerpt; 0.5 phrases alone) and accepted ``templates``."""
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [scan(t) for t in b.column(1).to_pylist()]
            columns = [
                b.column(0),
                pa.array([r["n_words"] for r in found], pa.int64()),
                pa.array([len(r["starts"]) for r in found], pa.int64()),
                pa.array([r["starts"][0] if r["starts"] else None for r in found], pa.int64()),
                pa.array([r["starts"][-1] if r["starts"] else None for r in found], pa.int64()),
                pa.array([",".join(r["base_labels"]) for r in found], pa.string()),
                pa.array([",".join(r["labels"]) for r in found], pa.string()),
                pa.array([r["score"] for r in found], pa.float64()),
                pa.array([[{"label": x, "start": s, "end": e} for x, s, e in r["templates"]] for r in found], place),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)
