"""License scans with a generalised suffix automaton of licence templates.

The templates (short names, notices and the start of full texts) form one automaton over
word numbers, built once on the driver from the given list. A document's words are streamed
through it, which gives matching statistics: at each word, the longest stretch ending there
that occurs in any template, and on its suffix path the longest for each place of a template.
A stretch that its own template cannot prolong is a match, also inside a longer one of another;
long ones are chained per template in the order of both texts, and a template covered to
``COVERAGE`` or more gives its label and a span. Names are templates that must occur whole; they end
at a word if their state is on the suffix path of the state reached there. Base names are
counted; the further ones, built from the lists below, give their label and a span, of names
that start at one word the longest.

One narrow pass; words outside the templates reset the automaton, so only the few runs of
template word pairs are walked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, sliced

# The base names and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Public licence notices.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
     "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
     "specific language governing permissions and limitations under the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
     "and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
     "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
     "more details."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any "
     "later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
     "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent "
     "versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
     "for any damages arising from the use of this software."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
)
# Names in running text, with their labels.
NAMES = (
    ("gnu gpl", "gpl"), ("either version 2 of the license", "gpl-2.0"), ("lesser general public license", "lgpl"),
    ("library general public license", "lgpl"), ("gnu lgpl", "lgpl"), ("affero general public license", "agpl-3.0"), ("gnu agpl", "agpl-3.0"),
    ("bsd 2 clause", "bsd-2-clause"), ("2 clause bsd", "bsd-2-clause"), ("simplified bsd license", "bsd-2-clause"),
    ("two clause bsd", "bsd-2-clause"), ("bsd 3 clause", "bsd-3-clause"), ("3 clause bsd", "bsd-3-clause"), ("three clause bsd", "bsd-3-clause"),
    ("new bsd license", "bsd-3-clause"), ("modified bsd license", "bsd-3-clause"), ("bsd license", "bsd"), ("isc license", "isc"),
    ("mozilla public license", "mpl-2.0"), ("eclipse public license", "epl"), ("eclipse public license v 2 0", "epl-2.0"),
    ("eclipse public license 2 0", "epl-2.0"), ("eclipse public license version 2 0", "epl-2.0"), ("eclipse public license v1 0", "epl-1.0"),
    ("eclipse public license version 1 0", "epl-1.0"), ("european union public licence", "eupl-1.2"), ("european union public license", "eupl-1.2"),
    ("licensed under the eupl", "eupl-1.2"), ("the unlicense", "unlicense"), ("zlib license", "zlib"), ("boost software license", "bsl-1.0"),
    ("artistic license", "artistic-2.0"), ("creative commons zero", "cc0-1.0"), ("cc0 1 0 universal", "cc0-1.0"),
)
# Licences with versions, whose names are made with the forms below.
VERSIONED = (
    ("gpl", "gpl", ("2", "3")), ("gnu general public license", "gpl", ("2", "3")), ("lgpl", "lgpl", ("2 1", "3")),
    ("lesser general public license", "lgpl", ("2 1", "3")), ("agpl", "agpl", ("3",)), ("affero general public license", "agpl", ("3",)),
)
FORMS = ("{} version {}", "{} v{}", "{} {}", "{} {} 0")
# Creative Commons elements in the order of their names.
CC_ELEMENTS = (("noncommercial", "nc"), ("noderivatives", "nd"), ("sharealike", "sa"))
# Identifiers of the SPDX list.
SPDX = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
    "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
#: Notices that a longer name inside them turns into another licence's: label -> starts of the labels that do.
UNLESS = {"gpl": ("lgpl", "agpl")}


def further_names() -> tuple[tuple[str, str], ...]:
    """(name, label) of all names but the base ones."""
    out = dict(NAMES)
    for name, label, versions in VERSIONED:
        for version in versions:
            number = version.replace(" ", ".") if " " in version else f"{version}.0"
            for form in FORMS[:3] if " " in version else FORMS:
                out[form.format(name, version)] = f"{label}-{number}"
    for mask in range(1, 8):
        words, marks = zip(*(e for i, e in enumerate(CC_ELEMENTS) if mask >> i & 1))
        if {"nd", "sa"} <= set(marks):
            continue  # there is no such licence
        label = "-".join(("cc-by", *marks))
        out["creative commons attribution " + " ".join(words)] = out[label.replace("-", " ")] = label
    out["creative commons attribution share alike"] = "cc-by-sa"
    for identifier in SPDX:
        label = identifier.lower().removesuffix("-only").removesuffix("-or-later")
        out["spdx license identifier " + " ".join(identifier.lower().replace("-", " ").replace(".", " ").split())] = (
            label.removesuffix("-4.0") if label.startswith("cc-") else label)
    return tuple(out.items())


#: Words that a match must have to be chained, words between chained matches, and the covered share that counts.
MIN_MATCH, MAX_GAP, COVERAGE = 3, 12, 0.7

_SPLIT = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of all non-ASCII characters."""
    return (text or b"").lower().translate(_SPLIT).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the templates' places at each state."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, names=()):
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.labels = [label for _, label in (*phrases, *names)] + [label for label, _ in templates]
        self.n_base, self.n_phrases = len(phrases), len(phrases) + len(names)
        texts = [text for text, _ in (*phrases, *names)] + [text for _, text in templates]
        self.rows = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(t.encode())] for t in texts]
        for row in self.rows:
            last = 0
            for number in row:
                last = self._extend(last, number)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        self.whole: list[list[int]] = [[] for _ in self.next]
        for t, row in enumerate(self.rows):
            state = 0
            for i, number in enumerate(row):
                state = self.next[state][number]
                self.ends[state].append((t, i + 1))
            if t < self.n_phrases:
                self.whole[state].append(t)
        # places go up, whole names go down the suffix links
        by_size = sorted(range(1, len(self.next)), key=self.size.__getitem__)
        for state in reversed(by_size):
            self.ends[self.link[state]] += self.ends[state]
        for state in by_size:
            self.whole[state] = self.whole[state] + self.whole[self.link[state]]
        # (template, end, length, next word) of the stretches that end at a state: length 0 for the state's own
        self.stops: list[list[tuple[int, int, int, int]]] = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            seen, at = set(), state
            while at > 0 and (at == state or self.size[at] >= MIN_MATCH):
                for t, end in self.ends[at]:
                    if t >= self.n_phrases and (t, end) not in seen:
                        seen.add((t, end))
                        follow = self.rows[t][end] if end < len(self.rows[t]) else 0
                        self.stops[state].append((t, end, 0 if at == state else self.size[at], follow))
                at = self.link[at]
        self.pairs = np.zeros((len(self.numbers) + 1,) * 2, bool)
        for row in self.rows:
            self.pairs[row[:-1], row[1:]] = True

    def _extend(self, last: int, number: int) -> int:
        known = self.next[last].get(number)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._clone(last, number, known)
        state = self._state(self.size[last] + 1, {})
        at = last
        while at >= 0 and number not in self.next[at]:
            self.next[at][number] = state
            at = self.link[at]
        if at >= 0:
            known = self.next[at][number]
            self.link[state] = known if self.size[known] == self.size[at] + 1 else self._clone(at, number, known)
        return state

    def _state(self, size: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(0)
        self.size.append(size)
        return len(self.next) - 1

    def _clone(self, at: int, number: int, known: int) -> int:
        twin = self._state(self.size[at] + 1, dict(self.next[known]))
        self.link[twin], self.link[known] = self.link[known], twin
        while at >= 0 and self.next[at].get(number) == known:
            self.next[at][number] = twin
            at = self.link[at]
        return twin

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, word numbers) of the longest runs whose neighbouring words are neighbours in a template."""
        if len(words) < 2:
            return
        get = self.numbers.get
        numbers = np.array([get(w, 0) for w in words])
        good = self.pairs[numbers[:-1], numbers[1:]].astype(np.int8)
        edges = np.flatnonzero(np.diff(good, prepend=0, append=0))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            yield a, numbers[a:b + 1].tolist()

    def walk(self, first: int, numbers: list[int]) -> Iterator[tuple[int, int, int]]:
        """(word, state, length): the matching statistics along a run."""
        state = length = 0
        for i, number in enumerate(numbers):
            while state and number not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if number in self.next[state]:
                state, length = self.next[state][number], length + 1
            yield first + i, state, length


def _chains(found: list[tuple[int, int, int, int]], reach: int) -> Iterator[tuple[int, int, int]]:
    """(covered words, first word, end) of the best chain up to each match (first, end, template first, end).

    Chained matches are at most ``MAX_GAP`` words apart, so only those that start within
    ``reach`` + MAX_GAP words before a match can precede it.
    """
    best: list[tuple[int, int, int]] = []
    found = sorted(set(found))
    for k, (a, b, s, e) in enumerate(found):
        top = (e - s, a, b)
        for j in range(k - 1, -1, -1):
            a0, b0, s0, e0 = found[j]
            if a - a0 > reach + MAX_GAP:
                break
            # overlapping matches count the words that the later one adds, in the text and in the template
            added = e - s - max(0, b0 - a, e0 - s)
            if a0 < a and s0 < s and added > 0 and a - b0 <= MAX_GAP:
                top = max(top, (best[j][0] + added, best[j][1], b), key=lambda x: x[0])
        best.append(top)
    yield from best


def _apart(chains: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Chains that do not overlap: by their ends, the better of two that do."""
    out: list[tuple[int, int, int]] = []
    for covered, a, b in sorted(chains, key=lambda c: (c[2], c[1])):
        if not out or a >= out[-1][2]:
            out.append((covered, a, b))
        elif covered > out[-1][0]:
            out[-1] = (covered, a, b)
    return out


def licences(text: bytes | None, automaton: Automaton) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
    """(words, [(phrase, first word)], [(template, first word, end, coverage)]) of a text."""
    words = words_of(text)
    names, further, matches = [], {}, {}
    for first, numbers in automaton.runs(words):
        steps = list(automaton.walk(first, numbers))
        for k, (at, state, length) in enumerate(steps):
            for phrase in automaton.whole[state]:
                size = len(automaton.rows[phrase])
                if size <= length and phrase < automaton.n_base:
                    names.append((phrase, at - size + 1))
                elif size <= length:  # of names at one place the longest, which comes last
                    further[at - size + 1] = (phrase, at + 1)
            if length >= MIN_MATCH:
                coming = numbers[k + 1] if k + 1 < len(numbers) else -1
                for t, end, size, follow in automaton.stops[state]:
                    size = size or length
                    if follow != coming and end >= size:
                        matches.setdefault(t, []).append((at - size + 1, at + 1, end - size, end))
    spans = []
    for t, found in matches.items():
        size = len(automaton.rows[t])
        for covered, a, b in _apart(c for c in _chains(found, size) if c[0] >= COVERAGE * size):
            spans.append((t, a, b, min(1.0, covered / size)))
    found = [(p, a, b, 1.0) for a, (p, b) in further.items()]
    spans = [x for x in spans if not any(
        x[1] <= a and b <= x[2] and automaton.labels[p].startswith(UNLESS.get(automaton.labels[x[0]], ())) for p, a, b, _ in found)] + found
    return len(words), names, sorted(spans, key=lambda s: (s[1], s[2], s[0]))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, more_names=None) -> DataFrame:
    """One row per row: base places, labels, template spans and a score.

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans); the
    score is the largest covered share of a template, 1 for a whole name, 0 for none. Null
    and empty texts have no words; texts of any length are streamed through the automaton; of
    chains that overlap the one that covers more stays, of equal ones the one that ends first;
    repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    more_names = further_names() if more_names is None else more_names

    def run(batches):
        automaton = Automaton(phrases, templates, more_names)
        for part in sliced(batches):
            out = []
            for text in raw_texts(part):
                n, names, spans = licences(text, automaton)
                places = [at for _, at in names]
                base = {automaton.labels[p] for p, _ in names}
                extra = {automaton.labels[t] for t, *_ in spans}
                out.append((
                    n, len(names), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | extra)), max([1.0 if names else 0.0, *(c for *_, c in spans)]),
                    ",".join(f"{automaton.labels[t]}:{a}:{b}" for t, a, b, _ in spans)))
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*out), kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
             "score double, spans string")
