"""Licence scans by a generalised suffix automaton of licence texts: matching statistics, then chained spans.

Words are runs of ASCII letters and digits and of other bytes from 0x80 up, A-Z lowered. Base labels come
from fixed phrases. Beyond them, the words of the templates in `TEMPLATES` make a generalised suffix
automaton; a text is streamed through it word by word, which gives at each place the length of the longest
run, ending there, that occurs in a template (the matching statistics). Maximal runs of at least
`LEAST_RUN` words are chained, template by template, where they follow one another in the same order with
gaps of at most `MOST_GAP` words; of chains of one template that overlap, that of the largest cover counts.

Licences share many passages, so a chain counts by what tells its label from the others: a place is telling if the `LEAST_RUN`
words that end there occur in templates of one label only (the automaton knows in which templates a state ends). A chain
adds its label and a span if it covers `LEAST_COVER` of its template and holds a telling place, or holds `LEAST_TELLING` of them. Templates
without a label are passages that belong to no single licence, such as bare disclaimers. A chain that lies inside a
chain of another label which covers more gives way to it.

The score is the largest share of a template that an accepted chain covers, or, for a base phrase,
its share of the shortest notice that says it: a phrase alone is weaker evidence than the notice. The automaton is small
and fixed, so it goes to every task; texts are never shuffled. Words outside all templates reset the automaton, so only runs of
known words are streamed. A run is chained with those that end at most `MOST_GAP` words before it starts, so the time is
proportional to a text's length. Of long licences the built-in templates hold title and opening; whole texts can be passed as `templates`.

Defined results. Null or empty text: no words, empty labels, score 0. Repeated rows and null ids: scanned
each by its text. Empty table: no rows. Very long texts: streamed whole. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_table, coded, text_slices, words

LEAST_RUN = 4
MOST_GAP = 8
LEAST_COVER, LEAST_TELLING = 0.8, 8

#: Phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public notices by which files state their licence, opening passages of long licences, and whole short licences.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("bsd", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("boost", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    ("unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'),
    ("gpl", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("gpl", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation"),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program."),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("apache", 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.'),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution.'),
    ("0bsd", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("cc0", "Affirmer makes the Waiver for the benefit of each member of the public at large and to the detriment of Affirmer's heirs and successors, fully intending that such Waiver shall not be subject to revocation, rescission, cancellation, termination, or any other legal or equitable action to disrupt the quiet enjoyment of the Work by the public"),
    (None, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    (None, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    (None, 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    (None, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    (None, 'Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.'),
    (None, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    (None, "The name of the copyright holder may not be used to endorse or promote products derived from this software without specific prior written permission."),
    (None, "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    (None, "is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    (None, "is a free, copyleft license for software and other kinds of works"),
    (None, "Permission is hereby granted, free of charge, to any person obtaining a copy of"),
]

_TABLE = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()), lower=True)


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class SuffixAutomaton:
    """All runs of words of several sequences; words are numbered."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, place) at which a state's runs end
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extended(last, word)
                state = last
                while state > 0:
                    self.ends[state].add((number, place))
                    state = self.link[state]

    def _state(self, length: int, link: int, edges: dict[int, int], ends: set[tuple[int, int]]) -> int:
        self.next.append(edges), self.link.append(link), self.length.append(length), self.ends.append(ends)
        return len(self.next) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state that parent reaches by word, split off if it also holds longer runs."""
        child = self.next[parent][word]
        if self.length[child] == self.length[parent] + 1:
            return child
        clone = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]), set(self.ends[child]))
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:  # known from an earlier sequence
            return self._split(last, word)
        new = self._state(self.length[last] + 1, 0, {}, set())
        parent = last
        while parent >= 0 and word not in self.next[parent]:
            self.next[parent][word] = new
            parent = self.link[parent]
        if parent >= 0:
            self.link[new] = self._split(parent, word)
        return new

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest run that ends at each place."""
        state, length = 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield length, state


Templates = list[tuple[str | None, str]]


def scanner(templates: Templates = TEMPLATES) -> tuple[SuffixAutomaton, dict[bytes, int], list[int]]:
    """The automaton of the templates, the numbers of their words, and the templates' lengths."""
    number: dict[bytes, int] = {}
    sequences = [[number.setdefault(w, len(number)) for w in split_words(t)] for _, t in templates]
    return SuffixAutomaton(sequences), number, [len(s) for s in sequences]


def telling_states(automaton: SuffixAutomaton, templates: Templates = TEMPLATES) -> list[str | None]:
    """For each state the one label in whose templates the last LEAST_RUN words of its runs occur, if there is just one."""
    out: list[str | None] = []
    for state in range(len(automaton.length)):
        while state > 0 and automaton.length[automaton.link[state]] >= LEAST_RUN:
            state = automaton.link[state]
        found = {templates[t][0] for t, _ in automaton.ends[state]} if automaton.length[state] >= LEAST_RUN else set()
        out.append(found.pop() if len(found) == 1 else None)
    return out


def runs_of(automaton: SuffixAutomaton, sequence: list[int], offset: int, tells: list[str | None] = (), told: dict[str, list[int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, state) of the maximal matching runs of at least LEAST_RUN words; places that tell a label are added to `told`."""
    out, before = [], (0, 0)
    for place, now in enumerate([*automaton.statistics(sequence), (0, 0)]):
        if told is not None and now[0] >= LEAST_RUN and tells[now[1]] is not None:
            told.setdefault(tells[now[1]], []).append(offset + place)
        if before[0] >= LEAST_RUN and now[0] <= before[0]:
            out.append((offset + place - before[0], offset + place, before[1]))
        before = now
    return out


def chains(automaton: SuffixAutomaton, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(template, start, end, covered words) of chains of matching runs, which come by rising end; of overlapping ones of a template the best."""
    grown: dict[int, list[tuple[int, int, int, int]]] = {}  # by template: (start, end, end in the template, covered)
    for start, end, state in runs:
        for template, place in automaton.ends[state]:
            own = grown.setdefault(template, [])
            best = (start, end, place + 1, end - start)
            for a, b, t, n in reversed(own):
                if start - b > MOST_GAP:
                    break  # all before end even earlier
                fresh = min(end - start, end - b, place + 1 - t)  # words that the chain doesn't hold yet
                if a < start and fresh > 0 and place + 1 - (end - start) - t <= MOST_GAP and n + fresh > best[3]:
                    best = (a, end, place + 1, n + fresh)
            own.append(best)
    out = []
    for template, own in grown.items():
        best = None  # of the chains that overlap
        for a, b, _, n in sorted(own):
            if best is not None and a < best[2]:
                best = max(best, (template, a, b, n), key=lambda c: (c[3], -c[2]))
            else:
                out += [best] if best else []
                best = (template, a, b, n)
        out += [best] if best else []
    return sorted(out, key=lambda c: (c[1], c[2], c[0]))


def accepted(found: list[tuple[int, int, int, int]], told: dict[str, list[int]], sizes: list[int], templates: Templates = TEMPLATES) -> list[tuple[int, int, int, int]]:
    """The chains that tell their label; one inside a larger chain of another label gives way."""
    kept = []
    for template, a, b, n in found:
        places = told.get(templates[template][0], [])
        telling = bisect_left(places, b) - bisect_left(places, a + LEAST_RUN - 1)
        if telling >= LEAST_TELLING or (telling and n >= LEAST_COVER * sizes[template]):
            kept.append((template, a, b, n))
    out, widest = [], {}  # by label: (end, covered) of the chain that reaches furthest so far
    for chain in sorted(kept, key=lambda c: (c[1], -c[2], -c[3])):
        template, a, b, n = chain
        label = templates[template][0]
        if not any(end >= b and covered > n for other, (end, covered) in widest.items() if other != label):
            out.append(chain)
        widest[label] = max(widest.get(label, (0, 0)), (b, n))
    return sorted(out, key=lambda c: (c[1], c[2], c[0]))


def phrase_scores(templates: Templates = TEMPLATES) -> dict[str, float]:
    """For each base label the share of its phrase in the shortest template of that label that says it."""
    out = {}
    for phrase, label in PHRASES.items():
        says = lambda t, p=split_words(phrase): any(t[i : i + len(p)] == p for i in range(len(t)))
        out[label] = len(split_words(phrase)) / min([len(t) for own, text in templates if own == label and says(t := split_words(text))], default=len(split_words(phrase)))
    return out


def _scanned(templates: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(batches, templates)

    return run


def _scan(batches: Iterator[pa.RecordBatch], templates: Templates) -> Iterator[pa.RecordBatch]:
    automaton, number, sizes = scanner(templates)
    tells = telling_states(automaton, templates)
    phrases, of_phrase = [(split_words(p), label) for p, label in PHRASES.items()], phrase_scores(templates)
    for batch in batches:
        for part in text_slices(batch):
            first, _, _, found = words(part.column("text"), _TABLE)
            codes, distinct = coded(found)
            spelled = distinct.to_pylist()
            at_code = {w: c for c, w in enumerate(spelled)}
            n = part.num_rows
            n_words = np.diff(first)
            row = np.repeat(np.arange(n), n_words)
            n_base, first_word, last_word = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            base: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in phrases:
                wanted = [at_code.get(w) for w in phrase]
                if None in wanted:
                    continue
                places = np.flatnonzero(codes == wanted[0])
                places = places[places + len(wanted) <= first[1:][row[places]]]
                for k, c in enumerate(wanted):
                    places = places[codes[places + k] == c]
                for p, r in zip(places.tolist(), row[places].tolist(), strict=True):
                    i = p - int(first[r])
                    n_base[r] += 1
                    first_word[r] = i if first_word[r] < 0 else min(first_word[r], i)
                    last_word[r] = max(last_word[r], i)
                    base[r].add(label)
            # Runs of words that are in templates; shorter ones can't hold a match.
            known = np.array([number.get(w, -1) for w in spelled], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
            inside = known >= 0
            edge = np.ones(len(known) + 1, bool)
            if len(known):
                edge[1:-1] = (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])
            cuts = np.flatnonzero(edge)
            long = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a >= LEAST_RUN and inside[a]] if len(known) else []
            runs: dict[int, list[tuple[int, int, int]]] = {}
            told: dict[int, dict[str, list[int]]] = {}
            for a, b in long:
                r = int(row[a])
                runs.setdefault(r, []).extend(runs_of(automaton, known[a:b].tolist(), a - int(first[r]), tells, told.setdefault(r, {})))
            labels, scores, spans = [], [], []
            for r in range(n):
                held = accepted(chains(automaton, runs[r]), told[r], sizes, templates) if told.get(r) else []
                labels.append(",".join(sorted(base[r] | {templates[t][0] for t, *_ in held})))
                scores.append(round(max([0.0, *(min(1.0, c / sizes[t]) for t, _, _, c in held), *(of_phrase[label] for label in base[r])]), 6))
                spans.append([{"label": templates[t][0], "start": a, "end": b} for t, a, b, _ in held])
            some = n_base > 0
            nullable = lambda v: pa.array([int(x) if s else None for x, s in zip(v, some, strict=True)], pa.int64())  # noqa: E731, B023
            span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n_base), nullable(first_word), nullable(last_word), pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )


def license_scan(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans for each row.

    `templates` are (label, text), of no label if a text belongs to no single licence; they take the place of TEMPLATES.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(
        _scanned(TEMPLATES if templates is None else templates), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long>>"
    )
