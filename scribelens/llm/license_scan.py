"""License scanning by template markup.

A template is a license's wording with markup: ``{...}`` around words that may be missing,
``[name]`` for a replaceable region of up to 12 words (``[name:n]``: up to n). It is compiled
into an automaton over tokens: each mandatory word must stand exactly as written, an optional
region may be skipped, a replaceable one takes any words up to the mandatory one that follows
it. A text is accepted from a place if some path through the automaton ends there; the
longest is reported. A template neither begins nor ends with a replaceable region, so what is
reported is wording of the license from its first word to its last.

Automata are started only where the template's first mandatory words stand, which is found
for all texts of a batch at once by word hashes and then compared as words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bytes_of, flat, pieces
from .words import grams, words

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_AS_IS = "without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."

#: Wording of common licenses and of the notices that apply them, in our markup.
TEMPLATES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice {(including the next paragraph)} shall be included in all copies or substantial portions of the Software. "
        f"The software is provided as is, {_AS_IS} In no event shall [holders] be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, "
        "arising from, out of or in connection with the software or the use or other dealings in the software."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and{/or} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "The software is provided as is and [author] disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. "
        "In no event shall [author] be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, "
        "arising out of or in connection with the use or performance of this software."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "{1.} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "{2.} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "{{3.} Neither the name of [holder] nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.} "
        "This software is provided by [holder] as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. "
        "In no event shall [holder] be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) "
        "however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
    ),
    "zlib-text": (
        "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "{1.} The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "{2.} Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. {3.} This notice may not be removed or altered from any source distribution."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at [url] "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-notice": "licensed under the apache license {version} 2 0",
    "gpl-header": (
        "free software; you can redistribute it and/or modify it under the terms of the GNU {Lesser} {Library} {Affero} General Public License as published by the Free Software Foundation; "
        "{either} version [version:2] of the License{, or (at your option) any later version}"
    ),
    "gpl-notice": "licensed under the {terms of the} gnu {lesser} {library} {affero} general public license {version {1} {2} {3} {0}} {or later}",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at [url:4] mozilla.org {MPL/2.0}",
    "cc-notice": "licensed under {a} {the} {creative commons} {attribution} cc by {nc} {sa} {nd} {1 0} {2 0} {2 5} {3 0} {4 0} {international}",
}

_RESULT = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base:array<string>,labels:array<string>,spans:array<struct<label:string,first:int,end:int>>,score:double>"
_TYPE = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))), ("score", pa.float64())])


class Automaton:
    """States are numbers; ``step[s]`` has word moves, ``any_`` moves on any word, ``free`` moves without a word."""

    def __init__(self, markup: str):
        self.words: list[tuple[int, bytes, int]] = []
        self.any: list[tuple[int, int]] = []
        self.free: list[tuple[int, int]] = []
        self.states = 1
        parts = re.findall(r"[{}]|\[[^\]]*\]|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", markup.lower())
        self.mandatory = 0
        end, rest = self._row(parts, 0, 0)
        if rest != len(parts):
            raise ValueError("a closing brace without an opening one")
        self.end = end
        self.next: dict[int, list[tuple[bytes | None, int]]] = {}
        for a, w, b in self.words:
            self.next.setdefault(a, []).append((w, b))
        for a, b in self.any:
            self.next.setdefault(a, []).append((None, b))
        reach: dict[int, set[int]] = {}
        for s in range(self.states):
            seen, todo = {s}, [s]
            while todo:
                x = todo.pop()
                for a, b in self.free:
                    if a == x and b not in seen:
                        seen.add(b)
                        todo.append(b)
            reach[s] = seen
        self.closure = reach
        if any(end in reach[b] for _, b in self.any):
            raise ValueError("a template must not end with a replaceable region")

    def _new(self) -> int:
        self.states += 1
        return self.states - 1

    def _row(self, parts: Sequence[str], i: int, state: int, depth: int = 0) -> tuple[int, int]:
        while i < len(parts):
            part = parts[i]
            if part == "}":
                if not depth:
                    raise ValueError("a closing brace without an opening one")
                return state, i
            if part == "{":
                end, i = self._row(parts, i + 1, state_in := self._new(), depth + 1)
                if i >= len(parts):
                    raise ValueError("an opening brace without a closing one")
                out = self._new()
                self.free += [(state, state_in), (end, out), (state, out)]
                state = out
            elif part[0] == "[":
                most = int(part[1:-1].partition(":")[2] or 12)
                out = self._new()
                self.free.append((state, out))
                for _ in range(most):
                    new = self._new()
                    self.any.append((state, new))
                    self.free.append((new, out))
                    state = new
                state = out
            else:
                new = self._new()
                self.words.append((state, part.encode(), new))
                self.mandatory += depth == 0
                state = new
            i += 1
        return state, i

    def starts(self, k: int) -> set[tuple[bytes, ...]]:
        """Every sequence of up to ``k`` words with which an accepted text can begin (None: any word, and what follows is cut)."""
        out, todo = set(), [(0, ())]
        while todo:
            state, sofar = todo.pop()
            for s in self.closure[state]:
                if s == self.end or len(sofar) == k:
                    out.add(sofar)
                for w, to in self.next.get(s, ()) if len(sofar) < k else ():
                    out.add(sofar) if w is None else todo.append((to, (*sofar, w)))
        if () in out:
            raise ValueError("a template must begin with a word, and need one")
        return out

    def longest(self, text: Sequence[bytes], at: int) -> int:
        """End of the longest accepted run of words from ``at``; -1 if there is none."""
        states, end, i = set(self.closure[0]), -1, at
        while states and i < len(text):
            new: set[int] = set()
            for s in states:
                for w, to in self.next.get(s, ()):
                    if w is None or w == text[i]:
                        new |= self.closure[to]
            states, i = new, i + 1
            if self.end in states:
                end = i
        return end


def _prefixes(automata: Mapping[str, Automaton], k: int = 3) -> dict[int, dict[tuple[bytes, ...], list[str]]]:
    """Beginnings of templates by their length; shorter ones cover longer ones that begin with them."""
    out: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for name, machine in automata.items():
        for start in machine.starts(k):
            out.setdefault(len(start), {}).setdefault(start, []).append(name)
    return out


def _hash_of(parts: Sequence[bytes]) -> int:
    line = b" ".join(parts)
    _, _, _, _, hashes = words(np.frombuffer(line, np.uint8), np.array([0, len(line)]))
    if len(hashes) != len(parts):
        raise ValueError(f"{line!r} is not made of words")
    return int(grams(hashes, len(parts), 77 + len(parts))[0])


def _scanner(phrases: Sequence[tuple[str, str]], templates: Mapping[str, str]):
    automata = {name: Automaton(markup) for name, markup in templates.items()}
    base = {tuple(p.encode() for p in phrase.split()): label for phrase, label in phrases}
    prefixes = _prefixes(automata)
    wanted: dict[int, np.ndarray] = {}
    for n in {len(p) for p in base} | set(prefixes):
        each = {p for p in base if len(p) == n} | set(prefixes.get(n, ()))
        wanted[n] = np.array(sorted(_hash_of(p) for p in each), np.uint64)

    def scan(texts: pa.Array):
        low, starts, ends, at, hashes = words(*flat(texts))
        places: dict[int, set[tuple[int, int]]] = {}
        text_of = lambda p: int(np.searchsorted(at, p, "right")) - 1
        for n, hashed in wanted.items():
            for p in np.flatnonzero(np.isin(grams(hashes, n, 77 + n), hashed)).tolist():
                d = text_of(p)
                if p + n <= at[d + 1]:
                    places.setdefault(d, set()).add((p, n))
        lowered = low.tobytes()
        out = []
        for d in range(len(texts)):
            first, last = int(at[d]), int(at[d + 1])
            here = []
            longest: dict[tuple[str, int], int] = {}
            if d in places:
                split = [lowered[a:b] for a, b in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True)]
                for p, n in sorted(places[d]):
                    i = p - first
                    found = tuple(split[i : i + n])
                    if found in base:
                        here.append((i, base[found]))
                    for name in prefixes.get(n, {}).get(found, ()):
                        end = automata[name].longest(split, i)
                        if end > i:
                            longest[name, end] = min(i, longest.get((name, end), i))
            spans = {(name, i, end) for (name, end), i in longest.items()}
            covered = set()
            for _, a, b in spans:
                covered.update(range(a, b))
            for i, label in here:
                covered.update(range(i, i + max(len(p) for p, x in base.items() if x == label)))
            n_words = last - first
            # the score is the share of words in license wording, half of it from having any
            score = 0.5 * bool(covered) + 0.5 * min(1.0, len(covered) / n_words) if n_words else 0.0
            labels = sorted({x for _, x in here} | {x for x, _, _ in spans})
            out.append({
                "n_words": n_words, "n_base": len(here), "first_word": min(i for i, _ in here) if here else None, "last_word": max(i for i, _ in here) if here else None,
                "base": sorted({x for _, x in here}), "labels": labels, "spans": [{"label": x, "first": a, "end": b} for x, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2]))], "score": score,
            })
        return pa.array(out, _TYPE)

    @arrow_udf(_RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [scan(texts) for texts in pieces(batch)]
            yield pa.concat_arrays(found) if found else pa.array([], _TYPE)

    return run


def scanned(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base, labels, spans, score) of every row.

    Words are runs of letters, digits and characters above ASCII, A-Z lower-cased. ``n_base``
    counts places of phrases, first_word and last_word are the smallest and largest start
    (null if none), ``base`` has the phrases' labels, ``labels`` the templates' too, ``spans``
    what templates accepted (label, first word, end word). ``score`` is 0 without any, else a
    half and half the share of words covered.

    Null and empty texts have no words; very long ones are read whole. Of equally placed
    templates all are reported; repeated rows are judged alike; other columns are ignored; no
    rows give no rows.
    """
    found = documents.select(F.col(id_col).alias("id"), _scanner(phrases, templates)(bytes_of(F.col(text_col))).alias("r"))
    return found.select("id", "r.*")
