"""Licence scans over a generalised suffix automaton of licence tokens.

Templates and phrases, as words, make one automaton that knows every run of
words of any of them. A text streams through it once: for each word it gives
the length of the longest run ending there that some template contains (the
matching statistics) and the state that stands for it. Where the statistics
reach a phrase's end state, the phrase stands in the text. Runs of LEAST or
more words are chained, in template order and with bounded gaps, into spans of
a template; a template of which SHARE is covered gives its label.

The automaton is built from the templates alone, which are parameters, so it
is small and travels with the task. The scan is a single map over the rows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

LEAST, SHARE, GAP = 6, 0.5, 12
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

#: Phrases that make a place of their label wherever their words stand in a row.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public licences by label, the short ones whole and the long ones by the notices that stand in files.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
        "the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    "boost": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
    ),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",),
    "cc0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide",
    ),
    "all-rights-reserved": ("All rights reserved. No part of this publication may be reproduced",),
}


def words_of(text: str | None) -> list[str]:
    """Runs of digits, letters a to z and all non-ASCII characters, A-Z in lower case."""
    return _WORD.findall((text or "").translate(_LOWER))


class SuffixAutomaton:
    """Of several word sequences: every run of words of any of them is a path from the start."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]  # (sequence, end) of one or more runs that end here

    def _state(self, length: int, copied: int | None = None) -> int:
        self.next.append({} if copied is None else dict(self.next[copied]))
        self.link.append(-1 if copied is None else self.link[copied])
        self.length.append(length)
        self.places.append([])
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The part of q whose runs are one word longer than p's, as a state of its own."""
        copy = self._state(self.length[p] + 1, q)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, sequence: list[int], name: int) -> None:
        last = 0
        for end, word in enumerate(sequence, 1):
            q = self.next[last].get(word)
            if q is not None:  # another sequence has this run already
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p < 0:
                    self.link[new] = 0
                else:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
            self.places[last].append((name, end))

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The state and length of the longest run after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, length + 1)


@dataclass(frozen=True)
class Found:
    n_words: int
    base: list[tuple[int, str]]  # start word and label of each phrase's place
    spans: list[tuple[str, int, int, float]]  # label, first word, end word, share of the template covered

    @property
    def base_labels(self) -> list[str]:
        return sorted({label for _, label in self.base})

    @property
    def labels(self) -> list[str]:
        return sorted({label for _, label in self.base} | {s[0] for s in self.spans})

    @property
    def score(self) -> float:
        return 1.0 if self.base else max((s[3] for s in self.spans), default=0.0)


class Scanner:
    """Finds phrases and template spans in texts."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: int = LEAST, share: float = SHARE, gap: int = GAP):
        self.least, self.share, self.gap = least, share, gap
        self.ids: dict[str, int] = {}
        self.automaton = SuffixAutomaton()
        self.sequences: list[tuple[str, int]] = []  # label and number of words; phrases first
        number = lambda text: [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
        coded = [(label, number(text)) for text, label in phrases.items()]
        self.phrases = len(coded)
        coded += [(label, number(text)) for label, texts in templates.items() for text in texts]
        for k, (label, sequence) in enumerate(coded):
            self.automaton.add(sequence, k)
            self.sequences.append((label, len(sequence)))
        a = self.automaton
        ends: list[list[tuple[int, str]]] = [[] for _ in a.length]  # phrases whose last word is here, by state
        for k, (label, sequence) in enumerate(coded[: self.phrases]):
            state = length = 0
            for word in sequence:
                state, length = a.step(state, length, word)
            ends[state].append((len(sequence), label))
        order = sorted(range(1, len(a.length)), key=a.length.__getitem__)
        self.ends: list[list[tuple[int, str]]] = [[] for _ in a.length]
        self.known: list[list[tuple[int, int]]] = [list(p) for p in a.places]
        for s in order:  # what ends at a suffix ends here too
            self.ends[s] = ends[s] + self.ends[a.link[s]]
        for s in reversed(order):  # a run occurs wherever a longer one that it ends does
            if a.length[a.link[s]] >= least:  # shorter runs are no evidence
                self.known[a.link[s]] += self.known[s]

    def scan(self, text: str | None) -> Found:
        words = words_of(text)
        codes = list(map(self.ids.get, words))
        base: list[tuple[int, str]] = []
        runs: list[tuple[int, int, int]] = []  # first word, end word, state of each longest run
        a, least = self.automaton, self.least
        state = length = 0
        for i, code in enumerate(codes):
            if code is None:
                if length >= least:
                    runs.append((i - length, i, state))
                state = length = 0
                continue
            before, was = state, length
            state, length = a.step(state, length, code)
            if length <= was and was >= least:
                runs.append((i - was, i, before))
            if self.ends[state]:
                base += [(i + 1 - n, label) for n, label in self.ends[state] if n <= length]
        if length >= least:
            runs.append((len(words) - length, len(words), state))
        return Found(len(words), base, self.chain(runs) if runs else [])

    def chain(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Runs of a template in its order, at most `gap` words apart in the text, as spans of it.

        Each run goes behind the chain that covers most of those it can follow.
        Runs come in the order of their ends, so a chain that ended over `gap`
        words ago is closed, and what is open is bounded by `gap` and by how
        often one run stands in a template. Of the chains that begin with the
        same run the one that covers most counts.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for begin, end, state in runs:
            for name, at in self.known[state]:
                if name >= self.phrases:
                    by.setdefault(name, []).append((begin, end, at))
        out = []
        for name, found in by.items():
            label, size = self.sequences[name]
            live: deque[tuple[int, int, int, int]] = deque()  # end word, end in the template, words covered, first word
            best: dict[int, tuple[int, int]] = {}  # by first word: words covered, end word
            for begin, end, at in found:
                n = end - begin
                while live and live[0][0] + self.gap < begin:
                    live.popleft()
                before = (0, 0, 0, begin)
                for chain in live:
                    if chain[0] > begin:
                        break
                    if chain[1] <= at - n and chain[2] > before[2]:
                        before = chain
                grown = (end, at, before[2] + n, before[3])
                live.append(grown)
                best[grown[3]] = max(best.get(grown[3], (0, 0)), (grown[2], end))
            out += [(label, first, end, n / size) for first, (n, end) in best.items() if n >= self.share * size]
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))


_scanner: list[Scanner] = []


def license_scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_words, base (start, label), spans (label, first, end, covered), labels and score for each row.

    Null and empty texts have no words, no places and score 0; repeated rows
    repeat their result. score is 1 where a phrase stands, else the largest
    share of a template that is covered.
    """
    base = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
    names = ["doc_id", "n_words", "base", "spans", "base_labels", "labels", "score"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if scanner is None and not _scanner:
            _scanner.append(Scanner())
        scan = (scanner or _scanner[0]).scan
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array([f.n_words for f in found], pa.int64()),
                pa.array([[{"start": s, "label": k} for s, k in f.base] for f in found], base),
                pa.array([[{"label": k, "first": a, "end": b, "covered": c} for k, a, b, c in f.spans] for f in found], span),
                pa.array([f.base_labels for f in found], pa.list_(pa.string())),
                pa.array([f.labels for f in found], pa.list_(pa.string())),
                pa.array([min(1.0, f.score) for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = (
        "doc_id long, n_words long, base array<struct<start:long,label:string>>, "
        "spans array<struct<label:string,first:long,end:long,covered:double>>, "
        "base_labels array<string>, labels array<string>, score double"
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, schema)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.transform("base", lambda b: b["start"])
    return license_scan(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
