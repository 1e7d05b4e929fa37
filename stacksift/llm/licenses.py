"""Licence scans through a positional index of rare words.

Templates are whole licence texts, the notices that stand in files, and the base phrases; each has key phrases that must
stand word for word, in order and about as far apart as in the template. The words of all key phrases are weighted by their
inverse document frequency over all documents. A file is looked up by its own words of highest IDF: those at or above the
weight that every key phrase reaches with at least one word, so that no phrase can be missed. Each of them votes, through
the postings of the key phrases, for the place where a phrase would start; where all of a phrase's rare words agree on one
place, the phrase is verified word for word.

score: of the templates found, the largest share of IDF weight that agrees, every word of the template being held against
the file at its distance from the nearest key phrase before it (the first one's, where there is none); 0 if none is found.

Defined cases: a null or empty text has no words, no place and score 0. Repeated rows get equal results; rows without
doc_id are scanned like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import pkgutil
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, texts

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Key phrases of the whole licence texts in the folder licence_texts, as their authors publish them.
WHOLE = {
    "apache-2": ("apache license version 2 0 january 2004", "terms and conditions for use reproduction and distribution", "grant of patent license", "limitation of liability"),
    "artistic-1": ("the artistic license", "copyright holder maintains some semblance of artistic control"),
    "bsd-2": ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice", "possibility of such damage"),
    "bsd-3": ("redistribution and use in source and binary forms", "neither the name of", "possibility of such damage"),
    "bsl-1": ("boost software license version 1 0", "machine executable object code generated by a source language processor"),
    "cc0": ("cc0 1 0 universal", "statement of purpose", "public license fallback"),
    "gpl-2": ("gnu general public license version 2 june 1991", "terms and conditions for copying distribution and modification", "no warranty"),
    "gpl-3": ("gnu general public license version 3 29 june 2007", "conveying verbatim copies", "disclaimer of warranty"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose", "tortious action"),
    "lgpl-2.1": ("gnu lesser general public license version 2 1 february 1999", "combined work", "no warranty"),
    "lgpl-3": ("gnu lesser general public license version 3 29 june 2007", "combined works"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy", "the above copyright notice and this permission notice", "noninfringement"),
    "mpl-2": ("mozilla public license version 2 0", "covered software", "exhibit a source code form license notice"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "relinquishment in perpetuity"),
    "zlib": ("altered source versions must be plainly marked as such", "this notice may not be removed or altered from any source distribution"),
}
#: Notices with their labels; key phrases are between asterisks.
NOTICES = (
    ("*licensed under the apache license* version 2 0 the license *you may not use this file except in compliance with the license*", "apache-2"),
    ("it under the terms of the *gnu general public license as published by the free software foundation* *either version 2 of the license* or at your option any later version", "gpl-2"),
    ("it under the terms of the *gnu general public license as published by the free software foundation* *either version 3 of the license* or at your option any later version", "gpl-3"),
    ("*gnu general public license version 2*", "gpl-2"),
    ("*gnu general public license version 3*", "gpl-3"),
    ("under the terms of the *gnu general public license as published by the free software foundation*", "gpl"),
    ("it under the terms of the *gnu lesser general public license as published by the free software foundation*", "lgpl"),
    ("it under the terms of the *gnu affero general public license as published by the free software foundation*", "agpl"),
    ("this source code form is *subject to the terms of the mozilla public license* v 2 0", "mpl-2"),
    ("this work is licensed under a *creative commons attribution noncommercial* 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a *creative commons attribution sharealike* 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a *creative commons attribution 4 0* international license", "cc-by"),
    ("*cc by sa*", "cc-by-sa"),
    ("*spdx license identifier mit*", "mit"),
    ("*spdx license identifier apache 2 0*", "apache-2"),
    ("*spdx license identifier bsd 3 clause*", "bsd-3"),
    ("*spdx license identifier bsd 2 clause*", "bsd-2"),
    ("*all rights reserved*", "proprietary"),
)
#: Labels whose templates hold another's: where both are found only the first stays.
INSTEAD = (("bsd-3", "bsd-2"), ("gpl-2", "gpl"), ("gpl-3", "gpl"))
#: How far a key phrase may be from its place in the template: words, or a share of the distance if that is more.
SLACK, STRETCH = 60, 0.25
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def _find(w: list[bytes], phrase: tuple[bytes, ...], start: int) -> int:
    n = len(phrase)
    return next(i for i in range(start, len(w) - n + 1) if tuple(w[i : i + n]) == phrase)


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, int], ...]
    label: str
    base: bool = False

    def phrases(self) -> list[tuple[bytes, ...]]:
        return [self.words[a:b] for a, b in self.keys]


def _template(text: list[bytes], phrases: tuple[str, ...], label: str) -> Template:
    keys, at = [], 0
    for p in phrases:
        phrase = tuple(p.encode().split())
        at = _find(text, phrase, at)
        keys.append((at, at + len(phrase)))
        at += len(phrase)
    return Template(tuple(text), tuple(keys), label)


@functools.cache
def templates() -> tuple[Template, ...]:
    out = [Template(tuple(p.encode().split()), ((0, len(p.split())),), label, True) for p, label in BASE]
    for text, label in NOTICES:
        out.append(_template(words(text.replace("*", " ").encode()), tuple(text.split("*")[1::2]), label))
    for label, phrases in WHOLE.items():
        out.append(_template(words(pkgutil.get_data(__package__, f"licence_texts/{label}.txt")), phrases, label))
    return tuple(out)


@functools.cache
def vocabulary() -> frozenset[bytes]:
    return frozenset(w for t in templates() for w in t.words)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows, known = Counter(), 0, vocabulary()
    for batch in batches:
        for text in texts(batch.column(0)):
            seen.update(known.intersection(words(text)))
            rows += 1
    names = [w.decode(errors="replace") for w in seen]
    yield pa.RecordBatch.from_arrays([pa.array([None, *names], pa.string()), pa.array([rows, *seen.values()], pa.int64())], ["word", "n"])


class Index:
    """Postings of key phrases by their rare words, and templates by key phrases."""

    def __init__(self, idf: dict[bytes, float]):
        self.idf, self.all = idf, templates()
        self.phrases = list(dict.fromkeys(p for t in self.all for p in t.phrases()))
        number = {p: i for i, p in enumerate(self.phrases)}
        self.floor = min(max(idf[w] for w in p) for p in self.phrases)
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.rare = [0] * len(self.phrases)
        for n, p in enumerate(self.phrases):
            for i, w in enumerate(p):
                if idf[w] >= self.floor:
                    self.postings.setdefault(w, []).append((n, i))
                    self.rare[n] += 1
        self.needs = [(t, [number[p] for p in t.phrases()]) for t in self.all]

    def places(self, w: list[bytes]) -> dict[int, list[int]]:
        """By key phrase: where it starts."""
        votes: Counter = Counter()
        postings = self.postings
        for i in [i for i, x in enumerate(w) if x in postings]:
            for phrase, offset in postings[w[i]]:
                votes[phrase, i - offset] += 1
        out: dict[int, list[int]] = {}
        for (phrase, start), n in votes.items():
            p = self.phrases[phrase]
            if n == self.rare[phrase] and start >= 0 and tuple(w[start : start + len(p)]) == p:
                out.setdefault(phrase, []).append(start)
        return {k: sorted(v) for k, v in out.items()}

    def _found(self, t: Template, at: list[list[int]]) -> Iterator[list[int]]:
        """Places of all key phrases, in order and near where the template has them, for each place of the first."""
        for first in at[0]:
            chain = [first]
            for k in range(1, len(at)):
                apart = t.keys[k][0] - t.keys[k - 1][0]
                most = max(SLACK, STRETCH * apart)
                i = bisect_right(at[k], max(chain[-1], chain[-1] + apart - most - 1))
                if i == len(at[k]) or at[k][i] > chain[-1] + apart + most:
                    break
                chain.append(at[k][i])
            else:
                yield chain

    def _share(self, t: Template, w: list[bytes], chain: list[int]) -> float:
        starts = [a for a, _ in t.keys]
        got = whole = 0.0
        for i, x in enumerate(t.words):
            k = max(0, bisect_right(starts, i) - 1)
            at = chain[k] + i - starts[k]
            whole += self.idf[x]
            if 0 <= at < len(w) and w[at] == x:
                got += self.idf[x]
        return got / whole

    def scan(self, w: list[bytes]) -> tuple[int, int | None, int | None, str, str, float]:
        places = self.places(w)
        base, own, best, starts = set(), set(), 0.0, []
        for t, needs in self.needs if places else ():
            if not all(n in places for n in needs):
                continue
            if t.base:
                starts += places[needs[0]]
                base.add(t.label)
                own.add(t.label)
                best = 1.0
                continue
            for chain in self._found(t, [places[n] for n in needs]):
                own.add(t.label)
                if best < 1:
                    best = max(best, self._share(t, w, chain))
        for stays, goes in INSTEAD:
            if stays in own and goes not in base:
                own.discard(goes)
        return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(own)), min(1.0, best)


def _scan(idf: dict[bytes, float]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf)
        for batch in batches:
            rows = [(len(w), *index.scan(w)) for w in map(words, texts(batch.column(1)))]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return scan


def weights(docs: DataFrame) -> dict[bytes, float]:
    """IDF over all documents of the templates' words; a row for each of them at most comes to the driver."""
    counts = docs.select("text").mapInArrow(lean(_frequencies), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = {r["word"]: r["n"] for r in counts.collect()}
    rows = seen.get(None, 0)
    return {w: math.log((rows + 1) / (seen.get(w.decode(errors="replace"), 0) + 1)) + 1 for w in vocabulary()}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    idf = weights(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_scan(idf)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
