"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of a document's words twice as long as a template, started every template length, so any passage of
a template's length lies whole in one. It meets the template if it has at least THRESHOLD of the template's distinct
words (containment). Template words are ordered by how many documents have them, counted over the whole table, the rarest
first; a template and a block are lists of ranks in that order, a block's over the words of all templates. Prefix filter:
a template and a block that meet share a word within the first of both, so only blocks around the places of a template's
prefix words are looked at, and only the prefix of a block is compared. Length filter: a block needs as many ranks as
the threshold asks for. Positional filter: after the first common word, at places i and j of the two lists, no more can
follow than the shorter rest. Blocks that pass are counted whole. Templates and their counts are the only things sent to
every task; both are bounded by the list of templates.

Base labels are exact phrases. ``labels`` has both; ``score`` is 1 with a base place, else the best containment found
(0 if none meets the threshold). Null text counts as empty: no words, null places, empty labels; ids may repeat; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.llm.common import table

THRESHOLD = 0.8
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices of public licenses, by label.
TEMPLATES = {
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-work": "this work is licensed under the gnu general public license version",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-short": "licensed under the apache license version 2 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-short": "released under the mit license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution international license",
    "cc-by-short": "licensed under cc by",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "all-rights-reserved": "all rights reserved",
    "gpl-whole": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
    "apache-whole": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "mit-whole": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
LABELS = {"gpl-work": "gpl", "apache-short": "apache", "mit-short": "mit", "cc-by-short": "cc-by", "gpl-whole": "gpl", "apache-whole": "apache", "mit-whole": "mit"}


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER) if not text.islower() else text)


@dataclass(frozen=True)
class Template:
    """A notice as its ranks in order, what it needs of them, and its length in words."""

    label: str
    ranks: tuple[int, ...]
    need: int
    size: int

    @property
    def prefix(self) -> tuple[int, ...]:
        return self.ranks[: len(self.ranks) - self.need + 1]

    def may_meet(self, block: list[int]) -> bool:
        """Length and prefix filters: false only if the block's ranks (distinct, in order) can't hold ``need`` of the template's."""
        return len(block) >= self.need and not frozenset(self.prefix).isdisjoint(block[: len(block) - self.need + 1])

    def overlap(self, block: list[int]) -> int:
        """Number of shared ranks, or 0 if under ``need``: the walk ends where those met and the shorter rest can't reach it."""
        met = i = j = 0
        while met + min(len(self.ranks) - i, len(block) - j) >= self.need:
            if i == len(self.ranks) or j == len(block):
                return met
            if self.ranks[i] == block[j]:
                met, i, j = met + 1, i + 1, j + 1
            elif self.ranks[i] < block[j]:
                i += 1
            else:
                j += 1
        return 0


class Scanner:
    """Prefix index of the templates under a global word order."""

    def __init__(self, frequency: dict[str, int], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD):
        vocabulary = {w for text in templates.values() for w in text.split()}
        self.rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates = []
        for label, text in templates.items():
            ranks = tuple(sorted({self.rank[w] for w in text.split()}))
            self.templates.append(Template(LABELS.get(label, label), ranks, math.ceil(threshold * len(ranks) - 1e-9), len(text.split())))
        self.prefix: dict[int, list[Template]] = {}
        for t in self.templates:
            for r in t.prefix:
                self.prefix.setdefault(r, []).append(t)
        self.phrases = [(p.split(), label) for p, label in PHRASES.items()]

    def scan(self, text: str) -> tuple:
        w = words(text)
        there = set(w)
        places, base = [], set()
        for phrase, label in self.phrases:
            if there.issuperset(phrase):
                at = [i for i, x in enumerate(w) if x == phrase[0] and w[i : i + len(phrase)] == phrase]
                places += at
                base |= {label} if at else set()
        best, found = self._blocks(w, {self.rank[x] for x in self.rank.keys() & there})
        score = 1.0 if places else best
        return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score)

    def _blocks(self, w: list[str], there: set[int]) -> tuple[float, set[str]]:
        """Best containment over all blocks that meet a template, and the labels met."""
        best, found = 0.0, set()
        whole = sorted(there)
        open_templates = {t for r in there for t in self.prefix.get(r, ()) if t.overlap(whole)}
        if not open_templates:
            return best, found
        known = [(i, self.rank[x]) for i, x in enumerate(w) if x in self.rank]
        for t in open_templates:
            first = frozenset(t.prefix)
            cells: dict[int, set[int]] = {}
            hot = set()
            for i, r in known:
                cells.setdefault(i // t.size, set()).add(r)
                if r in first:
                    hot.add(i // t.size)
            for k in {h - d for h in hot for d in (0, 1) if h >= d}:  # a block is two cells
                block = sorted(cells.get(k, set()) | cells.get(k + 1, set()))
                if t.may_meet(block) and (share := t.overlap(block)):
                    found.add(t.label)
                    best = max(best, share / len(t.ranks))
        return best, found


def frequencies(docs: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> dict[str, int]:
    """Number of documents that have each template word, over the whole table; at most as many rows as template words."""
    vocabulary = frozenset(w for t in templates.values() for w in t.split())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    counts.update(vocabulary.intersection(words(text)))
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    made = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in made.collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    frequency = frequencies(docs, text_col)
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Scanner(frequency)
        for batch in (b for b in batches if len(b)):
            made = pd.DataFrame([own.scan(t or "") for t in batch["text"]], columns=columns)
            made = made.astype({"first_word": "Int64", "last_word": "Int64"})
            yield made.assign(id=batch["id"].to_numpy())[["id", *columns]]

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInPandas(run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return made.withColumnRenamed("id", id_col)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return scan(table(spark, sf_dir, "documents"))
