"""Licence scans by a positional index over rare words.

The words of the licence templates are ranked by inverse document frequency over the whole corpus. Each
template is represented by its rarest words (its anchors). For a file, the anchors it contains are looked up;
their postings (template, position) are intersected by relative position: words that stand as far apart in
the file as in the template vote for the same place of the template. Places with enough votes are verified:
every mandatory key phrase of the template must stand there word for word, and the share of template words
found in order of place gives the score.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.llm.common import alnum_words, chunks, doc_columns

# Names that are labels by themselves, wherever their words stand consecutively.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening or notice texts of public licences, with the phrases that must be present.
TEMPLATES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
        ["permission is hereby granted free of charge", "without limitation the rights to use copy modify merge publish"]),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
        ["permission to use copy modify", "with or without fee is hereby granted"]),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ["redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice"]),
    "bsd-3-clause": (
        "may be used to endorse or promote products derived from this software without specific prior written permission.",
        ["endorse or promote products derived from this software without specific prior written permission"]),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    "apache-2.0-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ["you may not use this file except in compliance with the license", "apache org licenses license 2 0"]),
    "gpl-2.0": ("GNU General Public License, version 2", ["general public license version 2"]),
    "gpl-3.0": ("GNU General Public License, version 3", ["general public license version 3"]),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ["gnu general public license as published by the free software foundation"]),
    "lgpl": ("GNU Lesser General Public License", ["gnu lesser general public license"]),
    "agpl": ("GNU Affero General Public License", ["gnu affero general public license"]),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ["subject to the terms of the mozilla public license v 2 0"]),
    "epl-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        ["free and unencumbered software released into the public domain"]),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        ["without any express or implied warranty", "to alter it and redistribute it freely"]),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0.", ["boost software license version 1 0"]),
    "cc0-1.0": ("released under CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0"]),
    "cc-by": ("Licensed under CC BY 4.0", ["licensed under cc by 4 0"]),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", ["licensed under cc by sa 4 0"]),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", ["licensed under cc by nc 4 0"]),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0", ["licensed under cc by nd 4 0"]),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0", ["licensed under cc by nc sa 4 0"]),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0", ["licensed under cc by nc nd 4 0"]),
    "cc-by-long": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution"]),
}

ANCHORS = 6
"""Rarest distinct words that stand for a template (all of them where it has fewer)."""

VOTES = 0.6
"""Share of a template's anchors that must agree on a place."""


class LicenceIndex:
    """Templates, their key phrases and, once ranked, the postings of their anchors."""

    def __init__(self, templates: dict[str, tuple[str, list[str]]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES):
        self.names = list(templates)
        self.words = [alnum_words(t.encode()) for t, _ in templates.values()]
        self.keys = [[alnum_words(k.encode()) for k in keys] for _, keys in templates.values()]
        self.phrases = [(alnum_words(p.encode()), label) for p, label in phrases.items()]
        self.vocabulary = sorted({w for words in self.words for w in words})

    def rank(self, document_counts: dict[bytes, int], n_docs: int) -> LicenceIndex:
        """Choose the anchors: highest inverse document frequency, ties by word."""
        idf = {w: math.log((1 + n_docs) / (1 + document_counts.get(w, 0))) for w in self.vocabulary}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for k, words in enumerate(self.words):
            anchors = sorted(set(words), key=lambda w: (-idf[w], w))[:ANCHORS]
            self.needed.append(max(1, math.ceil(VOTES * len(anchors))))
            for p, w in enumerate(words):
                if w in anchors:
                    self.postings[w].append((k, p))
        self.anchors = frozenset(self.postings)
        return self

    def base(self, words: list[bytes], present: set[bytes]) -> list[tuple[int, str]]:
        """(start, label) of every place where a base phrase's words stand consecutively."""
        found = []
        for phrase, label in self.phrases:
            if present.issuperset(phrase):
                n, last = len(phrase), phrase[-1]
                at = -1
                try:
                    while True:
                        at = words.index(last, at + 1)
                        if at + 1 >= n and words[at + 1 - n : at + 1] == phrase:
                            found.append((at + 1 - n, label))
                except ValueError:
                    pass
        return found

    def templates_in(self, words: list[bytes], present: set[bytes]) -> dict[str, float]:
        """Score of each template that the words contain."""
        anchors = self.anchors & present
        possible = Counter(k for w in anchors for k in {k for k, _ in self.postings[w]})
        possible = {k for k, n in possible.items() if n >= self.needed[k]}
        if not possible:
            return {}
        places: dict[int, list[tuple[int, bytes]]] = {k: [] for k in possible}
        for p, w in enumerate(words):
            if w in anchors:
                for k, q in self.postings[w]:
                    if k in places:
                        places[k].append((p - q, w))
        out = {}
        for k, votes in places.items():
            size = len(self.words[k])
            slack = max(2, size // 6)
            votes.sort()
            inside: Counter = Counter()
            left, best = 0, 0.0
            checked = -1
            for offset, w in votes:
                inside[w] += 1
                while votes[left][0] < offset - slack:
                    inside[votes[left][1]] -= 1
                    if not inside[votes[left][1]]:
                        del inside[votes[left][1]]
                    left += 1
                if len(inside) >= self.needed[k] and offset > checked:
                    checked = offset
                    a, b = max(0, votes[left][0] - slack), min(len(words), offset + size + slack)
                    best = max(best, self._verified(k, words[a:b]))
            if best:
                out[self.names[k]] = best
        return out

    def _verified(self, k: int, stretch: list[bytes]) -> float:
        """Share of the template's words in the stretch, 0 if a key phrase is missing."""
        text = b" " + b" ".join(stretch) + b" "
        if not all(b" " + b" ".join(key) + b" " in text for key in self.keys[k]):
            return 0.0
        have, want = Counter(stretch), Counter(self.words[k])
        return sum(min(n, have[w]) for w, n in want.items()) / len(self.words[k])

    def scan(self, text: bytes) -> tuple:
        words = alnum_words(text)
        present = set(words)
        base = self.base(words, present)
        found = self.templates_in(words, present)
        starts = [s for s, _ in base]
        base_labels = {label for _, label in base}
        score = max([1.0 if base else 0.0, *found.values()])
        return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | set(found))), score)


def _count(index):
    def run(batches):
        vocabulary, total, n = frozenset(index.value.vocabulary), Counter(), 0
        for _, texts in chunks(batches):
            n += len(texts)
            for text in texts:
                total.update(vocabulary.intersection(alnum_words(text)))
        words = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([*words, None], pa.binary()), pa.array([*(total[w] for w in words), n], pa.int64())], ["word", "n"])

    return run


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
])


def _scan(index):
    def run(batches):
        own = index.value
        for keys, texts in chunks(batches):
            rows = [(k, *own.scan(t)) for k, t in zip(keys, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def licence_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: dict | None = None) -> DataFrame:
    """Per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from the plain names; ``labels`` adds those of the templates found; ``score`` is 1 where
    a plain name stands, else the largest share of a found template, else 0. A null or empty text has no words
    and no labels; repeated rows each get their row.
    """
    sc = docs.sparkSession.sparkContext
    source = doc_columns(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    index = LicenceIndex(templates or TEMPLATES)
    counted = source.mapInArrow(_count(sc.broadcast(index)), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per template word
    counts = {bytes(r[0]): r[1] for r in counted if r[0] is not None}
    index.rank(counts, next((r[1] for r in counted if r[0] is None), 0))
    return source.mapInArrow(
        _scan(sc.broadcast(index)),
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
