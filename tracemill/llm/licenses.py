"""License scans (1): exact set-similarity join between license templates and text blocks.

Tokens are words of ASCII letters, digits and non-ASCII, A-Z as a-z. For a template of m words, the blocks
of a text are the windows of 2m words at every m-th word, so any run of m words lies whole in one. A block
matches when it holds at least ``threshold`` of the template's distinct tokens. The join is exact:

* the tokens of all templates are put in one global order, rarest in the whole corpus first;
* prefix filter: a match must hold one of the template's first m - need + 1 tokens in that order;
* length filter: a block with fewer words than needed is passed over;
* positional filter: counting stops once too many tokens in the order have been missed.

Two licenses may share nearly all words. Where the whole text of another label's template would match a
template too, its match also needs the same share of the tokens that tell it from the other; a template
without such tokens needs its own, by the median, more often in the block than those that tell the other.

Besides, the places of the base phrases are found by their consecutive words.

Defined results: null counts as empty (no words, score 0, empty labels); repeated rows and rows without an
id give a row each; an empty table gives none; very long texts are read whole; other columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, U, map_rows, pieces, words_of

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# The operative sentences of public licenses.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)

OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _vocabulary(templates: tuple[tuple[str, str], ...]) -> np.ndarray:
    return np.unique(np.concatenate([ALNUM.hash_all(t) for _, t in templates] or [np.zeros(0, U)]))


def token_counts(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> dict[int, int]:
    """How often each template token stands in the whole corpus. At most one number a token and task is moved."""
    vocabulary = _vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        finder = _Finder(vocabulary)
        for batch in batches:
            for _, data, offsets in pieces(batch.column("text")):
                _, which = finder(words_of(ALNUM, data, offsets)[0])
                total += np.bincount(which, minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["token", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {int(vocabulary[r.token]): r.n for r in rows.collect()}


class _Finder:
    """Places of vocabulary words among word hashes; a bit table turns most words away."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.vocabulary = vocabulary
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[vocabulary >> U(48)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.maybe[h >> U(48)])
        if not len(at) or not len(self.vocabulary):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        right = self.vocabulary[which] == h[at]
        return at[right], which[right]


class _Join:
    def __init__(self, templates: tuple[tuple[str, str], ...], counts: dict[int, int], threshold: float) -> None:
        vocabulary = _vocabulary(templates)
        self.finder = _Finder(vocabulary)
        place = {int(h): i for i, h in enumerate(vocabulary)}
        order = sorted(range(len(vocabulary)), key=lambda i: (counts.get(int(vocabulary[i]), 0), i))
        rank = {v: r for r, v in enumerate(order)}
        self.templates, prefixes = [], {}
        for label, text in templates:
            hashes = ALNUM.hash_all(text)
            tokens = sorted({place[int(h)] for h in hashes}, key=rank.__getitem__)
            need = max(1, math.ceil(round(threshold * len(tokens), 9)))
            self.templates.append((label, len(hashes), tokens, need))
            for t in tokens[: len(tokens) - need + 1]:
                prefixes.setdefault(t, []).append(len(self.templates) - 1)
        # For each template: tokens that tell it from a like one of another label, and how many must be there; or the other's, for it to outnumber.
        self.telling: list[list[tuple[list[int], int]]] = [[] for _ in self.templates]
        for k, (label, _, tokens, need) in enumerate(self.templates):
            for other, _, theirs, _ in self.templates:
                if other != label and len(set(tokens) & set(theirs)) >= need:
                    own = sorted(set(tokens) - set(theirs))
                    self.telling[k].append((own, max(1, math.ceil(round(threshold * len(own), 9)))) if own else (sorted(set(theirs) - set(tokens)), 0))
        self.prefixes = prefixes
        self.first = np.zeros(len(vocabulary), bool)
        self.first[list(prefixes)] = True
        self.phrases = [([U(ALNUM.hash(w)) for w in p.split()], label) for p, label in PHRASES.items()]

    def blocks(self, at: np.ndarray, which: np.ndarray, n: int) -> dict[str, float]:
        """Best containment by label for one text: places and numbers of its vocabulary words, and its length."""
        best: dict[str, float] = {}
        seen: set[tuple[int, int]] = set()
        for p, token in zip(at[(lead := self.first[which])].tolist(), which[lead].tolist(), strict=True):
            for k in self.prefixes[token]:
                label, m, tokens, need = self.templates[k]
                for b in {p // m, max(p // m - 1, 0)}:
                    lo, hi = b * m, min(b * m + 2 * m, n)
                    if (k, b) in seen or hi - lo < need or not lo <= p < hi:
                        continue
                    seen.add((k, b))
                    block = Counter(which[np.searchsorted(at, lo) : np.searchsorted(at, hi)].tolist())
                    if len(block) < need:
                        continue
                    may_miss, held = len(tokens) - need, 0
                    for i, t in enumerate(tokens):
                        held += t in block
                        if i + 1 - held > may_miss:
                            break
                    else:
                        if self._told(k, block):
                            best[label] = max(best.get(label, 0.0), held / len(tokens))
        return best

    def _told(self, k: int, block: Counter[int]) -> bool:
        """Whether the block is this template's rather than that of a like one."""
        usual = sorted(block[t] for t in self.templates[k][2])[len(self.templates[k][2]) // 2]
        return all(sum(t in block for t in tokens) >= need if need else usual > min(block[t] for t in tokens) for tokens, need in self.telling[k])

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").cast(pa.int64())
        for rows, data, offsets in pieces(batch.column("text")):
            h, _, bounds = words_of(ALNUM, data, offsets)
            n = len(bounds) - 1
            row_of = lambda at, bounds=bounds: np.searchsorted(bounds, at, "right") - 1
            base = np.zeros(n, np.int64)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: dict[int, set[str]] = {}
            for words, label in self.phrases:
                at = np.flatnonzero(h[: max(0, len(h) - len(words) + 1)] == words[0])
                for i, w in enumerate(words[1:], 1):
                    at = at[h[at + i] == w]
                at = at[row_of(at) == row_of(at + len(words) - 1)]
                r = row_of(at)
                base += np.bincount(r, minlength=n)
                np.minimum.at(first, r, at - bounds[r])
                np.maximum.at(last, r, at - bounds[r])
                for x in set(r.tolist()):
                    labels.setdefault(x, set()).add(label)
            at, which = self.finder(h)
            own = row_of(at)
            more = {}
            for x in np.unique(own[self.first[which]]).tolist():
                lo, hi = np.searchsorted(own, [x, x + 1])
                more[x] = self.blocks(at[lo:hi] - bounds[x], which[lo:hi], int(bounds[x + 1] - bounds[x]))
            gone = base == 0
            told = [",".join(sorted(labels.get(x, ()))) for x in range(n)]
            full = [",".join(sorted(labels.get(x, set()) | set(more.get(x, ())))) for x in range(n)]
            score = [1.0 if x in labels else max(more.get(x, {"": 0.0}).values(), default=0.0) for x in range(n)]
            yield pa.RecordBatch.from_arrays(
                [ids[rows], pa.array(np.diff(bounds)), pa.array(base), pa.array(first, mask=gone), pa.array(last, mask=gone), pa.array(told), pa.array(full), pa.array(score, pa.float64())],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """A row for each document: its words, base places, labels and the best containment as score."""
    counts, state = token_counts(docs, templates), {}

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if "join" not in state:
            state["join"] = _Join(templates, counts, threshold)
        return state["join"](batch)

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, OUT)
