"""Licence scans with a generalised suffix automaton of licence tokens.

Template texts and base phrases are put, as word ids, into one suffix automaton. Texts
stream through it: at each word the automaton holds the longest suffix read so far that
occurs in any template (the matching statistics). Words outside the licence vocabulary
reset it, so only runs of known words are walked. Long maximal matches are chained per
template, in order in both text and template, into covered template spans.

A base phrase stands at a place when it is a suffix of what has been matched there; every
place counts, overlapping ones too. A template's label is added when its best chain covers
``MIN_COVER`` of its words. ``score`` is the largest share of a template covered by one
chain (0 without a chain of ``MIN_MATCH`` words).

Null and empty texts: no words, no places, empty labels, score 0, null first and last
word. Rows are independent, so repeated rows repeat their result; an empty table stays
empty. Only the id and the text are read, so other columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Opening or standard sentences of public licences, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-work": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "reserved-notice": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}
#: Words that a maximal match must have to be chained, and the share of a template that a chain must cover.
MIN_MATCH, MIN_COVER = 4, 0.6

_DELIMITERS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes(0x20 if b in _DELIMITERS else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then words of digits, a-z and bytes of other letters."""
    return text.lower().translate(_TO_SPACE).split()


class Automaton:
    """Generalised suffix automaton over word ids; states know where in which templates they end."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, words in enumerate(templates):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((k, at + 1))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(dict(follow))
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.length[p] + 1, self.next[q], self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        texts = [words_of(t.encode()) for t in [*templates.values(), *phrases]]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t), 1)}
        self.labels = list(templates)
        self.sizes = [len(t) for t in texts[: len(templates)]]
        self.auto = Automaton([[self.ids[w] for w in t] for t in texts])
        #: By state: (words, label) of the phrases that are suffixes of what the state stands for.
        self.phrase_ends: list[list[tuple[int, str]]] = [[] for _ in self.auto.link]
        for t, label in zip(texts[len(templates) :], phrases.values()):
            state = 0
            for w in t:
                state = self.auto.next[state][self.ids[w]]
            self.phrase_ends[state].append((len(t), label))
        for state in sorted(range(1, len(self.auto.link)), key=self.auto.length.__getitem__):
            self.phrase_ends[state] += self.phrase_ends[self.auto.link[state]]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """Words; base places (start, end, label); best chain per template (start, end, label, cover)."""
        words = words_of(text)
        if len(words) < 2:
            return len(words), [], []
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        known = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        if not len(known):
            return len(words), [], []
        cut = np.flatnonzero(np.diff(known) > 1)
        firsts, lasts = known[np.r_[0, cut + 1]], known[np.r_[cut, len(known) - 1]] + 1
        follow, link, length, phrase_ends = self.auto.next, self.auto.link, self.auto.length, self.phrase_ends
        places, matches = [], []
        for first, last in zip(firsts.tolist(), lasts.tolist()):
            state = size = 0
            for i in range(first, last + 1):
                w = int(ids[i])
                if w not in follow[state]:
                    if size >= MIN_MATCH:
                        matches.append((i, size, state))
                    while state and w not in follow[state]:
                        state = link[state]
                        size = length[state]
                if w in follow[state]:
                    state, size = follow[state][w], size + 1
                    for n, label in phrase_ends[state]:
                        if size >= n:
                            places.append((i + 1 - n, i + 1, label))
            if size >= MIN_MATCH:
                matches.append((last + 1, size, state))
        return len(words), places, self.chains(matches) if matches else []

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Per template, the chain of matches, in order in both, that covers most of its words."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in matches:
            for k, at in self.auto.ends[state]:
                if k < len(self.labels):
                    by.setdefault(k, []).append((end, at, min(size, at)))
        out = []
        for k, found in sorted(by.items()):
            # Copies of a template lie apart: a chain spans twice the template's words at most.
            found.sort()
            best: list[tuple[int, int]] = []  # words covered, first word of the text
            top, reach, oldest = (0, 0, 0), 2 * self.sizes[k], 0
            for j, (end, at, size) in enumerate(found):
                mine = (size, end - size)
                while found[oldest][0] < end - reach:
                    oldest += 1
                for i in range(oldest, j):
                    e, a, _ = found[i]
                    gain = min(size, end - e, at - a)
                    if gain > 0 and end - best[i][1] <= reach:
                        mine = max(mine, (best[i][0] + gain, best[i][1]), key=lambda x: x[0])
                best.append(mine)
                top = max(top, (mine[0], mine[1], end), key=lambda x: x[0])
            out.append((top[1], top[2], self.labels[k], top[0] / self.sizes[k]))
        return out


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, ``places`` and ``covered`` (arrays of structs). One pass, no shuffle."""
    common.shipped(docs.sparkSession)
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    kept = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    place = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    cover = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for block in common.blocks(batches, "text"):
            got = [scanner.scan(t) for t in common.utf8(block.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([[{"first": a, "end": b, "label": x} for a, b, x in g[1]] for g in got], place),
                    pa.array([[{"first": a, "end": b, "label": x, "cover": c} for a, b, x, c in g[2]] for g in got], cover),
                ],
                names=["key", "n_words", "places", "covered"],
            )

    kind = kept.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_words long, places array<struct<first:long,end:long,label:string>>, covered array<struct<first:long,end:long,label:string,cover:double>>"
    return kept.mapInArrow(work, schema).withColumnRenamed("key", key)


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    hits = scanned(common.table(spark, sf_dir, "documents"))
    base = F.array_distinct(F.transform("places", lambda p: p.label))
    added = F.transform(F.filter("covered", lambda c: c.cover >= MIN_COVER), lambda c: c.label)
    return hits.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p.first)).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p.first)).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, added)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("covered", lambda c: c.cover)), F.lit(0.0)).alias("score"),
    )
