"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of every template. A text is streamed through it once and
gives its matching statistics: at each word, the length of the longest run ending there that
some template contains. Runs that cannot be made longer are anchored in their templates and
chained along text and template; a chain that covers enough of a template is a span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Phrases whose places are counted, and public licence wording.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy,"
     " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
     " AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
     " as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
     " following conditions are met"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
     " disclaimer in the documentation and/or other materials provided with the distribution"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
# Shortest run that anchors, widest gap in a chain (words), and share of a template a span covers.
ANCHOR, GAP, COVERED = 3, 40, 0.6
# Bytes split into words at once.
SLICE = 4 << 20

_SEPARATED = bytes(
    32 if i <= 0x2F or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F else i for i in range(256)
)


def words(text: str) -> Iterator[list[bytes]]:
    """Words of a text in portions: runs of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    data = text.encode().lower().translate(_SEPARATED)
    start = 0
    while start < len(data):
        end = len(data) if len(data) - start <= SLICE else data.find(b" ", start + SLICE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


class Automaton:
    """Suffix automaton of several word sequences, with the places where its states end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].add((number, place + 1))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            ends[self.link[state]] |= ends[state]
        self.ends = [tuple(sorted(e)) for e in ends]

    def _state(self, size: int, link: int, following: dict[int, int], ends: list) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        ends.append(set())
        return len(self.size) - 1

    def _divided(self, state: int, word: int, ends: list) -> int:
        """The state of the longest run that ends in ``state``'s run plus ``word``, split off if it shares one."""
        target = self.next[state][word]
        if self.size[target] == self.size[state] + 1:
            return target
        part = self._state(self.size[state] + 1, self.link[target], dict(self.next[target]), ends)
        self.link[target] = part
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            return self._divided(last, word, ends)
        new = self._state(self.size[last] + 1, 0, {}, ends)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._divided(state, word, ends)
        return new

    def statistics(self, run: list[int]) -> Iterator[tuple[int, int]]:
        """Longest match ending at each word, and its state."""
        state = size = 0
        for word in run:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            yield size, state


@dataclass
class Span:
    label: str
    template: int
    start: int
    end: int
    covered: int
    reached: int


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        texts = [t for _, t in (*phrases, *templates)]
        split = [[w for part in words(t) for w in part] for t in texts]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for s in split for w in s}))}
        sequences = [[self.number[w] for w in s] for s in split]
        self.labels = [label for label, _ in (*phrases, *templates)]
        self.sizes = [len(s) for s in sequences]
        self.phrases = len(phrases)
        self.automaton = Automaton(sequences)
        # phrases that a state's longest run ends with: its own or those of the shorter runs it links to
        a = self.automaton
        self.phrase_ends: list[tuple[int, ...]] = [()] * len(a.size)
        for state in sorted(range(1, len(a.size)), key=a.size.__getitem__):
            own = tuple(t for t, end in a.ends[state] if t < self.phrases and end == self.sizes[t] == a.size[state])
            self.phrase_ends[state] = own + self.phrase_ends[a.link[state]]
        width = len(self.number) + 1
        self.follows = np.zeros((width, width), bool)
        for s in sequences:
            self.follows[s[:-1], s[1:]] = True

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[Span]]:
        """Word count, places of phrases ``(start, phrase)``, and spans of templates."""
        number = self.number.get
        parts = [np.fromiter((number(w, 0) for w in part), np.int32, len(part)) for part in words(text)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        if len(ids) < 2:
            return len(ids), [], []
        # a match of two or more words needs neighbours that some template has; elsewhere the
        # statistics are 0 or 1 and neither phrases nor anchors can lie there
        tied = np.concatenate(([False], self.follows[ids[:-1], ids[1:]], [False]))
        edges = np.flatnonzero(tied[1:] != tied[:-1])
        places: list[tuple[int, int]] = []
        open_: dict[int, Span] = {}
        done: list[Span] = []
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
            run = ids[first : last + 1].tolist()
            matches = [*self.automaton.statistics(run), (0, 0)]
            for i, (size, state) in enumerate(matches[:-1]):
                for phrase in self.phrase_ends[state]:
                    if size >= self.sizes[phrase]:
                        places.append((first + i + 1 - self.sizes[phrase], phrase))
                if size >= ANCHOR and matches[i + 1][0] <= size:
                    self._chain(open_, done, first + i + 1, size, state)
        done += open_.values()
        spans = [s for s in done if s.covered >= COVERED * self.sizes[s.template]]
        return len(ids), sorted(places), sorted(spans, key=lambda s: (s.start, s.end, s.template))

    def _chain(self, open_: dict[int, Span], done: list[Span], end: int, size: int, state: int) -> None:
        """Append an anchor to the open chain of each template it occurs in, or start a new one."""
        for template, reached in self.automaton.ends[state]:
            if template < self.phrases:
                continue
            span = open_.get(template)
            if span and end - size - span.end <= GAP and reached > span.reached and end > span.end:
                span.covered += min(size, reached - span.reached, end - span.end)
                span.end, span.reached = end, reached
                continue
            if span and reached == span.reached and end - size < span.end:
                continue
            if span:
                done.append(span)
            open_[template] = Span(self.labels[template], template, end - size, end, size, reached)


@lru_cache(maxsize=2)
def _scanner(phrases, templates) -> Scanner:
    return Scanner(phrases, templates)


def scan_licences(docs: DataFrame, id: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per input row: ``id, n_words, places, spans``.

    ``places`` are the phrases found, ``(start, label)`` with words counted from 0; ``spans`` the
    template spans ``(label, template, start, end, coverage)``, ``end`` exclusive. A null or empty
    text has no words and empty lists. Repeated rows come back as often as they went in; an empty
    table gives an empty table; other columns are ignored. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(f"`{id}`"), F.col(f"`{text}`"))
    kind = narrow.schema[0].dataType.simpleString()
    schema = (
        f"`{id}` {kind}, n_words bigint, places array<struct<start:bigint,label:string>>, "
        "spans array<struct<label:string,template:int,start:bigint,end:bigint,coverage:double>>"
    )
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    found = pa.list_(
        pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(phrases, templates)
        for batch in batches:
            counts, places, spans = [], [], []
            for value in batch.column(1):
                n, at, covered = scanner.scan(value.as_py() or "")
                counts.append(n)
                places.append([{"start": s, "label": scanner.labels[p]} for s, p in at])
                spans.append(
                    [
                        {"label": s.label, "template": s.template - scanner.phrases, "start": s.start, "end": s.end,
                         "coverage": s.covered / scanner.sizes[s.template]}
                        for s in covered
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, found)],
                [id, "n_words", "places", "spans"],
            )

    return narrow.mapInArrow(work, schema)


def licence_summary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` are the smallest
    and largest start (null without a place), the labels are distinct, sorted and comma-joined,
    ``score`` is the largest coverage of a template, 1 where a phrase stands, 0 without either.
    """
    scanned = scan_licences(docs, id, text)
    base, starts = F.array_distinct(F.col("places.label")), F.col("places.start")
    every = F.array_distinct(F.concat(F.col("places.label"), F.col("spans.label")))
    covered = F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))
    return scanned.select(
        F.col(f"`{id}`"),
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(every), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(covered).alias("score"),
    )
