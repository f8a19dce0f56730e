"""License scans with a generalised suffix automaton over the words of license templates.

The automaton holds every run of words of every template. A file's words are fed
through it once; after each word it knows the longest run ending there that is part
of some template (the matching statistics). From them come

* the places of the base phrases: a phrase ends where the automaton stands in or
  below the phrase's own state with a run at least as long as the phrase;
* maximal matches of at least ``min_match`` words, which are chained per template, in
  the order of both file and template, into spans; a span's coverage is the share of
  the template's words that its matches hold.

A span with coverage ``min_coverage`` or more gives its template's label; the score of
a file is its best coverage, and 1 where a base phrase stands. The templates are the
fixed texts below, short notices as they are written into files, so the automaton is
of constant size. Null, empty and wordless texts match nothing and score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import alnum_words, bounded_batches, bytes_of

MIN_MATCH = 4
MIN_COVERAGE = 0.6
MAX_GAP = 12

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of widespread licenses, as (label, text).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


class SuffixAutomaton:
    """Of several word sequences; state 0 is the empty run."""

    def __init__(self, sequences: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word)

    def _state(self, length: int, following: dict, link: int) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word, below: int) -> int:
        """The state of the runs that ``state`` extends by ``word``, made one of its own if longer runs share it."""
        if self.length[below] == self.length[state] + 1:
            return below
        part = self._state(self.length[state] + 1, dict(self.next[below]), self.link[below])
        self.link[below] = part
        while state >= 0 and self.next[state].get(word) == below:
            self.next[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def find(self, words: list) -> int:
        state = 0
        for w in words:
            state = self.next[state][w]
        return state

    def step(self, state: int, length: int, word) -> tuple[int, int]:
        """State and length of the longest run after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        state = self.next[state].get(word)
        return (0, 0) if state is None else (state, length + 1)


class Scanner:
    def __init__(self, templates=None, phrases=None, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE):
        templates = TEMPLATES if templates is None else templates
        phrases = PHRASES if phrases is None else phrases
        self.min_match, self.min_coverage = min_match, min_coverage
        self.labels = [label for label, _ in templates]
        self.words = [alnum_words(text.encode()) for _, text in templates]
        base = [(alnum_words(p.encode()), label) for p, label in phrases.items()]
        self.automaton = a = SuffixAutomaton(self.words + [p for p, _ in base])
        marks = {}
        for words, label in base:
            marks.setdefault(a.find(words), []).append((len(words), label))
        # phrases that are ends of a state's runs
        self.ends: list[list] = [[] for _ in a.link]
        for state in sorted(range(len(a.link)), key=a.length.__getitem__):
            if state:
                self.ends[state] = marks.get(state, []) + self.ends[a.link[state]]
        # where a state's runs end: (sequence, place) of their last words
        self.places: list[list[tuple[int, int]]] = [[] for _ in a.link]
        for number, words in enumerate(self.words + [p for p, _ in base]):
            for place in range(len(words)):
                self.places[a.find(words[:place + 1])].append((number, place))
        for state in sorted(range(1, len(a.link)), key=a.length.__getitem__, reverse=True):
            self.places[a.link[state]] += self.places[state]
        self.places[0] = []
        self.known = {w for s in self.words + [p for p, _ in base] for w in s}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Places of phrases as (first word, label), and spans as (first, last, label, coverage)."""
        a, known = self.automaton, self.known
        phrases, matches = [], []
        state = length = 0
        for i, word in enumerate(words):
            if word not in known:
                if length >= self.min_match:
                    matches.append((i - length, length, state))
                state = length = 0
                continue
            before, run = state, length
            state, length = a.step(state, length, word)
            if length <= run and run >= self.min_match:
                matches.append((i - run, run, before))
            for size, label in self.ends[state]:
                if length >= size:
                    phrases.append((i - size + 1, label))
        if length >= self.min_match:
            matches.append((len(words) - length, length, state))
        return phrases, self.chained(matches) if matches else []

    def chained(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Chains of matches that go forward in file and template; a long gap or a step back starts a new one."""
        best: dict[tuple[str, int], tuple[int, int, str, float]] = {}
        open_: dict[int, list[tuple[int, int, int]]] = {}

        def close(number: int) -> None:
            chain = open_.pop(number, [])
            covered = sum(n for _, _, n in chain) / len(self.words[number])
            if chain and covered >= self.min_coverage:
                found = (chain[0][0], chain[-1][0] + chain[-1][2] - 1, self.labels[number], covered)
                key = (found[2], found[0])
                if key not in best or best[key][3] < covered:
                    best[key] = found

        for first, size, state in matches:
            starts: dict[int, list[int]] = {}
            for number, end in self.places[state]:
                if number < len(self.labels):
                    starts.setdefault(number, []).append(end - size + 1)
            for number, places in starts.items():
                if number in open_:
                    at, place, n = open_[number][-1]
                    over = max(0, at + n - first)
                    onward = [p for p in places if p + over >= place + n]
                    if onward and first - (at + n) <= MAX_GAP and over < size:
                        open_[number].append((first + over, min(onward) + over, size - over))
                        continue
                    close(number)
                open_[number] = [(first, min(places), size)]
        for number in list(open_):
            close(number)
        return sorted(best.values())


def scanned(text: str, templates=None, phrases=None, **limits) -> Column:
    """Struct of n_words, places and labels of phrases, and firsts, lasts, names and coverages of spans."""
    kind = ("n_words bigint, places array<bigint>, labels array<string>, "
            "firsts array<bigint>, lasts array<bigint>, names array<string>, coverages array<double>")

    @F.pandas_udf(kind)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, phrases, **limits)
        for batch in batches:
            rows = []
            for data in batch:
                words = alnum_words(data)
                found, spans = scanner.scan(words)
                rows.append((len(words), [p for p, _ in found], [x for _, x in found], *([x[k] for x in spans] for k in range(4))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return scan(bytes_of(text))


def scan_licenses(docs: DataFrame, text: str = "text", into: str = "licenses", **options) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, phrases (first, label), spans (first, last, label, coverage), score.

    Words count from 0. ``score`` is the best coverage of a span, 1 where a phrase stands, else 0.
    """
    bounded_batches(docs.sparkSession)
    raw = docs.withColumn(into, scanned(text, **options))
    c = lambda name: F.col(f"{into}.{name}")
    score = F.when(F.size(c("places")) > 0, 1.0).otherwise(F.coalesce(F.array_max(c("coverages")), F.lit(0.0)))
    return raw.withColumn(into, F.struct(
        c("n_words").alias("n_words"),
        F.arrays_zip(c("places").alias("first"), c("labels").alias("label")).alias("phrases"),
        F.arrays_zip(c("firsts").alias("first"), c("lasts").alias("last"), c("names").alias("label"),
                     c("coverages").alias("coverage")).alias("spans"),
        score.alias("score")))
