"""Licence scans: matching statistics of uploads against one automaton over licence texts.

A generalised suffix automaton holds every phrase and template as a sequence of word numbers. An upload is streamed through it
once, which gives at each word the longest match that ends there. Whole phrases are found on the way; maximal long
matches are chained, in the order of text and template, into the spans a template covers.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

from movara.llm.common import WORD, map_content, words

#: Phrases that name a licence by themselves, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Public licence texts and notices, with the labels that their coverage gives.
TEMPLATES = (
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ),
    (
        "apache-2-notice",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    ),
    (
        "bsd-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    ),
    (
        "gpl-notice",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    (
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "mpl-2-notice",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("cc-by-4-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense-text", "This is free and unencumbered software released into the public domain"),
    ("proprietary-notice", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted"),
)

#: Words of a match that is chained, words that may lie between two matches of a chain, covered share that names a template.
LONG = 4
GAP = 40
COVERED = 0.75


class SuffixAutomaton:
    """All substrings of several sequences, with where in which sequence each state's substrings end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].append((number, place + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]].extend(self.ends[state])
        self.ends[0] = []

    def _state(self, length: int, out: dict[int, int], link: int) -> int:
        self.next.append(out)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, token: int, target: int) -> int:
        """A state for the target's substrings no longer than the state's, plus the token."""
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if (target := self.next[last].get(token)) is not None:  # a later sequence repeats an earlier one's start
            return target if self.length[target] == self.length[last] + 1 else self._split(last, token, target)
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][token]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, token, target)
        return new


class Library:
    """The automaton, its vocabulary, and the phrases that end at each state."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(words(p.encode()), label) for p, label in phrases]
        texts = [p for p, _ in self.phrases] + [words(t.encode()) for _, t in templates]
        self.labels = [label for _, label in self.phrases] + [label for label, _ in templates]
        self.sizes = [len(t) for t in texts]
        self.vocabulary: dict[bytes, int] = {}
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t] for t in texts]
        self.automaton = SuffixAutomaton(sequences)
        self.shortest = min(LONG, *self.sizes)
        whole = range(len(self.phrases))
        self.whole = [
            [n for n, end in ends if n in whole and end == self.sizes[n] == length]
            for ends, length in zip(self.automaton.ends, self.automaton.length, strict=True)
        ]
        for state in sorted(range(1, len(self.whole)), key=self.automaton.length.__getitem__):
            # a phrase also ends where a longer match ends with it
            self.whole[state] = sorted({*self.whole[state], *self.whole[self.automaton.link[state]]})

    def stream(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrases as (start, number), and maximal long matches as (start, end, state)."""
        found, long = [], []
        numbers = np.fromiter(map(self.vocabulary.get, tokens, repeat(0)), np.int64, len(tokens))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], numbers > 0, [0])).astype(np.int8)))
        for start, end in edges.reshape(-1, 2):  # runs of known words; no match holds another word
            if end - start >= self.shortest:
                self._run(numbers[start:end].tolist(), int(start), found, long)
        return found, long

    def _run(self, run: list[int], first: int, found: list, long: list) -> None:
        machine, state, matched = self.automaton, 0, 0
        for at, token in enumerate(run):
            before, length = state, matched
            while state and token not in machine.next[state]:
                state = machine.link[state]
                matched = machine.length[state]
            state = machine.next[state].get(token, 0)
            matched = matched + 1 if state else 0
            if length >= LONG and matched <= length:  # the match that ended at the word before went no further
                long.append((first + at - length, first + at, before))
            for n in self.whole[state]:
                if self.sizes[n] <= matched:
                    found.append((first + at + 1 - self.sizes[n], n))
        if matched >= LONG:
            long.append((first + len(run) - matched, first + len(run), state))

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, word after the last, covered template words) of every chain."""
        open_chains: dict[int, list[int]] = {}
        done = []
        for start, end, state in matches:
            places: dict[int, list[int]] = {}
            for number, place in self.automaton.ends[state]:
                if number >= len(self.phrases):
                    places.setdefault(number, []).append(place)
            for number, ends in places.items():
                size, chain = end - start, open_chains.get(number)
                if chain and start - chain[1] <= GAP:
                    fits = [e for e in ends if e > chain[3]]
                    if fits:
                        reach = min(fits)
                        chain[2] += min(size, reach - chain[3])
                        chain[1], chain[3] = end, reach
                        continue
                if chain:
                    done.append((number, chain[0], chain[1], chain[2]))
                open_chains[number] = [start, end, size, min(ends)]
        return done + [(n, c[0], c[1], c[2]) for n, c in open_chains.items()]

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """Phrases (start, number), and licence spans (label, first word, word after the last, covered share)."""
        found, long = self.stream(tokens) if len(tokens) >= self.shortest else ([], [])
        spans = [(self.labels[n], start, start + self.sizes[n], 1.0) for start, n in found]
        covered = [(self.labels[n], a, b, min(1.0, size / self.sizes[n])) for n, a, b, size in self.chains(long)]
        return found, sorted(spans + [c for c in covered if c[3] >= COVERED])


def scan_licences(uploads: DataFrame, carry: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Licences that each upload states or contains.

    ``uploads``: ``content`` and the ``carry`` columns. Returns the carried columns, ``n_words``, ``phrases`` (``start`` in
    words from 0, ``label``; every place where a phrase's words stand together), ``licences`` (``label``, ``start``, ``end`` by
    code points, ``covered`` share of the template) and ``score``, the largest share.

    A missing or empty text has no words, no licences and the score 0; rows are scanned by themselves, so repeated
    rows repeat their result.
    """

    def start():
        library = Library()

        def step(contents: list) -> dict[str, list]:
            made = {"n_words": [], "phrases": [], "licences": [], "score": []}
            for content in contents:
                tokens = words(content)
                found, spans = library.scan(tokens)
                at = [m.span() for m in WORD.finditer(content.decode("utf-8", "replace"))] if spans else []
                made["n_words"].append(len(tokens))
                made["phrases"].append([{"start": s, "label": library.labels[n]} for s, n in sorted(found)])
                made["licences"].append(
                    [{"label": n, "start": at[a][0], "end": at[b - 1][1], "covered": c} for n, a, b, c in spans]
                )
                made["score"].append(max((c for *_, c in spans), default=0.0))
            return made

        return step

    fields = (
        "n_words long, phrases array<struct<start: long, label: string>>, "
        "licences array<struct<label: string, start: long, end: long, covered: double>>, score double"
    )
    return map_content(uploads, carry, fields, start)
