"""License scan: a generalised suffix automaton of license tokens.

All templates and phrases go into one automaton over words. A text is streamed through it, which
gives at each word the longest stretch ending there that occurs in some template (the matching
statistics). Long stretches are placed in their template and chained in order into covered
spans; the covered share of the template is its score. Short fixed phrases (the base) are read
off the same stream: they are suffixes of the current match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import normal, prepare, utf8

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening sentences of well-known licenses and the notices that name them.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the Software), to deal in the Software without restriction, including without limitation the"
    " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
    " with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
    " Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
    " General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

MIN_MATCH = 6  # words of a stretch that counts as a template match
MIN_COVER = 0.6  # share of a template that has to be covered for its label
GAP = 8  # words of text that may lie between two stretches of one chain

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, spans array<struct<label:string,first:long,last:long,cover:double>>"
)


def words_of(text: str) -> list[bytes]:
    return normal(text.encode()).split()


@dataclass
class Automaton:
    """Suffix automaton of several token sequences; ``end`` is one (sequence, end) of a state."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else -1)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def add(self, tokens: list[int], sequence: int) -> None:
        last = 0
        for at, token in enumerate(tokens):
            last = self._extend(last, token)
            self.ends[last].add((sequence, at))

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            target = self.next[last][token]
            if self.length[target] == self.length[last] + 1:
                return target
            return self._split(last, target, token)
        new = self._state(self.length[last] + 1)
        p = last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            target = self.next[p][token]
            self.link[new] = target if self.length[target] == self.length[p] + 1 else self._split(p, target, token)
        return new

    def _split(self, p: int, target: int, token: int) -> int:
        copy = self._state(self.length[p] + 1, target)
        self.link[target] = copy
        while p != -1 and self.next[p].get(token) == target:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def finish(self) -> None:
        """Hand end places down the suffix links."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]


class Scanner:
    """Compiled templates and phrases; small and fixed, so it travels with the task."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]) -> None:
        self.labels = list(templates)
        sequences = [words_of(templates[k]) for k in self.labels]
        self.sizes = [len(s) for s in sequences]
        bases = [(words_of(p), label) for p, label in phrases.items()]
        vocabulary: dict[bytes, int] = {}
        for words in sequences + [w for w, _ in bases]:
            for w in words:
                vocabulary.setdefault(w, len(vocabulary))
        self.vocabulary = vocabulary
        self.automaton = automaton = Automaton()
        coded = [[vocabulary[w] for w in words] for words in sequences + [w for w, _ in bases]]
        for i, tokens in enumerate(coded):
            automaton.add(tokens, i)
        automaton.finish()
        # The phrases that end where a state is current, with their number of words.
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in automaton.next]
        for words, label in bases:
            at = 0
            for w in words:
                at = automaton.next[at][vocabulary[w]]
            self.phrases[at].append((len(words), label))
        for state in sorted(range(1, len(automaton.next)), key=lambda s: automaton.length[s]):
            self.phrases[state] = self.phrases[state] + self.phrases[automaton.link[state]]
        # Word pairs that occur in a sequence: a stretch of two or more words uses only these.
        v = len(vocabulary)
        self.pairs = np.zeros((v + 1) * (v + 1), bool)
        for tokens in coded:
            for x, y in zip(tokens, tokens[1:]):
                self.pairs[x * (v + 1) + y] = True
        self.single = any(len(w) == 1 for w, _ in bases)

    def stretches(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Maximal (start, end) runs of words whose neighbours form known pairs."""
        v = len(self.vocabulary)
        get = self.vocabulary.get
        ids = np.array([get(w, v) for w in words], np.int64)
        live = ids < v if self.single else self.pairs[ids[:-1] * (v + 1) + ids[1:]]
        edges = np.flatnonzero(np.diff(live, prepend=False, append=False))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            yield a, b + (not self.single)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Base places (start, label) and template spans (label, first, last, cover)."""
        places, found = [], []
        if len(words) < 2 and not self.single:
            return places, found
        a = self.automaton
        for first, last in self.stretches(words):
            state = length = 0
            peak: tuple[int, int, int] | None = None  # state, length and place of a growing match
            for at in range(first, last):
                token = self.vocabulary[words[at]]
                grown = True
                while state and token not in a.next[state]:
                    state = a.link[state]
                    length = a.length[state]
                    grown = False
                if token in a.next[state]:
                    state, length = a.next[state][token], length + 1
                else:
                    state = length = 0
                if peak and not grown:
                    found.append(peak)
                peak = (state, length, at) if length >= MIN_MATCH else None
                for size, label in self.phrases[state]:
                    if size <= length:
                        places.append((at - size + 1, label))
            if peak:
                found.append(peak)
        return places, self._chains(found)

    def _chains(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Join the stretches of a template that follow one another in text and template."""
        spans = []
        open_chains: dict[int, list[int]] = {}  # template -> first, last, place in template, covered words

        def close(template: int) -> None:
            first, last, _, covered = open_chains.pop(template)
            spans.append((self.labels[template], first, last, min(1.0, covered / self.sizes[template])))

        for state, length, at in found:
            for template in sorted({t for t, _ in self.automaton.ends[state] if t < len(self.labels)}):
                ends = sorted(e for t, e in self.automaton.ends[state] if t == template)
                chain = open_chains.get(template)
                if chain:
                    after = [e for e in ends if e > chain[2]]
                    if after and at - length + 1 - chain[1] <= GAP:
                        gain = min(length, after[0] - chain[2], at - chain[1])
                        open_chains[template] = [chain[0], at, after[0], chain[3] + gain]
                        continue
                    close(template)
                open_chains[template] = [at - length + 1, at, ends[0], length]
        for template in list(open_chains):
            close(template)
        return sorted(spans, key=lambda s: (s[1], s[0]))


def scan_licenses(
    documents: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES
) -> DataFrame:
    """Licenses named or quoted in each text: one row per row of ``documents`` (doc_id, text).

    ``n_base`` counts all places of the phrases; ``labels`` adds the templates of which
    ``MIN_COVER`` is covered by one chain. ``score`` is 1 if a phrase occurs, else the best cover.
    A NULL or empty text has no words and score 0; NULL or repeated doc_ids are kept as they are;
    an empty table gives an empty result. Other columns are not read.
    """
    prepare(documents.sparkSession)
    scanner = Scanner(templates, phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = normal(text).split()
                places, spans = scanner.scan(words)
                base = {label for _, label in places}
                named = base | {label for label, _, _, cover in spans if cover >= MIN_COVER}
                starts = [s for s, _ in places]
                rows.append(
                    {
                        "doc_id": doc_id,
                        "n_words": len(words),
                        "n_base": len(places),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(named)),
                        "score": 1.0 if places else max((c for *_, c in spans), default=0.0),
                        "spans": [{"label": t, "first": f, "last": e, "cover": c} for t, f, e, c in spans],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)


def brute_places(text: str | None, phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """Base places by comparing every position; for tests."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [
        (i, label)
        for phrase, label in phrases.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
