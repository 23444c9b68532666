"""Licence texts in documents by matching statistics over a generalised suffix automaton.

The automaton holds every run of words of every template. A document's words are streamed through it:
after each word it knows the longest run of words ending there that stands in some template, and, along
suffix links, the longest run at every place of every template. Long runs that the next word ends are
matches; those of one template whose ends in document and template both advance are chained, each to its
best predecessor. A chain's covered template words, relative to the template, are its cover. Short phrases are templates
of their own: a phrase occurs where its state is the current state or an ancestor on suffix links.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.llm.text import alnum_words, coded, map_text

# Phrases with their labels, and the opening or permission passages of public licences.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
              "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
              "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
              "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
           "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
           "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
           "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
           "conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
           "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: Words of a match that may enter a chain, words that may lie between two of a chain's matches,
#: and the covered share of a template from which its label is given.
MIN_MATCH, MAX_GAP, MIN_COVER = 5, 12, 0.5


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty run."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.code: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.names = list(templates)
        texts = [self._coded(t) for t in templates.values()]
        self.sizes = [len(t) for t in texts]
        self.phrases = [(self._coded(p), label) for p, label in phrases.items()]
        for words in [*texts, *(p for p, _ in self.phrases)]:
            last = 0
            for c in words:
                last = self._extend(last, c)
        n = len(self.next)
        deep = sorted(range(1, n), key=self.len.__getitem__)
        #: by state: (longest run, template, last word, word after it or 0) for every place whose longest
        #: common run with the state ends there, of at least ``MIN_MATCH`` words, nearest state first
        self.places: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
        for k, words in enumerate(texts):
            at = 0
            for i, c in enumerate(words):
                at = self.next[at][c]
                s, after = at, words[i + 1] if i + 1 < len(words) else 0
                while self.len[s] >= MIN_MATCH:
                    self.places[s].append((self.len[s], k, i, after))
                    s = self.link[s]
        for s in deep:
            own = {(k, i) for _, k, i, _ in self.places[s]}
            self.places[s] += [p for p in self.places[self.link[s]] if (p[1], p[2]) not in own]
        #: by state: phrases that end every run of the state's longest length
        self.ends: list[list[int]] = [[] for _ in range(n)]
        for p, (words, _) in enumerate(self.phrases):
            at = 0
            for c in words:
                at = self.next[at][c]
            self.ends[at].append(p)
        for s in deep:
            self.ends[s] = [*self.ends[s], *self.ends[self.link[s]]]

    def _coded(self, text: str) -> list[int]:
        return [self.code.setdefault(w, len(self.code) + 1) for w in alnum_words(text.encode())]

    def _new(self, length: int, follow: dict, link: int) -> int:
        self.next.append(dict(follow))
        self.len.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the shorter runs that reach it from p."""
        copy = self._new(self.len[p] + 1, self.next[q], self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.len[known] == self.len[last] + 1 else self._split(last, c, known)
        fresh = self._new(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = fresh
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[fresh] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return fresh

    def stream(self, codes, offset: int, phrase, match=None, ended=None) -> None:
        """``phrase(p, start)`` for every phrase place, ``match(end, length, state)`` for every maximal
        match of at least ``MIN_MATCH`` words (end exclusive), ``ended(end, length, template, last)`` for every
        place of a template (its last word) up to which at least ``MIN_MATCH`` words agree and no further one."""
        state = length = 0
        follow, link, size, ends, phrases = self.next, self.link, self.len, self.ends, self.phrases
        places, n = self.places, len(codes)
        for j, c in enumerate(codes):
            i = offset + j
            before, held = state, length
            while state and c not in follow[state]:
                state = link[state]
                length = size[state]
            if c in follow[state]:
                state = follow[state][c]
                length += 1
            if match and held >= MIN_MATCH and length <= held:
                match(i, held, before)
            if ended and length >= MIN_MATCH:
                coming = codes[j + 1] if j + 1 < n else -1
                for run, k, last, after in places[state]:
                    if after != coming:
                        ended(i + 1, min(run, length), k, last)
            for p in ends[state]:
                m = len(phrases[p][0])
                if length >= m:
                    phrase(p, i - m + 1)
        if match and length >= MIN_MATCH:
            match(offset + n, length, state)


def best_chain(matches: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(covered template words, document start, document end) of the best chain of one template's matches
    (document end, length, last template word), which are in order of their document ends.

    A match follows any other whose ends in document and template both lie before its own, if it starts
    at most ``MAX_GAP`` words after that one's end; words that overlap in either count once. Equal covers:
    the shortest in the document, of these the middle one.
    """
    held: list[tuple[int, int]] = []  # covered words and document start of the best chain up to each match
    for j, (end, length, last) in enumerate(matches):
        best = (length, end - length)
        i = j - 1
        while i >= 0 and matches[i][0] >= end - length - MAX_GAP:
            fresh = min(length, last - matches[i][2], end - matches[i][0])
            if fresh > 0:
                best = max(best, (held[i][0] + fresh, held[i][1]))
            i -= 1
        held.append(best)
    top = max((c, start - m[0]) for (c, start), m in zip(held, matches))
    tied = [(c, start, m[0]) for (c, start), m in zip(held, matches) if (c, start - m[0]) == top]
    return tied[len(tied) // 2]


def chained(matches: list[tuple[int, int, int]], size: int) -> tuple[float, list[tuple[float, int, int]]]:
    """The best cover of a template of ``size`` words, and all spans (cover, document start, document end) by
    start: the best chain, then the best ones of what stands wholly before and wholly after it, and so on,
    as long as they cover at least ``MIN_COVER``."""
    spans, highest, open_ = [], 0.0, [sorted(matches)]
    while open_:
        part = open_.pop()
        if not part:
            continue
        covered, start, end = best_chain(part)
        highest = max(highest, covered / size)
        if covered >= MIN_COVER * size:
            spans.append((covered / size, start, end))
            open_.append([m for m in part if m[0] <= start])
            open_.append([m for m in part if m[0] - m[1] >= end])
    return highest, sorted(spans, key=lambda s: s[1])


@cache
def standard() -> Automaton:
    return Automaton(TEMPLATES, PHRASES)


def scan(docs: DataFrame, text_col: str, keep: list[str], automaton=standard) -> DataFrame:
    """``keep`` and (n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. The base columns
    count the phrases' places (all of them) and their smallest and largest start, null without any.
    ``spans`` lists, per template, all separate chains that cover at least ``MIN_COVER`` of it; ``labels``
    adds those templates to the phrases' labels; ``score`` is 1 with a phrase, else the best cover.
    Null and empty texts have no words, no labels and score 0. Repeated rows repeat their result.
    """
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])

    def run(texts):
        auto = automaton()
        words = [alnum_words(t or b"") for t in texts]
        codes, distinct, offsets = coded(words)
        known = pa.array([auto.code.get(w, 0) for w in distinct], pa.int64()).to_numpy(zero_copy_only=False)
        codes = known[codes] if len(codes) else codes
        out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for a, b in zip(offsets[:-1], offsets[1:]):
            starts, base, matches = [], set(), {}

            def phrase(p, start):
                starts.append(start)
                base.add(auto.phrases[p][1])

            def ended(end, length, k, last):
                matches.setdefault(k, []).append((end, length, last))

            for lo, hi in _runs(codes[a:b]):
                auto.stream(codes[a + lo:a + hi].tolist(), lo, phrase, ended=ended)
            best = {auto.names[k]: chained(m, auto.sizes[k]) for k, m in matches.items()}
            spans = [{"label": k, "start": s, "end": e, "cover": round(c, 6)} for k, (_, each) in sorted(best.items()) for c, s, e in each]
            out["n_words"].append(int(b - a))
            out["n_base"].append(len(starts))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {s["label"] for s in spans})))
            out["score"].append(1.0 if starts else round(max((c for c, _ in best.values()), default=0.0), 6))
            out["spans"].append(spans)
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}
        return {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}

    return map_text(docs, text_col, run, "n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                    "base_labels string, labels string, score double, "
                    "spans array<struct<label: string, start: bigint, end: bigint, cover: double>>", keep)


def _runs(codes):
    """(start, end) of runs of two and more template words: elsewhere no match is longer than a word."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).astype(np.int8), [0]))))
    return [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2]) if e - s > 1]
