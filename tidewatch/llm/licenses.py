"""License scans: fixed phrases, and templates with optional and replaceable regions compiled into token automata."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, batch, blobs

# fixed values: phrase -> label
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# [[...]] may be missing; {n} stands for up to n words of any kind; the rest is mandatory wording
TEMPLATES = {
    "gpl-notice": (
        "this [[work]] [[program]] [[file]] [[software]] is [[licensed]] [[released]] [[distributed]] under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2",
        "this [[work]] [[program]] [[file]] [[software]] is [[licensed]] [[released]] [[distributed]] under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {1} of the license or [[at your option]] any later version",
    ),
    "apache-notice": (
        "licensed under the apache license version 2 0 [[the license]]",
        "[[this {1} is]] [[released]] [[distributed]] under the [[terms of the]] apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0",
    ),
    "cc-by-nc-notice": ("[[this {1} is]] licensed under [[a]] [[the]] [[creative commons]] cc by nc [[sa]] [[nd]] [[version]] 4 0 [[international]]",),
    "cc-by-notice": ("[[this {1} is]] licensed under [[a]] [[the]] [[creative commons]] cc by [[sa]] [[nd]] [[version]] 4 0 [[international]]",),
    "mit-notice": ("[[this {1} is]] released under the [[terms of the]] mit license", "[[this {1} is]] licensed under the [[terms of the]] mit license"),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is"
        " furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software",
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain"
        " the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and"
        " the following disclaimer in the documentation and or other materials provided with the distribution [[3]] [[neither the name of {12} nor the names of its contributors may be used to endorse"
        " or promote products derived from this software without specific prior written permission]]",
    ),
    "mpl-notice": ("this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at {8}]]",),
    "lgpl-notice": ("under the terms of the gnu lesser general public license as published by the free software foundation either version {2} of the license or [[at your option]] any later version",),
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled"
        " binary for any purpose commercial or non commercial and by any means",
    ),
    "cc0-notice": ("to the extent possible under law {12} has waived all copyright and related or neighboring rights to {20}",),
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone"
        " to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ),
    "isc-text": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
}


class Automaton:
    """States 0..n over tokens. Each state has words that lead on, states reached for free, and words it may swallow."""

    def __init__(self, template: str):
        self.step: list[dict[bytes, int]] = [{}]
        self.free: list[set[int]] = [set()]
        self.any: list[int | None] = [None]
        open_: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", template):
            if part == "[[":
                open_.append(len(self.step) - 1)
            elif part == "]]":
                self.free[open_.pop()].add(len(self.step) - 1)
            elif part[0] == "{":
                first = len(self.step) - 1
                for _ in range(int(part[1:-1])):
                    here = len(self.step) - 1
                    self.any[here] = self._add()
                for s in range(first, len(self.step) - 1):
                    self.free[s].add(len(self.step) - 1)
            else:
                here = len(self.step) - 1
                self.step[here][part.encode()] = self._add()
        self.last = len(self.step) - 1

    def _add(self) -> int:
        self.step.append({})
        self.free.append(set())
        self.any.append(None)
        return len(self.step) - 1

    def reach(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def starts(self) -> set[bytes]:
        """The words that a text of this template can start with (an optional first region may swallow others)."""
        return {w for s in self.reach({0}) for w in self.step[s]}

    def accepts(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest match that starts at this word."""
        now, found = self.reach({0}), None
        while True:
            if self.last in now:
                found = at
            if at >= len(words) or not now:
                return found
            w = words[at]
            nxt = {self.step[s][w] for s in now if w in self.step[s]} | {self.any[s] for s in now if self.any[s] is not None}
            now, at = self.reach(nxt), at + 1


def cue_of(template: str) -> bytes:
    """The longest word of the mandatory wording, between spaces: texts without it are not walked. No such word: one space."""
    plain = re.sub(r"\[\[.*?\]\]|\{\d+\}", " ", template).split()
    return b" " + max(plain, key=len).encode() + b" " if plain else b" "


class Scanner:
    def __init__(self, templates: dict = TEMPLATES):
        self.by_start: dict[bytes, list[tuple[str, Automaton, bytes]]] = {}
        self.cues: set[bytes] = set()
        for label, texts in templates.items():
            for t in texts:
                a, cue = Automaton(t), cue_of(t)
                self.cues.add(cue)
                for w in a.starts():
                    self.by_start.setdefault(w, []).append((label, a, cue))

    def scan(self, data: bytes) -> dict:
        words = data.translate(ALNUM).split()
        text = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in PHRASES.items():
            p = b" " + phrase.encode() + b" "
            word, seen, at = 0, 0, text.find(p)
            while at >= 0:
                word, seen = word + text.count(b" ", seen, at), at
                places.append(word)
                labels.add(label)
                at = text.find(p, at + 1)
        found = set()
        cues = {c for c in self.cues if c in text}
        if cues:
            for i, w in enumerate(words):
                for label, a, cue in self.by_start.get(w, ()):
                    if cue in cues:
                        end = a.accepts(words, i)
                        if end is not None:
                            found.add((label, i, -end))
        spans, last = [], None
        for label, i, end in sorted(found):  # of one label by start, longest first: a span within one before it goes
            if last is None or last[0] != label or -end > last[1]:
                spans.append((i, -end, label))
                last = (label, -end)
        return {"n_words": len(words), "places": places, "base": labels, "spans": spans}


def license_labels(docs: DataFrame, templates: dict = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every document.

    score is 1 where the whole mandatory wording of a template stands, 0.5 for a phrase alone, 0 for neither. spans lists
    the words that templates match, as label:first:end, of spans within spans of one label the outer one. Null and empty texts
    have no words and no labels. Rows that repeat, in id or text, each get a row; other columns are not read; no documents, no rows.
    """

    def run(batches):
        scanner = Scanner(templates)
        for b in batches:
            got = [scanner.scan(x) for x in blobs(b.column(1))]
            every = [g["base"] | {s[2] for s in g["spans"]} for g in got]
            yield batch(
                doc_id=b.column(0), n_words=pa.array([g["n_words"] for g in got], pa.int64()), n_base=pa.array([len(g["places"]) for g in got], pa.int64()),
                first_word=pa.array([min(g["places"], default=None) for g in got], pa.int64()), last_word=pa.array([max(g["places"], default=None) for g in got], pa.int64()),
                base_labels=pa.array([",".join(sorted(g["base"])) for g in got], pa.string()), labels=pa.array([",".join(sorted(e)) for e in every], pa.string()),
                score=pa.array([1.0 if g["spans"] else 0.5 if g["base"] else 0.0 for g in got], pa.float64()), spans=pa.array([",".join(f"{l}:{a}:{z}" for a, z, l in sorted(set(g["spans"]))) for g in got], pa.string()),
            )

    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, kind)
