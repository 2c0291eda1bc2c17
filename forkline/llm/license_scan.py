"""Licence scans: a paragraph classifier on sparse word n-grams, confirmed by comparison with templates."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, text_bytes

# Short notices of each licence family.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "This project is licensed under the terms of the BSD license."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "This project is licensed under the terms of the MIT license."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission of the publisher."],
}
FAMILIES = ["unknown", *TEMPLATES]
#: Documents whose paragraphs stand for the unknown class in training, at most; and those paragraphs.
BACKGROUND_DOCS, BACKGROUND_PARAGRAPHS = 400, 4000
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9\x80-\xff]+)*")


def words_of(paragraph: bytes) -> list[bytes]:
    return _WORD.findall(paragraph.lower())


def _grams(words: list[bytes]) -> set:
    return {*words, *zip(words, words[1:], strict=False)}


def _trigrams(words: list[bytes]) -> set:
    return set(zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else {tuple(words)} if words else set()


def similarity(paragraph: list[bytes], template: set) -> float:
    """The share of a template's word triples that a paragraph has."""
    return len(_trigrams(paragraph) & template) / max(1, len(template))


class Model:
    """Multinomial logistic regression over the n-grams seen in training; class 0 is unknown."""

    def __init__(self, background: list[list[bytes]], epochs: int = 60, rate: float = 0.5, penalty: float = 1e-4, false_alarms: float = 1e-3, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.templates = {f: [_trigrams(words_of(t.encode())) for t in texts] for f, texts in TEMPLATES.items()}
        filler = [w for p in background for w in p[:50]] or [b"text"]
        examples: list[tuple[int, list[bytes]]] = [(0, p) for p in background if p and not any(similarity(p, t) >= 0.5 for ts in self.templates.values() for t in ts)]
        examples.append((0, []))
        for k, (_, texts) in enumerate(TEMPLATES.items(), 1):
            for t in texts:
                words = words_of(t.encode())
                for copy in range(24):
                    kept = [w for w in words if copy < 4 or rng.random() > 0.05]
                    extra = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(0, 6)) if copy >= 4 else 0)]
                    examples.append((k, kept + extra if copy % 2 else extra + kept))
        held = np.arange(len(examples)) % 4 == 3
        names = sorted({g for (_, p), h in zip(examples, held, strict=True) if not h for g in _grams(p)}, key=repr)
        self.index = {g: i for i, g in enumerate(names)}
        rows = [self._row(p) for _, p in examples]
        y = np.array([k for k, _ in examples])
        self.w = np.zeros((len(names) + 1, len(FAMILIES)))
        at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)])
        cols = np.concatenate(rows)
        train = ~held[at]
        at, cols = at[train], cols[train]
        weight = 1 / np.bincount(y[~held], minlength=len(FAMILIES)).clip(1)
        weight = np.where(held, 0.0, weight[y]) / len(FAMILIES)
        step = np.ones_like(self.w)
        for _ in range(epochs):
            z = np.zeros((len(rows), len(FAMILIES)))
            np.add.at(z, at, self.w[cols])
            p = _softmax(z)
            p[np.arange(len(rows)), y] -= 1
            p *= weight[:, None]
            g = penalty * self.w
            np.add.at(g, cols, p[at])
            step += (100 * g) ** 2
            self.w -= rate * 100 * g / np.sqrt(step)
        # the unknown class is calibrated on examples that were left out: a family needs a probability that few of the background reach
        odd = [1 - self.probabilities(r)[0] for r, k, h in zip(rows, y, held, strict=True) if h and k == 0]
        self.threshold = float(min(0.99, max(0.5, np.quantile(odd, 1 - false_alarms) if odd else 0.5)))

    def _row(self, words: list[bytes]) -> np.ndarray:
        get = self.index.get
        found = [i for g in _grams(words) if (i := get(g)) is not None]
        return np.array([len(self.index), *found], np.int64)

    def probabilities(self, row: np.ndarray) -> np.ndarray:
        return _softmax(self.w[row].sum(0)[None])[0]

    def judge(self, words: list[bytes]) -> tuple[str, float, float]:
        """(family, probability, similarity with the family's best template)."""
        p = self.probabilities(self._row(words))
        k = int(p[1:].argmax()) + 1
        if 1 - p[0] < self.threshold:
            return "unknown", float(p[0]), 0.0
        return FAMILIES[k], float(p[k]), max(similarity(words, t) for t in self.templates[FAMILIES[k]])


#: A notice may be spread over so many times its template's words.
SPREAD = 1.5
_NOTICES = [(t, int(SPREAD * len(words_of(text.encode())))) for texts in TEMPLATES.values() for text in texts for t in [_trigrams(words_of(text.encode()))]]
_TRIPLES = frozenset().union(*[t for t, _ in _NOTICES])


def windows(words: list[bytes], least_similarity: float) -> list[tuple[int, int]]:
    """(start, end) of the places among `words` where `least_similarity` of a template's word triples are close together."""
    triples = list(zip(words, words[1:], words[2:], strict=False))
    if _TRIPLES.isdisjoint(triples):
        return []
    at = [(i, t) for i, t in enumerate(triples) if t in _TRIPLES]
    found = set()
    for template, most in _NOTICES:
        inside, held = deque(), Counter()
        for i, t in at:
            if t not in template:
                continue
            inside.append((i, t))
            held[t] += 1
            while i + 3 - inside[0][0] > most or held[inside[0][1]] > 1:
                old = inside.popleft()[1]
                held[old] -= 1
                if not held[old]:
                    del held[old]
            if len(held) >= least_similarity * len(template):
                found.add((inside[0][0], i + 3))
    return sorted(found)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame) -> Model:
    """Fit on the templates and on the paragraphs of BACKGROUND_DOCS documents at most, those first by a hash of their ids and texts."""
    sample = first_by_hash(docs.where("text is not null").select("doc_id", "text"), BACKGROUND_DOCS, "doc_id", "text").collect()
    paragraphs = [words_of(line.encode()) for r in sample for line in r.text.split("\n")]
    return Model([p for p in paragraphs if p][:BACKGROUND_PARAGRAPHS])


_HIT = pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])


def _hits(judge, lines: list[list[bytes]], least_similarity: float) -> list[dict]:
    """The hits of a run of lines, given as words; numbered from 0."""
    found = {}
    for i, words in enumerate(lines):
        family, probability, alike = judge(words)
        if family != "unknown":
            found[i, family] = {"paragraph": i, "family": family, "probability": probability, "similarity": alike, "confirmed": alike >= least_similarity}
    words = [w for line in lines for w in line]
    places = windows(words, least_similarity)
    if places:
        line_of = [i for i, line in enumerate(lines) for _ in line]
        judged = [(alike, end - start, start, family, probability) for start, end in places for family, probability, alike in [judge(words[start:end])] if family != "unknown" and alike >= least_similarity]
        taken = np.zeros(len(words), bool)
        # of windows that overlap, as those of GPL and LGPL do, the one that is most like a template counts
        for alike, size, start, family, probability in sorted(judged, key=lambda w: (-w[0], -w[1], w[2])):
            if taken[start : start + size].any():
                continue
            taken[start : start + size] = True
            over = range(line_of[start], line_of[start + size - 1] + 1)
            if any((i, family) in found and found[i, family]["confirmed"] for i in over):
                continue
            for i in over:
                found.pop((i, family), None)
            found[over[0], family] = {"paragraph": over[0], "family": family, "probability": probability, "similarity": alike, "confirmed": True}
    return list(found.values())


def scan(docs: DataFrame, model: Model | None = None, least_similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_paragraphs, families, hits): one row for each row of `docs` (doc_id, text, ...), from whole texts, without a shuffle.

    Paragraphs are the lines that are not blank. hits are the paragraphs that the classifier gives to a licence family
    (paragraph number, family, probability, similarity, confirmed); families are the distinct ones, sorted, that a
    template confirms: at least `least_similarity` of its word triples are in the paragraph. Notices that are wrapped
    over lines or stand within a long line are found too: in each run of lines without a blank one, every window of
    words with that share of a template's triples is classified and compared as a paragraph, numbered by its first
    line; single lines of it that the same family is only suspected in are part of it. Of windows
    that overlap, the one most like a template counts. A null or empty text has
    no paragraphs. Without documents to train on, templates alone are learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value.judge
        for batch in batches:
            n, families, hits = [], [], []
            for text in batch.column(1).to_pylist():
                found, run_of, total = {}, [], 0
                for line in [*text.split(b"\n"), b""]:
                    if line.strip():
                        run_of.append(words_of(line))
                        continue
                    if run_of:
                        for h in _hits(judge, run_of, least_similarity):
                            found[total + h["paragraph"], h["family"]] = h | {"paragraph": total + h["paragraph"]}
                        total += len(run_of)
                        run_of = []
                found = [found[k] for k in sorted(found)]
                n.append(total)
                hits.append(found)
                families.append(sorted({h["family"] for h in found if h["confirmed"]}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(families, pa.list_(pa.string())), pa.array(hits, pa.list_(_HIT))], ["doc_id", "n_paragraphs", "families", "hits"])

    schema = "doc_id long, n_paragraphs long, families array<string>, hits array<struct<paragraph: long, family: string, probability: double, similarity: double, confirmed: boolean>>"
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, schema)
