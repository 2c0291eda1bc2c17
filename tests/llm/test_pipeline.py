"""The corpus pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import re
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from forkline.llm import quality
    from forkline.llm.common import read_table, store

    from .test_operators import brute_jaccard_roots, brute_lines

    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    steps = [docs]
    for _, stage in pipeline.STAGES:
        steps.append(store(stage(spark, steps[-1], SF), "stage"))
    pairs = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in steps]
    assert all(s.columns == columns for s in steps[:-1])
    # rejected documents go
    good = {r.doc_id for r in quality.classify(docs, read_table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {i for i, _ in pairs[1]} == good and 0 < len(good) < len(pairs[0])
    labels = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    kept = [i in good for i in labels if labels[i] == 1]
    assert sum(kept) / len(kept) > 0.97
    # shared lines go
    assert Counter(pairs[2]) == Counter((w[0], w[4]) for w in brute_lines(pairs[1]))
    # one document of each group stays
    roots = brute_jaccard_roots([t for _, t in pairs[2]])
    least = {}
    for (i, _), r in zip(pairs[2], roots, strict=True):
        least[r] = min(i, least.get(r, i))
    assert sorted(i for i, _ in pairs[3]) == sorted(least.values())
    # documents with benchmark passages go
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for r in read_table(spark, SF, "benchmark").collect() if (w := split(r.text)) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = [(i, t) for i, t in pairs[3] if not any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in sizes for k in range(len(w) - n + 1))]
    assert Counter(pairs[4]) == Counter(clean)
    # the mix takes each document up to twice
    mixed = Counter(pairs[5])
    assert set(mixed) <= set(pairs[4]) and max(mixed.values()) <= 2
