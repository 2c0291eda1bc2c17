"""Quality classifier: support vectors on n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, first_by_hash, text_bytes

#: Hashed n-grams; labelled rows that the model is fitted on, at most.
DIMENSIONS, SAMPLE = 1 << 18, 12_000
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
REMEMBERED_SHAPES = 100_000


class Shapes(dict):
    """Hash of a word's shape: letters and digits by kind, repeats pressed together."""

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(_RUNS.sub(rb"\1\1", word))
        if len(self) >= REMEMBERED_SHAPES:
            self.clear()
        self[word] = h
        return h


def features(text: bytes, shapes: Shapes) -> np.ndarray:
    """Indices of the n-grams in a text, each once: words, shapes, pairs and triples of shapes, runs of repeated words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    word = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    shape = np.fromiter(map(shapes.__getitem__, text.translate(_SHAPE).split()), np.uint64, n)
    pair = shape[1:] * np.uint64(1_000_003) + shape[:-1]
    triple = pair[1:] * np.uint64(1_000_003) + shape[:-2]
    same = (word[1:] == word[:-1]).astype(np.uint64)
    quad = same[3:] + 2 * same[2:-1] + 4 * same[1:-2] + 8 * same[:-3]
    kinds = (word * np.uint64(5), shape * np.uint64(5) + np.uint64(1), pair * np.uint64(5) + np.uint64(2), triple * np.uint64(5) + np.uint64(3), quad * np.uint64(5) + np.uint64(4))
    mixed = np.concatenate(kinds) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((mixed >> np.uint64(46)).astype(np.int64))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of each indicator's share among the rows of label 1 over its share among the others, smoothed."""
    p, q = (np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if bool(y) is side] or [np.zeros(0, np.int64)]), minlength=DIMENSIONS) + smoothing for side in (True, False))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 8, seed: int = 1) -> np.ndarray:
    """Weights (and a bias, last) that minimise |w|^2 / 2 + cost * sum of hinge losses, by dual coordinate descent.

    A row is its scaled indicators at unit length, and 1 for the bias; each label gets the same cost in all.
    """
    w, rng = np.zeros(DIMENSIONS + 1), np.random.default_rng(seed)
    sign = np.where(labels > 0, 1.0, -1.0)
    share = {s: cost * len(sign) / (2 * max(1, int((sign == s).sum()))) for s in (1.0, -1.0)}
    values = [scale[r] for r in rows]
    values = [v / max(np.linalg.norm(v), 1e-12) for v in values]
    norm = [float(v @ v) + 1 for v in values]
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v, y = rows[i], values[i], sign[i]
            gradient = y * (float(w[r] @ v) + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), share[y])
            if (move := (new - alpha[i]) * y) != 0:
                w[r] += move * v
                w[-1] += move
                alpha[i] = new
    return w


def _margin(row: np.ndarray, scale: np.ndarray, w: np.ndarray) -> float:
    v = scale[row]
    return float(w[row] @ v) / max(float(np.linalg.norm(v)), 1e-12) + float(w[-1])


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a m + b))), by Newton steps with a small penalty; a stays positive."""
    a, b = 1.0, 0.0
    n1 = labels.sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        s = p * (1 - p)
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b])
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def crc_mod(name: str = "doc_id", n: int = 5) -> Column:
    """crc32 of an id as text, mod n; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, y, f) of the whole sample -> one row with the model."""
    got = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("id", "y", "f")), strict=True)]
    got.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[2]))
    y, rows = np.array([r[1] for r in got]), [np.frombuffer(r[2], np.int32) for r in got]
    del got
    out = {"constant": [float(y.mean()) if len(y) else 0.5], "scale": [b""], "w": [b""], "a": [0.0], "b": [0.0]}
    if len(set(y.tolist())) == 2:
        held = np.arange(len(y)) % 5 == 0
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held[:] = False
        inner = [r for r, h in zip(rows, held, strict=True) if not h]
        scale = log_count_ratios(inner, y[~held])
        w = fit_hinge(inner, y[~held], scale)
        probe = held if held.any() else ~held
        a, b = fit_sigmoid(np.array([_margin(r, scale, w) for r, h in zip(rows, probe, strict=True) if h]), y[probe])
        out = {"constant": [None], "scale": [scale.astype(np.float32).tobytes()], "w": [w.astype(np.float32).tobytes()], "a": [a], "b": [b]}
    types = (pa.float64(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> dict:
    """Fit on `sample` labelled rows at most, in the order of a hash of doc_id, of those whose crc32(doc_id) mod 5 is not 0.

    The sample is bounded, so it is broadcast to the texts, and one task fits the model on its features; the driver
    reads the model alone. A fifth of the sample is left out of the support vectors and gives the sigmoid. Rows with null
    ids or labels other than 0 and 1 are not used; without rows of both labels the model is a constant, the share of
    label 1 (0.5 without rows).
    """
    usable = labels.where(f"doc_id is not null and {label} in (0, 1)").where(crc_mod() != 0).groupBy("doc_id").agg(F.min(label).alias("y"))
    chosen = first_by_hash(usable, sample, "doc_id").select(F.col("doc_id").alias("id"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            rows = [features(t, shapes).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "y", "f"])

    texts = docs.select("doc_id", text_bytes().alias("t")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select(F.col("id").cast("long"), F.col("y").cast("int"), "t")
    rows = texts.mapInArrow(run, "id long, y int, f binary")
    # documents that share an id could outnumber the sample; one row for each id stands for them
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.min("f").alias("f")).repartition(1)
    got = rows.mapInArrow(_fit, "constant double, scale binary, w binary, a double, b double").first()
    if got is None or got.constant is not None:
        return {"constant": 0.5 if got is None else got.constant}
    return {"scale": np.frombuffer(bytes(got.scale), np.float32), "w": np.frombuffer(bytes(got.w), np.float32), "a": got.a, "b": got.b}


def score(docs: DataFrame, model: dict, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """`docs` with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 if score >= threshold), from the whole text alone.

    A null or empty text is scored by its lack of features. Repeated rows get equal scores, an empty table an empty result.
    Columns of `docs` with the two new `names` are replaced, all others passed on. Without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = list(names)
    names = [c for c in docs.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shapes = shared.value, Shapes()
        for batch in batches:
            if "constant" in m:
                p = np.full(batch.num_rows, m["constant"])
            else:
                margins = np.array([_margin(features(t, shapes), m["scale"], m["w"]) for t in batch.column("__bytes").to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(m["a"] * margins + m["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], [*names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select([f"`{c}`" for c in names]).schema), f"`{new[0]}` double", f"`{new[1]}` int"])
    return docs.select(*(f"`{c}`" for c in names), text_bytes().alias("__bytes")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of `docs` (doc_id, text, ...); held_out rows (crc32(doc_id) mod 5 = 0) are never fitted on.

    Inputs of a score are words and word shapes of the text only. Other columns of `docs` are ignored, whatever their names;
    a null doc_id stays null and counts as the empty text in the remainder. See fit() and score() for nulls, repeated rows and missing labels.
    """
    model = fit(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod() == 0).alias("held_out"), "text")
    return score(rows, model, threshold).select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that are predicted to be of label 1, with all their own columns, `score` and `predicted` too if there are such; see fit() and score()."""
    model, own = fit(docs, labels, sample), ("__quality_score", "__quality")
    return apart(docs, lambda rows: score(rows, model, threshold, own).where("__quality = 1").select([f"`{c}`" for c in rows.columns]))
