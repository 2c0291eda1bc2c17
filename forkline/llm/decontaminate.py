"""Benchmark decontamination: an FM-index for each shard of the training texts, searched for all windows of the benchmark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, store, text_bytes
from .fm_index import FMIndex

#: A shard is closed at so many words. A benchmark is searched in blocks of about so many words; so many blocks at most are broadcast at once.
SHARD_WORDS, BLOCK_WORDS, BLOCKS_AT_ONCE = 3_000_000, 400_000, 8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_NEW = ("n_words", "n_hit", "items", "spans")
_TYPES = ("long", "long", "array<string>", "array<struct<start: long, stop: long>>")
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits and all beyond ASCII."""
    return text.translate(_LOWER).split()


class Phrases:
    """The windows of some benchmark items, over the symbols 1, 2, ... of their words."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.symbols: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.items = list(windows.values())
        self.least = min(map(len, windows), default=0)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(windows):
            by_length.setdefault(len(w), []).append(i)
        keys = list(windows)
        self.groups = [(n, np.array(at), np.array([keys[i] for i in at], np.int64)) for n, at in by_length.items()]

    def search(self, docs: list[list[bytes]]) -> tuple[np.ndarray, list[set[str]]]:
        """Of some documents laid end to end with a gap after each: which words are inside an occurrence, and the items found in each."""
        sizes = np.array([len(d) + 1 for d in docs])
        get = self.symbols.get
        ids = np.zeros(int(sizes.sum()), np.int32)
        at = 0
        for d, n in zip(docs, sizes.tolist(), strict=True):
            ids[at : at + n - 1] = [get(w, 0) for w in d]
            at += n
        hit, found = np.zeros(len(ids), bool), [set() for _ in docs]
        if not self.groups:
            return hit, found
        # words of no item break the text; what is left between two breaks is indexed if a window fits in it
        known = ids > 0
        edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        fits = stop - start >= self.least
        step = np.bincount(start[fits], minlength=len(ids) + 1) - np.bincount(stop[fits] + 1, minlength=len(ids) + 2)[: len(ids) + 1]
        place = np.flatnonzero(np.cumsum(step[: len(ids)]))  # with the break after each
        if not len(place):
            return hit, found
        index = FMIndex(ids[place], len(self.symbols) + 1)
        delta, pairs, owner = np.zeros(len(ids) + 1, np.int64), [], np.repeat(np.arange(len(docs)), sizes)
        for length, window, patterns in self.groups:
            lo, hi = index.ranges(patterns)
            some = np.flatnonzero(hi > lo)
            n = hi[some] - lo[some]
            rows = np.repeat(lo[some] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            begin = place[index.locate(rows)]
            delta += np.bincount(begin, minlength=len(delta)) - np.bincount(begin + length, minlength=len(delta))
            pairs.append(np.unique(owner[begin] * len(self.items) + np.repeat(window[some], n)))
        for doc, w in (divmod(x, len(self.items)) for x in np.concatenate(pairs).tolist()):
            found[doc] |= self.items[w]
        return np.cumsum(delta)[:-1] > 0, found


def _rounds(benchmark: DataFrame, width: int) -> Iterator[list]:
    """The benchmark as lists of broadcast variables, whose number and size are bounded."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / 6 / BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    context = benchmark.sparkSession.sparkContext
    for at in range(0, n, BLOCKS_AT_ONCE):
        yield [context.broadcast(Phrases([(r.item, bytes(r.text)) for r in items.where(block == k).collect()], width)) for k in range(at, min(n, at + BLOCKS_AT_ONCE))]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, width: int = 10, names: tuple[str, str, str, str] = _NEW) -> DataFrame:
    """`docs` (doc_id, text, ...) with n_words, n_hit, items (sorted item_ids found) and spans (merged [start, stop) word positions to remove).

    Words are runs of ASCII letters and digits (lower-cased) and of all characters beyond ASCII. A window is `width`
    consecutive words of an item (an item of fewer words, but not none, is one window); a word inside any occurrence
    is hit. A null or empty text has no words, a null item_id counts as the empty string, items that share an id are one.
    Repeated rows each get their result, an empty table an empty one. Columns of `docs` with the four new `names` are
    replaced, all others passed on. No shuffle: a shard is what a task reads, up to SHARD_WORDS words at a time.
    A benchmark of more than BLOCKS_AT_ONCE blocks takes further rounds over the texts, each added to the one before as a stored table.
    """
    rows, before = docs, False
    for blocks in _rounds(benchmark, width):
        if before:
            rows = store(rows, "overlaps")
        rows, before = _search(rows, blocks, names, before), True
    return rows


def _search(docs: DataFrame, blocks: list, new: tuple[str, ...], before: bool) -> DataFrame:
    """One round over the texts; `before`: the rows hold the results of earlier ones, to be added to."""
    names = [c for c in docs.columns if c not in new]
    held_names = [*names, *(new if before else ())]

    def close(batches: list[pa.RecordBatch], texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for t in texts])
        hit, found = np.zeros(int(sizes.sum()) + len(texts), bool), [set() for _ in texts]
        for block in blocks:
            h, more = block.value.search(texts)
            hit |= h
            found = [a | b for a, b in zip(found, more, strict=True)]
        base = np.cumsum(sizes + 1) - sizes - 1
        if before:
            earlier = [[x for b in batches for x in b.column(c).to_pylist()] for c in new[2:]]
            for i, (items, spans, at) in enumerate(zip(*earlier, base.tolist(), strict=True)):
                found[i].update(items)
                for s in spans:
                    hit[at + s["start"] : at + s["stop"]] = True
        n_hit = np.add.reduceat(hit, base, dtype=np.int64)
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        owner = np.searchsorted(base, edge[::2], "right") - 1
        spans: list[list[dict]] = [[] for _ in texts]
        for o, a, b in zip(owner.tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            spans[o].append({"start": a - int(base[o]), "stop": b - int(base[o])})
        at = 0
        for batch in batches:
            part = slice(at, at := at + batch.num_rows)
            made = [pa.array(sizes[part], pa.int64()), pa.array(n_hit[part], pa.int64()), pa.array([sorted(f) for f in found[part]], pa.list_(pa.string())), pa.array(spans[part], pa.list_(_SPAN))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                held.append(part.select(held_names))
                words = [words_of(t) for t in part.column("__bytes").to_pylist()]
                texts += words
                n += sum(map(len, words))
                if n >= SHARD_WORDS:
                    yield from close(held, texts)
                    held, texts, n = [], [], 0
        if texts:
            yield from close(held, texts)

    own = docs.select([f"`{c}`" for c in names]).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), *(f"`{c}` {t}" for c, t in zip(new, _TYPES, strict=True))])
    return docs.select(*(f"`{c}`" for c in held_names), text_bytes().alias("__bytes")).mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): one row for each row of `docs`; see find_overlaps()."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_overlaps(slim, benchmark, width)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of `docs` in which no benchmark window occurs, with all their own columns, n_words, n_hit, items and spans too if there are such; see find_overlaps()."""
    own = ("__n_words", "__n_hit", "__items", "__spans")
    return apart(docs, lambda rows: find_overlaps(rows, benchmark, width, own).where("__n_hit = 0").select([f"`{c}`" for c in rows.columns]))
