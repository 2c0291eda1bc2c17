"""Line dedup: lines that many documents share stay in one document only.

Keys of all long lines are range-partitioned by hash with documents and positions as secondary order, read as a
stream, and turned into the lines to drop; what comes back is a compressed keep bitmap for each document, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, apart, id_or_none, partitions, store, text_bytes

_WS = SPACES.encode()
_HASH = np.dtype([("hi", ">i8"), ("lo", ">i8")])


def _key(line: bytes, least: int) -> bytes | None:
    """A line's key, or None if it has fewer than `least` code points."""
    if len(line) < least:
        return None
    key = line.strip(_WS).lower()
    if len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least:
        return key
    return None


def _copy() -> Column:
    """Tells apart the texts of rows that share a doc_id; equal texts lose the same lines."""
    return F.xxhash64(text_bytes())


def _line_keys(docs: DataFrame, least: int) -> DataFrame:
    """(hi, lo, doc, copy, pos): the 128-bit hash of each long line's key, and where the line is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids, copies, places = [], [], [], []
            for doc, copy, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = [(pos, key) for pos, line in enumerate(text.split(b"\n")) if (key := _key(line, least)) is not None]
                digests += [xxhash.xxh3_128_digest(key) for _, key in found]
                places += [pos for pos, _ in found]
                ids += [doc] * len(found)
                copies += [copy] * len(found)
            h = np.frombuffer(b"".join(digests), _HASH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h["hi"].astype("i8")), pa.array(h["lo"].astype("i8")), pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array(places, pa.int32())],
                ["hi", "lo", "doc", "copy", "pos"],
            )

    return docs.select(id_or_none(), _copy(), text_bytes()).mapInArrow(run, "hi long, lo long, doc long, copy long, pos int")


def _stream(min_docs: int):
    """Read one range of sorted keys; yields rows (kind, hi, lo, doc, copy, pos, n).

    kind 0: drop this line of this document. A key whose run touches the range's edge may go on in the next
    range: kind 1 are its lines that can't be decided here, kind 2 its distinct documents and the largest.
    The lines of at most `min_docs` documents are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = top = last = None
        n, held, first = 0, [], True

        def end(edge: bool) -> None:
            if key is not None and edge:
                out.extend((1, *key, *line, 0) for line in held)
                out.append((2, *key, top, 0, 0, n))

        for batch in batches:
            for hi, lo, doc, copy, pos in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key is None or hi != key[0] or lo != key[1]:
                    if key is not None:
                        end(first)
                        first = False
                    key, top, last, n, held = (hi, lo), doc, None, 0, []
                if doc != last:
                    last, n = doc, n + 1
                if first:
                    out.append((1, hi, lo, doc, copy, pos, 0))
                elif n < min_docs:
                    held.append((doc, copy, pos))
                else:
                    out.extend((0, hi, lo, *line, 0) for line in held if line[0] != top)
                    if doc != top:
                        out.append((0, hi, lo, doc, copy, pos, 0))
                    held = []
            if out:
                yield _marks(out)
                out = []
        end(True)
        if out:
            yield _marks(out)

    return run


_MARKS = {"kind": pa.int32(), "hi": pa.int64(), "lo": pa.int64(), "doc": pa.int64(), "copy": pa.int64(), "pos": pa.int32(), "n": pa.int64()}


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MARKS.values(), strict=True)], list(_MARKS))


def drop_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, copy, bitmap): for each document that loses lines, a zlib-compressed bitmap of its lines up to the last that goes, lowest bit first; 1: it goes.

    Ranges are drawn over (hash, document), so a line that a third of all documents hold spreads over many tasks;
    only one row for each of a range's two edge keys is then gathered to decide the keys that cross ranges. No text moves.
    """
    keys = store(_line_keys(docs, min_chars), "line-keys")
    n = partitions(docs.sparkSession)
    order = ["hi", "lo", F.col("doc").desc()]
    marks = store(
        keys.repartitionByRange(n, *order).sortWithinPartitions(*order, "copy", "pos").mapInArrow(_stream(min_docs), "kind int, hi long, lo long, doc long, copy long, pos int, n long"),
        "line-marks",
    )
    crossing = marks.where("kind = 2").groupBy("hi", "lo").agg(F.sum("n").alias("n_docs"), F.max("doc").alias("top")).where(F.col("n_docs") >= min_docs)
    # two rows at most for each range: the side that is broadcast is bounded by the number of partitions
    late = marks.where("kind = 1").join(F.broadcast(crossing), ["hi", "lo"]).where("doc <> top").select("doc", "copy", "pos")
    drops = marks.where("kind = 0").select("doc", "copy", "pos").union(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps = []
            for places in batch.column(2):
                at = places.values.to_numpy(zero_copy_only=False)
                gone = np.zeros(int(at.max()) + 1, bool)
                gone[at] = True
                bitmaps.append(zlib.compress(np.packbits(gone, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bitmaps, pa.binary())], ["doc", "copy", "bitmap"])

    # rows that share a document and a text bring up each position anew
    return drops.groupBy("doc", "copy").agg(F.collect_set("pos")).mapInArrow(run, "doc long, copy long, bitmap binary")


def _unpacked(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of n lines stay."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        gone = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n]
        keep[: len(gone)] = gone == 0
    return keep


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int, *columns: Column | str) -> DataFrame:
    bitmaps = drop_bitmaps(docs, min_chars, min_docs).withColumnsRenamed({"doc": "__doc", "copy": "__copy", "bitmap": "__bitmap"})
    rows = docs.select(*columns, id_or_none().alias("__id"), _copy().alias("__own"))
    return rows.join(bitmaps, (F.col("__id") == F.col("__doc")) & (F.col("__own") == F.col("__copy")), "left").drop("__doc", "__copy", "__id", "__own")


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep_bitmap): one row for each row of `docs` (doc_id, text, ...).

    A text is split at \\n; a line's key is the line stripped of white space, with A-Z in lower case. Lines whose
    key has `min_chars` code points or more and is found in `min_docs` documents or more go, except in the largest
    doc_id that holds the key. keep_bitmap is a zlib-compressed bitmap, lowest bit first, of the lines that stay.
    A null or empty text is one empty line. Rows that share a doc_id count as one document and lose the same keys; a null
    doc_id is one document, the smallest. Other columns are ignored; an empty table gives an empty result. Texts are not shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keeps = [_unpacked(m, n) for n, m in zip(batch.column("n_lines").to_pylist(), batch.column("__bitmap").to_pylist(), strict=True)]
            bits = [zlib.compress(np.packbits(k, bitorder="little").tobytes(), 1) for k in keeps]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), pa.array([len(k) - int(k.sum()) for k in keeps], pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "n_lines", "n_dropped", "keep_bitmap"])

    text = F.coalesce("text", F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    rows = _with_bitmaps(docs, min_chars, min_docs, F.col("doc_id").cast("long").alias("doc_id"), n_lines.cast("long").alias("n_lines"))
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, keep_bitmap binary")


def _kept(text: str, bitmap: bytes | None) -> tuple[int, int, str]:
    """Lines of a text, those that go, and what stays."""
    if bitmap is None:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    keep = _unpacked(bitmap, len(lines)).tolist()
    return len(lines), len(lines) - sum(keep), "\n".join(line for line, k in zip(lines, keep, strict=True) if k)


def kept_digests(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): the bitmaps of line_bitmaps() laid on the texts, which meet them by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_kept(t, m) for t, m in zip(batch.column("text").to_pylist(), batch.column("__bitmap").to_pylist(), strict=True)]
            columns = [[r[0] for r in rows], [r[1] for r in rows], [hashlib.sha256(r[2].encode()).hexdigest() for r in rows]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = _with_bitmaps(docs, min_chars, min_docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """`docs` with the lines that line_bitmaps() marks cut from text (and n_chars, if there, counted anew); no row goes.

    Nulls stay null, further columns are passed on, whatever their names; see line_bitmaps() for repeated rows and missing ids.
    """
    return apart(docs, lambda rows: _without_lines(rows, min_chars, min_docs))


def _without_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if m is None else _kept(t or "", m)[2] for t, m in zip(batch.column("text").to_pylist(), batch.column("__bitmap").to_pylist(), strict=True)]
            columns = {name: batch.column(name) for name in names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    cut = _with_bitmaps(docs, min_chars, min_docs, *(f"`{c}`" for c in names)).mapInArrow(run, docs.schema)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut
