"""Exact dedup on a log-structured merge index of digests.

Each task fills a memtable and flushes it as a sorted run; runs are Parquet files whose row groups carry a Bloom
filter on the digest. Compaction merges levels of sorted entries and keeps the best row of each digest; texts whose
digest is in several runs are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, partitions, store, text_bytes

_WS = SPACES.encode()
#: A memtable is flushed at so many digests, rows or bytes of text.
MEMTABLE_DIGESTS, MEMTABLE_ROWS, MEMTABLE_BYTES = 20_000, 50_000, 24 << 20
_MEMBER = pa.struct([("doc_id", pa.int64()), ("n_chars", pa.int64())])
_RUN = pa.schema(
    [("digest", pa.binary()), ("run", pa.int64()), ("size", pa.int64()), ("short", pa.int64()), ("no_id", pa.bool_()), ("best_id", pa.int64()), ("best_pos", pa.int64()), ("members", pa.list_(_MEMBER)), ("content", pa.binary())]
)


def _flush(table: dict[bytes, list], run: int) -> Iterator[pa.RecordBatch]:
    """The memtable as a run sorted by digest, some MB at a time."""
    rows, held = [], 0
    for digest in sorted(table):
        content, members = table[digest]
        pos, (doc, n) = min(enumerate(members), key=lambda x: (-x[1][1], x[1][0] is None, x[1][0] or 0, x[0]))
        rows.append((digest, run, len(members), -n, doc is None, doc, pos, [{"doc_id": d, "n_chars": c} for d, c in members], content))
        held += len(content)
        if held > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _RUN, strict=True)], schema=_RUN)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _RUN, strict=True)], schema=_RUN)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table: dict[bytes, list] = {}
    part = seq = rows = held = 0
    for batch in batches:
        for doc, text, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            content = text.translate(None, _WS)
            entry = table.setdefault(hashlib.sha256(content).digest(), [content, []])
            if entry[0] != content:
                raise ValueError("two texts share a SHA-256 digest")
            if not entry[1]:
                held += len(content)
            entry[1].append((doc, len(text.decode("utf-8", "replace"))))
            rows += 1
            if len(table) >= MEMTABLE_DIGESTS or rows >= MEMTABLE_ROWS or held >= MEMTABLE_BYTES:
                yield from _flush(table, part << 24 | seq)
                table, seq, rows, held = {}, seq + 1, 0, 0
    yield from _flush(table, part << 24 | seq)


def digest_runs(docs: DataFrame) -> DataFrame:
    """The index's sorted runs, as a stored table: a row for each digest of a run, with its members, its best row and its text without white space."""
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes(), F.spark_partition_id().cast("long"))
    made = rows.mapInArrow(_runs, "digest binary, run long, size long, short long, no_id boolean, best_id long, best_pos long, members array<struct<doc_id: long, n_chars: long>>, content binary")
    return store(made, "digest-runs", **_filters())


def _filters() -> dict[str, str]:
    """Parquet options: a Bloom filter on the digest in each row group."""
    return {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(MEMTABLE_DIGESTS), "compression": "zstd"}


_ENTRY = {"digest": pa.binary(), "group_size": pa.int64(), "n_runs": pa.int64(), "short": pa.int64(), "no_id": pa.bool_(), "best_id": pa.int64(), "run": pa.int64(), "best_pos": pa.int64()}
_ENTRY_SQL = "digest binary, group_size long, n_runs long, short long, no_id boolean, best_id long, run long, best_pos long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of several runs in the order of their digests, best first, read as a stream: those of one digest become one."""
    held: list | None = None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in _ENTRY), strict=True):
            if held is not None and held[0] == row[0]:
                held[1] += row[1]
                held[2] += row[2]
                continue
            if held is not None:
                out.append(held)
            held = list(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ENTRY.values(), strict=True)], list(_ENTRY))
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, _ENTRY.values(), strict=True)], list(_ENTRY))


def entries(runs: DataFrame) -> DataFrame:
    """The runs' rows as entries of an index's level, which compact() merges."""
    one = F.lit(1).cast("long").alias("n_runs")
    return runs.select("digest", F.col("size").alias("group_size"), one, "short", "no_id", "best_id", "run", "best_pos")


def compact(*levels: DataFrame) -> DataFrame:
    """The next level of the index, as a stored table sorted by digest within ranges, with Bloom filters: one entry for each digest of the `levels`.

    An entry has the size of its group, the number of runs that hold it, and its best row: the longest original text,
    then the smallest doc_id. Levels are merged range by range of the digest; a digest has one entry in each run at
    most, however many rows it stands for. Merging levels one after another gives what merging all at once gives.
    """
    every = reduce(DataFrame.union, levels)
    spark = every.sparkSession
    best = ["digest", "short", "no_id", "best_id", "run", "best_pos"]
    merged = every.repartitionByRange(partitions(spark), "digest").sortWithinPartitions(*best).mapInArrow(_merge, _ENTRY_SQL)
    return store(merged, "digest-index", **_filters())


def _filter_key(words: int, digest: str = "digest") -> dict[str, Column]:
    """A digest's place in a filter of so many longs: which one, and the bit in it."""
    number = lambda at, n: F.conv(F.hex(F.substring(digest, at, n)), 16, 10).cast("long")
    return {"__row": (number(1, 4) % words).cast("int"), "__bit": number(5, 1).bitwiseAND(63).cast("int")}


#: The longs of the filter of shared digests, at least and at most: the largest is 16 MB of bits.
FILTER_LONGS = (1 << 10, 1 << 21)


def verify(runs: DataFrame, compacted: DataFrame) -> None:
    """Compare, byte by byte, the text of each run's entry with that of the entry kept; one text for each digest and run moves.

    The index is first asked through a filter of the digests that several runs hold, which has 16 bits or more for each
    up to its largest size and is broadcast; it keeps back the texts of nearly all digests that only one run holds, and the join that
    follows is exact. Runs are compared with the kept text one by one, so the copies of a text spread over tasks as a join's rows do.
    """
    shared = compacted.where("n_runs > 1").select("digest", F.col("run").alias("keeper"))
    n = shared.count()
    if not n:
        return
    words = min(max(1 << (n // 4).bit_length(), FILTER_LONGS[0]), FILTER_LONGS[1])
    bit = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bit"))).alias("__bits")
    known = shared.withColumns(_filter_key(words)).groupBy("__row").agg(bit)
    held = runs.select("digest", "run", "content").withColumns(_filter_key(words)).join(F.broadcast(known), "__row")
    held = held.where(F.call_function("getbit", F.col("__bits"), F.col("__bit")) == 1)
    found = held.select("digest", "run", "content").join(shared, "digest")
    kept = found.where("run = keeper").select("digest", F.col("content").alias("kept"))
    if not found.where("run <> keeper").join(kept, "digest").where("content <> kept").isEmpty():
        raise ValueError("two texts share a SHA-256 digest")


def lookup(index: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size): what an index of compact() has for each row of `docs`; null where it has no equal text. No text moves."""
    digest = F.unhex(F.sha2(F.translate(F.coalesce("text", F.lit("")), SPACES, "").cast("binary"), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    return rows.join(index.select("digest", F.col("best_id").alias("keep_id"), "group_size"), "digest", "left").drop("digest")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of `docs` (doc_id, text, ...).

    Texts are equal when identical without the characters of [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the
    row with the most code points in the original stays, then the smallest doc_id (null last); of rows that also share
    the doc_id exactly one is kept. Other columns are ignored; an empty table gives an empty result.

    A task sends one row for each digest of a run, so a group that holds a third of all rows reaches the compaction
    pre-aggregated, and its members stay spread over the runs' rows.
    """
    runs = digest_runs(docs)
    index = compact(entries(runs))
    verify(runs, index)
    best = index.select("digest", "group_size", F.struct("best_id", "run", "best_pos").alias("best"))
    rows = runs.select("digest", "run", "members").join(best, "digest")
    one = rows.select("digest", "run", "group_size", "best", F.posexplode("members").alias("pos", "member"))
    return one.select(
        F.col("member.doc_id").alias("doc_id"),
        F.col("best.best_id").alias("keep_id"),
        "group_size",
        ((F.col("run") == F.col("best.run")) & (F.col("pos") == F.col("best.best_pos"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
