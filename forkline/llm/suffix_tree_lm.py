"""LM scoring with a probabilistic suffix tree: contexts of varying length, kept by divergence tests, smoothed into their parents.

Texts are encoded once, as blocks of token numbers with a dictionary of word hashes. Every word is a symbol of its own,
and every word sequence that occurs twice in training can be a context, so the tree grows with the corpus. It is never
gathered: for each length, blocks send what they have of each context to the range of hashes that the context belongs
to, as packed arrays; there counts are summed, the context is tested and smoothed, and each block gets back what it asked for.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_dir, store, text_bytes

#: A block is closed at so many tokens, and a range is meant for about so many.
BLOCK_TOKENS, RANGE_TOKENS = 1_300_000, 4_000_000
#: The hash of the end of a text.
END = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """least: occurrences in training from which a word sequence is a context, and a symbol is listed after one (else its
    mass goes to the parent); depth: longest context; divergence: least gain in nats for each listed symbol; discount: taken off each count."""

    least: int = 2
    depth: int = 2
    divergence: float = 1.0
    discount: float = 0.5


@dataclass(frozen=True)
class Totals:
    """Training tokens (ends included), distinct ones, and ends."""

    tokens: int
    types: int
    ends: int


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, train, sizes, ids, known, part, seq = [], [], [], [], {}, 0, 0

    def close() -> pa.RecordBatch:
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known)).view(np.int64)
        longs = pa.list_(pa.int64())
        row = [([part << 20 | seq], pa.int64()), ([docs], longs), ([train], pa.list_(pa.bool_())), ([sizes], longs), ([np.concatenate(ids).tobytes()], pa.binary()), ([keys], longs)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in row], ["block", "docs", "train", "sizes", "ids", "keys"])

    n = 0
    for batch in batches:
        for doc, text, learn, part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            words = text.lower().split()
            docs.append(doc)
            train.append(learn)
            sizes.append(len(words))
            ids.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32))
            n += len(words) + 10
            if n >= BLOCK_TOKENS:
                yield close()
                docs, train, sizes, ids, known, n, seq = [], [], [], [], {}, 0, seq + 1
    if docs:
        yield close()


def encode(docs: DataFrame, train: Column) -> tuple[DataFrame, int]:
    """Blocks of encoded texts, as a table bucketed by block, and the number of its buckets.

    A block: doc_ids, which are for training, words in each, their numbers, and the hash of each number's word. Joins
    on the block move only what is joined to it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes(), train, F.spark_partition_id().cast("long"))
    made = rows.mapInArrow(_encode, "block long, docs array<long>, train array<boolean>, sizes array<long>, ids binary, keys array<long>")
    n, name = partitions(spark), f"forkline_blocks_{uuid.uuid4().hex}"
    made.write.bucketBy(n, "block").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), n


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of hashes begins and ends in sorted hashes."""
    own = (hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    return np.searchsorted(own, np.arange(n + 1, dtype=np.uint64))


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def _pack_hashes(a: np.ndarray) -> bytes:
    """The upper seven bytes of 64-bit hashes."""
    return a.view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()


def _unpack_hashes(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 7, 8), np.uint8)
    out[:, 1:] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).ravel()


class Level:
    """The contexts of one length before a block's tokens, and the symbols after them that may be listed.

    state and count are those of the sequence one shorter that ends at each token. Contexts are sorted by hash, symbols
    by context and the upper half of their hashes, so those of a range of hashes are a slice.
    """

    def __init__(self, state: np.ndarray, count: np.ndarray, symbols: np.ndarray, place: np.ndarray, length: int, least: int):
        at = np.flatnonzero((place[1:] >= length) & (count[:-1] >= least)) + 1
        self.contexts, first, self.context = np.unique(state[at - 1], return_index=True, return_inverse=True)
        self.at, self.total = at, count[at - 1][first]
        may = count[at] >= least
        self.listed_at, owner = at[may], self.context[may]
        codes, self.first, self.listed = np.unique(owner.astype(np.uint64) << np.uint64(32) | symbols[self.listed_at] >> np.uint64(32), return_index=True, return_inverse=True)
        self.owner, self.symbol = (codes >> np.uint64(32)).astype(np.int64), codes.astype(np.uint32)


class Block:
    """One row of a batch of blocks, and what has been answered to it so far: {length: arrays in the order asked}."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        def array(name: str) -> np.ndarray:
            return batch.column(name)[i].values.to_numpy(zero_copy_only=False)

        self.number, self.docs = batch.column("block")[i].as_py(), batch.column("docs")[i].values
        self.train, self.sizes, self.keys = array("train").astype(bool), array("sizes"), array("keys").view(np.uint64)
        self.ids = np.frombuffer(batch.column("ids")[i].as_buffer() or b"", np.int32)
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.answers: dict[int, tuple[np.ndarray, ...]] = {}
        if "answers" in batch.schema.names:
            got = sorted(batch.column("answers")[i].as_py() or (), key=lambda a: a["range"])
            for length in {a["length"] for a in got}:
                mine = [a for a in got if a["length"] == length]
                self.answers[length] = tuple(np.concatenate([_unpack(a[c], k) for a in mine]) for c, k in (("counts", "u8"), ("mass", "f4")))

    def walk(self, totals: Totals, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, Level | None]:
        """Training counts of the tokens, their probabilities by counts alone and by the contexts known so far, and the next level."""
        n = int((self.sizes + 1).sum())
        words = np.ones(n, bool)
        words[self.begin + self.sizes] = False
        counts = np.zeros(len(self.keys))
        counts[np.argsort(self.keys)] = self.answers[0][0] if 0 in self.answers else 0
        symbols, count = np.full(n, END), np.full(n, float(totals.ends))
        symbols[words], count[words] = self.keys[self.ids], counts[self.ids]
        place = np.arange(n) - np.repeat(self.begin, self.sizes + 1)
        known = count
        base = (count + 0.5) / (totals.tokens + 0.5 * (totals.types + 1))
        p, state = base.copy(), symbols
        for length in range(1, settings.depth + 1):
            level = Level(state, count, symbols, place, length, settings.least)
            if length not in self.answers:
                return known, base, p, level
            found, mass = self.answers.pop(length)
            # a context that is not kept hands everything on to its parent
            share = np.where(mass[level.owner] < 1, np.maximum(found - settings.discount, 0) / level.total[level.owner], 0.0)
            p[level.at] *= mass[level.context]
            p[level.listed_at] += share[level.listed]
            state = np.r_[state[:1], _mix(state[:-1], symbols[1:])]
            count = np.zeros(n)
            count[level.listed_at] = found[level.listed]
            del level, found, mass, share
        return known, base, p, None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch, i)


_ASKED = {"range": pa.int32(), "block": pa.int64(), "contexts": pa.binary(), "sizes": pa.binary(), "totals": pa.binary(), "symbols": pa.binary(), "counts": pa.binary(), "parents": pa.binary()}
_ASKED_SQL = "range int, block long, contexts binary, sizes binary, totals binary, symbols binary, counts binary, parents binary"
_ANSWERS = {"block": pa.int64(), "length": pa.int32(), "range": pa.int32(), "counts": pa.binary(), "mass": pa.binary()}
_ANSWERS_SQL = "block long, length int, range int, counts binary, mass binary"


def _rows(rows: list[tuple], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


def _ask_words(n_ranges: int):
    """How often each word of a block is in its training texts, 0 included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n = np.bincount(block.ids[np.repeat(block.train, block.sizes)], minlength=len(block.keys))
            order = np.argsort(block.keys)
            keys, n = block.keys[order], n[order].astype(np.uint64)
            cuts = _ranges(keys, n_ranges)
            rows = [(r, block.number, keys[a:b].tobytes(), b"", _pack(n[a:b]), b"", b"", b"") for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            if rows:
                yield _rows(rows, _ASKED)

    return run


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over all blocks; a row of block -1 has their sum and the number of words with a count."""
    for batch in batches:
        for r, asked in zip(batch.column("range").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            keys = [np.frombuffer(a["contexts"], np.uint64) for a in asked]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate([_unpack(a["totals"], "u8") for a in asked])).astype(np.uint64)
            ends = np.cumsum([len(k) for k in keys])
            rows = [(a["block"], 0, r, _pack(total[at[e - len(k) : e]]), _pack(np.zeros(0, "f4"))) for a, k, e in zip(asked, keys, ends, strict=True)]
            sums = np.array([total.sum(), (total > 0).sum()], "u8").tobytes()
            yield _rows([*rows, (-1, 0, r, sums, b"")], _ANSWERS)


def _ask(n_ranges: int, totals: Totals, settings: Settings):
    """The next length's contexts and symbols of each block, with the symbols' counts in its training texts and the probabilities their parents give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            _, _, p, level = block.walk(totals, settings)
            learn = np.repeat(block.train, block.sizes + 1)[level.listed_at]
            n = np.bincount(level.listed[learn], minlength=len(level.symbol)).astype(np.uint32)
            # the test reads the parents' probabilities in twentieths of a power of ten
            parents = np.clip(np.rint(-20 * np.log10(p[level.listed_at[level.first]])), 0, 255).astype(np.uint8)
            sizes = np.bincount(level.owner, minlength=len(level.contexts)).astype(np.uint32)
            cuts = _ranges(level.contexts, n_ranges)
            inner = np.searchsorted(level.owner, cuts)
            rows = []
            for r in range(n_ranges):
                a, b, c, d = cuts[r], cuts[r + 1], inner[r], inner[r + 1]
                if a < b:
                    rows.append((r, block.number, _pack_hashes(level.contexts[a:b]), _pack(sizes[a:b]), _pack(level.total[a:b].astype(np.uint64)), level.symbol[c:d].tobytes(), _pack(n[c:d]), parents[c:d].tobytes()))
            if rows:
                yield _rows(rows, _ASKED)

    return run


def judge(total: np.ndarray, owner: np.ndarray, count: np.ndarray, parent: np.ndarray, settings: Settings) -> np.ndarray:
    """The mass that each context hands to its parent; 1 where it is not kept.

    total: occurrences of the contexts; of each of their listed symbols the context, the count and the parent's probability.
    A context is kept if its own distribution, on the listed symbols and on the rest together, gains enough over its parent's.
    """
    n = len(total)
    own = count / total[owner]
    gain = np.bincount(owner, count * np.log(own / parent), minlength=n)
    rest, below = 1 - np.bincount(owner, own, minlength=n), 1 - np.bincount(owner, parent, minlength=n)
    some = (rest > 1e-12) & (below > 1e-12)
    gain[some] += (total * rest)[some] * np.log(rest[some] / below[some])
    kept = gain > settings.divergence * np.maximum(1, np.bincount(owner, minlength=n))
    mass = 1 - np.bincount(owner, np.maximum(count - settings.discount, 0) / total[owner], minlength=n)
    return np.where(kept, mass, 1.0)


def _answer(length: int, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, asked in zip(batch.column("range").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                contexts = [_unpack_hashes(a["contexts"]) for a in asked]
                unique, first, context = np.unique(np.concatenate(contexts), return_index=True, return_inverse=True)
                total = np.concatenate([_unpack(a["totals"], "u8") for a in asked])[first].astype(float)
                owner = np.repeat(context, np.concatenate([_unpack(a["sizes"], "u4") for a in asked]))
                symbols = [np.frombuffer(a["symbols"], np.uint32) for a in asked]
                codes, first, symbol = np.unique(owner.astype(np.uint64) << np.uint64(32) | np.concatenate(symbols), return_index=True, return_inverse=True)
                count = np.bincount(symbol, np.concatenate([_unpack(a["counts"], "u4") for a in asked]), minlength=len(codes))
                count[count < settings.least] = 0
                listed = np.flatnonzero(count)
                parent = 10 ** (np.concatenate([np.frombuffer(a["parents"], np.uint8) for a in asked])[first[listed]] / -20.0)
                mass = judge(total, (codes[listed] >> np.uint64(32)).astype(np.int64), count[listed], parent, settings).astype(np.float32)
                count = count.astype(np.uint64)
                ends, inner = np.cumsum([len(c) for c in contexts]), np.cumsum([len(s) for s in symbols])
                yield _rows([(a["block"], length, r, _pack(count[symbol[j - len(s) : j]]), _pack(mass[context[i - len(c) : i]])) for a, c, i, s, j in zip(asked, contexts, ends, symbols, inner, strict=True)], _ANSWERS)

    return run


def _exchange(asked: DataFrame, n_ranges: int, answer, label: str) -> DataFrame:
    """Questions to their ranges, and the answers as a stored table."""
    names = [c for c in _ASKED if c != "range"]
    by_range = asked.repartition(n_ranges, "range").groupBy("range").agg(F.collect_list(F.struct(*names)).alias("asked"))
    return store(by_range.mapInArrow(answer, _ANSWERS_SQL), label)


def _with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    rows = answers[0].where("block >= 0")
    for more in answers[1:]:
        rows = rows.union(more)
    each = rows.groupBy("block").agg(F.collect_list(F.struct("length", "range", "counts", "mass")).alias("answers"))
    return blocks.join(each, "block", "left")


def score_texts(docs: DataFrame, train: Column, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of `docs` (doc_id, text, ...).

    Learns from the rows where `train` is true and scores all. Tokens are the runs outside [\\x20\\x09-\\x0D] of the text with
    A-Z in lower case, then one end; a null or empty text has the end alone. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1)))
    over the tokens; score sums log10 of the tree's probabilities: these start from the same distribution, and each
    retained context that ends before the token, from the shortest to the longest, gives its own share and hands the rest on.
    Words are told apart by a 64-bit hash, contexts by 56 bits, the symbols after one context by 32. Repeated rows
    each count; a null doc_id stays null; other columns are ignored, an empty table gives an empty result; without training texts every word is unknown.

    What is shuffled are packed arrays: of each block the distinct contexts and symbols, to ranges of hashes and back. A
    frequent context is sent by each block once. The driver reads three sums.
    """
    blocks, n = encode(docs, train)
    ends, tokens = blocks.select(F.sum(F.aggregate("train", F.lit(0).cast("long"), lambda n, t: n + t.cast("long"))), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, s: n + s + 1))).first()
    ends, n_ranges = ends or 0, max(n, -(-(tokens or 0) // RANGE_TOKENS))
    answers = [_exchange(blocks.mapInArrow(_ask_words(n_ranges), _ASKED_SQL), n_ranges, _answer_words, "words")]
    sums = [np.frombuffer(bytes(r.counts), "u8") for r in answers[0].where("block < 0").select("counts").toLocalIterator()]
    words, types = (int(sum(int(s[i]) for s in sums)) for i in (0, 1))
    totals = Totals(words + ends, types + (ends > 0), ends)
    for length in range(1, settings.depth + 1):
        asked = _with_answers(blocks, answers).mapInArrow(_ask(n_ranges, totals, settings), _ASKED_SQL)
        answers.append(_exchange(asked, n_ranges, _answer(length, settings), f"contexts-{length}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            known, base, p, _ = block.walk(totals, settings)
            flat, logs, seen = (np.add.reduceat(x, block.begin) for x in (np.log10(base), np.log10(p), (known > 0).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [block.docs, pa.array(~block.train), pa.array(block.sizes + 1), pa.array(seen), pa.array(np.full(len(block.begin), totals.tokens)), pa.array(flat), pa.array(logs)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_answers(blocks, answers).mapInArrow(run, schema)
