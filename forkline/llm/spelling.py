"""Spelling variants: words within one edit of each other, found by an index of variable-length grams, and the form that each is a variant of.

A gram dictionary holds the runs of code points that many words have. A word is cut into grams from its left end and again from its right end;
a gram grows while the dictionary still holds it, so frequent beginnings make long grams and rare ones short ones. One edit leaves
every gram alone that lies wholly on one side of it, as cutting looks at nothing beyond a gram's own end: the least number left,
over all places of the edit, is what two near words are bound to share, and a word needs to be looked up under only so many of its rarest grams that one of
them must be shared. Pairs of a list that share the grams they are bound to are verified code point by code point.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, store

#: Code points of the shortest and longest gram.
SHORTEST, LONGEST = 2, 8
#: A gram is frequent, and grown further, above this many occurrences in the words.
FREQUENT = 256
#: Grams that the broadcast dictionary holds at most: beyond it, only those with more occurrences are frequent.
DICTIONARY = 400_000
#: Members of a list that are compared with each other; the members of longer lists are told apart by the halves of what may still differ.
LIST = 512
#: Rows, code points and pairs that are compared at once; words of more code points are compared one pair after another.
ROWS_AT_ONCE, CELLS_AT_ONCE, PAIRS_AT_ONCE, LONG_WORD = 20_000, 2_000_000, 200_000, 256
#: Distinct words that a task counts before it sends them on.
COUNTED_AT_ONCE = 400_000

_RUN = re.compile("[a-zÀ-ÿ]{5,}")


def words_of(doc_id: int | None, text: str, damage: int = 97) -> Counter:
    """Occurrences of each word of a text: A-Z lower-cased runs of letters with the run's code point h % length deleted where `damage` divides h, of five code points or more.

    h is the unsigned crc32 of `<doc_id>:<run>`; a missing id is the empty text.
    """
    runs = Counter(_RUN.findall(text.encode().lower().decode()))
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    changed = [(run, h % len(run)) for run in runs if (h := zlib.crc32(run.encode(), head)) % damage == 0]
    for run, k, n in [(run, k, runs.pop(run)) for run, k in changed]:
        if len(run) > 5:
            runs[run[:k] + run[k + 1 :]] += n
    return runs


def word_counts(docs: DataFrame, least: int = 3, damage: int = 97) -> DataFrame:
    """(word, n) of the words that `docs` (doc_id, text) hold `least` times or more in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.update(words_of(doc, text, damage))
                if len(total) >= COUNTED_AT_ONCE:
                    yield sent()
                    total.clear()
        yield sent()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def gram_dictionary(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, frequent: int = FREQUENT, most: int = DICTIONARY) -> dict[str, int]:
    """The frequent grams of the distinct `words` and their occurrences, of up to `longest` - 1 code points: `most` of them at most.

    Grams with more occurrences than the bound are kept. The bound is `frequent`, or so much more that the number of grams fits: the
    occurrences of all grams of one length are fewer than the words' code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "c"])

        for batch in batches:
            for word in batch.column(0).to_pylist():
                for n in range(shortest, longest):
                    total.update(word[k : k + n] for k in range(len(word) - n + 1))
                if len(total) >= COUNTED_AT_ONCE:
                    yield sent()
                    total.clear()
        yield sent()

    points = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    bound = max(frequent, (longest - shortest) * points // most)
    grams = words.select("word").mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    return {r.gram: r.c for r in grams.where(F.col("c") > bound).toLocalIterator()}


def _chain(word: str, frequent: dict[str, int], first: int, shortest: int, longest: int) -> list[str]:
    """The grams of a word from its left end; one that the word ends in before it is rare is left out, unless it is the first, which has at most `first` code points."""
    grams, at, most = [], 0, min(first, longest)
    while at < len(word):
        end = at + min(shortest, most)
        while end - at < most and word[at:end] in frequent and end <= len(word):
            end += 1
        if end > len(word):
            break
        grams.append(word[at:end])
        at, most = end, longest
    return grams


def decompose(word: str, frequent: dict[str, int], length: int, shortest: int = SHORTEST, longest: int = LONGEST) -> tuple[list[str], list[str], int]:
    """The grams of a word from the left and, reversed, from the right, among words of `length` code points or one more; and how many of them one edit can affect.

    The first gram of either end takes half of `length` at most, so that no edit reaches both.
    """
    left = _chain(word, frequent, length // 2, shortest, longest)
    right = _chain(word[::-1], _Reversed(frequent), length // 2, shortest, longest)
    # an edit at a code point leaves what ends before it and what begins after it; fewest where a left gram is about to end or a right one begins
    ends, starts = list(accumulate(map(len, left))), [len(word) - k for k in accumulate(map(len, right))]
    kept = min(sum(e <= i for e in ends) + sum(s > i for s in starts) for i in {0, *(e - 1 for e in ends), *starts})
    return left, right, len(left) + len(right) - kept


class _Reversed:
    """A dictionary asked for reversed grams."""

    def __init__(self, frequent: dict[str, int]) -> None:
        self.frequent = frequent

    def __contains__(self, gram: str) -> bool:
        return gram[::-1] in self.frequent


def _index(words: DataFrame, frequent: dict[str, int], shortest: int, longest: int) -> DataFrame:
    """(list, word, n, length, needs, left, right, low, high): the lists that each word is looked up in, once among words of its own length and one more, once as the longer one.

    needs: the grams that a near word is bound to share; left, right: 32-bit hashes of all grams, with their places (one that is shared by chance lets a pair through to be verified). low, high: code points at either end that all of a list have in common (none yet).
    """
    shared = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for length in (len(word), len(word) - 1):
                    if length < 5:
                        continue
                    left, right, affected = decompose(word, grams, length, shortest, longest)
                    rare, hashes = [], ([], [])
                    for side, chain in enumerate((left, right)):
                        at = 0
                        for gram in chain:
                            h = digest(f"{length} {side} {at} {gram}".encode()) - (1 << 63)
                            at += len(gram)
                            hashes[side].append((h & 0xFFFFFFFF) or 1)
                            rare.append((grams.get(gram if side == 0 else gram[::-1], 0), h))
                    rare.sort()
                    packed = [np.array(x, "<u4").tobytes() for x in hashes]
                    out += [(h, word, n, length, len(rare) - affected, *packed) for _, h in rare[: affected + 1]]
            if out:
                columns = list(zip(*out, strict=True))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["list", "word", "n", "length", "needs", "left", "right"])

    index = words.select("word", "n").mapInArrow(run, "list long, word string, n long, length int, needs int, left binary, right binary")
    return index.withColumns({"low": F.lit(0), "high": F.lit(0)})


def _halved(members: DataFrame) -> DataFrame:
    """The members of long lists in two lists each: an edit is in the right half of what may differ, so the left half is shared, or the other way round."""
    half = F.floor((F.col("length") - F.col("low") - F.col("high")) / 2).cast("int")
    sides = F.array(F.struct((F.col("low") + half).alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), (F.col("high") + half).alias("high")))
    each = members.where(half > 0).withColumn("side", F.explode(sides))
    low, high = F.col("side.low"), F.col("side.high")
    key = F.xxhash64("list", low, high, F.substr("word", F.lit(1), low), F.substr("word", F.length("word") - high + 1))
    return each.select(key.alias("list"), "word", "n", "length", "needs", "left", "right", low.alias("low"), high.alias("high"))


def _same(a: np.ndarray, b: np.ndarray, short: np.ndarray) -> np.ndarray:
    """How many code points rows of `a`, of `short` code points each, and of `b` have in common from the left."""
    other = (a != b) & (np.arange(a.shape[1]) < short[:, None])
    return np.where(other.any(1), other.argmax(1), short)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of each word, and zeros behind."""
    width = max(map(len, words))
    return np.array(words, dtype=f"<U{width}").view("<u4").reshape(len(words), width)


def _table(hashes: list[bytes]) -> np.ndarray:
    width = max(4, max(map(len, hashes)))
    return np.array(hashes, dtype=f"S{width}").view("<u4").reshape(len(hashes), width // 4)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point tells two different words apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _pairs(starts: np.ndarray, sizes: np.ndarray, shorts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of lists that lie one after another: each of a list's first `shorts` rows with all behind it, a bounded number at a time."""
    first = np.concatenate([np.arange(s, s + k) for s, k in zip(starts.tolist(), shorts.tolist(), strict=True)])
    left = np.repeat(starts + sizes, shorts) - first - 1
    for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(np.cumsum(left) // PAIRS_AT_ONCE)) + 1):
        a = np.repeat(first[part], left[part])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left[part]) - left[part], left[part])


def _near(rows: list[tuple], starts: list[int]) -> tuple[list, ...]:
    """Near pairs of lists that lie one after another in `rows`, shorter words first: (word, other, n, other's n). Two words that are both longer than their list meet in another one."""
    words, ns, own, needs, left, right = map(list, zip(*rows, strict=True))
    lengths, bound = np.fromiter(map(len, words), np.int64, len(words)), np.array(needs)
    at = np.array(starts)
    shorts = np.add.reduceat((lengths == np.array(own)).astype(np.int64), at)
    out: tuple[list, ...] = ([], [], [], [])
    long = lengths.max() > LONG_WORD
    if not long:
        front, back, tables = _codes(words), _codes([w[::-1] for w in words]), (_table(left), _table(right))
    for a, b in _pairs(at, np.diff([*starts, len(rows)]), shorts):
        if long:
            ok = np.fromiter((one_edit(words[i], words[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
        else:
            # both ends are cut one gram after another, so the grams that an edit leaves alone are where the chains begin alike
            shared = sum(((t[a] == t[b]) & (t[a] != 0)).cumprod(1).sum(1) for t in tables)
            met = shared >= np.maximum(bound[a], bound[b])
            a, b = a[met], b[met]
            same = _same(front[a], front[b], lengths[a]) + _same(back[a], back[b], lengths[a])
            ok = np.where(lengths[a] == lengths[b], same == lengths[a] - 1, same >= lengths[a])
        for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            for column, value in zip(out, (words[i], words[j], ns[i], ns[j]), strict=True):
                column.append(value)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lists -> (word, near, n, near_n) of their near pairs; whole lists are held up to ROWS_AT_ONCE rows or CELLS_AT_ONCE code points, or else one list."""
    held: list[tuple] = []
    starts: list[int] = []
    key, widest = None, 0

    def found(rows: list[tuple], starts: list[int]) -> Iterator[pa.RecordBatch]:
        if starts and len((pairs := _near(rows, starts))[0]):
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(pairs, types, strict=True)], ["word", "near", "n", "near_n"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("list", "word", "n", "length", "needs", "left", "right")]
        for k, *row in zip(*columns, strict=True):
            if k != key:
                if len(held) >= ROWS_AT_ONCE or len(held) * widest >= CELLS_AT_ONCE or (widest > LONG_WORD) != (len(row[0]) > LONG_WORD):
                    yield from found(held, starts)
                    held, starts, widest = [], [], 0
                key = k
                starts.append(len(held))
            held.append(row)
            widest = max(widest, len(row[0]))
    yield from found(held, starts)


def near_words(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, frequent: int = FREQUENT, dictionary: int = DICTIONARY, longest_list: int = LIST) -> DataFrame:
    """(word, near, n, near_n): each pair of the distinct `words` (word of five code points or more, n) that one inserted, deleted or replaced code point tells apart, in one order.

    Lists of more than `longest_list` members are not compared but split by the halves of what may still differ, round by round, down to lists whose
    members differ in one code point or two; these are bounded by the alphabet.
    """
    grams = gram_dictionary(words, shortest, longest, frequent, dictionary)
    members = store(_index(words, grams, shortest, longest), "gram-lists")
    found = []
    while True:
        sizes = members.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("length") - F.col("low") - F.col("high")).alias("open")).where("m > 1").withColumnRenamed("list", "key")
        sized = members.join(sizes, F.col("list") == F.col("key"))
        short = sized.where((F.col("m") <= longest_list) | (F.col("open") < 2)).drop("key", "m", "open")
        listed = short.repartition(partitions(words.sparkSession), "list").sortWithinPartitions("list", F.length("word"), "word")
        found.append(store(listed.mapInArrow(_compare, "word string, near string, n long, near_n long"), "near-words"))
        long = store(_halved(sized.where((F.col("m") > longest_list) & (F.col("open") >= 2))), "long-lists")
        if long.isEmpty():
            break
        members = long
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> (word, root): where following forms ends. Each round doubles the steps; a form has twice its word's occurrences, so there are few."""
    reached = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = store(reached.join(onward, reached.root == onward["at"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        reached = step.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = 3, ratio: int = 2, damage: int = 97, **index) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each distinct word of five code points or more that `docs` (doc_id, text, ...) hold `least` times.

    Words are those of words_of(); near words are within exactly one inserted, deleted or replaced code point. form is the near word of
    largest n, of equal ones the first in code-point order, if that n is `ratio` times the word's or more; root is where following forms ends, the word itself if it has
    none. A null text has no words; a null doc_id is the empty text in the crc32. Repeated rows count again; an empty table gives
    an empty result; other columns are ignored. `index` are settings of near_words(), none of which changes the result.
    """
    words = store(word_counts(docs, least, damage), "words")
    pairs = store(near_words(words, **index), "near-pairs")
    both = pairs.select("word", "near", "n", "near_n").union(pairs.select("near", "word", "near_n", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    met = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("own_n"), best.alias("best"))
    chosen = -F.col("best.order") >= ratio * F.col("own_n")
    forms = store(met.select("word", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.order")).alias("form_n")), "forms")
    roots = _roots(forms.where("form is not null"))
    rows = words.join(forms, "word", "left").join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
