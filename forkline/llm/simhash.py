"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes at eight positions. Two fingerprints within `bits` differing bits (up to 4) have at
least 8 - bits bytes in common at the same positions. Pairs that meet in a posting have their shared positional bytes
tallied, those that reach the guaranteed minimum are retained, and the bits of these are compared.

A posting is of POSITIONS bytes at once. One byte alone is shared by 1/256 of all fingerprints, so postings of single
bytes would bring up nearly all pairs of the table; three bytes bring up one of 2^24 for each choice of positions.

near_duplicates() links by these bits alone. near_copies() is after texts alike to 0.8, whose fingerprints share a byte with
a chance of 0.27 only. It takes fingerprints of WORDS such words, of which the first is the one above, posts them by three
of all their bytes, tallies the bytes that pairs share, and counts the shingles of the pairs that it retains. A check of
what is still apart follows, as no number of shared bytes is sure to hold all texts of a given similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, apart, id_or_none, partitions, store, text_bytes
from .components import components

#: Byte positions of a posting; fewer than the guaranteed minimum of shared bytes.
POSITIONS = 3
#: Fingerprints of a posting are compared in pairs up to this length; those of longer ones are linked through midpoints, which is exact too.
LONG_POSTING = 1024
#: Words of the fingerprints of near_copies().
WORDS = 7
#: Pairs of their postings are looked at up to so many differing bits of the first word, and retained from so many shared bytes on.
#: At a similarity of 0.8 these are 9.7 and 15 on average; at random 32, and 3.2 with those of the posting.
WIDE, SHARED = 20, 5
#: Candidates of a posting are paired up to this length; in longer ones, which are of families, each is paired with the first.
FAMILY = 8
#: Bands of minima in which texts that fingerprints left apart are found, and the minima of each.
BANDS, BAND_ROWS = 32, 4
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of two arrays of 64-bit fingerprints."""
    return _ONES[(a ^ b).reshape(-1, 1).view(np.uint16)].sum(1)


def shingles(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """The 64-bit hashes of a text's word shingles in order, repeats included; empty without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    last = max(1, len(words) - width + 1)
    starts = [0, *ends[: last - 1]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a : b - 1], seed) for a, b in zip(starts, ends[min(width, len(words)) - 1 :], strict=True)), "<u8", last)


def fingerprint(text: bytes, width: int, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    hashes = shingles(text, width, seed)
    last = len(hashes)
    if not last:
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > last, bitorder="little").view("<i8")[0])


_SPREAD = np.random.default_rng(7).integers(1 << 62, 1 << 63, WORDS, "u8") * np.uint64(2) + np.uint64(1)


def long_fingerprint(hashes: np.ndarray) -> bytes:
    """The SimHash of WORDS words of a text's shingle hashes; the first is that of the hashes themselves, as fingerprint() has it, the others of mixtures of them."""
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
        part = hashes[at : at + 255, None]
        mixed = part * _SPREAD
        mixed ^= mixed >> np.uint64(32)
        mixed *= _SPREAD[::-1]
        mixed ^= mixed >> np.uint64(29)
        mixed[:, :1] = part
        total += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for each row of `docs` (doc_id, text, ...); a null text is empty. Without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, width, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, fp long")


_CHOICES = list(combinations(range(8), POSITIONS))


def _postings():
    """Each fingerprint under every choice of byte positions: (choice, bytes there) -> fingerprint."""
    masks = [np.uint64(sum(0xFF << 8 * p for p in c)) for c in _CHOICES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy().astype("i8").view("u8")
            for at in range(0, len(whole), 4096):
                fps = whole[at : at + 4096]
                for i, mask in enumerate(masks):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fps), i, np.int32)), pa.array((fps & mask).view("i8")), pa.array(fps.view("i8"))], ["choice", "part", "fp"]
                    )

    return run


#: Positions of the postings of long fingerprints: two turns around all bytes, in which no two positions come together twice.
_TURNS = [[(i + step) % (8 * WORDS) for step in steps] for steps in ((0, 1, 3), (0, 4, 9)) for i in range(8 * WORDS)]


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 8 * WORDS)


def _long_postings():
    """(fp, words) -> fp, the first word, under the bytes of each of _TURNS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bytes(batch.column(1)).astype(np.int64)
            for i, (x, y, z) in enumerate(_TURNS):
                part = at[:, x] | at[:, y] << 8 | at[:, z] << 16
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int32)), pa.array(part), batch.column(0)], ["choice", "part", "fp"])

    return run


def _shared():
    """(x, y) of the pairs (x, y, words, words2) that share SHARED bytes or more at the same positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = (_bytes(batch.column(2)) == _bytes(batch.column(3))).sum(1) >= SHARED
            yield batch.select([0, 1]).filter(pa.array(kept))

    return run


def _close(bits: int):
    """Pairs of one posting of long fingerprints within `bits` bits in the first word."""

    def pairs(fps: np.ndarray, choice: int) -> list[tuple[int, int]]:
        signed, found = fps.view("i8").tolist(), []
        for i in range(1, len(fps)):
            found += [(signed[j], signed[i]) for j in np.flatnonzero(distance(fps[:i], fps[i : i + 1]) <= bits).tolist()]
        return found

    return pairs


def _pairs(fps: np.ndarray, choice: int, bits: int) -> list[tuple[int, int]]:
    """Linked pairs of one posting: shared positional bytes are tallied, pairs with 8 - bits or more retained, and these verified.

    A pair counts in the first of its postings only.
    """
    found = []
    for i in range(1, len(fps)):
        equal = ((fps[:i] ^ fps[i]).reshape(-1, 1).view(np.uint8) == 0).reshape(-1, 8)
        kept = np.flatnonzero(equal.sum(1) >= 8 - bits)
        if not len(kept):
            continue
        kept = kept[distance(fps[kept], fps[i : i + 1]) <= bits]
        first = np.argsort(~equal[kept], axis=1, kind="stable")[:, :POSITIONS]
        mine = kept[(first == np.array(_CHOICES[choice])).all(1)]
        b = int(fps[i : i + 1].view("i8")[0])
        found += [(a, b) for a in fps[mine].view("i8").tolist()]
    return found


def _tally(linked: Callable[[np.ndarray, int], list[tuple[int, int]]], longest: int):
    """Read a range of sorted postings as a stream; yields (kind, choice, part, a, b). Those of more than `longest` are long, linked(fps, choice) has the pairs of others.

    kind 0: a and b are linked. kind 1: a is in a long posting. The posting at either edge of a range may go on in the
    next one: kind 2 are its fingerprints where they are few, kind 3 says that it is long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n, first, out = None, [], 0, True, []

        def end(edge: bool) -> None:
            fps = np.concatenate(held) if held else np.zeros(0, "u8")
            if edge:
                out.extend([(3, *key, 0, 0)] if n > longest else [(2, *key, f, 0) for f in fps.view("i8").tolist()])
            elif 2 <= n <= longest:
                out.extend((0, *key, a, b) for a, b in linked(fps, key[0]))

        for batch in batches:
            choice, part, fp = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (part[1:] != part[:-1])) + 1
            starts, stops = [0, *cuts.tolist()], [*cuts.tolist(), len(fp)]
            for i, (lo, hi) in enumerate(zip(starts, stops, strict=True)):
                if hi - lo == 1 and 0 < i < len(starts) - 1:
                    continue  # alone in its posting, and not at an edge of the batch
                here = (int(choice[lo]), int(part[lo]))
                if key != here:
                    if key is not None:
                        end(first)
                        first = False
                    key, held, n = here, [], 0
                n += hi - lo
                held.append(fp[lo:hi].astype("i8").view("u8"))
                if n > longest:
                    out.extend((1, *key, f, 0) for x in held for f in x.view("i8").tolist())
                    held = []
            if out:
                yield _rows(out)
                out.clear()
        if key is not None:
            end(True)
        if out:
            yield _rows(out)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "choice", "part", "a", "b"])


def _across(edges: DataFrame, bits: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Links and long-posting members (choice, part, a) of the postings that cross ranges; at most 2 * longest rows came from each range."""
    rows = edges.where("kind = 2").select("choice", "part", "a")
    sizes = edges.where("kind in (2, 3)").groupBy("choice", "part").agg(F.sum(F.when(F.col("kind") == 3, longest + 1).otherwise(1)).alias("n"))
    sized = rows.join(sizes, ["choice", "part"])
    short = sized.where(F.col("n").between(2, longest))
    other = short.select("choice", "part", F.col("a").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    links = short.join(other, ["choice", "part"]).where((F.col("a") < F.col("b")) & near)
    return links.select("a", "b"), sized.where(F.col("n") > longest).select("choice", "part", "a")


def _met(index: DataFrame, linked: Callable[[np.ndarray, int], list[tuple[int, int]]], bits: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that meet in a posting of up to `longest` of `index` (choice, part, fp); members (choice, part, a) of longer postings."""
    keys = ["choice", "part", "fp"]
    spread = index.repartitionByRange(partitions(index.sparkSession), *keys).sortWithinPartitions(*keys)
    found = store(spread.mapInArrow(_tally(linked, longest), "kind int, choice int, part long, a long, b long"), "postings")
    across, late = _across(found, bits, longest)
    return found.where("kind = 0").select("a", "b").union(across), found.where("kind = 1").select("choice", "part", "a").union(late)


def _midpoints(bits: int):
    """All fingerprints within bits / 2 of each one: two are within `bits` exactly if they have such a point in common."""
    reach = (bits + 1) // 2
    flips = np.array([sum(1 << i for i in c) for k in range(reach + 1) for c in combinations(range(64), k)], "u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in batch.column(0).to_numpy().astype("i8").view("u8"):
                yield pa.RecordBatch.from_arrays([pa.array((fp ^ flips).view("i8")), pa.array(np.full(len(flips), fp).view("i8"))], ["point", "fp"])

    return run


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints `fps` (fp long) exactly as all pairs within `bits` bits do; bits is 2 or 4.

    Every pair whose shared postings include one of up to LONG_POSTING members is listed itself. Members of longer
    postings are linked to the points within half the distance, which is linear in their number and misses none.
    """
    if bits not in (2, 4):
        raise ValueError("bits must be 2 or 4")
    index = fps.mapInArrow(_postings(), "choice int, part long, fp long")
    pairs, long = _met(index, lambda found, choice: _pairs(found, choice, bits), bits, LONG_POSTING)
    points = store(long.select("a").distinct().mapInArrow(_midpoints(bits), "point long, fp long"), "midpoints")
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub <> top").select("point", "hub")
    through = points.join(hubs, "point").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.union(through).distinct()


def near_pairs(prints: DataFrame) -> DataFrame:
    """(x, y): keys of pairs of `prints` (fp long, the first word; words binary, the long fingerprint; key; one row for each fp) that the index brings together.

    They share three bytes at the positions of one of _TURNS, and SHARED bytes or more in all. Members of postings of more
    than FAMILY are paired with the posting's first alone, so that pairs grow with the fingerprints, however many are alike.
    """
    pairs, long = _met(prints.select("fp", "words").mapInArrow(_long_postings(), "choice int, part long, fp long"), _close(WIDE), WIDE, FAMILY)
    first = long.groupBy("choice", "part").agg(F.min("a").alias("b"))
    through = long.join(first, ["choice", "part"]).where((F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= WIDE))
    met = pairs.union(through.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a = prints.select(F.col("fp").alias("a"), F.col("key").alias("x"), "words")
    b = prints.select(F.col("fp").alias("b"), F.col("key").alias("y"), F.col("words").alias("words2"))
    return met.join(a, "a").join(b, "b").select("x", "y", "words", "words2").mapInArrow(_shared(), "x long, y long")


def _labels(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """rows (key, least) and links (a, b: keys) -> key, component_id: the smallest `least` of each component.

    A node carries its least id in front of its key, so that the root of its component holds the answer, and no
    component, however large, is gathered by its root.
    """
    node = rows.select(key, F.struct(F.col("least").isNull().alias("none"), F.coalesce("least", F.lit(0)).alias("least"), F.col(key).alias("key")).alias("node"))
    ends = links.join(node.select(F.col(key).alias("a"), F.col("node").alias("x")), "a").join(node.select(F.col(key).alias("b"), F.col("node").alias("y")), "b")
    roots = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node.key").alias(key), "root")
    return rows.select(key, "least").join(roots, key, "left").select(key, F.when(F.col("root").isNull(), F.col("least")).when(~F.col("root.none"), F.col("root.least")).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, bits: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of `docs` (doc_id, text, ...).

    Words are the runs outside [\\x20\\x09-\\x0D] of the text with A-Z in lower case; shingles are `width` words joined by a
    space (fewer words: all of them; none, or a null text: fingerprint zero, linked like any other). Fingerprints link
    at `bits` or fewer differing bits; component_id is the smallest doc_id that can be reached (null only if no
    member has an id). Copies share a fingerprint and are never paired; other columns are ignored.
    """
    rows = store(fingerprints(docs, width, seed), "fingerprints")
    distinct = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    classes = _labels(distinct, links(distinct.select("fp"), bits), "fp")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _signatures(width: int, seed: int):
    """(doc_id, digest, key, fp, words, bands) of each (doc_id, digest, text): key stands for the set of shingles, fp is the first of the words of its fingerprint, bands stand for choices of the least shingles."""
    scales = np.random.default_rng(seed).integers(1 << 62, 1 << 63, (BANDS * BAND_ROWS + BAND_ROWS + BANDS), "u8") * np.uint64(2) + np.uint64(1)
    orders, mix, places = scales[: BANDS * BAND_ROWS], scales[BANDS * BAND_ROWS :][:BAND_ROWS], scales[-BANDS:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, bands = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingles(text, width, seed)
                words.append(long_fingerprint(hashes))
                hashes = np.unique(hashes)
                keys.append(xxhash.xxh3_64_intdigest(hashes.tobytes(), seed))
                least = np.full(len(orders), ~np.uint64(0))
                for at in range(0, len(hashes), 512):
                    np.minimum(least, (orders[:, None] * hashes[at : at + 512]).min(1), out=least)
                bands.append(((least.reshape(BANDS, BAND_ROWS) * mix).sum(1, dtype="u8") ^ places).view("i8") if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(keys, "u8").view("i8")), pa.array(np.frombuffer(b"".join(w[:8] for w in words), "<i8")), pa.array(words, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "digest", "key", "fp", "words", "bands"])

    return run


def _sets(width: int, seed: int):
    """(key, hashes) of each (key, text): the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.unique(shingles(text, width, seed)).view("i8")], pa.list_(pa.int64()))], ["key", "hashes"])

    return run


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of `pairs` (a, b: keys) whose sets have a Jaccard similarity of 0.8 or more."""
    a = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    sizes = F.least(F.size("x"), F.size("y")) * 5 >= F.greatest(F.size("x"), F.size("y")) * 4
    both = F.size(F.array_intersect("x", "y"))
    # 5 * both >= 4 * (x + y - both)
    return pairs.join(a, "a").join(b, "b").where(sizes & (both * 9 >= (F.size("x") + F.size("y")) * 4)).select("a", "b")


def _candidates(sets: DataFrame) -> DataFrame:
    """(a, b: keys) of `sets` (key, fp, words) that the index of fingerprints brings together; of the sets of one first word, the first stands for all."""
    prints = store(sets.groupBy("fp").agg(F.min(F.struct("key", "words")).alias("one")).select("fp", "one.*"), "fingerprints")
    same = sets.join(prints.select("fp", F.col("key").alias("first")), "fp").where("first <> key").select(F.col("first").alias("x"), F.col("key").alias("y"))
    return same.union(near_pairs(prints)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _still_apart(bands: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, key, root, first: key, root): the rows of `bands` (band, key) whose sets are still in several of the components `roots` (key, root)."""
    placed = bands.join(roots, "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    first = placed.groupBy("band").agg(F.min(F.struct("key", "root")).alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
    return placed.join(first.where("low <> high").select("band", "first"), "band")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(hash, key, n, pos): the rarest shingles of each set of n, in one order for all sets: by the number of sets that have them, then by hash.

    Two sets at 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of both. Those that no other set has are left out.
    """
    each = sets.select("key", F.explode("hashes").alias("hash"))
    spread = each.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(spread, "hash").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("order"))
    n = F.size("order")
    first = ordered.select("key", n.alias("n"), F.posexplode(F.slice("order", 1, n - F.floor((n * 4 + 4) / 5).cast("int") + 1)).alias("pos", "s"))
    return first.where("s.df > 1").select("s.hash", "key", "n", "pos")


#: Sizes and places at which sets can still be alike to 0.8, if the shingle is the first that they share.
_MAY = "5 * least(n, n2) >= 4 * greatest(n, n2) and 9 * least(n - pos, n2 - pos2) >= 4 * (n + n2)"


def _roots(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("key"), "root")


def _more_links(sets: DataFrame, first: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): with the links `first`, whose components are `roots` (key, root), what connects `sets` as all pairs at 0.8 or more do.

    Prefix filtering: only sets that share one of their rarest shingles are compared. A shingle's sets are compared with
    the one in which it comes first, the nearest to what they have in common; then those that are still outside of
    its largest component are compared with all others of the shingle. So no pair goes unseen, and pairs within a component stay unlisted.
    """

    def placed(roots: DataFrame) -> DataFrame:
        return store(rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")

    rows = store(_prefixes(sets), "prefixes")
    here = placed(roots)
    hub = here.groupBy("hash").agg(F.min(F.struct("pos", "key", "n", "root")).alias("h"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    hubs = hub.select("hash", F.col("h.key").alias("key2"), F.col("h.n").alias("n2"), F.col("h.pos").alias("pos2"), F.col("h.root").alias("root2"))
    near = here.join(hubs, (here.hash == hubs.hash) & (here.root != hubs.root2) & F.expr(_MAY))
    second = first.union(store(_alike(near.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct(), sets), "alike"))
    here = placed(_roots(second))
    parts = here.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("hash").agg(F.max(F.struct("m", "root")).alias("x"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("hash", F.col("x.root").alias("main"))
    open_ = store(here.join(main, "hash"), "open")
    apart = open_.where("root <> main").select(F.col("hash").alias("hash2"), F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("root").alias("root2"))
    rest = open_.join(apart, (open_.hash == apart.hash2) & (open_.root != apart.root2) & F.expr(_MAY))
    return second.union(_alike(rest.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct(), sets))


def near_copies(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, component_id): one row for each row of `docs` (doc_id, text, ...).

    Words and shingles are those of near_duplicates(). Texts link if the Jaccard similarity of their sets of shingles is
    0.8 or more, counted exactly on 64-bit hashes; component_id is the smallest doc_id that can be reached (null only if
    no member has an id). Texts with the same set are one.

    Candidates come from the SimHash index (near_pairs()). What their links leave apart is checked: texts in one of BANDS bands of
    BAND_ROWS minima, all of which a pair at 0.8 misses with a chance of 5e-8 and a closer one with less, are compared with
    the band's first if they are not yet in its component, and what is still apart after that by _more_links().
    """
    # the least id with a hash of its text finds one text of each set again
    rows = docs.select(id_or_none().alias("doc_id"), F.xxhash64(text_bytes()).alias("digest"), text_bytes().alias("text"))
    marks = store(rows.mapInArrow(_signatures(width, seed), "doc_id long, digest long, key long, fp long, words binary, bands array<long>"), "signatures")
    known = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    one = F.min(F.struct("doc_id", "digest"))
    distinct = store(marks.groupBy("key", "bands").agg(F.min(F.struct("fp", "words")).alias("print"), F.min(known).alias("least"), one.alias("one")), "distinct-sets")
    candidates = store(_candidates(distinct.select("key", "print.*")), "candidates")
    each = distinct.select("key", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("band")
    bands = store(each.join(shared, "band"), "bands")
    needed = bands.select("key").union(candidates.select("a")).union(candidates.select("b")).distinct().join(distinct.select("key", "one.doc_id", "one.digest"), "key")
    texts = rows.join(needed, ["doc_id", "digest"]).select("key", "text")
    sets = store(texts.mapInArrow(_sets(width, seed), "key long, hashes array<long>").dropDuplicates(["key"]), "sets")
    first = store(_alike(candidates, sets), "alike")
    missed = _still_apart(bands, _roots(first)).where("root <> first.root").select(F.col("first.key").alias("a"), F.col("key").alias("b"))
    second = first.union(store(_alike(missed.distinct(), sets), "alike"))
    roots = _roots(second)
    pool = _still_apart(bands, roots).select("key").distinct()
    labels = _labels(distinct.select("key", "least"), _more_links(store(sets.join(pool, "key"), "pool"), second, roots), "key")
    return marks.join(labels, "key").select(known.alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component of near_copies(), with all their columns, whatever their names; rows without an id stay, an empty table stays empty."""
    classes = near_copies(docs, width).where("doc_id <> component_id").select(F.col("doc_id").alias("__doc"))
    return apart(docs, lambda rows: rows.join(classes, F.col("doc_id") == F.col("__doc"), "left_anti"))
