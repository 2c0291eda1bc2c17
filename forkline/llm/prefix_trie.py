"""The trie of conversation prefixes, by van Emde Boas recursion.

All sequences are cut at half of the depth. Sequences with the same first half get that half's name, the smallest
conversation that has it; the first halves, one for each name, are the upper trie, and the second halves are forests that
grow from the names. Both are cut again, all of them in the same jobs, until a piece is one turn deep. On the way back the totals
of the forests are grafted on the names they grow from and on what lies above these in the piece. A level takes a
fixed number of joins and sums, and there are as many levels as the logarithm of the longest conversation; a level reads only what reaches its cuts.

A sequence is a set of rows, one for each turn, and never an array; a part of a sequence is told by 128 bits that rows add up to in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .common import partitions, store

_WORD = r"[^\x20\x09-\x0D]+"
#: Conversation ids that go into one row on the way to their digest.
IDS_IN_BLOCK = 4096


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, at, a, b, words): the turns of each conversation, numbered from 1 in the order of turn (null first), then of role and text by their hashes.

    Rows are ranked in ranges and counts are carried between the ranges, so a conversation may span many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), F.xxhash64(role, F.lit(1), text).alias("a"), F.xxhash64(text, F.lit(2), role).alias("b"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")
    )
    order = ["conv", "turn", "a", "b"]
    ranged = said.repartitionByRange(partitions(said.sparkSession), *order).sortWithinPartitions(*order)
    rows = store(ranged.select("conv", "a", "b", "words", F.monotonically_increasing_id().alias("place")), "turns")
    part = F.shiftright("place", 33)
    runs = rows.groupBy("conv", part.alias("part")).agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("m"))
    # a row for each conversation of a range
    before = F.coalesce(F.sum("m").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(F.col("conv").alias("c"), F.col("part").alias("p"), (before - F.col("low") + 1).alias("shift"))
    return rows.join(starts, (rows.conv == starts.c) & (part == starts.p)).select("conv", (F.col("place") + F.col("shift")).alias("at"), "a", "b", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, a, b, words) and (conv): each conversation c with the first h turns of c - c % family, then its own turns after its first h.

    h is the unsigned crc32 of c in decimals, modulo `most`. A conversation may be left without turns.
    """
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"), (F.col("conv") - F.col("conv") % family).alias("source"))
    heads = lengths.select(F.col("conv").alias("head"), F.least("n", F.lit(most - 1)).alias("there"))
    plan = store(lengths.join(heads, lengths.source == heads["head"], "left").select("conv", "h", "source", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")), "plan")
    mine = plan.select(F.col("conv").alias("c"), "h", "taken")
    own = turns.join(mine, turns.conv == mine.c).where("at > h").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "words")
    shared = turns.where((F.col("at") < most) & (F.col("conv") % family == 0)).select(F.col("conv").alias("s"), "at", "a", "b", "words")
    borrowed = shared.join(plan, shared.s == plan.source).where("at <= taken").select("conv", F.col("at").alias("depth"), "a", "b", "words")
    return store(own.union(borrowed), "rebuilt"), plan.select("conv")


def id_digests(members: DataFrame) -> DataFrame:
    """members (key, conv) -> (key, sha): lower-case SHA-256 hex of each key's ids in decimals, in numerical order, joined by commas.

    Ranges of (key, id) pack IDS_IN_BLOCK ids at most into a row, in order; a digest reads its blocks as a stream, so no key's ids are held together.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["key", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) == IDS_IN_BLOCK):
                    yield packed()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield packed()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or k != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if done:
                yield _pairs(done)
                done = []
        if state is not None:
            yield _pairs([(key, state.hexdigest())])

    n = partitions(members.sparkSession)
    packs = members.select("key", "conv").repartitionByRange(n, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(blocks, "key long, first long, ids string")
    return packs.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(digests, "key long, sha string")


def _pairs(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["key", "sha"])


def _classes(turns: DataFrame, everyone: DataFrame) -> DataFrame:
    """(conv, last, w, sha): one row for each distinct sequence, with its smallest conversation, its length, the conversations that have it and the digest of their ids."""
    whole = turns.groupBy("conv").agg(F.max("depth").alias("last"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    known = everyone.join(whole, "conv", "left").select("conv", F.coalesce("last", F.lit(0)).alias("last"), F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    known = store(known, "sequences")
    classes = store(known.groupBy("last", "x", "y").agg(F.min("conv").alias("key"), F.count(F.lit(1)).alias("w")), "classes")
    digests = id_digests(known.join(classes, ["last", "x", "y"]).select("key", "conv"))
    return store(classes.join(digests, "key").select(F.col("key").alias("conv"), "last", "w", "sha"), "classes")


def _level(turns: Column) -> Column:
    """The largest k with 2^k <= `turns`."""
    return (F.length(F.bin(turns)) - 1).cast("int")


def _stored_by(rows: DataFrame, label: str) -> DataFrame:
    """A stored table with a folder for each value of `level`, so that a level reads its own rows only."""
    path = new_path(rows.sparkSession, label)
    rows.write.partitionBy("level").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(rows.columns)


def _of_level(tables: list[DataFrame], level: int) -> DataFrame:
    rows = [t.where(F.col("level") == level).drop("level") for t in tables]
    return reduce(DataFrame.union, rows)


def _cut(strands: DataFrame, half: int) -> DataFrame:
    """One level down: pieces that begin at `base` are cut `half` turns on.

    strands (conv, depth, x, y, words, base, root, last, w): the turns of one conversation for each beginning of a piece that is
    told apart so far, of strands that reach the cut; `root` is the name of what comes before the piece, `last` where the strand ends, `w` how many
    conversations it stands for. Returns them with the level at which each is to be cut next.
    """
    middle = F.col("base") + half
    # those that end at the cut belong to its name, but nothing of theirs goes below
    slices = store(strands.where(F.col("depth") <= middle).groupBy("base", "root", "conv", "last", "w").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")), "slices")
    named = slices.groupBy("base", "root", "x", "y").agg(F.min("conv").alias("name"), F.sum(F.when(F.col("last") > middle, F.col("w")).otherwise(0)).alias("below"))
    names = slices.join(named, ["base", "root", "x", "y"]).select(F.col("base").alias("b"), F.col("conv").alias("c"), "name", "below")
    met = strands.join(names, (F.col("base") == F.col("b")) & (F.col("conv") == F.col("c")))
    through, mine = F.col("last") > middle, F.col("name") == F.col("conv")
    lower, upper = through & (F.col("depth") > middle), through & (F.col("depth") <= middle)
    ended = F.col("last") == middle
    weight = F.when(upper, F.col("below")).when(ended & mine, F.col("w") + F.col("below")).otherwise(F.col("w"))
    cut = met.where(~upper | mine).select(
        "conv", "depth", "x", "y", "words", F.when(lower, middle).otherwise(F.col("base")).alias("base"), F.when(lower, F.col("name")).otherwise(F.col("root")).alias("root"),
        F.when(upper, middle).otherwise(F.col("last")).alias("last"), weight.alias("w"),
    )
    return cut.withColumn("level", F.least(_level(F.col("last") - F.col("base")), _level(F.lit(half)) - 1))


def _graft(tops: DataFrame, spines: DataFrame, half: int) -> tuple[DataFrame, DataFrame]:
    """One level up: totals of the forests below a cut go to the names they grow from and to all above these in the piece.

    tops (depth, parent, leaves, tokens): what the uppermost nodes of the forests have in their subtrees, within pieces of `half` turns.
    spines (conv, depth, above): for each node at the lower end of such a piece, itself and what lies above it in the piece. Returns what is added to
    nodes, and the spines of pieces of twice the size.
    """
    forests = tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv")).agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
    whole = 2 * half
    upper, lower = (spines.where(F.col("depth") % whole == r) for r in (half, 0))
    added = upper.join(forests, ["conv", "depth"]).groupBy("above").agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens")).select("above.conv", "above.depth", "above.parent", "leaves", "tokens")
    # the node at the cut that each lower spine grows from
    feet = lower.where((F.col("above.depth") - 1) % whole == half).select("conv", "depth", F.col("above.parent").alias("foot"))
    over = upper.select(F.col("conv").alias("foot"), (F.col("depth") + half).alias("depth"), "above")
    return added, lower.union(feet.join(over, ["foot", "depth"]).select("conv", "depth", "above"))


def prefix_trie(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row for each distinct beginning of a rebuilt conversation.

    `conversations` has conv_id, turn, role, text and any other columns, which are ignored. Turns go by turn, null first, and
    those with the same turn by hashes of role and text; repeated rows are turns of their own. Null role or text is empty. Rows with
    a null conv_id belong to no conversation and are left out. Conversations are rebuilt as in rebuilt(); one without turns is a member of the root alone.
    A node is the sequence of the first `depth` turns; conv_id is its smallest member. The root (depth 0) has no text and no parent. An empty table
    has no members, so no root, and gives an empty result.
    """
    turns, everyone = rebuilt(ordered_turns(conversations), family, most)
    marked = turns.select("conv", "depth", "words", F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64("b", "depth", "a").alias("y"))
    classes = _classes(marked, everyone)
    size = classes.agg(F.max("last").alias("deep"), F.min("conv").alias("least"), F.sum("w").alias("n")).first()
    levels = max(0, int(size.deep or 0) - 1).bit_length()
    ends = classes.select("conv", "last", "w")
    # of equal sequences one goes down
    strands = marked.join(ends, "conv").select("conv", "depth", "x", "y", "words", F.lit(0).cast("long").alias("base"), F.lit(size.least).cast("long").alias("root"), "last", "w")
    waiting = [_stored_by(strands.withColumn("level", F.least(_level(F.col("last")), F.lit(levels - 1))), "strands")]
    for k in reversed(range(levels)):
        # a strand waits until a cut reaches it
        waiting.append(_stored_by(_cut(_of_level(waiting, k), 1 << k), "strands"))
    strands = _of_level(waiting, -1)
    sha = classes.select("conv", F.col("last").alias("depth"), "sha")
    met = strands.join(sha, ["conv", "depth"], "left")
    found = store(met.groupBy(F.col("depth"), F.col("root").alias("parent"), "x", "y").agg(F.min("conv").alias("conv"), F.sum("w").alias("n_convs"), F.max("words").alias("words"), F.max("sha").alias("sha")), "nodes")
    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv")).agg(F.count(F.lit(1)).alias("n_children"))
    known = store(found.join(children, ["conv", "depth"], "left").select("conv", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "sha"), "nodes")
    # a node's sums are needed at one level: that of the forest in which it is uppermost
    level = F.when(F.col("depth") > 1, _level((F.col("depth") - 1).bitwiseAND(1 - F.col("depth")))).otherwise(-1).alias("level")
    own = known.select("conv", "depth", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("saved").alias("tokens"), level)
    parts = [_stored_by(own, "totals")]
    spines = known.select("conv", "depth", F.struct("depth", "conv", "parent").alias("above"))
    for k in range(levels):
        added, longer = _graft(_of_level(parts, k), spines, 1 << k)
        parts.append(_stored_by(added.select("*", level), "totals"))
        spines = store(longer, "spines") if k < levels - 1 else longer
    totals = store(reduce(DataFrame.union, parts).groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens")), "totals")
    sums = totals.select("conv", "depth", "leaves", "tokens")
    nothing = hashlib.sha256(b"").hexdigest()
    below = known.join(sums, ["conv", "depth"]).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"), F.coalesce("sha", F.lit(nothing)).alias("ends_sha256")
    )
    # the root: what grows from it, and the conversations without turns
    grows = totals.where("depth = 1").agg(F.count(F.lit(1)).alias("c"), F.sum("leaves").alias("l"), F.sum("tokens").alias("t"), F.lit(None).cast("string").alias("sha"))
    empty = classes.where("last = 0").agg(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.max("sha"))
    root = grows.union(empty).agg(F.max("c").alias("c"), F.max("l").alias("l"), F.max("t").alias("t"), F.max("sha").alias("sha")).where(F.lit(size.n is not None)).select(
        F.lit(size.least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(size.n).cast("long").alias("n_convs"),
        F.col("c").alias("n_children"), F.coalesce("l", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("t", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"),
    )
    return below.union(root)
