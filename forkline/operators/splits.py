"""Splits of a bubble's variants into competing groups, with the parts that tell the groups apart and those all share.

splits(gene, src, snk, groups array<struct<paths, txs, diff, status>>, ref array<int>): status is `parts`, `none` (no
variant of the group has a part) or `empty` (nothing distinguishes the group).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import intersect_all, part_labels, proximity, union_all


def _status(diff: Column, blank: Column) -> Column:
    return F.when(blank, "none").when(F.size(diff) == 0, "empty").otherwise("parts")


def _side(members: Column, diff: Column, blank: Column, txs: bool = True) -> Column:
    """One side of a split: its variants, the parts that all of them and no other have, and whether none has a part; its transcripts if `txs`."""
    own = [F.array_distinct(F.flatten(F.transform(members, lambda v: v["txs"]))).alias("txs")] if txs else []
    return F.struct(F.transform(members, lambda v: v["inner"]).alias("paths"), *own, diff.alias("diff"), _status(diff, blank).alias("status"))


def _have_txs(bubbles: DataFrame) -> bool:
    """Splits of bubbles that were found without transcripts have none."""
    return "txs" in bubbles.schema["variants"].dataType.elementType.names


def _near(*first: Column) -> Column:
    """The parts that enter the source and leave the sink, where the first paths of all groups have them."""
    return reduce(F.array_intersect, first, F.array(F.col("src") - 1, F.col("snk")))


def _told(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with the columns, where d1 or d2 has a part. The columns are made as a row of their own: a condition on them is then asked of what they are, where the planner would put each of their steps in its place, over and over."""
    made = rows.select("*", F.explode_outer(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("__made"))
    return made.select(*rows.columns, "__made.*").where("size(d1) > 0 or size(d2) > 0")


def _two_sides(rows: DataFrame, *keep: str) -> DataFrame:
    """Splits of rows with two lists of variants, `one` and `two`; step by step, so that no set is worked out twice."""
    parts = lambda side: F.transform(side, lambda v: v["parts"])
    rows = rows.withColumns({"s1": parts("one"), "s2": parts("two")})
    rows = rows.withColumns({"u1": union_all(F.col("s1")), "u2": union_all(F.col("s2")), "c1": intersect_all(F.col("s1")), "c2": intersect_all(F.col("s2"))})
    # what each variant of a side and none of the other has
    told = _told(rows, d1=F.array_sort(F.array_except("c1", "u2")), d2=F.array_sort(F.array_except("c2", "u1")))
    ref = F.array_sort(F.array_union(F.array_intersect("c1", "c2"), _near(F.element_at("one", 1)["rep"], F.element_at("two", 1)["rep"])))
    groups = F.array(*(_side(F.col(side), F.col(diff), F.size(union) == 0) for side, diff, union in (("one", "d1", "u1"), ("two", "d2", "u2"))))
    return told.select("gene", "src", "snk", "n_paths", *keep, groups.alias("groups"), ref.alias("ref"))


#: The most variants that a mask has bits for.
MOST_VARIANTS = 62


def bipartitions(bubbles: DataFrame) -> DataFrame:
    """Every split in two that never parts a variant from one whose parts it contains, once: side 1 holds the first variant.

    Bits of `mask` are side 1. One side or the other is a lower set: with a variant it has all whose parts are a proper
    subset of that one's. Splits without distinguishing parts on either side go. A part tells the sides apart exactly if
    the variants that have it are one of the sides; and those that lack it are a lower set, as what lies in them lacks it
    too. So the splits are those between the variants with and without each part, no more than there are parts, and no
    other set is tried. More than MOST_VARIANTS variants in a bubble are an error.
    """
    long = lambda x: F.lit(x).cast("bigint")
    bit = lambda i: F.call_function("shiftleft", long(1), i)
    whole = F.when(F.col("n_paths") <= MOST_VARIANTS, bit(F.col("n_paths")) - 1).otherwise(F.raise_error(F.lit(f"a bubble has more than {MOST_VARIANTS} variants")))
    parts = F.array_sort(union_all(F.transform("variants", lambda v: v["parts"])))
    users = lambda p: F.aggregate(F.transform("variants", lambda v, i: F.when(F.array_contains(v["parts"], p), bit(i)).otherwise(long(0))), long(0), lambda bits, x: bits.bitwiseOR(x))
    rows = bubbles.withColumns({"__all": whole, "__parts": F.transform(parts, lambda p: F.struct(p.alias("part"), users(p).alias("users")))})
    first = lambda u: F.when(u.bitwiseAND(long(1)) == 1, u).otherwise(F.col("__all").bitwiseXOR(u))
    masks = F.array_distinct(F.transform(F.filter("__parts", lambda x: x["users"] != F.col("__all")), lambda x: first(x["users"])))
    rows = rows.select("*", F.explode_outer(masks).alias("mask")).where("mask is not null")
    rows = rows.withColumns({"one": F.expr("filter(variants, (v, i) -> (mask & shiftleft(1L, i)) <> 0)"), "two": F.expr("filter(variants, (v, i) -> (mask & shiftleft(1L, i)) = 0)")})
    having = lambda mask: F.transform(F.filter("__parts", lambda x: x["users"] == mask), lambda x: x["part"])
    blank = lambda mask: ~F.exists("__parts", lambda x: x["users"].bitwiseAND(mask) != 0)
    mask, rest = F.col("mask"), F.col("__all").bitwiseXOR(F.col("mask"))
    ref = F.array_sort(F.array_union(having(F.col("__all")), _near(F.element_at("one", 1)["rep"], F.element_at("two", 1)["rep"])))
    txs = _have_txs(bubbles)
    groups = F.array(_side(F.col("one"), having(mask), blank(mask), txs), _side(F.col("two"), having(rest), blank(rest), txs))
    return rows.select("gene", "src", "snk", "n_paths", "mask", groups.alias("groups"), ref.alias("ref"))


def pairs(bubbles: DataFrame) -> DataFrame:
    """Every two variants against each other (one, two: their 1-based numbers); pairs without distinguishing parts on either side go."""
    chosen = bubbles.select("gene", "src", "snk", "n_paths", "variants", F.posexplode("variants").alias("i", "v"))
    chosen = chosen.select("gene", "src", "snk", "n_paths", "i", "v", F.posexplode(F.expr("slice(variants, i + 2, n_paths)")).alias("j", "w"))
    sides = chosen.select("gene", "src", "snk", "n_paths", (F.col("i") + 1).alias("one"), (F.col("i") + F.col("j") + 2).alias("two"), "v", "w")
    told = _told(sides, d1=F.array_sort(F.array_except("v.parts", "w.parts")), d2=F.array_sort(F.array_except("w.parts", "v.parts")))
    ref = F.array_sort(F.array_union(F.array_intersect("v.parts", "w.parts"), _near(F.col("v.rep"), F.col("w.rep"))))
    side = lambda v, diff: F.struct(F.array(f"{v}.inner").alias("paths"), F.array_distinct(f"{v}.txs").alias("txs"), F.col(diff).alias("diff"), _status(F.col(diff), F.size(f"{v}.parts") == 0).alias("status"))
    return told.select("gene", "src", "snk", "n_paths", "one", "two", F.array(side("v", "d1"), side("w", "d2")).alias("groups"), ref.alias("ref"))


def multinomial(bubbles: DataFrame) -> DataFrame:
    """Each variant is a group of its own; rows in which a group has parts but none of its own go."""
    rows = bubbles.select("gene", "src", "snk", "n_paths", "variants", F.array_sort(F.flatten(F.transform("variants", lambda v: F.array_distinct(v["parts"])))).alias("__each"))
    # parts in order, each once for every variant that has it: those unlike both neighbours are of one variant alone
    alone = F.expr("filter(__each, (p, i) -> not coalesce(get(__each, i - 1) = p, false) and not coalesce(get(__each, i + 1) = p, false))")
    own = rows.select("*", F.explode_outer(F.array(alone)).alias("__alone")).drop("__each")
    all_told = F.forall("variants", lambda v: (F.size(v["parts"]) == 0) | F.arrays_overlap(v["parts"], F.col("__alone")))
    diff = lambda v: F.array_sort(F.array_intersect(v["parts"], F.col("__alone")))
    txs = lambda v: [F.array_distinct(v["txs"]).alias("txs")] if _have_txs(bubbles) else []
    group = lambda v: F.struct(F.array(v["inner"]).alias("paths"), *txs(v), diff(v).alias("diff"), F.when(F.size(v["parts"]) == 0, "none").otherwise("parts").alias("status"))
    near = F.array_intersect(F.array(F.col("src") - 1, F.col("snk")), intersect_all(F.transform("variants", lambda v: v["rep"])))
    ref = F.array_sort(F.array_union(intersect_all(F.transform("variants", lambda v: v["parts"])), near))
    return own.where(all_told).select("gene", "src", "snk", "n_paths", F.transform("variants", group).alias("groups"), ref.alias("ref"))


def one_vs_rest(bubbles: DataFrame) -> DataFrame:
    """(gene, src, snk, one, txs1, txs2, path1, paths2): each variant against all others, paths only."""
    rows = bubbles.select("gene", "src", "snk", "variants", F.posexplode("variants").alias("i", "v"))
    rest = F.expr("filter(variants, (w, j) -> j <> i)")
    return rows.select("gene", "src", "snk", (F.col("i") + 1).alias("one"), F.col("v.txs").alias("txs1"), F.array_distinct(F.flatten(F.transform(rest, lambda w: w["txs"]))).alias("txs2"), F.col("v.inner").alias("path1"), F.transform(rest, lambda w: w["inner"]).alias("paths2"))


def chosen_vs_rest(bubbles: DataFrame, chosen: DataFrame) -> DataFrame:
    """(gene, src, snk, txs1, txs2, n1, n2): in each bubble the variants with a chosen path (gene, tx) against those without one, where both occur."""
    own = chosen.groupBy("gene").agg(F.collect_set("tx").alias("chosen"))
    rows = bubbles.join(own, "gene").withColumn("one", F.filter("variants", lambda v: F.arrays_overlap(v["txs"], F.col("chosen")))).withColumn("two", F.filter("variants", lambda v: ~F.arrays_overlap(v["txs"], F.col("chosen"))))
    txs = lambda side: F.array_sort(F.array_distinct(F.flatten(F.transform(side, lambda v: v["txs"]))))
    return rows.where("size(one) > 0 and size(two) > 0").select("gene", "src", "snk", txs("one").alias("txs1"), txs("two").alias("txs2"), F.size("one").alias("n1"), F.size("two").alias("n2"))


def changed_vs_constant(bubbles: DataFrame, changed: DataFrame, constant: DataFrame) -> DataFrame:
    """Splits of the variants of changed paths against those of constant ones (gene, tx each), where both occur apart."""
    a, b = (t.groupBy("gene").agg(F.collect_set("tx").alias(name)) for t, name in ((changed, "a"), (constant, "b")))
    has = lambda v, name: F.arrays_overlap(v["txs"], F.col(name))
    rows = bubbles.join(a, "gene").join(b, "gene").withColumn("one", F.filter("variants", lambda v: has(v, "a") & ~has(v, "b"))).withColumn("two", F.filter("variants", lambda v: has(v, "b") & ~has(v, "a")))
    return _two_sides(rows.where("size(one) > 0 and size(two) > 0"))


def dedupe(splits: DataFrame, order: list[str | Column]) -> DataFrame:
    """One row for each gene and tuple of distinguishing parts: fewest reference parts, then those nearest to them, then the first in `order`; numbered as `event` within the gene.

    A gene's splits that agree are put in order where they are; the second window finds the gene's rows in its order already.
    """
    diffs = F.transform("groups", lambda g: F.when(g["status"] == "none", F.array(F.lit(-1))).otherwise(g["diff"]))
    near = proximity(F.col("ref"), F.flatten(F.transform("groups", lambda g: g["diff"])))
    keyed = splits.withColumn("__diffs", diffs).withColumn("__near", near)
    first = F.row_number().over(W.partitionBy("gene", "__diffs").orderBy(F.size("ref"), "__near", *order))
    kept = keyed.withColumn("__first", first).where("__first = 1")
    return kept.withColumn("event", F.row_number().over(W.partitionBy("gene").orderBy("__diffs"))).drop("__diffs", "__near", "__first")


def classify(splits: DataFrame, root: int, leaf: int) -> DataFrame:
    """`splits` with class: TSSTTS if the source is the root or the sink the leaf, else internal."""
    return splits.withColumn("class", F.when((F.col("src") == root) | (F.col("snk") == leaf), "TSSTTS").otherwise("internal"))


def as_text(splits: DataFrame, n_groups: int) -> DataFrame:
    """The wide text form: ref_ex_part, and setdiff<k>, transcripts<k>, path<k> for each group; blank where there is no such group."""
    def one(k: int) -> list[Column]:
        g = F.try_element_at("groups", F.lit(k))
        diff = F.when(g["status"] == "none", "no_exon_part").when(g["status"] == "empty", "{}").otherwise(part_labels(g["diff"]))
        path = F.array_join(F.transform(g["paths"], lambda p: F.array_join(F.concat(F.array("src"), p, F.array("snk")), "-")), ", ")
        texts = {f"setdiff{k}": diff, f"transcripts{k}": F.array_join(g["txs"], ", "), f"path{k}": path}
        return [F.coalesce(c, F.lit("")).alias(n) for n, c in texts.items()]

    return splits.select(*[c for c in splits.columns if c not in ("groups", "ref")], part_labels(F.col("ref")).alias("ref_ex_part"), *reduce(lambda a, k: a + one(k), range(1, n_groups + 1), []))


def focal_report(bubbles: DataFrame) -> DataFrame:
    """(gene, src, snk, kind, only1, only2, either): of bubbles with two variants the parts of one only; Complex with more."""
    p = [F.element_at("variants", k)["parts"] for k in (1, 2)]
    two = F.col("n_paths") == 2
    only = [F.when(two, part_labels(F.array_except(p[i], p[1 - i]))).otherwise("N/A") for i in (0, 1)]
    either = F.when(two, part_labels(F.array_union(F.array_except(p[0], p[1]), F.array_except(p[1], p[0])))).otherwise("N/A")
    return bubbles.select("gene", "src", "snk", F.when(two, "Binary").otherwise("Complex").alias("kind"), only[0].alias("only1"), only[1].alias("only2"), either.alias("either"))
