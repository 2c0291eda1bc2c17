"""Counts on part sets: long tables of events by sample.

counts(gene, part, sample, grp, cnt). Samples are the columns of an experiment: few, and the same for all genes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More samples than any experiment has: their list is read by the driver.
MOST_SAMPLES = 100_000


def sample_list(counts: DataFrame) -> Column:
    """array<struct<sample, grp>> of all samples, as a literal."""
    rows = counts.select("sample", "grp").distinct().orderBy("sample", "grp").limit(MOST_SAMPLES + 1).collect()
    if len(rows) > MOST_SAMPLES:
        raise ValueError("too many samples")
    return F.array(*(F.struct(F.lit(r.sample).alias("sample"), F.lit(r.grp).alias("grp")) for r in rows))


def sum_over_parts(lists: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """lists (keys..., gene, role, parts array) -> keys, gene, role, sample, grp, cnt: the sum over the listed parts in each sample.

    A null list gives null; a listed part without counts adds 0. Genes without any counts give no rows. Counts are
    summed by part and sample first, and by list before samples that lack them are filled in.
    """
    totals = counts.groupBy("gene", "part", "sample").agg(F.sum("cnt").alias("cnt"))
    parts = lists.select(*keys, "gene", "role", F.explode(F.array_distinct("parts")).alias("part"))
    summed = parts.join(totals, ["gene", "part"]).groupBy(*keys, "gene", "role", "sample").agg(F.sum("cnt").alias("cnt"))
    known = lists.join(counts.select("gene").distinct(), "gene", "left_semi")
    grid = known.select(*keys, "gene", "role", F.col("parts").isNull().alias("missing"), F.inline(sample_list(counts)))
    joined = grid.join(summed, [*keys, "gene", "role", "sample"], "left")
    return joined.select(*keys, "gene", "role", "sample", "grp", F.when(~F.col("missing"), F.coalesce("cnt", F.lit(0))).alias("cnt"))


def _roles(events: DataFrame, roles: dict[str, str]) -> DataFrame:
    """events with one list column for each role -> one row for each role."""
    each = F.explode(F.array(*(F.struct(F.lit(role).alias("role"), F.col(name).alias("parts")) for role, name in roles.items())))
    return events.select("gene", "event", each.alias("r")).select("gene", "event", "r.role", "r.parts")


def count_bipartitions(events: DataFrame, counts: DataFrame) -> DataFrame:
    """events (gene, event, ref, diff1, diff2: arrays of parts or null) -> gene, event, sample, grp, ref, diff1, diff2.

    Events with neither side go. A gene stays if the mean of a side of one of its events is above 0; a missing mean counts as such.
    """
    some = events.where("diff1 is not null or diff2 is not null")
    long = sum_over_parts(_roles(some, {"ref": "ref", "diff1": "diff1", "diff2": "diff2"}), counts, ["event"])
    wide = long.groupBy("gene", "event", "sample", "grp").pivot("role", ["ref", "diff1", "diff2"]).agg(F.max("cnt"))
    means = wide.groupBy("gene", "event").agg(F.avg("diff1").alias("m1"), F.avg("diff2").alias("m2"))
    # null or true is true, null or false is unknown and passes like true
    genes = means.where(F.coalesce((F.col("m1") > 0) | (F.col("m2") > 0), F.lit(True))).select("gene").distinct()
    return wide.join(genes, "gene", "left_semi")


def count_both_sides(events: DataFrame, counts: DataFrame) -> DataFrame:
    """Each side an event of its own: gene, event (`<event>_s1`, `<event>_s2`), sample, grp, ref, diff, n."""
    side = F.explode(F.array(F.struct(F.lit("_s1").alias("s"), F.col("diff1").alias("diff")), F.struct(F.lit("_s2").alias("s"), F.col("diff2").alias("diff"))))
    split = events.select("gene", "event", "ref", side.alias("x")).where("x.diff is not null")
    named = split.select("gene", F.concat(F.col("event").cast("string"), "x.s").alias("event"), "ref", F.col("x.diff").alias("diff"))
    long = sum_over_parts(_roles(named, {"ref": "ref", "diff": "diff"}), counts, ["event"])
    wide = long.groupBy("gene", "event", "sample", "grp").pivot("role", ["ref", "diff"]).agg(F.max("cnt"))
    return wide.withColumn("n", F.col("ref") + F.col("diff"))


def count_multinomial(splits: DataFrame, counts: DataFrame) -> DataFrame:
    """splits (gene, event, ref, groups) -> gene, event, type (ref, setdiff<k>), sample, grp, cnt; groups without parts of their own count 0, a blank reference is left out."""
    groups = splits.select("gene", "event", F.posexplode("groups").alias("k", "g")).select("gene", "event", F.concat(F.lit("setdiff"), F.col("k") + 1).alias("role"), F.col("g.diff").alias("parts"))
    refs = splits.where("size(ref) > 0").select("gene", "event", F.lit("ref").alias("role"), F.col("ref").alias("parts"))
    return sum_over_parts(groups.union(refs), counts, ["event"]).where("cnt is not null").withColumnRenamed("role", "type")


def type_means(long: DataFrame) -> DataFrame:
    """(gene, event, type, mean) of a long count table."""
    return long.groupBy("gene", "event", "type").agg(F.avg("cnt").alias("mean"))


def unpivot_counts(wide: DataFrame, names: list[str]) -> DataFrame:
    """One column for each count -> (gene, event, sample, grp, type, cnt)."""
    return wide.unpivot(["gene", "event", "sample", "grp"], names, "type", "cnt")


# --- junctions -------------------------------------------------------------------------------------------------


def junction_matrix(junctions: DataFrame, use_multi: bool = False) -> DataFrame:
    """(chrom, start, end, sample, grp, cnt): reads across each junction; a junction that a sample lacks has no row and counts 0."""
    n = F.col("n_uniq") + F.col("n_multi") if use_multi else F.col("n_uniq")
    return junctions.groupBy("chrom", "start", "end", "sample", "grp").agg(F.sum(n).alias("cnt"))


def _inside(splits: DataFrame, introns: DataFrame) -> DataFrame:
    """Each split with the introns between nodes of its own. They meet by gene alone, so that rows that are dealt by gene stay where they are."""
    return splits.join(introns, "gene").where(F.array_contains("nodes", F.col("a")) & F.array_contains("nodes", F.col("b")))


def label_introns(splits: DataFrame, introns: DataFrame) -> DataFrame:
    """splits (gene, event, nodes array, txs1, txs2) and introns (gene, a, b, chrom, from_pos, to_pos, txs) -> gene, event, diff1, diff2, ref.

    Each is an array of struct<chrom, start, end>, or null: introns within the bubble's nodes that paths of one side
    only, of the other only, or of both use. Without introns, or if a side has no path in the gene's introns, all are null.
    """
    inside = _inside(splits, introns)
    key = F.struct("chrom", F.least("from_pos", "to_pos").alias("start"), F.greatest("from_pos", "to_pos").alias("end"))
    one, two = F.arrays_overlap("txs", "txs1"), F.arrays_overlap("txs", "txs2")
    gather = lambda cond: F.array_sort(F.collect_set(F.when(cond & F.col("from_pos").isNotNull() & F.col("to_pos").isNotNull(), key)))
    got = inside.groupBy("gene", "event").agg(gather(one & ~two).alias("diff1"), gather(~one & two).alias("diff2"), gather(one & two).alias("ref"))
    blank = lambda name: F.when(F.size(name) > 0, F.col(name)).alias(name)
    return splits.select("gene", "event").join(got.select("gene", "event", blank("diff1"), blank("diff2"), blank("ref")), ["gene", "event"], "left")


def sum_junctions(lists: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """lists (keys..., gene, role, parts array<struct<chrom, start, end>>) -> as sum_over_parts(), over junctions; each is looked up with its end and the end less one."""
    # told apart as rows: arrays of structs are searched from end to end for each of their members
    each = lists.select(*keys, "gene", "role", F.explode("parts").alias("j")).select(*keys, "gene", "role", "j.chrom", "j.start", F.explode(F.array("j.end", F.col("j.end") - 1)).alias("end"))
    wanted = each.distinct()
    # a junction's samples are one row, so that it is looked up once
    packed = matrix.groupBy("chrom", "start", "end").agg(F.collect_list(F.struct("sample", "cnt")).alias("in"))
    summed = wanted.join(packed, ["chrom", "start", "end"]).select(*keys, "gene", "role", F.inline("in")).groupBy(*keys, "gene", "role", "sample").agg(F.sum("cnt").alias("cnt"))
    grid = lists.select(*keys, "gene", "role", F.col("parts").isNull().alias("missing"), F.inline(sample_list(matrix)))
    joined = grid.join(summed, [*keys, "gene", "role", "sample"], "left")
    return joined.select(*keys, "gene", "role", "sample", "grp", F.when(~F.col("missing"), F.coalesce("cnt", F.lit(0))).alias("cnt"))


def count_bipartition_junctions(labels: DataFrame, matrix: DataFrame) -> DataFrame:
    """labels (gene, event, diff1, diff2, ref) -> gene, event, sample, grp, diff1, diff2, ref; ref is 0 where no junction is shared, events without either side go."""
    some = labels.where("diff1 is not null or diff2 is not null")
    long = sum_junctions(_roles(some, {"ref": "ref", "diff1": "diff1", "diff2": "diff2"}), matrix, ["event"])
    wide = long.groupBy("gene", "event", "sample", "grp").pivot("role", ["ref", "diff1", "diff2"]).agg(F.max("cnt"))
    return wide.withColumn("ref", F.coalesce("ref", F.lit(0)))


def count_split_junctions(splits: DataFrame, introns: DataFrame, matrix: DataFrame) -> DataFrame:
    """count_bipartition_junctions() of label_introns(splits, introns): gene, event, sample, grp, ref, diff1, diff2, one event for each (gene, event) of splits.

    No lists are made and looked up: an intron takes the counts of its junctions (the one with its end, and that with the end less one) along to the
    splits of its gene, where they are told apart and summed. Only introns and junctions are dealt anew, once there and back.
    """
    samples, zero = sample_list(matrix), F.lit(0).cast(matrix.agg(F.sum("cnt")).schema[0].dataType)
    packed = matrix.groupBy("chrom", "start", "end").agg(F.collect_list(F.struct("sample", "cnt")).alias("in"))
    of = lambda s: F.aggregate(F.filter("in", lambda x: x["sample"] == s["sample"]), zero, lambda n, x: n + F.coalesce(x["cnt"], zero))
    packed = packed.select("chrom", "start", "end", F.transform(samples, of).alias("cnts"))
    placed = introns.where("from_pos is not null and to_pos is not null").select("gene", "a", "b", "txs", "chrom", F.least("from_pos", "to_pos").alias("start"), F.greatest("from_pos", "to_pos").alias("stop"))
    looked = placed.select("*", F.explode(F.array(F.col("stop"), F.col("stop") - 1)).alias("end")).join(packed, ["chrom", "start", "end"], "left").where("cnts is not null or end = stop").drop("stop")
    one, two = F.arrays_overlap("txs", "txs1"), F.arrays_overlap("txs", "txs2")
    role = F.when(one & two, "ref").when(one & ~two, "diff1").when(~one & two, "diff2")
    inside = _inside(splits.select("gene", "event", "nodes", "txs1", "txs2"), looked).select("gene", "event", role.alias("role"), "chrom", "start", "end", "cnts").where("role is not null")
    # a junction that is an intron's, and another one's with the end less one, counts once
    each = inside.groupBy("gene", "event", "role", "chrom", "start", "end").agg(F.first("cnts").alias("cnts"))
    rows = each.select("gene", "event", "role", F.inline(F.transform(samples, lambda s, i: F.struct(s["sample"].alias("sample"), s["grp"].alias("grp"), F.coalesce(F.get("cnts", i), zero).alias("cnt")))))
    sums = rows.groupBy("gene", "event", "sample", "grp").agg(*(F.sum(F.when(F.col("role") == r, F.col("cnt"))).alias(r) for r in ("ref", "diff1", "diff2")))
    return sums.where("diff1 is not null or diff2 is not null").withColumn("ref", F.coalesce("ref", zero))
