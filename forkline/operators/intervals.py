"""Intervals: disjoint parts, overlapping genes, and reads counted on parts. Coordinates are closed on both sides.

Overlaps are found by equal keys: an interval is listed under each bin of positions that it touches, and a pair of
intervals counts in the first bin that both have. Bins are about as wide as the intervals are long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import save


def _bins(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))


def bin_width(rows: DataFrame) -> int:
    """The power of two from 16 on that is next above the mean length of the intervals: an interval then touches two or three bins."""
    mean = rows.agg(F.avg(F.col("end") - F.col("start") + 1)).first()[0] or 1
    return max(16, 1 << math.ceil(math.log2(mean)))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Rows of a and b (keys..., start, end, ...) whose intervals have a position in common; b's interval becomes start2, end2."""
    width = width or bin_width(b)
    other = _bins(b, width).withColumnsRenamed({"start": "start2", "end": "end2"})
    joined = _bins(a, width).join(other, [*keys, "bin"])
    first = F.floor(F.greatest("start", "start2") / width) == F.col("bin")
    return joined.where((F.col("start") <= F.col("end2")) & (F.col("start2") <= F.col("end")) & first).drop("bin")


#: Positions of a stretch that one window works through.
STRETCH = 1 << 16


def exonic_parts(exons: DataFrame, by: list[str] | None = None) -> DataFrame:
    """exons (gene, tx, chrom, strand, start, end) -> chrom, strand[, by], start, end, genes, txs: the steps between all starts and ends that a transcript covers."""
    keys = ["chrom", "strand", *(by or [])]
    cuts = exons.select(*keys, F.explode(F.array(F.col("start"), F.col("end") + 1)).alias("start")).distinct()
    # windows run within stretches of a chromosome; the first cut of the next stretch follows the last one of each
    cuts = cuts.withColumn("stretch", F.floor(F.col("start") / STRETCH))
    onward = cuts.groupBy(*keys, "stretch").agg(F.min("start").alias("first"))
    onward = onward.select(*keys, "stretch", F.lead("first").over(W.partitionBy(*keys).orderBy("stretch")).alias("next"))
    ends = F.coalesce(F.lead("start").over(W.partitionBy(*keys, "stretch").orderBy("start")), "next") - 1
    steps = cuts.join(onward, [*keys, "stretch"]).withColumn("end", ends).where("end is not null").drop("stretch", "next")
    covered = overlap_join(steps, exons.select(*keys, "start", "end", F.col("gene").alias("g"), F.col("tx").alias("t")), keys)
    return covered.groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_set("g")).alias("genes"), F.array_sort(F.collect_set("t")).alias("txs"))


def label_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, label: the smallest node that can be reached. Labels jump from root to root, so rounds grow with the logarithm of the longest chain."""
    both = save(edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b")).distinct())
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = save(near.join(jump, "label", "left").select(F.col("a").alias("node"), F.coalesce("further", "label").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def aggregate_genes(parts: DataFrame, merge: bool = True) -> DataFrame:
    """Parts with `gene`: genes that share parts become one, named by all of them joined with +. Without merge, shared parts go."""
    if not merge:
        return parts.where(F.size("genes") == 1).withColumn("gene", F.col("genes")[0])
    shared = parts.where(F.size("genes") > 1)
    edges = shared.select(F.col("genes")[0].alias("a"), F.explode("genes").alias("b")).where("a <> b")
    labels = label_components(edges)
    names = labels.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("node")), "+").alias("name"))
    named = labels.join(names, "label").select(F.col("node").alias("first"), "name")
    rows = parts.withColumn("first", F.col("genes")[0]).join(named, "first", "left")
    return rows.withColumn("gene", F.coalesce("name", "first")).drop("first", "name")


def number_parts(parts: DataFrame) -> DataFrame:
    """Parts with `part` (1, 2, ... by position within the gene) and the gene's extent, gene_start and gene_end."""
    gene = W.partitionBy("gene")
    rows = parts.withColumn("part", F.row_number().over(gene.orderBy("start", "end")))
    return rows.withColumns({"gene_start": F.min("start").over(gene), "gene_end": F.max("end").over(gene)})


def overlapping_genes(parts: DataFrame) -> DataFrame:
    """parts (gene, chrom, strand, start, end) -> gene, label: groups of genes of one strand whose parts overlap; touching ones don't."""
    rows = parts.select("gene", "chrom", "strand", "start", "end")
    met = overlap_join(rows, rows.withColumnRenamed("gene", "other"), ["chrom", "strand"]).where("gene < other")
    return label_components(met.select(F.col("gene").alias("a"), F.col("other").alias("b")).distinct()).withColumnsRenamed({"node": "gene"})


def resolve_overlaps(groups: DataFrame, parts: DataFrame, biotypes: DataFrame) -> DataFrame:
    """gene, label, biotype, n_parts, keep: of each group the protein_coding gene with the most parts stays (any gene if none is); ties by name."""
    sizes = parts.groupBy("gene").agg(F.count(F.lit(1)).alias("n_parts"))
    rows = groups.join(sizes, "gene", "left").join(biotypes.select("gene", "biotype").distinct(), "gene", "left").withColumn("biotype", F.coalesce("biotype", F.lit("unknown")))
    rows = rows.withColumn("n_parts", F.coalesce("n_parts", F.lit(0)))
    best = W.partitionBy("label").orderBy((F.col("biotype") == "protein_coding").desc(), F.col("n_parts").desc(), "gene")
    return rows.withColumn("keep", F.row_number().over(best) == 1)


def biotype_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("biotype").agg(F.count(F.lit(1)).alias("n_genes"), F.count_if("keep").alias("n_kept"))


def several_transcripts(exons: DataFrame, least: int = 2) -> DataFrame:
    """Exons of genes with `least` transcripts or more."""
    genes = exons.groupBy("gene").agg(F.countDistinct("tx").alias("n")).where(F.col("n") >= least)
    return exons.join(genes.drop("n"), "gene", "left_semi")


def aligned_blocks(alignments: DataFrame) -> DataFrame:
    """Alignments with `blocks`, array<struct<start, end>>: the stretches that the CIGAR string matches to the chromosome."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    size = lambda o: F.substring(o, F.lit(1), F.length(o) - 1).cast("int")
    kind = lambda o: F.substring(o, F.length(o), F.lit(1))
    start = F.struct(F.col("pos").alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("blocks"))

    def step(s: Column, o: Column) -> Column:
        match = kind(o).isin("M", "=", "X")
        block = F.struct(s["at"].alias("start"), (s["at"] + size(o) - 1).alias("end"))
        moved = F.when(kind(o).isin("M", "=", "X", "D", "N"), s["at"] + size(o)).otherwise(s["at"])
        return F.struct(moved.alias("at"), F.when(match, F.array_append(s["blocks"], block)).otherwise(s["blocks"]).alias("blocks"))

    return alignments.withColumn("blocks", F.aggregate(ops, start, step)["blocks"])


def _hits(rows: DataFrame, parts: DataFrame, stranded: str) -> DataFrame:
    """(unit, chrom, strand, blocks) -> unit, hits: array<struct<gene, part>> of the parts that its blocks touch."""
    blocks = rows.select("unit", "chrom", "strand", F.inline("blocks"))
    table = parts.select("gene", "part", "chrom", F.col("strand").alias("part_strand"), "start", "end")
    met = overlap_join(blocks, table, ["chrom"])
    if stranded != "no":
        met = met.where(F.col("strand") == F.col("part_strand"))
    return met.groupBy("unit").agg(F.collect_set(F.struct("gene", "part")).alias("hits"))


def _tally(units: DataFrame, hits: DataFrame, parts: DataFrame) -> DataFrame:
    """units (unit, special) -> gene, part, special, cnt: parts without reads count 0; special rows have no part."""
    joined = units.join(hits, "unit", "left")
    genes = F.size(F.array_distinct(F.transform("hits", lambda h: h["gene"])))
    special = F.coalesce("special", F.when(F.col("hits").isNull(), "_empty"), F.when(genes > 1, "_ambiguous"))
    marked = joined.select("hits", special.alias("special")).cache()
    per_part = marked.where("special is null").select(F.inline("hits")).groupBy("gene", "part").agg(F.count(F.lit(1)).alias("cnt"))
    every = parts.select("gene", "part").distinct().join(per_part, ["gene", "part"], "left").select("gene", "part", F.lit(None).cast("string").alias("special"), F.coalesce("cnt", F.lit(0)).alias("cnt"))
    rest = marked.where("special is not null").groupBy("special").agg(F.count(F.lit(1)).alias("cnt"))
    return every.union(rest.select(F.lit(None).cast(every.schema["gene"].dataType), F.lit(None).cast(every.schema["part"].dataType), "special", "cnt"))


def _strand(stranded: str) -> Column:
    forward = (F.col("flag").bitwiseAND(16) == 0) != F.lit(stranded == "reverse")
    second = F.col("flag").bitwiseAND(128) != 0
    return F.when(forward != second, "+").otherwise("-")


def count_reads(alignments: DataFrame, parts: DataFrame, stranded: str = "no", least_quality: int = 10) -> DataFrame:
    """Single-end reads on parts: gene, part, special, cnt. A read counts once for every part that it touches.

    Reads with several alignments are left out; _notaligned, _lowaqual, _empty (no part) and _ambiguous (parts of
    several genes) are counted as special rows. stranded: no, yes or reverse.
    """
    rows = alignments.where("coalesce(nh, 1) <= 1").withColumn("unit", F.monotonically_increasing_id())
    special = F.when(F.col("flag").bitwiseAND(4) != 0, "_notaligned").when(F.col("mapq") < least_quality, "_lowaqual")
    rows = aligned_blocks(rows.withColumns({"special": special, "strand": _strand(stranded)}))
    rows = save(rows.select("unit", "chrom", "strand", "blocks", "special"))
    return _tally(rows.select("unit", "special"), _hits(rows.where("special is null"), parts, stranded), parts)


def count_pairs(alignments: DataFrame, parts: DataFrame, stranded: str = "no", least_quality: int = 10) -> DataFrame:
    """Read pairs on parts: mates of one name are joined, whatever the order of the file, and the parts of both are one set.

    A mate that is not aligned adds nothing; _notaligned if neither is; _lowaqual if all aligned mates are below the
    quality; _ambiguous_readpair_position if the mates are on different chromosomes.
    """
    rows = alignments.where("coalesce(nh, 1) <= 1").withColumns({"aligned": F.col("flag").bitwiseAND(4) == 0, "strand": _strand(stranded)})
    mates = aligned_blocks(rows).groupBy(F.col("read").alias("unit")).agg(
        F.collect_set(F.when(F.col("aligned"), F.col("chrom"))).alias("chroms"), F.max(F.when(F.col("aligned"), F.col("mapq"))).alias("best"),
        F.flatten(F.collect_list(F.when(F.col("aligned"), F.col("blocks")))).alias("blocks"), F.min(F.when(F.col("aligned"), F.col("strand"))).alias("strand"),
    )
    special = F.when(F.size("chroms") == 0, "_notaligned").when(F.size("chroms") > 1, "_ambiguous_readpair_position").when(F.col("best") < least_quality, "_lowaqual")
    pairs = save(mates.select("unit", F.try_element_at("chroms", F.lit(1)).alias("chrom"), "strand", "blocks", special.alias("special")))
    return _tally(pairs.select("unit", "special"), _hits(pairs.where("special is null"), parts, stranded), parts)
