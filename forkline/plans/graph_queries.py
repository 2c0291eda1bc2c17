"""Registered queries over graphs that are built from exons: annotation files, parts, edges, walks, introns, events of other tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import part_labels
from ..operators import counts, graph, intervals, mapping, splits
from ..operators import bubbles as b
from ..sources import annotation
from ..sources.shared import new_path, save
from .queries import MAX_SINGLE, QUERIES, _text, node_lists, query
from .views import LEAF, ROOT, view


def _exons(spark: SparkSession, sf: str) -> DataFrame:
    """v_chains from a row for each path: every two nodes after the root are the ends of an exon."""
    up = node_lists(spark, sf).select("gene", "tx", F.expr(f"filter(nodes, x -> x > {ROOT})").alias("up")).where("size(up) > 1")
    rows = up.selectExpr("gene", "tx", "floor(gene / 10) * 90 + floor(gene / 30) * 200 as place", "inline(transform(sequence(1, cast(floor(size(up) / 2) as int)), k -> struct(up[2 * k - 2] as a, up[2 * k - 1] as b)))")
    return rows.selectExpr(
        "gene", "tx", "'c' || cast(gene % 5 as string) as chrom", "case when gene % 2 = 0 then '+' else '-' end as strand",
        "cast(place + case when gene % 2 = 0 then a * 10 + 1 else 121 - b * 10 end as int) as start", "cast(place + case when gene % 2 = 0 then b * 10 else 120 - a * 10 end as int) as `end`",
    )


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_graph(_exons(spark, sf))


def _parts(exons: DataFrame) -> DataFrame:
    return intervals.number_parts(intervals.exonic_parts(exons, ["gene"])).drop("gene_start", "gene_end")


def _all_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Exons, introns and parts."""
    return graph.build_graph(_exons(spark, sf), parts=True)


# --- parts and overlapping genes ----------------------------------------------------------------------------------


def _named_parts(spark: SparkSession, sf: str, merge: bool) -> DataFrame:
    exons = _exons(spark, sf).withColumn("gene", F.col("gene").cast("string"))
    rows = intervals.number_parts(intervals.aggregate_genes(intervals.exonic_parts(exons), merge))
    return rows.select("gene", "part", "chrom", "strand", "start", "end", F.size("txs").alias("n_txs"), "gene_start", "gene_end")


@query
def exonic_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _named_parts(spark, sf, merge=False)


@query
def exonic_parts_merged(spark: SparkSession, sf: str) -> DataFrame:
    return _named_parts(spark, sf, merge=True)


@query
def biotype_counts(spark: SparkSession, sf: str) -> DataFrame:
    exons = _exons(spark, sf)
    kinds = spark.read.parquet(f"{sf}/customer.parquet").where("c_nationkey < 20").select(F.col("c_custkey").alias("gene"), F.when(F.col("c_nationkey") % 3 == 0, "protein_coding").otherwise(F.concat(F.lit("kind"), (F.col("c_nationkey") % 5).cast("string"))).alias("biotype"))
    return intervals.biotype_counts(intervals.resolve_overlaps(intervals.overlapping_genes(exons), _parts(exons), kinds))


@query
def several_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.several_transcripts(_exons(spark, sf), 12)


@query
def pair_counting(spark: SparkSession, sf: str) -> DataFrame:
    """Exons as mates of two blocks, the transcript's name being the pair's: counted by strand on the parts of genes."""
    exons = _exons(spark, sf)
    first = F.col("start") == F.min("start").over(b.W.partitionBy("tx"))
    half = F.floor((F.col("end") - F.col("start") + 1) / 2).cast("int")
    flag = F.when(first, 64).otherwise(128) + F.when((F.col("strand") == "+") == first, 0).otherwise(16) + F.when(F.col("tx") % 11 == 0, 4).otherwise(0)
    mates = exons.select(
        F.col("tx").cast("string").alias("read"), flag.alias("flag"), F.when((F.col("tx") % 13 == 0) & ~first, "other").otherwise(F.col("chrom")).alias("chrom"), F.col("start").alias("pos"),
        (F.col("tx") % 17 + 5).cast("int").alias("mapq"), F.concat(half.cast("string"), F.lit("M2N"), (half - 2).cast("string"), F.lit("M")).alias("cigar"), F.when(F.col("tx") % 19 == 0, 2).otherwise(1).alias("nh"),
    )
    return intervals.count_pairs(mates, _parts(exons), stranded="yes")


# --- graphs -------------------------------------------------------------------------------------------------------


@query
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_names(_edges(spark, sf)).select("gene", "a", "b", "kind", "from_pos", "to_pos", "name", F.size("txs").alias("n_txs"))


@query
def graph_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _all_edges(spark, sf).where("kind = 'ex_part'").select("gene", "a", "b", "part", "from_pos", "to_pos", F.size("txs").alias("n_txs"))


@query
def graph_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.transcripts(_edges(spark, sf))


@query
def graph_tx_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.tx_nodes(_edges(spark, sf))


@query
def graph_tx_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.tx_paths(save(_edges(spark, sf)))
    return rows.select("gene", "tx", _text("nodes").alias("nodes"), part_labels(F.col("parts")).alias("parts"))


@query
def graph_part_steps(spark: SparkSession, sf: str) -> DataFrame:
    return graph.part_of_step(_all_edges(spark, sf))


@query
def graph_node_types(spark: SparkSession, sf: str) -> DataFrame:
    return graph.node_types(save(_edges(spark, sf)))


@query
def graph_node_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Each transcript's chain of nodes by exons and introns, and by parts and introns."""
    edges = save(_all_edges(spark, sf))
    both = [graph.node_paths(edges, parts).select("gene", "tx", _text("nodes").alias(name)) for name, parts in (("nodes", False), ("part_nodes", True))]
    return both[0].join(both[1], ["gene", "tx"])


def _walks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The exon and intron edges along each transcript's chain; the path's number is the transcript's."""
    edges = save(_all_edges(spark, sf))
    return save(graph.path_edges(graph.node_paths(edges).withColumnRenamed("tx", "path_id"), edges)), edges


@query
def walk_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _walks(spark, sf)[0].select("gene", "path_id", "pos", "a", "b", "kind")


@query
def walk_parts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.exon_parts(*_walks(spark, sf))


@query
def walk_users(spark: SparkSession, sf: str) -> DataFrame:
    return graph.paths_of_edges(*_walks(spark, sf)).select("gene", "path_id", _text("txs").alias("txs"))


@query
def path_containment(spark: SparkSession, sf: str) -> DataFrame:
    return graph.containment(graph.tx_paths(save(_edges(spark, sf))).select("gene", F.col("tx").alias("path_id"), "parts"))


# --- introns and junctions ----------------------------------------------------------------------------------------


def _introns(spark: SparkSession, sf: str) -> DataFrame:
    chrom = F.concat(F.lit("c"), (F.col("gene") % 5).cast("string"))
    return _edges(spark, sf).where("kind = 'in'").select("gene", "a", "b", chrom.alias("chrom"), "from_pos", "to_pos", "txs")


def _transcript_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Each transcript as an event against the other ones of its gene, over the transcript's own nodes."""
    paths = graph.node_paths(_edges(spark, sf))
    every = paths.groupBy("gene").agg(F.collect_list("tx").alias("all"))
    return paths.join(every, "gene").select("gene", F.col("tx").alias("event"), "nodes", F.array("tx").alias("txs1"), F.array_except("all", F.array("tx")).alias("txs2"))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return counts.label_introns(_transcript_splits(spark, sf), _introns(spark, sf))


@query
def intron_labels(spark: SparkSession, sf: str) -> DataFrame:
    names = lambda c: F.array_join(F.transform(c, lambda j: F.concat_ws(":", j["chrom"], j["start"].cast("string"), j["end"].cast("string"))), ",")
    return _labels(spark, sf).select("gene", "event", *(names(c).alias(c) for c in ("diff1", "diff2", "ref")))


def _junction_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Saved, as its samples are listed before it is looked up."""
    used = _introns(spark, sf).select("chrom", F.least("from_pos", "to_pos").alias("start"), F.greatest("from_pos", "to_pos").alias("end"), F.explode("txs").alias("tx"))
    return save(counts.junction_matrix(used.select("chrom", "start", "end", (F.col("tx") % 4).cast("int").alias("sample"), F.lit("g").alias("grp"), (F.col("tx") % 3).alias("n_uniq"), F.lit(1).alias("n_multi"))))


@query
def junction_bipartition(spark: SparkSession, sf: str) -> DataFrame:
    wide = counts.count_split_junctions(_transcript_splits(spark, sf), _introns(spark, sf), _junction_counts(spark, sf))
    return wide.select("gene", "event", "sample", "grp", "ref", "diff1", "diff2")


@query
def junction_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return counts.unpivot_counts(junction_bipartition(spark, sf), ["ref", "diff1", "diff2"])


# --- events of a junction tool ------------------------------------------------------------------------------------


def _tool_table(edges: DataFrame, whole_exons: bool = False) -> DataFrame:
    """Skipped exons, retained introns and alternative sites of all genes' graphs, in a junction tool's 0-based coordinates.

    With whole_exons a retained intron is an event for each exon that holds it, with that exon's ends. The exons and introns of a gene
    are two lists, and its events are told from them where they are.
    """
    names = ("exonStart_0base", "exonEnd", "upstreamEE", "downstreamES", *(("riExonStart_0base", "riExonEnd", "upstreamES", "downstreamEE") if whole_exons else ()), *mapping.COORDINATES[4:])
    plus = F.col("gene") % 2 == 0

    def event(kind: str, nodes: list[Column], **at: Column) -> Column:
        label = F.concat_ws("_", F.lit(kind), F.col("gene").cast("string"), *(n.cast("string") for n in nodes))
        return F.struct(label.alias("event_id"), F.lit(kind).alias("etype"), *((at[c] - 1 if c in at else F.lit(None)).cast("int").alias(c) for c in names))

    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("a", "b", F.col("from_pos").alias("p"), F.col("to_pos").alias("q"))))
    lists = edges.where("kind in ('ex', 'in')").groupBy("gene").agg(of("ex").alias("ex"), of("in").alias("into"))  # a gene's edges
    lists = lists.selectExpr(
        "*",
        # exons with the nearest intron before and after them, where there are both
        """filter(transform(ex, x -> struct(x.a, x.b, x.p, x.q,
             array_max(transform(filter(into, i -> i.b = x.a), i -> struct(i.a as n, i.p as x))).x as before, array_min(transform(filter(into, i -> i.a = x.b), i -> struct(i.b as n, i.q as x))).x as after)),
             y -> y.before is not null and y.after is not null) as skipped""",
        # exons with each intron that ends where they begin, and with each one that begins where they end
        "flatten(transform(ex, x -> transform(filter(into, i -> i.b = x.a), i -> struct(i.a as f, x.a, x.b, x.p, x.q, i.p as x)))) as entered",
        "flatten(transform(ex, x -> transform(filter(into, i -> i.a = x.b), i -> struct(x.a, x.b, i.b as t, x.p, x.q, i.q as x)))) as left_",
    )
    low, high = (lambda e: F.least(e["p"], e["q"])), (lambda e: F.greatest(e["p"], e["q"]))

    se = F.transform("skipped", lambda e: event("SE", [e["a"], e["b"]], exonStart_0base=low(e), exonEnd=high(e), upstreamEE=F.least(e["before"], e["after"]), downstreamES=F.greatest(e["before"], e["after"])))

    holds = lambda e, i: (e["a"] < i["a"]) & (i["b"] < e["b"])
    if whole_exons:
        of_exon = lambda i, e: event("RI", [i["a"], i["b"], e["a"], e["b"]], upstreamEE=low(i), downstreamES=high(i), riExonStart_0base=low(e), riExonEnd=high(e), upstreamES=low(e), downstreamEE=high(e))
        ri = F.flatten(F.transform("into", lambda i: F.transform(F.filter("ex", lambda e: holds(e, i)), lambda e: of_exon(i, e))))
    else:
        ri = F.transform(F.filter("into", lambda i: F.exists("ex", lambda e: holds(e, i))), lambda i: event("RI", [i["a"], i["b"]], upstreamEE=low(i), downstreamES=high(i)))

    # the one strand's begin is the other one's end
    turned = lambda p, q: F.when(plus, p).otherwise(q)
    a3_of = lambda e, s: event(
        "A3SS", [e["f"], e["a"], s["a"], e["b"]], longExonStart_0base=turned(e["p"], e["q"]), longExonEnd=turned(e["q"], e["p"]), shortES=turned(s["p"], e["q"]), shortEE=turned(e["q"], s["p"]), flankingES=e["x"], flankingEE=e["x"]
    )
    a3 = F.flatten(F.transform("entered", lambda e: F.transform(F.filter("entered", lambda s: (s["f"] == e["f"]) & (s["b"] == e["b"]) & (e["a"] < s["a"])), lambda s: a3_of(e, s))))
    a5_of = lambda s, e: event(
        "A5SS", [s["a"], s["b"], e["b"], s["t"]], longExonStart_0base=turned(s["p"], e["q"]), longExonEnd=turned(e["q"], s["p"]), shortES=turned(s["p"], s["q"]), shortEE=turned(s["q"], s["p"]), flankingES=s["x"], flankingEE=s["x"]
    )
    a5 = F.flatten(F.transform("left_", lambda s: F.transform(F.filter("left_", lambda e: (e["a"] == s["a"]) & (e["t"] == s["t"]) & (s["b"] < e["b"])), lambda e: a5_of(s, e))))
    # the outer form asks nothing of the list beforehand, which would be made twice
    every = lists.select("gene", F.inline_outer(F.concat(se, ri, a3, a5))).where("event_id is not null")
    return every.withColumn("strand", F.when(plus, "+").otherwise("-"))


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    edges = _all_edges(spark, sf)
    return mapping.event_parts(mapping.boundaries(_tool_table(edges)), edges)


@query
def map_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of four kinds on both strands laid over the graphs, mapped to the parts that tell their sides apart."""
    return _mapped(spark, sf).select("gene", "event_id", "etype", part_labels(F.col("parts")).alias("parts"))


@query
def map_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.coverage(_mapped(spark, sf))


@query
def part_to_events(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.part_to_events(_mapped(spark, sf))


@query
def event_to_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of each event's number within its kind, over all kinds."""
    rows = _mapped(spark, sf).withColumn("event_id", F.regexp_replace("event_id", "^[^_]+_", ""))
    return mapping.event_to_parts(rows)


# --- events matched to splits -------------------------------------------------------------------------------------


def _numbered_splits(edges: DataFrame, kind: str) -> DataFrame:
    """The splits of all genes' graphs, numbered within the gene; the leaf of each graph, which all its paths end in, is numbered LEAF. A group's paths are one list of all their nodes."""
    dealt = edges.where("kind <> 'ex_part'").select("gene", "a", "b", "txs").repartition(b.partitions(edges), "gene")  # before a row for each transcript is made of them
    used = dealt.select("gene", F.explode("txs").alias("tx"), F.explode(F.array("a", "b")).alias("node"))
    lists = used.groupBy("gene", "tx").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    paths = b.with_parts(lists.withColumn("nodes", F.array_sort(F.array_distinct(F.concat(F.expr("slice(nodes, 1, size(nodes) - 1)"), F.array(F.lit(LEAF)))))), ROOT, LEAF)
    found = b.prune(b.detect_bubbles(paths, ("parts", "rep")), ROOT, LEAF, None if kind == "bipartition" else MAX_SINGLE)
    if kind == "bipartition":
        rows = splits.dedupe(splits.bipartitions(found), [F.col("snk") - F.col("src"), "src", "mask"])
    else:
        rows = splits.multinomial(found).withColumn("event", F.row_number().over(b.W.partitionBy("gene").orderBy("src", "snk")))
    groups = F.transform("groups", lambda g: F.struct(F.array(F.array_distinct(F.flatten(g["paths"]))).alias("paths"), g["diff"].alias("diff")))
    return rows.select("gene", "event", "src", "snk", groups.alias("groups"), "ref")


def _matched(edges: DataFrame, kind: str) -> DataFrame:
    """Splits stay with their gene until those are left out that lie as no event needs; the positions of their paths are looked up for the rest. `edges` are read several times."""
    nodes = graph.node_positions(edges)
    events = mapping.boundaries(_tool_table(edges, whole_exons=True))
    positions = mapping.step_positions(nodes)
    numbered = _numbered_splits(edges, kind).withColumn("whole", F.struct("src", "snk", "groups", "ref"))
    met = save(mapping.met_splits(events, mapping.two_sided(numbered).select("gene", "event", "diff1", "diff2", "ref", "whole"), positions))
    placed = mapping.placed_splits(met.dropDuplicates(["gene", "event"]).select("gene", "event", "whole.*"), nodes)
    return save(mapping.match_splits(events, placed, positions, met.drop("whole")))


def _match(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _matched(save(_edges(spark, sf)), kind)
        return rows.select("gene", "event_id", "etype", "event", "side", part_labels(F.col("diffs")).alias("parts"), part_labels(F.col("ref")).alias("ref_parts"))

    return run


QUERIES |= {f"match_{kind}": _match(kind) for kind in ("bipartition", "multinomial")}


@query
def match_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered parts that matched events are told apart by, and those that are their references, by kind."""
    edges = save(_all_edges(spark, sf))
    maps = mapping.split_maps(_matched(edges, "bipartition")).withColumnRenamed("part", "step")
    return maps.join(graph.part_of_step(edges), ["gene", "step"]).drop("step")


# --- files --------------------------------------------------------------------------------------------------------


@query
def source_exons(spark: SparkSession, sf: str) -> DataFrame:
    """Exons written as GTF text with other features in between, and read back for three chromosomes."""
    path = new_path(spark, "gtf")
    kind = F.explode(F.array(F.lit("exon"), F.when(F.col("tx") % 3 == 0, "start_codon").otherwise("stop_codon")))
    cells = F.concat_ws("\t", "chrom", F.lit("x"), "kind", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), F.format_string('gene_id "%s"; transcript_id "%s"; gene_type "protein_coding";', F.col("gene").cast("string"), F.col("tx").cast("string")))
    lines = _exons(spark, sf).withColumn("kind", kind).select(cells.alias("value"))
    lines.union(spark.range(1).select(F.lit("#a comment").alias("value"))).write.text(path)
    return annotation.read_exons(spark, path, ["c0", "c1", "c3"])


@query
def source_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts written as flattened GFF and read back, with the chromosome that the gene's line gives."""
    path = new_path(spark, "gff")
    annotation.write_parts(_parts(_exons(spark, sf)).withColumn("txs", F.transform("txs", lambda t: t.cast("string"))), path)
    genes = annotation.gene_chromosomes(spark, path).withColumnRenamed("chrom", "gene_chrom")
    return annotation.read_parts(spark, path).join(genes, "gene").select(F.col("gene").cast("long").alias("gene"), "part", "gene_chrom", "strand", "start", "end", F.size("txs").alias("n_txs"))


@query
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts written as a folder for each group and sample, with special rows, and read back."""
    path = new_path(spark, "counts")
    rows = view(spark, sf, "v_counts").withColumns({"id": F.format_string("%s:E%03d", F.col("gene").cast("string"), F.col("part")), "name": F.format_string("m%d_counts.txt", F.col("sample"))})
    special = rows.select("grp", "name").distinct().select(F.lit("_empty").alias("id"), F.lit(5).cast("long").alias("cnt"), "grp", "name")
    rows.select("id", "cnt", "grp", "name").union(special).write.partitionBy("grp", "name").csv(path, sep="\t")
    return annotation.read_counts(spark, path).withColumn("gene", F.col("gene").cast("long"))


@query
def source_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Exons as SAM text with header lines, read back and cut into blocks."""
    path = new_path(spark, "sam")
    cells = F.concat_ws("\t", F.col("tx").cast("string"), F.when(F.col("strand") == "+", "0").otherwise("16"), "chrom", F.col("start").cast("string"), F.lit("60"), F.lit("4S3M2D1I4M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("A"), F.lit("I"), F.when(F.col("tx") % 2 == 0, "NH:i:1"))
    _exons(spark, sf).select(cells.alias("value")).union(spark.range(1).select(F.lit("@HD\tVN:1.0").alias("value"))).write.text(path)
    rows = intervals.aligned_blocks(annotation.read_alignments(spark, path))
    return rows.select("read", "flag", "chrom", "pos", "mapq", "nh", F.inline("blocks"))


@query
def source_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event tables of four kinds, one folder for each, read as one."""
    root = new_path(spark, "events")
    rows = view(spark, sf, "v_exons").select((F.col("tx") * 10 + F.col("start") % 10).cast("string").alias("ID"), F.col("gene").cast("string").alias("GeneID"), (F.col("tx") % 4).alias("k"))
    for k, kind in enumerate(annotation.EVENT_TYPES):
        annotation.write_table(rows.where(F.col("k") == k).drop("k").withColumn(f"only{kind}", F.col("GeneID")), f"{root}/fromGTF.{kind}.txt", text=True)
    return annotation.read_events(spark, root).select("event_id", "etype", "GeneID", "onlyRI")


@query
def sink_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Counts written as Parquet by group and as appended text, both read back and counted by group and sample."""
    path, text = new_path(spark, "table"), new_path(spark, "summary")
    rows = view(spark, sf, "v_counts")
    annotation.write_table(rows, path, ["grp"])
    for g in ("g1", "g2"):
        annotation.append_summary(rows.where(F.col("grp") == g), text)
    again = spark.read.csv(text, sep="\t", header=True, schema=rows.schema).groupBy("grp", "sample").agg(F.sum("cnt").alias("text_cnt"))
    return spark.read.parquet(path).groupBy("grp", "sample").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n")).join(again, ["grp", "sample"])
