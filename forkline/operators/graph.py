"""Graphs as tables: nodes and edges of genes, built from their exons.

nodes(gene, node, position): numbered in the direction of transcription, the root 0 first, the leaf last.
edges(gene, a, b, kind, from_pos, to_pos, part, txs): kind is R, L, ex, in or ex_part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bubbles import with_uses


def _ends(exons: DataFrame) -> DataFrame:
    """Exons with begin and stop in the direction of transcription; the closed side is moved by one."""
    plus = F.col("strand") == "+"
    return exons.withColumns({"begin": F.when(plus, F.col("start")).otherwise(F.col("end") + 1), "stop": F.when(plus, F.col("end") + 1).otherwise(F.col("start"))})


def build_nodes(exons: DataFrame) -> DataFrame:
    """One node for each distinct coordinate of a gene (equal coordinates are one node), and the root and the leaf without position."""
    cuts = _ends(exons).select("gene", "strand", F.explode(F.array("begin", "stop")).alias("position")).distinct()
    key = F.when(F.col("strand") == "+", F.col("position")).otherwise(-F.col("position"))
    numbered = cuts.select("gene", F.row_number().over(W.partitionBy("gene").orderBy(key)).alias("node"), "position")
    none = F.lit(None).cast("int").alias("position")
    last = numbered.groupBy("gene").agg((F.max("node") + 1).alias("node"))
    return numbered.union(last.select("gene", "node", none)).union(last.select("gene", F.lit(0), none))


def build_edges(exons: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exons and introns between nodes, with the transcripts that use each, and edges from the root and to the leaf."""
    rows = _ends(exons).select("gene", "tx", "begin", "stop")
    at = nodes.where("position is not null")
    one = at.select("gene", F.col("node").alias("a"), F.col("position").alias("begin"))
    two = at.select("gene", F.col("node").alias("b"), F.col("position").alias("stop"))
    placed = rows.join(one, ["gene", "begin"]).join(two, ["gene", "stop"])
    chain = W.partitionBy("gene", "tx").orderBy("a", "b")
    placed = placed.withColumns({"next_a": F.lead("a").over(chain), "next_begin": F.lead("begin").over(chain), "first": F.row_number().over(chain) == 1})
    leaf = nodes.groupBy("gene").agg(F.max("node").alias("leaf"))
    placed = placed.join(leaf, "gene")
    edge = lambda a, b, kind, p, q: F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"), p.cast("int").alias("from_pos"), q.cast("int").alias("to_pos"))
    c, none = F.col, F.lit(None)
    each = F.array_compact(F.array(
        edge(c("a"), c("b"), "ex", c("begin"), c("stop")),
        F.when(c("next_a").isNotNull(), edge(c("b"), c("next_a"), "in", c("stop"), c("next_begin"))),
        F.when(c("first"), edge(F.lit(0), c("a"), "R", none, c("begin"))),
        F.when(c("next_a").isNull(), edge(c("b"), c("leaf"), "L", c("stop"), none)),
    ))
    flat = placed.select("gene", "tx", F.inline(each))
    return flat.groupBy("gene", "a", "b", "kind").agg(F.min("from_pos").alias("from_pos"), F.min("to_pos").alias("to_pos"), F.array_sort(F.collect_set("tx")).alias("txs")).select("gene", "a", "b", "kind", "from_pos", "to_pos", F.lit(None).cast("int").alias("part"), "txs")


def part_edges(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """parts (gene, part, strand, start, end, txs) as edges between the nodes at their ends."""
    at = nodes.where("position is not null")
    rows = _ends(parts)
    one = at.select("gene", F.col("node").alias("a"), F.col("position").alias("begin"))
    two = at.select("gene", F.col("node").alias("b"), F.col("position").alias("stop"))
    placed = rows.join(one, ["gene", "begin"]).join(two, ["gene", "stop"])
    return placed.select("gene", "a", "b", F.lit("ex_part").alias("kind"), F.col("begin").alias("from_pos"), F.col("stop").alias("to_pos"), "part", "txs")


def build_graph(exons: DataFrame, parts: bool = False) -> DataFrame:
    """The edges of build_edges() over the nodes of build_nodes(), and with `parts` an edge for each unit step that an exon covers, numbered by position: what part_edges() makes of a gene's own parts.

    Exons are dealt by gene once. A gene's nodes are numbered and its edges gathered where its exons are, without a join; rows
    stay dealt by gene, for what is grouped or joined by gene next. A gene lies on one strand of one chromosome; null is no gene.
    """
    gene, one_way = W.partitionBy("gene"), F.when(F.col("strand") == "+", 1).otherwise(-1)
    rows = _ends(exons).where("gene is not null").select("gene", "tx", one_way.alias("way"), "begin", "stop")
    # positions count upwards in the direction of transcription
    rows = rows.select("gene", "tx", "way", (F.col("way") * F.col("begin")).alias("x"), (F.col("way") * F.col("stop")).alias("y"))
    rows = rows.withColumns({"xs": F.collect_set("x").over(gene), "ys": F.collect_set("y").over(gene)})
    rows = rows.select("gene", "tx", "way", "x", "y", F.array_sort(F.array_union("xs", "ys")).alias("cuts"))
    at = lambda name: F.array_position("cuts", F.col(name)).cast("int")
    rows = rows.select("gene", "tx", "way", "cuts", "x", "y", at("x").alias("a"), at("y").alias("b"), (F.size("cuts") + 1).alias("leaf"))
    chain = W.partitionBy("gene", "tx").orderBy("a", "b")
    rows = rows.withColumns({"next_a": F.lead("a").over(chain), "next_x": F.lead("x").over(chain), "first": F.row_number().over(chain) == 1})
    edge = lambda a, b, kind, p, q: F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"), (p * F.col("way")).cast("int").alias("from_pos"), (q * F.col("way")).cast("int").alias("to_pos"))
    c, none = F.col, F.lit(None).cast("int")
    each = F.array_compact(F.array(
        edge(c("a"), c("b"), "ex", c("x"), c("y")),
        F.when(c("next_a").isNotNull(), edge(c("b"), c("next_a"), "in", c("y"), c("next_x"))),
        F.when(c("first"), edge(F.lit(0), c("a"), "R", none, c("x"))),
        F.when(c("next_a").isNull(), edge(c("b"), c("leaf"), "L", c("y"), none)),
    ))
    if parts:
        steps = F.when(c("a") < c("b"), F.sequence(c("a"), c("b") - 1)).otherwise(F.array().cast("array<int>"))
        each = F.concat(each, F.transform(steps, lambda k: edge(k, k + 1, "ex_part", F.get("cuts", k - 1), F.get("cuts", k))))
    flat = rows.select("gene", "tx", F.inline_outer(each))
    edges = flat.groupBy("gene", "a", "b", "kind").agg(F.min("from_pos").alias("from_pos"), F.min("to_pos").alias("to_pos"), F.array_sort(F.collect_set("tx")).alias("txs"))
    number = F.when(c("kind") == "ex_part", F.row_number().over(W.partitionBy("gene", "kind").orderBy(F.least("from_pos", "to_pos"), "a"))) if parts else none
    return edges.select("gene", "a", "b", "kind", "from_pos", "to_pos", number.alias("part"), "txs")


def node_positions(edges: DataFrame) -> DataFrame:
    """(gene, node, position) of the nodes between the root and the leaf."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("from_pos").alias("position")), F.struct(F.col("b").alias("node"), F.col("to_pos").alias("position")))
    return edges.where("kind = 'ex'").select("gene", F.inline(ends)).distinct()


def transcripts(edges: DataFrame) -> DataFrame:
    return edges.select("gene", F.explode("txs").alias("tx")).distinct()


def edge_names(edges: DataFrame) -> DataFrame:
    return edges.withColumn("name", F.format_string("%s-%s:%s", F.col("a").cast("string"), F.col("b").cast("string"), "kind"))


def node_paths(edges: DataFrame, parts: bool = False) -> DataFrame:
    """(gene, tx, nodes): the chain of a transcript's exons and introns (or parts) without the root and the leaf."""
    used = edges.where(F.col("kind").isin(*(["ex_part", "in"] if parts else ["ex", "in"])))
    rows = used.select("gene", F.explode("txs").alias("tx"), F.explode(F.array("a", "b")).alias("node"))
    return rows.groupBy("gene", "tx").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def tx_nodes(edges: DataFrame) -> DataFrame:
    """(gene, tx, node) with the root and the leaf: which nodes a transcript visits."""
    used = edges.where("kind <> 'ex_part'")
    return used.select("gene", F.explode("txs").alias("tx"), F.explode(F.array("a", "b")).alias("node")).distinct()


def tx_paths(edges: DataFrame) -> DataFrame:
    """(gene, tx, nodes, parts) for the bubble operators: parts are the unit steps inside a transcript's exons."""
    steps = edges.where("kind = 'ex'").select("gene", F.explode("txs").alias("tx"), F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("part"))
    parts = steps.groupBy("gene", "tx").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    nodes = tx_nodes(edges).groupBy("gene", "tx").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return nodes.join(parts, ["gene", "tx"], "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<int>")))


def part_of_step(edges: DataFrame) -> DataFrame:
    """(gene, step, part): the number of the part at each unit step, for rendering."""
    return edges.where("kind = 'ex_part'").select("gene", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("step"), "part")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """paths (gene, path_id, nodes) -> gene, path_id, pos, a, b, kind: the exon and intron edges along each."""
    pairs = F.posexplode(F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("a"), F.slice("nodes", F.lit(2), F.size("nodes") - 1).alias("b")))
    rows = paths.where(F.size("nodes") > 1).select("gene", "path_id", pairs.alias("pos", "e")).select("gene", "path_id", "pos", "e.a", "e.b")
    return rows.join(edges.where("kind <> 'ex_part'").select("gene", "a", "b", "kind"), ["gene", "a", "b"])


def exon_parts(walked: DataFrame, edges: DataFrame) -> DataFrame:
    """path_edges() rows with, for exons, the parts between their ends in order; other kinds keep a null part."""
    parts = edges.where("kind = 'ex_part'").select("gene", F.col("a").alias("pa"), F.col("b").alias("pb"), "part")
    steps = walked.where("kind = 'ex' and a < b").withColumn("pa", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))  # an equal key in place of a range
    exons = steps.join(parts, ["gene", "pa"]).where("pb <= b").select("gene", "path_id", "pos", "pa", "part", "kind")
    rest = walked.where("kind <> 'ex'").select("gene", "path_id", "pos", F.col("a").alias("pa"), F.lit(None).cast("int").alias("part"), "kind")
    return exons.union(rest)


def paths_of_edges(walked: DataFrame, edges: DataFrame) -> DataFrame:
    """(gene, path_id, txs): transcripts that use any edge of a path."""
    rows = walked.join(edges.select("gene", "a", "b", "kind", "txs"), ["gene", "a", "b", "kind"])
    return rows.groupBy("gene", "path_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("txs")))).alias("txs"))


def node_types(edges: DataFrame) -> DataFrame:
    """(gene, node, type): 1 at an exon's start, 2 at its end, 0 else; and conflict where a node is both."""
    exons = edges.where("kind = 'ex'")
    ends = exons.select("gene", F.col("a").alias("node"), F.lit(1).alias("t")).union(exons.select("gene", "b", F.lit(2)))
    typed = ends.groupBy("gene", "node").agg(F.max("t").alias("type"), (F.min("t") != F.max("t")).alias("conflict"))
    every = edges.select("gene", F.explode(F.array("a", "b")).alias("node")).distinct()
    return every.join(typed, ["gene", "node"], "left").select("gene", "node", F.coalesce("type", F.lit(0)).alias("type"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def containment(sets: DataFrame) -> DataFrame:
    """sets (gene, path_id, parts) -> gene, small, large: paths whose parts are a proper subset of another path's.

    A path is compared with those only that have its rarest part (of the gene; ties: the smallest) and more parts than it.
    Paths without parts lie in every path of the gene that has one; a null list counts as empty.
    """
    known = sets.select("gene", "path_id", F.array_distinct(F.coalesce("parts", F.array().cast("array<int>"))).alias("parts"))
    each = known.select("gene", "path_id", F.explode("parts").alias("part"))
    users = each.groupBy("gene", "part").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(users, ["gene", "part"]).groupBy("gene", "path_id").agg(F.min(F.struct("n", "part"))["part"].alias("part"))
    small = known.join(rarest, ["gene", "path_id"]).select("gene", "part", F.col("path_id").alias("small"), F.col("parts").alias("less"))
    large = known.select("gene", F.explode("parts").alias("part"), F.col("path_id").alias("large"), F.col("parts").alias("more"))
    found = small.join(large, ["gene", "part"]).where((F.size("less") < F.size("more")) & (F.size(F.array_except("less", "more")) == 0))
    empty = known.where(F.size("parts") == 0).select("gene", F.col("path_id").alias("small")).join(known.where(F.size("parts") > 0).select("gene", F.col("path_id").alias("large")), "gene")
    return found.select("gene", "small", "large").unionByName(empty)


def collapse_bubbles(paths: DataFrame, detect, root: int, leaf: int, save, max_rounds: int = 10_000) -> DataFrame:
    """Collapse bubbles, innermost first, all genes in step, until none is left: tx_paths after it.

    Of each gene's bubbles that have neither the root nor the leaf the shortest one that is not done comes next. A variant goes
    if its steps are used by its own transcripts only; those transcripts then follow the variant kept, the one with
    the most transcripts (at least one stays). Bubbles that nothing leaves change nothing, so a round is done with all of them up to
    the first one that something leaves, and only such ones take rounds. `detect` finds bubbles in tx_paths; `save` cuts lineage. A round
    leaves the genes that have no such bubble out of the next; beyond max_rounds it raises.
    """
    done, finished = [], []
    alone = lambda v: v["n"] == v["most"]
    place = F.struct(F.col("snk") - F.col("src"), F.col("src"))
    for _ in range(max_rounds):
        bubbles = detect(with_uses(paths), ("n", "most")).where(f"src <> {root} and snk <> {leaf}").drop("n_paths")
        if done:
            over = reduce(DataFrame.union, done).groupBy("gene").agg(F.collect_list(F.struct("src", "snk")).alias("over"))  # a gene's bubbles; joined by gene alone, they stay where they are
            bubbles = bubbles.join(over, "gene").where(~F.array_contains("over", F.struct("src", "snk"))).drop("over")
        marked = bubbles.withColumn("moves", F.exists("variants", alone))
        until = F.min(F.when(F.col("moves"), place)).over(W.partitionBy("gene"))
        taken = save(marked.withColumn("until", until).where(place <= F.col("until")).select("gene", "src", "snk", F.when(F.col("moves"), F.col("variants")).alias("variants")))
        now = taken.where("variants is not null")
        if now.isEmpty():
            return reduce(DataFrame.union, finished, paths)
        done.append(taken.drop("variants"))
        ranked = F.array_sort(F.transform("variants", lambda v, i: F.struct(alone(v).alias("alone"), (-v["n"]).alias("fewer"), i.alias("i"), v["inner"].alias("inner"))))
        gone = F.transform(F.filter(F.slice("ranked", F.lit(2), F.size("ranked")), lambda v: v["alone"]), lambda v: v["inner"])
        plan = now.withColumn("ranked", ranked).select("gene", "src", "snk", F.element_at("ranked", 1)["inner"].alias("keep"), gone.alias("gone"))
        inner = F.when(F.array_contains("nodes", F.col("src")) & F.array_contains("nodes", F.col("snk")), F.filter("nodes", lambda x: (x > F.col("src")) & (x < F.col("snk"))))
        here = paths.join(plan, "gene", "left").withColumn("inner", inner)
        first = F.min_by("parts", F.when(F.col("inner") == F.col("keep"), F.col("tx"))).over(W.partitionBy("gene"))
        moved = here.withColumns({"leaves": F.coalesce(F.array_contains("gone", F.col("inner")), F.lit(False)), "kept": first})
        outside = lambda name, low, high: F.filter(name, lambda x: (x <= low) | (x >= high))
        nodes = F.when(F.col("leaves"), F.array_sort(F.array_union(outside("nodes", F.col("src"), F.col("snk")), "keep"))).otherwise(F.col("nodes"))
        own = lambda p: (p >= F.col("src")) & (p < F.col("snk"))
        parts = F.when(F.col("leaves"), F.array_sort(F.array_union(F.filter("parts", lambda p: ~own(p)), F.filter("kept", own)))).otherwise(F.col("parts"))
        both = save(moved.select("gene", "tx", nodes.alias("nodes"), parts.alias("parts"), F.col("src").isNotNull().alias("open")))
        finished.append(both.where("not open").drop("open"))
        paths = both.where("open").drop("open")
    raise ValueError(f"bubbles left after {max_rounds} rounds")
