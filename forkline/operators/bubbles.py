"""Bubbles: pairs of nodes between which the paths of a gene differ and meet nowhere.

Tables. tx_nodes(gene, tx, node): the nodes a path visits, numbered in topological order, root and leaf included.
tx_paths(gene, tx, nodes array<int>, parts array<int>): part k lies between nodes k and k + 1.
bubbles(gene, src, snk, n_paths, variants array<struct<inner, txs, parts, rep>>): variants in the order of `inner`;
parts are those of the variant between src and snk, rep all parts of its first path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import intersect_all
from ..sources.shared import save as save_table


def tx_paths(tx_nodes: DataFrame, root: int | None = None, leaf: int | None = None) -> DataFrame:
    """Paths as arrays, with their parts."""
    return with_parts(tx_nodes.groupBy("gene", "tx").agg(F.array_sort(F.collect_set("node")).alias("nodes")), root, leaf)


def with_parts(paths: DataFrame, root: int | None = None, leaf: int | None = None) -> DataFrame:
    """paths (gene, tx, nodes) with parts. Between root and leaf, nodes alternate between starts and ends of a stretch; its unit steps are the path's parts."""
    inside = F.filter("nodes", lambda x: (x != root) & (x != leaf)) if root is not None else F.col("nodes")
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("inside") / 2).cast("int")), lambda k: F.sequence(F.element_at("inside", 2 * k - 1), F.element_at("inside", 2 * k) - 1))
    parts = F.when(F.size("inside") >= 2, F.flatten(pairs)).otherwise(F.array().cast("array<int>"))
    return paths.withColumn("inside", inside).withColumn("parts", parts).drop("inside")


def partitions(rows: DataFrame) -> int:
    """The session's number of shuffle partitions: paths are multiplied after they are dealt, so that few bytes must not mean few tasks."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: What is kept of a variant beside its inner nodes.
ALL = ("txs", "parts", "rep")


def variants(paths: DataFrame, keep: tuple[str, ...] = ALL) -> DataFrame:
    """(gene, src, snk, inner, txs, parts, rep): the distinct ways between any two nodes, each with its paths; of txs, parts and rep those in `keep`.

    `keep` may also have n, the number of a way's paths, and most, the greatest of its steps' `uses` (see with_uses()).
    Paths are dealt by gene before they are multiplied, and all later grouping by gene and nodes stays where it is.
    """
    needed = [c for c, used in (("tx", {"txs", "parts", "rep"} & set(keep)), ("parts", {"parts", "rep"} & set(keep)), ("uses", "most" in keep)) if used]
    starts = paths.select("gene", "nodes", *needed).repartition(partitions(paths), "gene").select("gene", *needed, F.size("nodes").alias("n"), "nodes", F.posexplode("nodes").alias("i", "src"))
    ends = starts.where("i < n - 1").select("gene", *needed, "nodes", "i", "src", F.posexplode(F.expr("slice(nodes, i + 2, n)")).alias("j", "snk"))
    most = [F.expr("array_max(slice(uses, i + 1, j + 1))").alias("most")] if "most" in keep else []
    pairs = ends.select("gene", *(c for c in needed if c != "uses"), *most, "src", "snk", F.expr("slice(nodes, i + 2, j)").alias("inner"))
    keys = ["gene", "src", "snk", "inner"]
    if not keep:
        return pairs.distinct()
    found = {"txs": F.array_sort(F.collect_list("tx")), "rep": F.min_by("parts", "tx"), "n": F.count(F.lit(1)), "most": F.max("most")}
    rows = pairs.groupBy(*keys).agg(*(c.alias(name) for name, c in found.items() if name in keep or name == "rep" and "parts" in keep))
    own = F.filter("rep", lambda p: (p >= F.col("src")) & (p < F.col("snk")))
    return (rows.withColumn("parts", own) if "parts" in keep else rows).select(*keys, *keep)


def detect_bubbles(paths: DataFrame, keep: tuple[str, ...] = ALL) -> DataFrame:
    """All bubbles: two variants or more, and no inner node that all of them share. An empty inner path is a variant like any other. Variants have inner, and of txs, parts, rep, n and most those in `keep`."""
    ways = variants(paths, tuple(c for c in keep if c != "parts" or "rep" not in keep))
    rows = ways.groupBy("gene", "src", "snk").agg(F.array_sort(F.collect_list(F.struct("inner", *ways.columns[4:]))).alias("variants"))
    several = rows.where(F.size("variants") >= 2)
    # in order, an empty inner path comes first
    apart = (F.size(F.element_at("variants", 1)["inner"]) == 0) | (F.size(intersect_all(F.transform("variants", lambda v: v["inner"]))) == 0)
    found = several.where(apart).select("gene", "src", "snk", F.size("variants").alias("n_paths"), "variants")
    if {"parts", "rep"} <= set(keep):
        own = lambda v: F.filter(v["rep"], lambda p: (p >= F.col("src")) & (p < F.col("snk")))
        each = lambda v: F.struct(v["inner"].alias("inner"), *((own(v) if c == "parts" else v[c]).alias(c) for c in keep))
        found = found.withColumn("variants", F.transform("variants", each))
    return found


def with_uses(paths: DataFrame) -> DataFrame:
    """(gene, nodes, uses) of paths (gene, tx, nodes): how many of the gene's paths take each step."""
    dealt = paths.select("gene", "tx", "nodes").repartition(partitions(paths), "gene")
    step = F.posexplode(F.expr("slice(nodes, 2, size(nodes) - 1)")).alias("i", "b")
    steps = dealt.select("gene", "tx", "nodes", step).withColumn("a", F.expr("nodes[i]"))
    used = steps.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("gene", "a", "b")))
    line = used.groupBy("gene", "tx", "nodes").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("line"))
    return line.select("gene", "nodes", F.transform("line", lambda x: x["n"]).alias("uses"))


def node_types(paths: DataFrame, root: int, leaf: int) -> DataFrame:
    """(gene, node, type, conflict): 1 where a stretch starts, 2 where it ends, 0 for root and leaf; conflict if paths disagree (the larger type counts)."""
    inside = paths.select("gene", F.posexplode(F.filter("nodes", lambda x: (x != root) & (x != leaf))).alias("pos", "node"))
    typed = inside.groupBy("gene", "node").agg(F.max(F.col("pos") % 2 + 1).alias("type"), (F.min(F.col("pos") % 2) != F.max(F.col("pos") % 2)).alias("conflict"))
    ends = paths.select("gene", F.explode(F.array(F.lit(root), F.lit(leaf))).alias("node")).distinct().select("gene", "node", F.lit(0).alias("type"), F.lit(False).alias("conflict"))
    return typed.unionByName(ends)


def variant_codes(ways: DataFrame, types: DataFrame) -> DataFrame:
    """`ways` with code: for each inner node its place among the nodes between src and snk and the sign of its type: - start, ^ end, [ from the root, ] to the leaf."""
    sign = F.when(F.col("type") == 1, "-").when(F.col("type") == 2, "^").otherwise("")
    signs = types.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("node", sign.alias("sign")))).alias("signs"))
    used = F.array_sort(F.array_distinct(F.flatten(F.collect_set("inner").over(W.partitionBy("gene", "src", "snk")))))
    joined = ways.withColumn("columns", used).join(signs, "gene")
    code = F.array_join(F.transform("inner", lambda x: F.concat(F.array_position("columns", x).cast("string"), F.element_at("signs", x))), "")
    return joined.withColumn("code", F.when(F.size("inner") == 0, "0").otherwise(code)).drop("signs", "columns")


def _depths(bubbles: DataFrame) -> DataFrame:
    """(gene, src, snk, n, depth): depths() with the number of equal intervals."""
    spans = bubbles.groupBy("gene", "src", "snk").agg(F.count(F.lit(1)).alias("n"))
    shift = lambda b: F.call_function("shiftright", F.col("snk"), b)
    at = lambda b, block, asks, n: F.struct(b.cast("int").alias("bit"), block.alias("block"), F.lit(asks).alias("asks"), n.alias("n"))
    bits, none = F.sequence(F.lit(0), F.lit(30)), F.lit(0).cast("long")
    held = F.transform(F.filter(bits, lambda b: shift(b) % 2 == 1), lambda b: at(b, shift(b), False, F.col("n")))
    # above a gene's largest sink there is nothing to ask for
    asked = F.transform(F.filter(bits, lambda b: (shift(b) % 2 == 0) & (F.call_function("shiftright", F.col("top"), b) > shift(b))), lambda b: at(b, shift(b) + 1, True, none))
    same = F.array(at(F.lit(-1), F.col("snk"), False, F.col("n")), at(F.lit(-1), F.col("snk"), True, none))
    topped = spans.withColumn("top", F.max("snk").over(W.partitionBy("gene")))
    both = topped.select("gene", "src", "snk", F.col("n").alias("equal"), F.inline(F.concat(same, held, asked)))
    upto = F.sum("n").over(W.partitionBy("gene", "bit", "block").orderBy("src").rangeBetween(W.unboundedPreceding, W.currentRow))
    met = both.withColumn("upto", upto).where("asks")
    return met.groupBy("gene", "src", "snk").agg(F.first("equal").alias("n"), (F.sum("upto") - 1).alias("depth"))


def depths(bubbles: DataFrame) -> DataFrame:
    """(gene, src, snk, depth): in how many other intervals of the gene each one lies, ends included; equal intervals count each other.

    Intervals that end at a sink or beyond are those with the same sink and, for each bit that the sink does not have, those
    with this bit whose sinks agree in all higher bits. So an interval is counted once for each bit of its sink, in blocks
    of sinks, and asks once for each bit it lacks, up to the gene's largest sink; in a block, running sums over the sources
    count those that begin no later. Rows are the intervals times the bits of a node's number; they are sorted and summed
    where the gene's bubbles are, and nothing is written or joined.
    """
    return _depths(bubbles).drop("n")


def order_by_depth(bubbles: DataFrame) -> DataFrame:
    """`bubbles` with depth and rank: deepest first, then by src and snk."""
    keys = ["gene", "src", "snk"]
    if set(bubbles.columns) == set(keys):  # nothing to join back
        deep = _depths(bubbles).select(*keys, "depth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("__copy")).drop("__copy")
    else:
        bubbles = save_table(bubbles, "bubbles")
        deep = bubbles.join(depths(bubbles), keys)
    return deep.withColumn("rank", F.row_number().over(W.partitionBy("gene").orderBy(F.col("depth").desc(), "src", "snk")))


def order_by_span(bubbles: DataFrame) -> DataFrame:
    """`bubbles` with span and rank: shortest first, then by src and snk."""
    return bubbles.withColumn("span", F.col("snk") - F.col("src")).withColumn("rank", F.row_number().over(W.partitionBy("gene").orderBy("span", "src", "snk")))


def prune(bubbles: DataFrame, root: int, leaf: int, max_path: int | None = 15, max_span: int | None = None) -> DataFrame:
    """Leave out the bubble from root to leaf and those with more than max_path variants or a longer span (None: no bound); meant to run before splits are listed."""
    kept = bubbles.where(f"not (src = {root} and snk = {leaf})")
    kept = kept if max_path is None else kept.where(f"n_paths <= {max_path}")
    return kept if max_span is None else kept.where(f"snk - src <= {max_span}")


def simple_paths(edges: DataFrame, src: int, snk: int, max_steps: int, save: Callable[[DataFrame, str], DataFrame] = lambda df, label: df) -> DataFrame:
    """(gene, path array<int>): all paths from src to snk over edges(gene, a, b) of directed acyclic graphs with a < b.

    Partial paths grow by one edge a round, all genes together, until none is open; max_steps must be at least the
    number of nodes less one: paths that are still open then are an error. `save` cuts lineage after each round.
    """
    steps = save(edges.select("gene", "a", "b").distinct(), "steps")
    front = steps.where(F.col("a") == src).select("gene", F.array("a", "b").alias("path"))
    done = None
    for _ in range(max_steps):
        front = save(front, "paths")
        here = front.where(F.element_at("path", -1) == snk)
        done = here if done is None else done.union(here)
        open_ = front.where(F.element_at("path", -1) < snk).withColumn("a", F.element_at("path", -1))
        front = open_.join(steps, ["gene", "a"]).select("gene", F.concat("path", F.array("b")).alias("path"))
    if not front.isEmpty():
        raise ValueError(f"some paths take more than {max_steps} steps")
    return done


def tx_edges(paths: DataFrame) -> DataFrame:
    """(gene, a, b, txs): the steps of all paths."""
    step = F.explode(F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda k: F.struct(F.element_at("nodes", k).alias("a"), F.element_at("nodes", k + 1).alias("b"))))
    rows = paths.where(F.size("nodes") > 1).select("gene", "tx", step.alias("s")).select("gene", "tx", "s.a", "s.b")
    return rows.groupBy("gene", "a", "b").agg(F.array_sort(F.collect_set("tx")).alias("txs"))


def contained_paths(bubbles: DataFrame) -> DataFrame:
    """(gene, src, snk, small, large): 1-based variants whose parts are a proper subset of another's."""
    n = F.sequence(F.lit(1), F.col("n_paths"))
    a, b = F.element_at("parts", F.col("small")), F.element_at("parts", F.col("large"))
    rows = bubbles.select("gene", "src", "snk", "n_paths", F.transform("variants", lambda v: v["parts"]).alias("parts"))
    pairs = rows.withColumn("small", F.explode(n)).withColumn("large", F.explode(n))
    return pairs.where((F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b))).select("gene", "src", "snk", "small", "large")
