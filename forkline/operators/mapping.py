"""Mapping the events of a junction tool to graphs and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import part_labels

COORDINATES = ("exonStart_0base", "exonEnd", "upstreamEE", "downstreamES", "longExonStart_0base", "longExonEnd", "shortES", "shortEE", "flankingES", "flankingEE")


def boundaries(events: DataFrame) -> DataFrame:
    """Events (etype, strand, 0-based coordinates) with b1, b2, alt_low, alt_hi in graph positions; null for other types."""
    at = lambda name: (F.col(name).cast("int") + 1) if name in events.columns else F.lit(None).cast("int")
    plus = F.col("strand") == "+"

    def pick(se: Column, ri: Column, a3: tuple[Column, Column], a5: tuple[Column, Column]) -> Column:
        e = F.col("etype")
        return F.when(e == "SE", se).when(e == "RI", ri).when((e == "A3SS") & plus, a3[0]).when(e == "A3SS", a3[1]).when((e == "A5SS") & plus, a5[0]).when(e == "A5SS", a5[1])

    up, down, xs, xe = at("upstreamEE"), at("downstreamES"), at("exonStart_0base"), at("exonEnd")
    ls, le, ss, se, fs, fe = (at(n) for n in COORDINATES[4:])
    return events.withColumns({
        "b1": pick(up, up, (fe, fs), (ls, le)), "b2": pick(down, down, (le, ls), (fs, fe)),
        "alt_low": pick(xs, up, (ls, se), (se, ls)), "alt_hi": pick(xe, down, (ss, le), (le, ss)),
    })


def event_parts(bounded: DataFrame, edges: DataFrame) -> DataFrame:
    """(gene, event_id, etype, parts): parts in the alternative region that transcripts with it have and those without it lack.

    Only transcripts with an edge at both boundaries count. Parts are null where either side has no transcript or
    nothing tells them apart. A gene's edges are two lists, which its events meet by gene alone: events and edges that are dealt by gene stay where they are.
    """
    events = bounded.where("b1 is not null and b2 is not null").select("gene", "event_id", "etype", "b1", "b2", "alt_low", "alt_hi")
    plain = F.when(F.col("kind").isin("ex", "in") & F.col("from_pos").isNotNull() & F.col("to_pos").isNotNull(), F.struct("from_pos", "to_pos", "txs"))
    part = F.when(F.col("kind") == "ex_part", F.struct(F.least("from_pos", "to_pos").alias("start"), (F.greatest("from_pos", "to_pos") - 1).alias("end"), "part", "txs"))
    lists = edges.where("kind in ('ex', 'in', 'ex_part')").groupBy("gene").agg(F.collect_list(plain).alias("plain"), F.collect_list(part).alias("every"))  # a gene's edges
    users = lambda b: F.flatten(F.transform(F.filter("plain", lambda e: (e["from_pos"] == F.col(b)) | (e["to_pos"] == F.col(b))), lambda e: e["txs"]))
    rows = events.join(lists, "gene", "left").withColumn("local", F.array_intersect(users("b1"), users("b2")))
    rows = rows.withColumn("alt", F.filter("every", lambda p: (p["start"] >= F.col("alt_low")) & (p["end"] < F.col("alt_hi"))))
    rows = rows.withColumn("one", F.array_intersect("local", F.flatten(F.transform("alt", lambda p: p["txs"])))).withColumn("two", F.array_except("local", "one"))
    own = F.filter("alt", lambda p: F.arrays_overlap(p["txs"], F.col("one")) & ~F.arrays_overlap(p["txs"], F.col("two")))
    found = F.array_sort(F.array_distinct(F.transform(own, lambda p: p["part"])))
    told = F.when((F.size("one") > 0) & (F.size("two") > 0) & (F.size(found) > 0), found)
    # made as a row of its own: what is asked of the parts later is not asked of each step behind them
    return rows.select("gene", "event_id", "etype", F.explode_outer(F.array(F.struct(told.alias("parts")))).alias("__made")).select("gene", "event_id", "etype", "__made.parts")


def coverage(mapped: DataFrame) -> DataFrame:
    """(etype, n_events, n_mapped)."""
    return mapped.groupBy("etype").agg(F.count(F.lit(1)).alias("n_events"), F.count("parts").alias("n_mapped"))


def placed_splits(splits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Splits (gene, event, src, snk, groups, ref) of any kind in the form of match_splits(): the first two groups as diff1 and diff2, and the positions of source, sink and paths.

    nodes (gene, node, position). pos1 has the positions on the paths of the first group, pos2 those on the paths of all others. The root and the leaf have none.
    """
    at = nodes.where("position is not null").groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("node", "position"))).alias("at"))  # a gene's nodes
    place = lambda node: F.try_element_at("at", node)
    on = lambda groups: F.array_compact(F.array_distinct(F.transform(F.concat(F.array("src", "snk"), F.flatten(F.flatten(F.transform(groups, lambda g: g["paths"])))), place)))
    rest = F.slice("groups", 2, F.greatest(F.size("groups") - 1, F.lit(0)))
    rows = two_sided(splits.join(at, "gene").withColumns({"src_pos": place(F.col("src")), "snk_pos": place(F.col("snk")), "pos1": on(F.slice("groups", 1, 1)), "pos2": on(rest)}))
    return rows.select("gene", "event", "src_pos", "snk_pos", "diff1", "diff2", "ref", "pos1", "pos2")


def step_positions(nodes: DataFrame) -> DataFrame:
    """(gene, part, low, high): where the unit step from each node to the next one of its gene lies."""
    following = W.partitionBy("gene").orderBy("node")
    rows = nodes.where("gene is not null and position is not null").withColumns({"next": F.lead("node").over(following), "further": F.lead("position").over(following)})
    return rows.where("next = node + 1").select("gene", F.col("node").alias("part"), F.least("position", "further").alias("low"), F.greatest("position", "further").alias("high"))


def _bounds(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """`rows` (gene, ...) of genes with positions, with `__spans`: where each part of the gene lies, at the part's number from __from on."""
    known = positions.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("part", F.struct("low", "high")))).alias("spans"), F.min("part").alias("__from"), F.max("part").alias("top"))  # a gene's parts
    lines = known.select("gene", "__from", F.transform(F.sequence("__from", "top"), lambda k: F.try_element_at("spans", k)).alias("__spans"))
    return rows.join(lines, "gene")


def _spans(parts: str) -> Column:
    """Of the parts those that have a position, as where they lie."""
    return F.array_compact(F.transform(parts, lambda p: F.get("__spans", p - F.col("__from"))))


def _events(bounded: DataFrame) -> DataFrame:
    given = lambda name: F.when(F.col("etype") == "RI", F.col(name).cast("int") + 1) if name in bounded.columns else F.lit(None).cast("int")
    return bounded.where("b1 is not null and b2 is not null").select(
        "gene", "event_id", "etype", "strand", "b1", "b2", F.coalesce(given("upstreamES"), "b1").alias("e1"), F.coalesce(given("downstreamEE"), "b2").alias("e2"), "alt_low", "alt_hi", given("riExonStart_0base").alias("r1"), given("riExonEnd").alias("r2")
    )


def met_splits(bounded: DataFrame, splits: DataFrame, positions: DataFrame) -> DataFrame:
    """Events with each side of a split (gene, event, diff1, diff2, ref) whose parts and reference parts lie as the event needs: their numbers, and what other columns the splits have; see match_splits().

    Events and splits meet by gene alone, so that splits that are dealt by gene stay where they are until the few that lie so are told.
    """
    rest = [c for c in splits.columns if c not in ("gene", "event", "ref", "diff1", "diff2")]
    sides = _bounds(splits.select("gene", "event", "ref", "diff1", "diff2", *rest), positions)
    flanks = F.struct(F.array_min(_spans("ref")).alias("first"), F.array_max(_spans("ref")).alias("last"))
    reach = lambda side, diff: F.struct(F.lit(side).alias("side"), F.array_min(_spans(diff))["low"].alias("alt_low"), F.array_max(F.transform(_spans(diff), lambda x: x["high"])).alias("alt_hi"))
    placed = sides.select("gene", "event", *rest, flanks.alias("flanks"), F.inline(F.array(reach(1, "diff1"), reach(2, "diff2")))).where("alt_low is not null")
    placed = placed.select("gene", "event", *rest, "side", "alt_low", "alt_hi", "flanks.first", "flanks.last")
    events = _events(bounded)
    lists = events.groupBy("gene").agg(F.collect_list(F.struct(*(c for c in events.columns if c != "gene"))).alias("events"))  # a gene's events
    below, above = F.col("first.high"), F.col("last.low")

    def lies(e: Column) -> Column:
        plus, kind = e["strand"] == "+", e["etype"]
        flanked = (
            F.when(kind == "SE", (below == e["b1"]) & (above == e["b2"])).when(kind == "A3SS", F.when(plus, below).otherwise(above) == e["b1"])
            .when(kind == "A5SS", F.when(plus, above).otherwise(below) == e["b2"]).when(e["r1"].isNotNull() & e["r2"].isNotNull(), (F.col("first.low") == e["r1"]) & (F.col("last.high") == e["r2"])).otherwise(True)
        )
        return (e["alt_low"] == F.col("alt_low")) & (e["alt_hi"] == F.col("alt_hi")) & flanked

    # the outer form asks nothing of the list beforehand, which would be made twice
    found = placed.join(lists, "gene").select("gene", "event", *rest, "side", F.explode_outer(F.filter("events", lies)).alias("e")).where("e is not null")
    return found.select("gene", "e.*", "event", "side", *rest)


def match_splits(bounded: DataFrame, splits: DataFrame, positions: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """Events matched to splits by where the distinguishing parts begin and end.

    splits (gene, event, src_pos, snk_pos, diff1, diff2, ref, and pos1, pos2: arrays of the positions of each side's
    paths), positions (gene, part, low, high). A split's side matches if its parts reach from alt_low to alt_hi, and the
    reference parts have the flanks: the lowest of them ends at a boundary below the alternative region, the highest begins at one above it (SE: both; A3SS, A5SS: the
    constant exon's); for RI they begin and end with the whole exon, where its riExonStart_0base and riExonEnd are given. Where
    several splits match, only those stay whose source and sink are the event's boundaries (for RI upstreamES and downstreamEE, where given); of several of these, those
    where one side's paths have the event's own sites (both ends of an SE, else of the longer form) and the other's have
    none; then the first event. `met` are the rows of met_splits(), where they are at hand. Returns gene, event_id, etype, event, side, parts, ref, and diffs, the parts of both sides.
    """
    met = met_splits(bounded, splits.select("gene", "event", "diff1", "diff2", "ref"), positions) if met is None else met
    diffs = F.array_sort(F.array_union(F.coalesce("diff1", F.array().cast("array<int>")), F.coalesce("diff2", F.array().cast("array<int>"))))
    told = splits.select("gene", "event", F.array("src_pos", "snk_pos").alias("ends"), "pos1", "pos2", "ref", diffs.alias("diffs"), "diff1", "diff2")
    met = met.join(told, ["gene", "event"]).withColumn("parts", F.when(F.col("side") == 1, F.col("diff1")).otherwise(F.col("diff2")))
    exact = F.size(F.array_except("ends", F.array("e1", "e2"))) == 0
    low_is_long = (F.col("etype") == "A3SS") == (F.col("strand") == "+")
    own = F.when(F.col("etype").isin("SE", "RI"), F.array("alt_low", "alt_hi")).otherwise(F.array(F.when(low_is_long, F.col("alt_low")).otherwise(F.col("alt_hi"))))
    has = lambda path: F.size(F.array_except(own, path)) == 0
    lacks = lambda path: ~F.arrays_overlap(own, path)
    apart = (has("pos1") & lacks("pos2")) | (has("pos2") & lacks("pos1"))
    group = W.partitionBy("gene", "event_id")
    several = lambda rows: rows.withColumn("n", F.size(F.collect_set("event").over(group)))
    met = several(several(met).where((F.col("n") == 1) | exact)).where((F.col("n") == 1) | apart)
    return met.withColumn("k", F.row_number().over(group.orderBy("event", "side"))).where("k = 1").select("gene", "event_id", "etype", "event", "side", "parts", "ref", "diffs")


def split_maps(matched: DataFrame) -> DataFrame:
    """(gene, part, etype, event_ids, ref_event_ids): for each part the matched events that it tells apart, and those that it is a reference of, joined in order; one of the two may be null."""
    each = matched.select("gene", "etype", "event_id", F.inline(F.array(F.struct(F.lit(False).alias("is_ref"), F.col("diffs").alias("numbers")), F.struct(F.lit(True).alias("is_ref"), F.col("ref").alias("numbers")))))
    rows = each.select("gene", "etype", "event_id", "is_ref", F.explode("numbers").alias("part"))
    joined = lambda ref: F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_ref") == ref, F.col("event_id")))), ",")
    return rows.groupBy("gene", "part", "etype").agg(F.nullif(joined(False), F.lit("")).alias("event_ids"), F.nullif(joined(True), F.lit("")).alias("ref_event_ids"))


def two_sided(splits: DataFrame) -> DataFrame:
    """Splits of any kind as event, diff1, diff2, ref: the first two groups."""
    diff = lambda k: F.try_element_at("groups", F.lit(k))["diff"]
    return splits.withColumns({"diff1": diff(1), "diff2": diff(2)}).drop("groups")


def part_to_events(mapped: DataFrame, name: str = "parts") -> DataFrame:
    """(gene, part, event_ids): for each part the events that it distinguishes, joined in order."""
    return mapped.select("gene", "event_id", F.explode(name).alias("part")).groupBy("gene", "part").agg(F.array_join(F.array_sort(F.collect_set("event_id")), ",").alias("event_ids"))


def event_to_parts(mapped: DataFrame, name: str = "parts") -> DataFrame:
    """(gene, event_id, parts): part labels of each event."""
    return mapped.where(F.col(name).isNotNull()).groupBy("gene", "event_id").agg(part_labels(F.array_distinct(F.flatten(F.collect_list(name)))).alias("parts"))
