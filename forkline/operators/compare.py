"""Bringing results of several tools together: crosswalks, categories, correlations, overlaps of gene sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_maps(maps: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of part-to-event maps (keys..., event_ids) with the ids of all joined by commas, missing ones left out."""
    named = [m.withColumnRenamed("event_ids", f"ids{i}") for i, m in enumerate(maps)]
    joined = reduce(lambda a, b: a.join(b, keys, "full"), named)
    return joined.select(*keys, F.concat_ws(",", *(f"ids{i}" for i in range(len(maps)))).alias("event_ids"))


def tests_of_parts(part_map: DataFrame, part_results: DataFrame, tests: DataFrame, keys: list[str]) -> DataFrame:
    """Part results joined in full to their events, one row for each event, with that event's tests (event_id, ...); rows without a test go."""
    rows = part_map.join(part_results, keys, "full").withColumn("event_id", F.explode(F.split("event_ids", ",")))
    return rows.join(tests, "event_id", "left").where(F.col(tests.columns[-1]).isNotNull())


def parts_of_tests(event_map: DataFrame, part_results: DataFrame, keys: list[str]) -> DataFrame:
    """Event-side join: each event's parts (gene, event_id, parts array) with the parts' results, in full."""
    each = event_map.select("gene", "event_id", F.explode("parts").alias("part"))
    return each.join(part_results, keys, "full")


def annotate(results: DataFrame, table: DataFrame, columns: list[str], keys: tuple[str, ...] = ("gene", "event")) -> DataFrame:
    """`results` with the named columns of a table of splits or junction labels, which has them once or many times for an event."""
    return results.join(table.select(*keys, *columns).distinct(), list(keys), "left")


def keep_first(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each group, in a stated order."""
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")


def funnel(rows: DataFrame, event: str, part: list[str], padj: str, fdr: str, below: float = 0.05) -> DataFrame:
    """One row of counts: parts and events that are tested or significant in either, both or one table only."""
    tested_a, tested_b = F.col(padj).isNotNull(), F.col(fdr).isNotNull()
    sig_a, sig_b = F.coalesce(F.col(padj) < below, F.lit(False)), F.coalesce(F.col(fdr) < below, F.lit(False))
    conditions = {
        "tested_a": tested_a, "tested_b": tested_b, "tested_both": tested_a & tested_b, "tested_a_only": tested_a & ~tested_b, "tested_b_only": tested_b & ~tested_a,
        "sig_a": sig_a, "sig_b": sig_b, "sig_both": sig_a & sig_b, "sig_a_only": sig_a & ~sig_b, "sig_b_only": sig_b & ~sig_a,
    }
    key = F.when(F.forall(F.array(*(F.col(p).isNotNull() for p in part)), lambda x: x), F.struct(*part))
    counts = [F.countDistinct(F.when(c, F.col(event))).alias(f"events_{n}") for n, c in conditions.items()] + [F.countDistinct(F.when(c, key)).alias(f"parts_{n}") for n, c in conditions.items()]
    return rows.agg(*counts, F.countDistinct(event).alias("events"))


def exclusive_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    """How many rows have exactly each combination of flags."""
    return rows.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


def crosswalk_strict(a: DataFrame, b: DataFrame) -> DataFrame:
    """Events of a (gene, event, ref, alt: arrays) with those of b whose reference and alternative sets are the same; events of a without one keep null."""
    sets = lambda t: t.withColumns({"r": F.array_sort(F.array_distinct("ref")), "x": F.array_sort(F.array_distinct("alt"))})
    left, right = sets(a).select("gene", "event", "r", "x"), sets(b).select("gene", F.col("event").alias("other"), "r", "x")
    return left.join(right, ["gene", "r", "x"], "left").select("gene", "event", "other")


def crosswalk_lenient(a: DataFrame, b: DataFrame) -> DataFrame:
    """As crosswalk_strict(), where both sets need only have a part in common."""

    def pairs(name: str) -> DataFrame:
        left = a.select("gene", "event", F.explode(F.array_distinct(name)).alias("part"))
        right = b.select("gene", F.col("event").alias("other"), F.explode(F.array_distinct(name)).alias("part"))
        return left.join(right, ["gene", "part"]).select("gene", "event", "other").distinct()

    both = pairs("ref").join(pairs("alt"), ["gene", "event", "other"])
    return a.select("gene", "event").distinct().join(both, ["gene", "event"], "left")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Matched pairs in which neither event has another match."""
    known = pairs.where("other is not null")
    n, m = F.count(F.lit(1)).over(W.partitionBy("gene", "event")), F.count(F.lit(1)).over(W.partitionBy("gene", "other"))
    return known.withColumns({"__n": n, "__m": m}).where("__n = 1 and __m = 1").drop("__n", "__m")


def categories(rows: DataFrame, p_a: str, p_b: str, effect_a: str, effect_b: str, below: float = 0.05) -> DataFrame:
    """`rows` with category (Both, A-only, B-only, Neither) and same_direction."""
    a, b = F.coalesce(F.col(p_a) < below, F.lit(False)), F.coalesce(F.col(p_b) < below, F.lit(False))
    named = F.when(a & b, "Both").when(a, "A-only").when(b, "B-only").otherwise("Neither")
    return rows.withColumn("category", named).withColumn("same_direction", F.signum(effect_a) == F.signum(effect_b))


def min_p_by_part(results: DataFrame) -> DataFrame:
    """results (gene, event, parts, pvalue, ...) -> for each gene and part the row with the smallest p-value."""
    each = results.where("pvalue is not null").withColumn("part", F.explode("parts")).drop("parts")
    return keep_first(each, ["gene", "part"], ["pvalue", "event"])


def average_ranks(rows: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """`rows` with the average rank of a column within `by`; a group's distinct values are counted before they are ranked."""
    values = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy(*by).orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = values.withColumn(out, before + (F.col("__c") + 1) / 2).drop("__c")
    return rows.join(ranks, [*by, column])


def correlations(rows: DataFrame, by: list[str], p_a: str, p_b: str, effect_a: str, effect_b: str) -> DataFrame:
    """by, n, pearson of -log10 p, spearman of p, pearson of the effects; complete rows only."""
    complete = rows.where(" and ".join(f"`{c}` is not null" for c in (p_a, p_b, effect_a, effect_b)))
    ranked = average_ranks(average_ranks(complete, by, p_a, "__ra"), by, p_b, "__rb")
    log = lambda c: -F.log10(F.col(c) + 1e-300)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(log(p_a), log(p_b)).alias("pearson_p"), F.corr("__ra", "__rb").alias("spearman_p"), F.corr(effect_a, effect_b).alias("pearson_effect"))


def gene_sets(expression: DataFrame, splicing: DataFrame) -> DataFrame:
    """expression (contrast, gene, up: boolean) and splicing (contrast, gene, class) -> contrast, gene, set: DGE_only, splicing_only or both, with the direction and the class."""
    a = expression.groupBy("contrast", "gene").agg(F.bool_or("up").alias("up"))
    b = splicing.groupBy("contrast", "gene").agg(F.array_join(F.array_sort(F.collect_set("class")), "+").alias("class"))
    joined = a.join(b, ["contrast", "gene"], "full")
    kind = F.when(F.col("class").isNull(), "DGE_only").when(F.col("up").isNull(), "splicing_only").otherwise("both")
    return joined.select("contrast", "gene", kind.alias("set"), F.when(F.col("up"), "up").when(~F.col("up"), "down").alias("direction"), "class")


def set_counts(sets: DataFrame) -> DataFrame:
    return sets.groupBy("contrast", "set", "direction", "class").agg(F.count(F.lit(1)).alias("n"))
