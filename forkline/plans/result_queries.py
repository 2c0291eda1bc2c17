"""Registered queries that bring results and splits together: joined tables, chosen paths, text forms, enrichment inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import part_labels
from ..operators import compare, enrich, mapping, splits, stats
from .queries import MAX_SINGLE, _bubbles, _genes, _phi, _pruned, _text, _two_tools, node_lists, query
from .views import view

def _part_table(spark: SparkSession, sf: str) -> DataFrame:
    """One result for each gene and part: the smallest p-value of the events that have the number."""
    return view(spark, sf, "v_results").where("event <> 2").groupBy("gene", "part").agg(F.round(F.min("pvalue"), 9).alias("part_p"))


@query
def tests_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_events").where("diff1 > 40").select("gene", F.concat_ws(":", F.col("gene").cast("string"), F.col("event").cast("string"), F.col("sample").cast("string")).alias("id"), (F.col("event") % 7).alias("part"))
    part_map = rows.groupBy("gene", "part").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("event_ids"))
    tests = rows.where(F.col("gene") % 3 > 0).select(F.col("id").alias("event_id"), F.length("id").alias("score"))
    return compare.tests_of_parts(part_map, _part_table(spark, sf), tests, ["gene", "part"]).select("gene", "part", "event_id", "part_p", "score")


@query
def parts_of_tests(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "v_splits").where("event < 3").select("gene", F.col("event").alias("event_id"), F.col("diff1").alias("parts"))
    return compare.parts_of_tests(events, _part_table(spark, sf), ["gene", "part"]).select("gene", "part", "event_id", "part_p")


@query
def annotate_results(spark: SparkSession, sf: str) -> DataFrame:
    table = view(spark, sf, "v_splits").withColumns({"ref": part_labels(F.col("ref")), "diff1": part_labels(F.col("diff1"))}).where("gene % 4 > 0")
    return compare.annotate(view(spark, sf, "v_results").select("gene", "event", "comparison"), table.union(table), ["ref", "diff1"])


@query
def exclusive_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _two_tools(spark, sf)
    for name, p in (("a", "p_a"), ("b", "p_b")):
        rows = rows.withColumns({f"tested_{name}": F.col(p).isNotNull(), f"sig_{name}": F.coalesce(F.col(p) < 0.2, F.lit(False))})
    return compare.exclusive_counts(rows, ["tested_a", "tested_b", "sig_a", "sig_b"])


@query
def override_expression(spark: SparkSession, sf: str) -> DataFrame:
    genes = _genes(spark, sf)
    known = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("gene"), F.col("s_acctbal").cast("double").alias("expr"))
    return enrich.override_expression(genes, known).withColumn("total_expr", F.round("total_expr", 6))


@query
def map_ids(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("gene"), F.concat(F.lit("id"), F.col("s_nationkey").cast("string")).alias("target"))
    return enrich.map_ids(_genes(spark, sf), table).select("target", "gene", "n_events", "is_sig")


@query
def chosen_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    chosen = node_lists(spark, sf).where("tx % 3 = 0").select("gene", "tx")
    rows = splits.chosen_vs_rest(_bubbles(spark, sf, ("txs",)), chosen)
    return rows.select("gene", "src", "snk", _text("txs1").alias("txs1"), _text("txs2").alias("txs2"), "n1", "n2")


@query
def changed_vs_constant(spark: SparkSession, sf: str) -> DataFrame:
    txs = node_lists(spark, sf).select("gene", "tx")
    rows = splits.changed_vs_constant(_bubbles(spark, sf), txs.where("tx % 3 = 0"), txs.where("tx % 3 = 1"))
    side = lambda k: F.element_at("groups", k)
    return rows.select("gene", "src", "snk", part_labels(F.col("ref")).alias("ref"), part_labels(side(1)["diff"]).alias("diff1"), part_labels(side(2)["diff"]).alias("diff2"), F.size(side(1)["txs"]).alias("n1"), F.size(side(2)["txs"]).alias("n2"))


@query
def split_text(spark: SparkSession, sf: str) -> DataFrame:
    """Multinomial splits in their wide text form, with columns for as many groups as a split can have."""
    return splits.as_text(splits.multinomial(_pruned(spark, sf, MAX_SINGLE)), MAX_SINGLE).drop("n_paths")


@query
def two_sided(spark: SparkSession, sf: str) -> DataFrame:
    rows = mapping.two_sided(splits.multinomial(_pruned(spark, sf, MAX_SINGLE)))
    return rows.select("gene", "src", "snk", *(part_labels(F.col(c)).alias(c) for c in ("ref", "diff1", "diff2")))


@query
def impute_means(spark: SparkSession, sf: str) -> DataFrame:
    """Moderated values of events that lack them: the comparison's median, else the median of all."""
    z = _phi(spark, sf).select(*stats.EVENT, F.when((F.col("gene") % 4 > 0) & (F.col("comparison") == "diff1_vs_ref"), F.col("phi")).alias("z_mod"))
    return stats.impute(z, z).select(*stats.EVENT, F.round("z_mod", 6).alias("z_mod"))
