"""Enrichment of significant genes in categories, with a correction for how many events a gene has."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.arrays import strip_version
from .compare import keep_first
from .fdr import p_adjust
from .ranks import quantiles


def gene_summary(results: DataFrame, contrast: str | None = None, exclude: DataFrame | None = None, strip: bool = True) -> DataFrame:
    """results (gene, event, contrast, baseMean, significant) -> gene, n_events, total_expr, is_sig."""
    rows = results if contrast is None else results.where(F.col("contrast") == contrast)
    if exclude is not None:
        rows = rows.join(exclude.select("gene").distinct(), "gene", "left_anti")
    if strip:
        rows = rows.withColumn("gene", strip_version(F.col("gene").cast("string")))
    events = rows.groupBy("gene", "event").agg(F.avg("baseMean").alias("m"), F.bool_or(F.coalesce("significant", F.lit(False))).alias("s"))
    return events.groupBy("gene").agg(F.count(F.lit(1)).alias("n_events"), F.sum("m").alias("total_expr"), F.bool_or("s").alias("is_sig"))


def override_expression(genes: DataFrame, expression: DataFrame) -> DataFrame:
    """`genes` with total_expr from expression (gene, expr) where it is known."""
    return genes.join(expression, "gene", "left").withColumn("total_expr", F.coalesce("expr", "total_expr")).drop("expr")


def map_ids(genes: DataFrame, table: DataFrame) -> DataFrame:
    """`genes` with target ids of table (gene, target), one gene for each: the one with the most events."""
    return keep_first(genes.join(table, "gene"), ["target"], [F.col("n_events").desc(), "gene"])


def bias_model(genes: DataFrame, with_expression: bool = False, knots: int = 3) -> DataFrame:
    """`genes` with pwf, the probability of being significant given log n_events (and log total_expr): a logistic regression on natural spline columns."""
    rows, columns = genes, []
    for name, value in [("n_events", F.log(F.greatest("n_events", F.lit(1)))), *([("total_expr", F.log(F.greatest("total_expr", F.lit(1.0))))] if with_expression else [])]:
        rows = rows.withColumn(f"__x_{name}", value)
        ks = sorted({r.q for r in quantiles(rows, [], f"__x_{name}", [i / knots for i in range(knots + 1)]).collect()})
        columns.append(f"__x_{name}")
        if len(ks) > 2:
            last, before = ks[-1], ks[-2]
            cube = lambda k: F.pow(F.greatest(F.col(f"__x_{name}") - k, F.lit(0.0)), 3)  # noqa: B023, E731
            tail = (cube(before) - cube(last)) / (last - before)
            for i, k in enumerate(ks[:-2]):
                rows = rows.withColumn(f"__s{i}_{name}", (cube(k) - cube(last)) / (last - k) - tail)
                columns.append(f"__s{i}_{name}")
    ready = VectorAssembler(inputCols=columns, outputCol="__f").transform(rows).withColumn("__y", F.col("is_sig").cast("double"))
    if ready.select("__y").distinct().limit(2).count() < 2:
        return genes.withColumn("pwf", F.lit(ready.agg(F.avg("__y")).first()[0]))
    model = LogisticRegression(featuresCol="__f", labelCol="__y", regParam=0.0, maxIter=100).fit(ready)
    return model.transform(ready).withColumn("pwf", vector_to_array("probability")[1]).select(*genes.columns, "pwf")


def over_representation(genes: DataFrame, members: DataFrame, least: int = 10, most: int = 500, all_genes: bool = False) -> DataFrame:
    """genes (gene, is_sig, pwf), members (gene, term) -> term, size, n_sig, odds, pvalue, padj, gene_ratio.

    The chance of n_sig or more significant members, where the significant genes are drawn from all by weight: a member is
    as much likelier than another gene as the mean pwf of the term's genes is larger than that of the others (`odds`; 1
    where there are no others). The tail is summed exactly (special.biased_urn), a row for each count. Genes of no term
    are not in the urn unless all_genes; terms of `least` to `most` genes only; gene_ratio is the share of all significant
    genes. A null is_sig is not significant, a null or no pwf counts as 0.
    """
    known = members.select("gene", "term").where("gene is not null and term is not null").distinct()
    weights = genes.select("gene", F.coalesce("is_sig", F.lit(False)).alias("is_sig"), F.greatest(F.coalesce("pwf", F.lit(0.0)), F.lit(1e-12)).alias("pwf"))
    drawn = weights if all_genes else weights.join(known.select("gene").distinct(), "gene", "left_semi")
    urn = drawn.agg(F.count(F.lit(1)).alias("n_genes"), F.count_if("is_sig").alias("draws"), F.sum("pwf").alias("weight"))
    every = weights.agg(F.count_if("is_sig").alias("sig"))
    terms = known.join(weights, "gene").groupBy("term").agg(F.count(F.lit(1)).alias("size"), F.count_if("is_sig").alias("n_sig"), F.sum("pwf").alias("own"))
    kept = terms.where(F.col("size").between(least, most)).crossJoin(F.broadcast(urn)).crossJoin(F.broadcast(every))  # one row each
    others = F.col("n_genes") - F.col("size")
    kept = kept.withColumn("others", others).withColumn("odds", F.when(F.col("others") > 0, (F.col("own") / F.col("size")) / ((F.col("weight") - F.col("own")) / F.col("others"))).otherwise(1.0))
    counts = F.sequence(F.col("n_sig"), F.least("size", "draws"))
    each = kept.select("term", "size", "others", "draws", "odds", F.explode(counts).alias("k"))
    each = each.select("term", special.biased_urn(*(F.col(c).cast("double") for c in ("k", "size", "others", "draws", "odds"))).alias("p"))
    tails = each.groupBy("term").agg(F.least(F.sum("p"), F.lit(1.0)).alias("pvalue"))
    ratio = F.col("n_sig") / F.when(F.col("sig") > 0, F.col("sig"))
    told = kept.select("term", "size", "n_sig", "odds", ratio.alias("gene_ratio")).join(tails, "term")
    return p_adjust(told, [], "pvalue", "padj").select("term", "size", "n_sig", "odds", "pvalue", "padj", "gene_ratio")


def significant_members(genes: DataFrame, members: DataFrame, terms: DataFrame, top: int = 20) -> DataFrame:
    """The `top` terms by p-value with their significant genes, joined in order."""
    best = terms.orderBy("pvalue", "term").limit(top)
    rows = members.select("gene", "term").distinct().join(genes.where("is_sig").select("gene"), "gene").join(best.select("term"), "term", "left_semi")
    return best.join(rows.groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("gene")), "/").alias("genes")), "term", "left")
