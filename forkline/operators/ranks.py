"""Ranks and quantiles within groups of any size: values are counted, sorted in ranges of (group, value), and counts are carried from range to range, so that no group meets in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import save


def same_group(left: DataFrame, right: DataFrame, by: list[str], names: list[str]) -> Column:
    """`by` of left and `names` of right are equal, null to null."""
    return reduce(lambda a, k: a & left[k[0]].eqNullSafe(right[k[1]]), zip(by, names, strict=True), F.lit(True))


def ranked_values(rows: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(by, value, __c, __range, __upto, __total): each distinct value of each group, how often it is there (or the sum of its rows' `weight`), the range it lies in, and how many rows of the group are up to it and in all. Null values are left out."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__c"))
    spread = counted.repartitionByRange(n, *by, value).withColumn("__range", F.spark_partition_id())
    values = save(spread, "ranges")
    sums = values.groupBy(*by, "__range").agg(F.sum("__c").alias("__m"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # a row for each range
    before = F.coalesce(F.sum("__m").over(group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*(F.col(b).alias(f"__by_{b}") for b in by), F.col("__range").alias("__range2"), before.alias("__ahead"), F.sum("__m").over(group).alias("__total"))
    met = values.join(starts, same_group(values, starts, by, [f"__by_{b}" for b in by]) & (values["__range"] == starts["__range2"]))
    inside = F.sum("__c").over(W.partitionBy(*by, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return met.withColumn("__upto", inside + F.col("__ahead")).select(*by, value, "__c", "__range", "__upto", "__total")


def running_best(values: DataFrame, by: list[str], order: str, value: str, largest_first: bool, least: bool) -> DataFrame:
    """`values` (by, order, __range, value, ...) with `__best`: the least or greatest value of a group's rows from either end of the order up to each row."""
    pick, both = (F.min, F.least) if least else (F.max, F.greatest)
    ends = values.groupBy(*by, "__range").agg(pick(value).alias("__end"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    line = group.orderBy(F.col("__range").desc() if largest_first else F.col("__range"))
    carry = ends.select(*(F.col(b).alias(f"__by_{b}") for b in by), F.col("__range").alias("__range2"), pick("__end").over(line.rowsBetween(W.unboundedPreceding, -1)).alias("__carry"))
    inside = W.partitionBy(*by, "__range").orderBy(F.col(order).desc() if largest_first else F.col(order)).rowsBetween(W.unboundedPreceding, 0)
    met = values.join(carry, same_group(values, carry, by, [f"__by_{b}" for b in by]) & (values["__range"] == carry["__range2"]))
    return met.withColumn("__best", both(pick(value).over(inside), F.col("__carry"))).drop(*(f"__by_{b}" for b in by), "__range2", "__carry")


def quantiles(rows: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """(by, at, q): exact quantiles of each group's known values, between two values in proportion; no row for a group without any."""
    values = ranked_values(rows, by, value)
    want = F.array(*(F.lit(float(p)) for p in at))
    place = lambda p: p * (F.col("__total") - 1)
    low, first = F.col("__upto") - F.col("__c"), lambda p: F.floor(place(p))
    # values whose ranks (from 0) hold the rank below or above the point
    holds = lambda r: (r >= low) & (r < F.col("__upto"))
    ends = F.filter(want, lambda p: holds(first(p)) | holds(F.ceil(place(p))))
    each = values.select(*by, F.col(value).alias("__v"), "__upto", "__c", "__total", F.explode(ends).alias("at"))
    share = place(F.col("at")) - first(F.col("at"))
    under = F.max(F.when((first(F.col("at")) >= low) & (first(F.col("at")) < F.col("__upto")), F.col("__v")))
    over = F.max(F.when((F.ceil(place(F.col("at"))) >= low) & (F.ceil(place(F.col("at"))) < F.col("__upto")), F.col("__v")))
    got = each.groupBy(*by, "at").agg(under.alias("a"), over.alias("b"), F.max(share).alias("s"))
    return got.select(*by, "at", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("s")).alias("q"))


def medians(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by and the exact median of each of `columns` in each group; null where a group has no known value."""
    long = rows.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))))
    got = quantiles(long, [*by, "name"], "v", [0.5])
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    wide = got.groupBy(*by).agg(*(F.max(F.when(F.col("name") == c, F.col("q"))).alias(c) for c in columns))
    if not by:
        return wide
    renamed = wide.withColumnsRenamed({b: f"__by_{b}" for b in by})
    return groups.join(renamed, same_group(groups, renamed, by, [f"__by_{b}" for b in by]), "left").drop(*(f"__by_{b}" for b in by))
