"""Local regression on all rows: windows, weights and normal equations are Spark jobs; only what there is of each knot comes to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save
from .ranks import quantiles, ranked_values, running_best

#: The trend is worked out at the quantiles of x that cut the rows in this many parts, and read off between them.
KNOTS = 200


def knots_of(points: DataFrame, n: int = KNOTS) -> list[float]:
    """The distinct quantiles k / n of x, n + 1 numbers at most."""
    return sorted({r.q for r in quantiles(points, [], "x", [k / n for k in range(n + 1)]).collect()})


def bandwidths(points: DataFrame, knots: list[float], nearest: int) -> list[float]:
    """The exact distance of each knot to the `nearest`-th of points (x), at most as many as there are.

    Of the windows of `nearest` neighbours in the order of x, from a to b, those with their middle up to a knot reach it
    from a, the others from b. So the greatest a and the least b on either side of the knot give its window. Windows
    that begin or end with another value than the one before are enough; a and b are carried on from range to range.
    """
    values = ranked_values(points, [], "x")
    start, none = F.col("__upto") - F.col("__c") + 1, F.lit(None).cast("double")
    begins = values.select(start.alias("i"), F.col("x").alias("a"), none.alias("b"), "__total")
    ends = values.select(F.greatest(start - (nearest - 1), F.lit(1)).alias("i"), none.alias("a"), F.col("x").alias("b"), "__total")
    windows = begins.union(ends).where(F.col("i") <= F.col("__total") - (nearest - 1)).groupBy("i").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = save(windows.repartitionByRange(parts, "i").withColumn("__range", F.spark_partition_id()), "windows")
    for end in ("a", "b"):
        spread = running_best(spread, [], "i", end, largest_first=False, least=False).drop(end).withColumnRenamed("__best", end)
    place = F.size(F.filter(F.lit(knots), lambda k: k < (F.col("a") + F.col("b")) / 2))
    sides = spread.groupBy(place.alias("place")).agg(F.max("a").alias("a"), F.min("b").alias("b")).collect()  # a row for each knot at most, and one more
    inf = float("inf")
    return [min(k - max((r.a for r in sides if r.place <= j), default=-inf), min((r.b for r in sides if r.place > j), default=inf) - k) for j, k in enumerate(knots)]


def fit(points: DataFrame, knots: list[float], reach: list[float]) -> list[float]:
    """Tricube-weighted quadratics of z on x (columns of points) at each knot, from the sums of each knot's normal equations."""
    table = F.arrays_zip(F.lit(list(range(len(knots)))).alias("k"), F.lit(knots).alias("p"), F.lit(reach).alias("h"))
    inside = lambda t: (F.abs(F.col("x") - t["p"]) < t["h"]) | (F.col("x") == t["p"])
    near = points.select("x", "z", F.explode(F.filter(table, inside)).alias("t"))
    near = near.select(F.col("t.k").alias("k"), "z", F.when(F.col("t.h") > 0, (F.col("x") - F.col("t.p")) / F.col("t.h")).otherwise(0.0).alias("u"))
    near = near.withColumn("w", F.pow(1 - F.pow(F.abs("u"), 3), 3))
    power = lambda j: F.lit(1.0) if j == 0 else F.pow("u", F.lit(float(j)))
    sums = near.groupBy("k").agg(*(F.sum(F.col("w") * power(j)).alias(f"s{j}") for j in range(5)), *(F.sum(F.col("w") * power(j) * F.col("z")).alias(f"y{j}") for j in range(3)))
    top = {r.k: np.linalg.lstsq([[r[f"s{i + j}"] for j in range(3)] for i in range(3)], [r[f"y{i}"] for i in range(3)], rcond=1e-12)[0][0] for r in sums.collect()}  # a row for each knot
    return [float(top[k]) for k in range(len(knots))]


def read_off(x: Column, knots: list[float], heights: list[float], outside: float) -> Column:
    """The height at x, in proportion between two knots; `outside` beyond the first and the last."""
    at = F.size(F.filter(F.lit(knots), lambda k: k < x))
    p, y = F.lit(knots), F.lit(heights)
    of = lambda a, i: F.try_element_at(a, i)
    between = of(y, at) + (of(y, at + 1) - of(y, at)) * (x - of(p, at)) / (of(p, at + 1) - of(p, at))
    return F.when((x < knots[0]) | (x > knots[-1]), outside).when(x == knots[0], heights[0]).otherwise(between)


def local_trend(points: DataFrame, span: float, outside: float, x: Column) -> Column:
    """The local regression of points (x, z, known numbers; a saved table) with windows of a share `span` of them, read off at a column x. With less than three distinct x it is `outside`."""
    knots = knots_of(points)
    if len(knots) < 3:
        return F.lit(outside)
    nearest = max(3, min(int(span * (n := points.count()) + 1e-5), n))
    return read_off(x, knots, fit(points, knots, bandwidths(points, knots, nearest)), outside)
