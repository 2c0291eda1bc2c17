"""Special functions as columns of built-in operations, so that likelihoods are summed by grouping, without Python."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Arguments are raised by so much before an asymptotic series is used.
RAISED = 8


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs that start in here have long expressions split into methods that the JVM compiles; one method of more than 8,000 bytes of code would be interpreted, six times slower. The session's own setting comes back."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def log1p(u: Column) -> Column:
    """ln(1 + u) for u >= 0, without loss for small u."""
    w = 1 + u
    return F.when(w == 1, u).otherwise(F.log(w) * u / (w - 1))


def log_rising(a: Column, y: Column) -> Column:
    """ln gamma(a + y) - ln gamma(a) for a > 0 and y >= 0; without loss where a is much larger than y."""
    low, high = a + RAISED, a + y + RAISED
    series = lambda z: (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - 1.0 / 1680 / (z * z)) / (z * z)) / (z * z)) / z
    steps = reduce(lambda p, q: p * q, [1 + y / (a + k) for k in range(RAISED)])
    return y * F.log(low) + (high - 0.5) * log1p(y / low) - y + series(high) - series(low) - F.log(steps)


def digamma_rise(a: Column, y: Column) -> Column:
    """digamma(a + y) - digamma(a) for a > 0 and y >= 0."""
    low, high = a + RAISED, a + y + RAISED
    series = lambda z: -0.5 / z - (1.0 / 12 - (1.0 / 120 - (1.0 / 252 - 1.0 / 240 / (z * z)) / (z * z)) / (z * z)) / (z * z)
    return log1p(y / low) + series(high) - series(low) + _sum([y / ((a + k) * (a + y + k)) for k in range(RAISED)])


def trigamma_rise(a: Column, y: Column) -> Column:
    """trigamma(a + y) - trigamma(a) for a > 0 and y >= 0."""
    low, high = a + RAISED, a + y + RAISED
    rest = lambda z: (0.5 + (1.0 / 6 - (1.0 / 30 - (1.0 / 42 - 1.0 / 30 / (z * z)) / (z * z)) / (z * z)) / z) / (z * z)
    return -y / (low * high) + rest(high) - rest(low) - _sum([y * (2 * (a + k) + y) / ((a + k) * (a + k) * (a + y + k) * (a + y + k)) for k in range(RAISED)])


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0: a series up to 2, a continued fraction beyond, so that small tails keep their digits."""
    small = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("total")), lambda s, k: F.struct((s["term"] * 2 * x * x / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * 2 * x * x / (2 * k + 1)).alias("total")))
    deep = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda t, k: x + k / 2 / t)
    e = F.exp(-x * x)
    return F.when(x < 2, 1 - 2 / math.sqrt(math.pi) * e * small["total"]).otherwise(e / (math.sqrt(math.pi) * deep))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(X > x) of a chi-square of a whole number of degrees: a finite sum, with erfc for odd ones."""
    h = F.greatest(x, F.lit(0.0)) / 2
    odd = (df % 2).cast("double")
    # of terms h^(j + odd / 2) / gamma(j + 1 + odd / 2)
    first = F.when(odd == 1, F.sqrt(h) * 2 / math.sqrt(math.pi)).otherwise(1.0)
    n = F.floor(df / 2).cast("int")
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.struct(first.alias("term"), F.lit(0.0).alias("total")), lambda s, k: F.struct((s["term"] * h / (k + odd / 2)).alias("term"), (s["total"] + s["term"]).alias("total")))
    total = F.when(n > 0, F.exp(-h) * terms["total"]).otherwise(0.0)
    return F.least(F.lit(1.0), total + F.when(odd == 1, erfc(F.sqrt(h))).otherwise(0.0))


def log_choose(m: Column, k: Column) -> Column:
    """The log of the number of ways to choose k of m, whole numbers with 0 <= k <= m."""
    return log_rising((m - k + 1).cast("double"), k) - log_rising(F.lit(1.0), k)


def biased_urn(k: Column, own: Column, others: Column, draws: Column, odds: Column) -> Column:
    """The probability that `draws` of own + others balls, one after the other and each own ball `odds` times as likely as another that is left, bring up k own ones (Wallenius' distribution).

    Its integral over (0, 1) is taken over the log of -ln t / d, d being the weight that stays in the urn, where the integrand
    is a single smooth peak that falls off exponentially: equal steps around the top are exact to rounding. Needs odds > 0.
    """
    rest = odds * (own - k) + (others - draws + k)
    lost = lambda a, times: F.when(times > 0, times * F.log(-F.expm1(-a))).otherwise(0.0)
    height = lambda y: F.log(rest) + y - rest * F.exp(y) + lost(odds * F.exp(y), k) + lost(F.exp(y), draws - k)
    # the slope falls all the way, so its zero is found by halving
    share = lambda a: F.when(a > 700, 0.0).when(a < 1e-12, 1.0).otherwise(a / F.expm1(a))
    slope = lambda y: 1 - rest * F.exp(y) + k * share(odds * F.exp(y)) + (draws - k) * share(F.exp(y))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        up = slope(middle) > 0
        return F.struct(F.when(up, middle).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(middle).alias("high"))

    top = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct(F.lit(-60.0).alias("low"), F.lit(60.0).alias("high")), halve)["low"]
    # the steps: 0.3 of the peak's width, to 24 widths below and 12 above
    once = F.transform(F.array(top), lambda y: F.struct(y.alias("y"), height(y).alias("h"), (1e-3 / F.sqrt(F.greatest(2 * height(y) - height(y - 1e-3) - height(y + 1e-3), F.lit(1e-12)))).alias("width")))
    whole = F.transform(once, lambda t: F.log(0.3 * t["width"]) + t["h"] + F.log(F.aggregate(F.sequence(F.lit(-80), F.lit(40)), F.lit(0.0), lambda total, j: total + F.exp(height(t["y"] + 0.3 * t["width"] * j) - t["h"]))))
    log_p = log_choose(own, k) + log_choose(others, draws - k) + F.element_at(whole, 1)
    return F.when((k < 0) | (k > own) | (draws - k > others) | (k > draws), 0.0).when(rest <= 0, 1.0).otherwise(F.exp(log_p))
