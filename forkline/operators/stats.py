"""Differential usage: comparisons, dispersion, moderation, tests and effect sizes, each over all events at once.

event_counts(gene, event, sample, grp, ref, diff1, diff2); comparisons(gene, event, comparison, sample, grp, diff, ref, n, y).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numerics, special
from ..sources.shared import save
from .fdr import add_significant, adjust
from .ranks import medians, quantiles
from .trend import local_trend

EVENT = ["gene", "event", "comparison"]
#: Label, the side that is tested and the side it is measured against.
COMPARISONS = [("diff1_vs_ref", "diff1", "ref"), ("diff2_vs_ref", "diff2", "ref")]
JUNCTION_COMPARISONS = [*COMPARISONS, ("diff2_vs_diff1", "diff2", "diff1")]


def comparisons(event_counts: DataFrame, table: list[tuple[str, str, str]] = COMPARISONS) -> DataFrame:
    """One row for each comparison of an event's sample in which both sides are known."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("comparison"), F.col(d).alias("diff"), F.col(r).alias("ref")) for name, d, r in table)))
    rows = event_counts.select("gene", "event", "sample", "grp", each.alias("__pair")).select("gene", "event", "sample", "grp", "__pair.*")
    return rows.where("diff is not null and ref is not null").withColumns({"n": F.col("diff") + F.col("ref"), "y": F.col("diff")})


def keep_events(rows: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Rows with a known n of events that have `least` of them or more."""
    known = rows.where("n is not null")
    enough = known.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).drop("c")
    return known.join(enough, by, "left_semi")


def base_mean(rows: DataFrame, by: list[str] = EVENT) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg("n").alias("baseMean"))


def base_mean_multinomial(long: DataFrame) -> DataFrame:
    """(gene, event, baseMean): the mean over samples of the sum over types."""
    return long.groupBy("gene", "event", "sample").agg(F.sum("cnt").alias("n")).groupBy("gene", "event").agg(F.avg("n").alias("baseMean"))


def pseudocount(rows: DataFrame, pc: float = 1) -> DataFrame:
    """Where ref is 0: ref becomes pc and n grows by it."""
    none = F.col("ref") == 0
    return rows.withColumn("n", F.when(none, F.col("n") + pc).otherwise(F.col("n"))).withColumn("ref", F.when(none, F.lit(pc)).otherwise(F.col("ref")))


def lfc_summary(rows: DataFrame, ref: str, trt: str, by: list[str] = EVENT, pc: float = 1) -> DataFrame:
    """by, lfc_diff, lfc_ref, lfc_diff_net, pi_trt, pi_ref, delta_pi from the groups' mean counts."""
    mean = lambda c, g: F.avg(F.when(F.col("grp") == g, F.col(c)))
    m = rows.groupBy(*by).agg(mean("diff", trt).alias("dt"), mean("diff", ref).alias("dr"), mean("ref", trt).alias("rt"), mean("ref", ref).alias("rr"))
    share = lambda d, r: F.when(F.col(d) + F.col(r) != 0, F.col(d) / (F.col(d) + F.col(r)))
    out = m.withColumns({"lfc_diff": F.log2((F.col("dt") + pc) / (F.col("dr") + pc)), "lfc_ref": F.log2((F.col("rt") + pc) / (F.col("rr") + pc)), "pi_trt": share("dt", "rt"), "pi_ref": share("dr", "rr")})
    return out.select(*by, "lfc_diff", "lfc_ref", (F.abs("lfc_diff") - F.abs("lfc_ref")).alias("lfc_diff_net"), "pi_trt", "pi_ref", (F.col("pi_trt") - F.col("pi_ref")).alias("delta_pi"))


# --- moderation ------------------------------------------------------------------------------------------------


def _shrunk(rows: DataFrame, by: list[str], z: str, var: str, target: Column | None = None) -> DataFrame:
    """Adds w and z_mod from z_bar, tau2 (columns) and a target (z_bar unless given); a weight that is not a number is 0."""
    w = F.coalesce(F.nanvl(F.col("tau2") / F.when(F.col("tau2") + F.col(var) != 0, F.col("tau2") + F.col(var)), F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("w", w).withColumn("z_mod", F.col("w") * F.col(z) + (1 - F.col("w")) * (F.col("z_bar") if target is None else target))


def _priors(rows: DataFrame, by: list[str], z: str, var: str, sure: Column) -> DataFrame:
    """by, middle, middle_var, spread, n (and sure_middle, sure_var, sure_spread, sure_n of the rows that are `sure`): exact medians, sample variance and count of the estimates."""
    marked = rows.withColumns({"middle": F.col(z), "middle_var": F.col(var), "sure_middle": F.when(sure, F.col(z)), "sure_var": F.when(sure, F.col(var))})
    points = medians(marked, by, ["middle", "middle_var", "sure_middle", "sure_var"])
    sums = rows.groupBy(*by).agg(F.var_samp(z).alias("spread"), F.var_samp(F.when(sure, F.col(z))).alias("sure_spread"), F.count(F.lit(1)).alias("n"), F.count_if(sure).alias("sure_n"))
    return points.join(sums, by) if by else points.crossJoin(sums)  # one row each


def _with_prior(rows: DataFrame, prior: DataFrame, by: list[str]) -> DataFrame:
    """A prior is one row for each comparison."""
    return rows.join(F.broadcast(prior), by) if by else rows.crossJoin(F.broadcast(prior))


def moderate_log(phi: DataFrame, by: list[str], limit: float = 1e10) -> DataFrame:
    """phi (..., phi, var_phi[, identifiable]) -> z, var_z, w, z_mod, phi_mod: log precisions shrunk to the median of the identifiable ones (all, if those are fewer than 10) of each `by`."""
    rows = phi.where((F.col("phi") > 0) & (F.col("phi") < limit)).withColumn("z", F.log("phi")).withColumn("var_z", F.col("var_phi") / (F.col("phi") * F.col("phi")))
    sure = F.coalesce(F.col("identifiable"), F.lit(False)) if "identifiable" in phi.columns else F.lit(True)
    pick = lambda a, b: F.when(F.col("sure_n") < 10, F.col(a)).otherwise(F.col(b))
    prior = _priors(rows, by, "z", "var_z", sure).select(*by, pick("middle", "sure_middle").alias("z_bar"), F.greatest(pick("spread", "sure_spread") - pick("middle_var", "sure_var"), F.lit(0.0)).alias("tau2"))
    return _shrunk(_with_prior(rows, prior, by), by, "z", "var_z").withColumn("phi_mod", F.exp("z_mod")).drop("z_bar", "tau2")


def moderate_precision(prec: DataFrame, by: list[str]) -> DataFrame:
    """prec (..., log_prec, var_log_prec[, identifiable]) -> w_prec, log_prec_mod, prec_mod, rho_mod (kept within 1e-6 of 0 and 1)."""
    valid = F.coalesce((F.col("var_log_prec") < 1000) & (F.abs("log_prec") < 50), F.lit(False))
    sure = F.coalesce(F.col("identifiable"), F.lit(False)) if "identifiable" in prec.columns else F.lit(True)
    whole = medians(prec, by, ["log_prec"]).withColumnRenamed("log_prec", "any_middle")
    usable = _priors(prec.where(valid), by, "log_prec", "var_log_prec", sure)
    joined = whole.join(usable, by, "left") if by else whole.crossJoin(usable)  # one row each
    many = F.coalesce(F.col("sure_n"), F.lit(0)) >= 10
    pick = lambda a, b: F.when(many, F.col(b)).otherwise(F.col(a))
    enough = many | (F.coalesce(F.col("n"), F.lit(0)) >= 10)
    tau = F.greatest(pick("spread", "sure_spread") - pick("middle_var", "sure_var"), F.lit(0.0))
    prior = joined.select(*by, F.when(enough, pick("middle", "sure_middle")).otherwise(F.col("any_middle")).alias("z_bar"), F.when(enough, tau).otherwise(0.0).alias("tau2"))
    out = _shrunk(_with_prior(prec, prior, by), by, "log_prec", "var_log_prec").withColumnsRenamed({"w": "w_prec", "z_mod": "log_prec_mod"})
    rho = F.greatest(F.least(1 / (1 + F.exp("log_prec_mod")), F.lit(1 - 1e-6)), F.lit(1e-6))
    return out.withColumn("prec_mod", F.exp("log_prec_mod")).withColumn("rho_mod", rho).drop("z_bar", "tau2")


def moderate_trend(est: DataFrame, means: DataFrame, keys: list[str], z: str, var: str, span: float = 0.5) -> DataFrame:
    """Estimates shrunk to a trend over log baseMean; every event of `means` gets a row, those without an estimate the trend.

    The trend is a local regression (trend.local_trend) on the reliable estimates: identifiable ones, below the 90 % point
    of the variance. With fewer than ten of them, and outside of their range, it is their median.
    """
    rows = save(est.join(means, keys).where("baseMean > 0").withColumn("x", F.log("baseMean")), "estimates")
    sure = F.coalesce(F.col("identifiable"), F.lit(False)) if "identifiable" in est.columns else F.lit(True)
    if rows.where(sure).limit(10).count() < 10:
        sure = F.lit(True)
    limit, known = quantiles(rows, [], var, [0.9]).first(), rows.where(sure)
    reliable = save(known.where((F.col(var) < F.lit(limit.q if limit else None)) & F.col(z).isNotNull()).select("x", F.col(z).alias("z")), "reliable")
    middle, noise = medians(reliable, [], ["z"]).first()[0], medians(known, [], [var]).first()[0]
    spread = known.agg(F.var_samp(z)).first()[0]
    tau = 0.0 if spread is None or noise is None else max(spread - noise, 0.0)
    everyone = means.withColumn("log_bm", F.log(F.greatest("baseMean", F.lit(1.0))))
    trend = F.lit(middle) if reliable.limit(10).count() < 10 else local_trend(reliable, span, middle, F.col("log_bm"))
    joined = everyone.withColumn("z_trend", trend.cast("double")).join(est.select(*keys, z, var), keys, "left").withColumn("tau2", F.lit(tau))
    return _shrunk(joined, keys, z, var, F.col("z_trend")).drop("tau2")


def trend_prior(moderated: DataFrame) -> DataFrame:
    """(comparison, sd): spread of the estimates around the trend of moderate_trend(), of the identifiable ones if 10 or more are marked so; comparisons with too few take the spread of all, and if that is not known that of the estimates themselves."""
    used = moderated
    if "identifiable" in moderated.columns and moderated.where("identifiable and z is not null").limit(10).count() == 10:
        used = moderated.where("identifiable")
    rest = F.col("z") - F.col("z_trend")
    overall, plain = used.agg(F.stddev_samp(rest), F.stddev_samp("z")).first()
    return used.groupBy("comparison").agg(F.coalesce(F.stddev_samp(rest), F.lit(overall), F.lit(plain)).alias("sd"))


def impute(rows: DataFrame, table: DataFrame) -> DataFrame:
    """`rows` (comparison, z_mod, ...) with missing z_mod from the comparison's median in `table`, else the median of all, else 0."""
    each = medians(table, ["comparison"], ["z_mod"]).withColumnRenamed("z_mod", "m")
    overall = medians(table, [], ["z_mod"]).first()
    return rows.join(F.broadcast(each), "comparison", "left").withColumn("z_mod", F.coalesce("z_mod", "m", F.lit(overall[0] if overall else None), F.lit(0.0))).drop("m")


# --- estimates and tests of single events ----------------------------------------------------------------------


#: Bounds of the log precision of a beta-binomial; Newton steps of the means at each point of the grid, of those that are tested, and of all parameters at once.
BB_RANGE, STEPS, MORE_STEPS, CLIMB = (-5.0, 18.0), 5, 12, 6


def _samples(rows: DataFrame, by: list[str], *more: str) -> DataFrame:
    """(by, grp, y, z, n, more): samples with counts, of which y are the event's and z the rest, of events with two or more."""
    some = rows.where("n > 0")
    many = some.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select(*by)
    return some.join(many, by, "left_semi").select(*by, "grp", F.col("y").cast("double").alias("y"), (F.col("n") - F.col("y")).cast("double").alias("z"), F.col("n").cast("double").alias("n"), *more)


_COLUMNS: dict[tuple, dict[str, Column]] = {}


def _columns(name: str, make: Callable[[], dict[str, Column]]) -> dict[str, Column]:
    """Long expressions over fixed column names, built once for each JVM."""
    key = (id(SparkContext._gateway), name)
    if key not in _COLUMNS:
        _COLUMNS[key] = make()
    return _COLUMNS[key]


def _rises() -> dict[str, Column]:
    """Of a sample, at a = mu phi and b = (1 - mu) phi: differences of digamma and trigamma that its likelihood's derivatives are made of."""
    a, b, y, z = map(F.col, ("a", "b", "y", "z"))
    return {"da": special.digamma_rise(a, y), "db": special.digamma_rise(b, z), "ta": special.trigamma_rise(a, y), "tb": special.trigamma_rise(b, z)}


def _whole_rises() -> dict[str, Column]:
    return {"dn": special.digamma_rise(F.col("phi"), F.col("n")), "tn": special.trigamma_rise(F.col("phi"), F.col("n"))}


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mu", 1 / (1 + F.exp(-F.col("e")))).withColumns({"a": F.col("mu") * F.col("phi"), "b": (1 - F.col("mu")) * F.col("phi")}).withColumns(_columns("rises", _rises))


def _clipped(column: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), column))


def fit_means(rows: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """`rows` (keys, grp, y, z, n, phi) with the group's mean mu, a, b, its logit e and the information h on that, at the precision phi.

    Groups have nothing in common once the precision is fixed, so each is a Newton search in one variable, with bounded steps; a step is two sums over
    the group's rows, and all steps keep the rows where they are.
    """
    group = W.partitionBy(*keys, "grp")
    start = (F.sum("y").over(group) + 0.5) / (F.sum("n").over(group) + 1)
    rows = rows.withColumn("start", start).withColumn("e", F.log(F.col("start") / (1 - F.col("start")))).drop("start")
    d = F.col("phi") * F.col("mu") * (1 - F.col("mu"))
    h = -(F.col("t") * d * d + F.col("s") * d * (1 - 2 * F.col("mu")))
    move = F.when(F.col("h") > 1e-10, F.col("s") * d / F.col("h")).otherwise(F.signum("s") * 0.5)
    for step in range(steps + 1):
        rows = _placed(rows).withColumns({"s": F.sum(F.col("da") - F.col("db")).over(group), "t": F.sum(F.col("ta") + F.col("tb")).over(group)}).withColumn("h", h)
        if step < steps:
            rows = rows.withColumn("e", _clipped(F.col("e") + _clipped(move, 2.0), 25.0))
    return rows


def _climbed(rows: DataFrame, by: list[str], steps: int, penalised: bool) -> DataFrame:
    """`rows` (by, grp, y, z, n, e, x, low, high) with the log precision x and the means' logits e at the top of the likelihood, by Newton steps in all of them at once; x stays between low and high.

    Groups meet in the precision alone, so the matrix of second derivatives is an arrow: a step is sums over the groups' rows, and sums of these over the event's.
    Leaves curve, the second derivative by x with the means at their best.
    """
    group, event = W.partitionBy(*by, "grp"), W.partitionBy(*by)
    mu, phi = F.col("mu"), F.col("phi")
    v = phi * mu * (1 - mu)
    rows = rows.withColumn("members", F.count(F.lit(1)).over(group))
    sums = {
        "s": F.col("da") - F.col("db"), "t": F.col("ta") + F.col("tb"), "mixed": F.col("da") - F.col("db") + phi * (mu * F.col("ta") - (1 - mu) * F.col("tb")),
    }
    slope = mu * F.col("da") + (1 - mu) * F.col("db") - F.col("dn")
    bend = mu * mu * F.col("ta") + (1 - mu) * (1 - mu) * F.col("tb") - F.col("tn")
    sure = F.col("h") > 1e-10
    per_row = lambda c: c / F.col("members")
    pull = -(F.col("x") - F.col("prior_mean")) / (F.col("prior_sd") * F.col("prior_sd")) if penalised else F.lit(0.0)
    stiff = 1 / (F.col("prior_sd") * F.col("prior_sd")) if penalised else F.lit(0.0)
    for step in range(steps + 1):
        rows = _placed(rows.withColumn("phi", F.exp("x"))).withColumns(_columns("whole", _whole_rises))
        rows = rows.withColumns({name: F.sum(c).over(group) for name, c in sums.items()})
        rows = rows.withColumn("h", -(F.col("t") * v * v + F.col("s") * v * (1 - 2 * mu))).withColumns({"ge": F.col("s") * v, "xe": v * F.col("mixed")})
        by_x = phi * slope + per_row(F.when(sure, F.col("xe") * F.col("ge") / F.col("h")).otherwise(0.0))
        by_xx = phi * phi * bend + phi * slope + per_row(F.when(sure, F.col("xe") * F.col("xe") / F.col("h")).otherwise(0.0))
        rows = rows.withColumns({"gx": F.sum(by_x).over(event) + pull, "curve": F.sum(by_xx).over(event) - stiff})
        if step < steps:
            dx = _clipped(F.when(F.col("curve") < -1e-12, -F.col("gx") / F.col("curve")).otherwise(F.signum("gx") * 0.5), 1.0)
            rows = rows.withColumn("x2", F.greatest(F.col("low"), F.least(F.col("high"), F.col("x") + dx)))
            de = F.when(sure, (F.col("ge") + F.col("xe") * (F.col("x2") - F.col("x"))) / F.col("h")).otherwise(F.signum("s") * 0.5)
            rows = rows.withColumn("e", _clipped(F.col("e") + _clipped(de, 2.0), 25.0)).withColumn("x", F.col("x2")).drop("x2")
    return rows


def _bb_likelihood() -> dict[str, Column]:
    """A sample's beta-binomial log likelihood without the binomial coefficient."""
    return {"v": special.log_rising(F.col("a"), F.col("y")) + special.log_rising(F.col("b"), F.col("z")) - special.log_rising(F.col("phi"), F.col("n"))}


def dispersion(rows: DataFrame, by: list[str] = EVENT, prior: tuple[float, float] | None = None) -> DataFrame:
    """by, phi, var_phi, identifiable: beta-binomial precision with a mean for each group, or its mode under a normal prior on its log.

    The prior (mean, sd) is one for all, or each event's own where the rows have prior_mean and prior_sd. A grid of log precisions, each with the best means, finds the
    neighbourhood of the top, and Newton steps in all parameters climb it. The variance is that of the curvature there (infinite where there is none). identifiable: better
    than binomials with the same means at the 5 % point of one degree. Each point of the grid is a row for each sample, and everything is summed by event, point and group.
    """
    own = {"prior_mean", "prior_sd"} <= set(rows.columns)
    if prior and not own:
        rows = rows.withColumns({"prior_mean": F.lit(float(prior[0])), "prior_sd": F.lit(float(prior[1]))})
    penalised = own or prior is not None
    terms = save(_samples(rows, by, *(["prior_mean", "prior_sd"] if penalised else [])), "samples")
    penalty = -((F.col("x") - F.col("prior_mean")) * (F.col("x") - F.col("prior_mean"))) / (2 * F.col("prior_sd") * F.col("prior_sd")) if penalised else None
    scored = lambda joined: fit_means(joined.withColumn("phi", F.exp("x")), [*by, "k"], STEPS).withColumns(_columns("likelihood", _bb_likelihood))
    spread = _by_event(terms, by)
    with special.small_methods(rows.sparkSession):
        ends = terms.select(*by).distinct().withColumns({"low": F.lit(BB_RANGE[0]), "high": F.lit(BB_RANGE[1])})
        near = save(_grid(spread, by, ends, scored, penalty).select(*by, _point(-1)["x"].alias("low"), _point(0)["x"].alias("x"), _point(1)["x"].alias("high")), "grid")
        at = fit_means(spread.join(near, by).withColumn("phi", F.exp("x")), by, STEPS // 2)
        top = _climbed(at, by, CLIMB, penalised).withColumns(_columns("likelihood", _bb_likelihood))
        y, n = F.col("y"), F.col("n")
        groups = top.groupBy(*by, "grp").agg(F.first("phi").alias("phi"), F.first("curve").alias("curve"), F.sum("v").alias("v"), F.sum("y").alias("y"), F.sum("n").alias("n"))
        flat = F.when(y > 0, y * F.log(y / n)).otherwise(0.0) + F.when(n > y, (n - y) * F.log(1 - y / n)).otherwise(0.0)
        found = groups.withColumn("flat", flat).groupBy(*by).agg(F.first("phi").alias("phi"), F.first("curve").alias("curve"), F.sum("v").alias("best"), F.sum("flat").alias("flat"))
        variance = F.when(F.col("curve") < -1e-8, F.col("phi") * F.col("phi") / -F.col("curve")).otherwise(F.lit(float("inf")))
        return save(found.select(*by, "phi", variance.alias("var_phi"), (2 * (F.col("best") - F.col("flat")) > CHI2_95).alias("identifiable")), "dispersion")


def prior_of(phi: DataFrame, limit: float = 1e10) -> tuple[float, float]:
    """Mean and standard deviation (n in the divisor) of log phi over identifiable events, or over all if those are fewer than 10."""
    rows = phi.where((F.col("phi") > 0) & (F.col("phi") < limit))
    sure, z = F.coalesce("identifiable", F.lit(False)), F.log("phi")
    r = rows.agg(F.count_if(sure), F.avg(F.when(sure, z)), F.stddev_pop(F.when(sure, z)), F.avg(z), F.stddev_pop(z)).first()
    mean, sd = (r[1], r[2]) if r[0] >= 10 else (r[3], r[4])
    return float(mean or 0.0), max(float(sd or 0.0), 1e-3)


def wald_test(rows: DataFrame, contrasts: list[tuple[str, str]], model: str, by: list[str] = EVENT) -> DataFrame:
    """by, contrast, LRT, pvalue, phi, effect_size, model: beta-binomial means compared in logits, for each contrast (trt, ref).

    The precision is exp(z_mod) of the rows, or each event's own estimate where they have none (`z_mod` not a column).
    At a fixed precision groups are independent, so a contrast's variance is the sum of two inverse informations.
    """
    if "z_mod" in rows.columns:
        known = rows.where(F.col("z_mod").isNotNull() & ~F.isnan("z_mod"))
        samples = _samples(known.withColumn("phi", F.exp("z_mod")), by, "phi")
    else:
        samples = _samples(rows, by).join(dispersion(rows, by).select(*by, "phi"), by)
    samples = save(samples, "samples")  # dealt anew below; behind a join by event that exchange would be left out, and the rest of it merged by size into few tasks
    usable = samples.groupBy(*by).agg(F.count_distinct("grp").alias("g"), F.sum("y").alias("c")).where("g >= 2 and c > 0").select(*by)
    with special.small_methods(rows.sparkSession):
        usable = save(usable, "usable")
        fits = save(fit_means(_by_event(samples, by).join(usable, by, "left_semi"), by, MORE_STEPS).groupBy(*by, "grp").agg(F.first("e").alias("e"), F.first("h").alias("h"), F.first("phi").alias("phi")), "fits")
    of = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    tests = F.inline(F.array(*(F.struct(F.lit(f"{trt}:{ref}").alias("contrast"), F.col(f"c{i}").alias("c")) for i, (trt, ref) in enumerate(contrasts))))
    wide = fits.groupBy(*by).agg(F.first("phi").alias("phi"), *(F.struct((of(trt, "e") - of(ref, "e")).alias("d"), of(trt, "h").alias("h1"), of(ref, "h").alias("h2")).alias(f"c{i}") for i, (trt, ref) in enumerate(contrasts)))
    each = wide.select(*by, "phi", tests).where("c.h1 > 0 and c.h2 > 0 and c.d is not null").withColumn("LRT", F.col("c.d") * F.col("c.d") / (1 / F.col("c.h1") + 1 / F.col("c.h2")))
    return each.select(*by, "contrast", "LRT", special.chi2_tail(F.col("LRT"), F.lit(1)).alias("pvalue"), "phi", F.col("c.d").alias("effect_size"), F.lit(model).alias("model"))


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Samples with counts, with prop, y / n, its average rank in the event and how many samples share it; an event has as many rows as the experiment has samples."""
    props = rows.where("n > 0").withColumn("prop", F.col("y") / F.col("n"))
    first, same = F.rank().over(W.partitionBy(*by).orderBy("prop")), F.count(F.lit(1)).over(W.partitionBy(*by, "prop"))
    return props.withColumn("same", same).withColumn("rank", first + (same - 1) / 2)


def rank_sum_table(sizes: DataFrame) -> DataFrame:
    """sizes (m, n) -> (m, n, u, low, high): the share of all orders of m and n untied values whose rank sum exceeds its least value by u or less, and by u or more.

    Made once for each pair of sizes under EXACT, so the table is bounded.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for m, n in zip(frame.m.tolist(), frame.n.tolist(), strict=True):
                yield numerics.rank_sum_tails(m, n)

    return sizes.select("m", "n").distinct().mapInPandas(run, "m long, n long, u long, low double, high double")


#: Groups of fewer samples have an exact rank-sum tail, if no two values are equal.
EXACT = 50


def wilcoxon_test(rows: DataFrame, by: list[str] = EVENT, first: str | None = None) -> DataFrame:
    """by, pvalue, effect_size, model: rank sums of the proportions y / n of events with two groups; `first` is the group that the other is measured against, the smaller name unless given.

    effect_size is the second mean less the first. Two-sided p-values: exact from rank_sum_table() for small groups without ties, else normal with
    a tie correction and half a rank of continuity; null where all values are equal.
    """
    ranked = _ranked(rows, by)
    one = F.col("grp") == (F.lit(first) if first is not None else F.min("grp").over(W.partitionBy(*by)))
    of = lambda f, c: f(F.when(F.col("one"), F.col(c)))
    sums = ranked.withColumn("one", one).groupBy(*by).agg(
        F.count_if("one").alias("m"), F.count_if(~F.col("one")).alias("n"), of(F.sum, "rank").alias("w"), F.sum(F.col("same") * F.col("same") - 1).cast("double").alias("ties"), F.count_distinct("grp").alias("groups"), F.sum("y").alias("y"),
        of(F.avg, "prop").alias("mean1"), F.avg(F.when(~F.col("one"), F.col("prop"))).alias("mean2"),
    )
    usable = sums.where("groups = 2 and m > 0 and n > 0 and y <> 0").withColumn("u", F.col("w") - F.col("m") * (F.col("m") + 1) / 2).withColumn("exact", (F.col("m") < EXACT) & (F.col("n") < EXACT) & (F.col("ties") == 0))
    usable = save(usable, "rank-sums")
    table = rank_sum_table(usable.where("exact")).select(F.col("m").alias("tm"), F.col("n").alias("tn"), F.col("u").alias("tu"), "low", "high")
    met = usable.join(table, F.col("exact") & (F.col("m") == F.col("tm")) & (F.col("n") == F.col("tn")) & (F.round("u").cast("long") == F.col("tu")), "left")
    size, half = F.col("m") + F.col("n"), F.col("m") * F.col("n") / 2
    sigma = F.sqrt(F.col("m") * F.col("n") / 12 * (size + 1 - F.col("ties") / (size * (size - 1))))
    z = F.abs(F.col("u") - half)
    far = F.when(z > 0, z - 0.5).otherwise(0.0)
    normal = F.when(sigma > 0, F.least(F.lit(1.0), special.erfc(F.abs(far) / sigma / F.sqrt(F.lit(2.0)))))
    exact = F.least(F.lit(1.0), 2 * F.when(F.col("u") > half, F.col("high")).otherwise(F.col("low")))
    return met.select(*by, F.when(F.col("exact"), exact).otherwise(normal).alias("pvalue"), (F.col("mean2") - F.col("mean1")).alias("effect_size"), F.lit("wilcoxon").alias("model"))


def rank_sums(rows: DataFrame, by: list[str] = EVENT) -> DataFrame:
    """by, grp, n_samples, rank_sum, mean_prop: average ranks of y / n within an event, summed by group."""
    return _ranked(rows, by).groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("rank").alias("rank_sum"), F.avg("prop").alias("mean_prop"))


def _type_counts(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, grp, sample, type, cnt, total): counts of an event's samples, null as 0, with each sample's total; samples without counts are left out."""
    cells = long.groupBy(*by, "grp", "sample", "type").agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("double").alias("cnt"))
    return cells.withColumn("total", F.sum("cnt").over(W.partitionBy(*by, "grp", "sample"))).where("total > 0")


def _dm_terms(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, sign, share, y, w): the log likelihood of a Dirichlet-multinomial of precision a is the sum of w * sign * (ln gamma(a share + y) - ln gamma(a share)).

    Shares are the types' parts of all of the event's counts; a sample's total has the share 1 and the sign -1. Equal terms are one. Events of fewer than two
    samples, or of fewer than two types with counts, have none.
    """
    event = W.partitionBy(*by)
    shared = cells.withColumns({"share": F.sum("cnt").over(W.partitionBy(*by, "type")) / F.sum("cnt").over(event)}).where("share > 0")
    facts = cells.groupBy(*by).agg(F.count_distinct("grp", "sample").alias("samples"), F.count_distinct(F.when(F.col("cnt") > 0, F.col("type"))).alias("types")).where("samples >= 2 and types >= 2")
    kinds = shared.where("cnt > 0").select(*by, F.lit(1.0).alias("sign"), "share", F.col("cnt").alias("y"))
    wholes = cells.select(*by, "grp", "sample", "total").distinct().select(*by, F.lit(-1.0).alias("sign"), F.lit(1.0).alias("share"), F.col("total").alias("y"))
    return kinds.union(wholes).join(facts.select(*by), by, "left_semi").groupBy(*by, "sign", "share", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))


#: Bounds of the log precision of a Dirichlet-multinomial, points of a grid, and how often it is drawn again between the best point's neighbours.
DM_RANGE, POINTS, REDRAWN = (-10.0, 12.0), 13, 4


def _by_event(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows dealt out by event, in as many tasks as the session asks for: they are few bytes and much work, which adaptive merging of partitions would put in few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _grid(spread: DataFrame, by: list[str], ends: DataFrame, scored: Callable[[DataFrame], DataFrame], extra: Column | None = None) -> DataFrame:
    """(by, line, i): the points (k, x, v) of a grid between each event's `low` and `high`, v the sum of the v that `scored` gives an event's rows (with `extra` added once), and the number of the best."""
    k = F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("k")
    points = ends.select(*by, "low", "high", k).withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * (F.col("k") / (POINTS - 1))).drop("low", "high")
    total = F.sum("v") if extra is None else F.sum("v") + F.first(extra)
    sums = scored(spread.join(points, by)).groupBy(*by, "k").agg(F.first("x").alias("x"), total.alias("v"))
    line = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "x", "v"))).alias("line"))  # POINTS items
    values = F.transform("line", lambda p: p["v"])
    return line.withColumn("i", F.array_position(values, F.array_max(values)).cast("int"))


def _point(move: int) -> Column:
    """The best point of _grid(), or the one before or behind it, as far as there is one."""
    return F.element_at("line", F.greatest(F.lit(1), F.least(F.lit(POINTS), F.col("i") + move)))


def maximum(terms: DataFrame, by: list[str], scored: Callable[[DataFrame], DataFrame], low: float, high: float) -> DataFrame:
    """(by, x, best): where the sum of `v` over an event's rows is greatest between two bounds, and how great.

    The grid is drawn anew between the best point's neighbours, and at last the top of the parabola through the best point and its neighbours is taken.
    Every step is a grouping by the event.
    """
    ends = terms.select(*by).distinct().withColumns({"low": F.lit(low), "high": F.lit(high)})
    spread = _by_event(terms, by)
    for _ in range(REDRAWN):
        ends = save(_grid(spread, by, ends, scored).select(*by, _point(-1)["x"].alias("low"), _point(1)["x"].alias("high")), "grid")
    line = _grid(spread, by, ends, scored)
    left, top, right = (_point(k)["v"] for k in (-1, 0, 1))
    bend = left - 2 * top + right
    inner = (F.col("i") > 1) & (F.col("i") < POINTS) & (bend < 0)
    step = F.element_at("line", 2)["x"] - F.element_at("line", 1)["x"]
    return line.select(*by, (_point(0)["x"] + F.when(inner, 0.5 * (left - right) / bend).otherwise(0.0) * step).alias("x"), top.alias("best"))


def dm_precision(long: DataFrame, by: list[str]) -> DataFrame:
    """by, log_prec, var_log_prec, identifiable of a long count table (by, type, sample, grp, cnt): Dirichlet-multinomials with the types' shares of all counts plugged in.

    The variance is that of the curvature; events whose likelihood has no top have no row. identifiable: better than a multinomial at the 5 % point of one degree, and not at the upper bound.
    """
    terms = save(_dm_terms(_type_counts(long, by), by), "dm-terms")
    rise = lambda f, a: F.col("w") * F.col("sign") * f(a * F.col("share"), F.col("y"))
    with special.small_methods(long.sparkSession):
        found = save(maximum(terms, by, lambda rows: rows.withColumn("v", rise(special.log_rising, F.exp("x"))), *DM_RANGE), "dm-tops")
    a = F.exp("x")
    bends = terms.join(found, by).groupBy(*by, "x", "best").agg(
        (F.first(a) * F.first(a) * F.sum(F.col("share") * F.col("share") * rise(special.trigamma_rise, a))).alias("bend"), F.sum(F.when(F.col("sign") > 0, F.col("w") * F.col("y") * F.log("share"))).alias("flat")
    )
    sure = (2 * (F.col("best") - F.col("flat")) > CHI2_95) & (F.col("x") < DM_RANGE[1] - 1e-3)
    return bends.where("bend < 0").select(*by, F.col("x").alias("log_prec"), (-1 / F.col("bend")).alias("var_log_prec"), sure.alias("identifiable"))


#: The 95 % point of a chi-square of one degree.
CHI2_95 = 3.841458820694124


def dm_test(long: DataFrame, by: list[str]) -> DataFrame:
    """by, LRT, df, pvalue, effect_size, model: one set of shares against one for each group, at the precision exp(log_prec_mod) of the rows.

    What samples' totals add is the same on both sides, so the ratio is a sum over (sample, type). effect_size is the change, from the first group to the second, of
    the log ratio of the first type to the last.
    """
    prec = long.groupBy(*by).agg(F.exp(F.min("log_prec_mod")).alias("a")).where("a is not null")
    cells = _type_counts(long, by)
    event = lambda *more: W.partitionBy(*by, *more)
    shares = cells.withColumns({"common": F.sum("cnt").over(event("type")) / F.sum("cnt").over(event()), "own": F.sum("cnt").over(event("grp", "type")) / F.sum("cnt").over(event("grp"))})
    gain = F.when(F.col("cnt") > 0, special.log_rising(F.col("a") * F.col("own"), F.col("cnt")) - special.log_rising(F.col("a") * F.col("common"), F.col("cnt"))).otherwise(0.0)
    sums = shares.join(prec, by).groupBy(*by).agg(
        F.greatest(2 * F.sum(gain), F.lit(0.0)).alias("LRT"), F.count_distinct("type").alias("types"), F.count_distinct("grp").alias("groups"), F.count_distinct("grp", "sample").alias("samples"),
        F.count_distinct(F.when(F.col("cnt") > 0, F.col("type"))).alias("some"), F.array_sort(F.collect_set(F.struct("grp", "type", F.greatest("own", F.lit(1e-10)).alias("own")))).alias("table"),  # groups x types
    ).where("samples >= 2 and groups >= 2 and some >= 2")
    first = lambda g, t: F.element_at("table", ((g - 1) * F.col("types") + t).cast("int"))["own"]
    ratio = lambda g: F.log(first(F.lit(g), F.lit(1)) / first(F.lit(g), F.col("types")))
    df = ((F.col("types") - 1) * (F.col("groups") - 1)).cast("int")
    return sums.select(*by, "LRT", df.alias("df"), special.chi2_tail(F.col("LRT"), df).alias("pvalue"), (ratio(2) - ratio(1)).alias("effect_size"), F.lit("dirmult_EBplugin").alias("model"))


def apply_test(rows: DataFrame, by: list[str], test: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, errors: bool = False) -> DataFrame:
    """A test of your own: a function of one event's rows that returns a frame, or None for no row.

    An event that raises an error does not end the job. It gives no row, or with `errors` one with the names of the
    event, as far as the schema has them, and the message in a further column `error`, which is null otherwise.
    """
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]
    out_names = [*names, *(["error"] if errors else [])]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            out = test(frame)
        except Exception as e:  # noqa: BLE001  one bad event must not end the job
            out = None
            if errors:
                row = dict.fromkeys(names) | {c: frame[c].iloc[0] for c in by if c in names} | {"error": f"{type(e).__name__}: {e}"}
                return pd.DataFrame([row], dtype=object)
        if out is None:
            return pd.DataFrame(columns=out_names)
        return out[names].assign(error=None) if errors else out[names]

    return rows.groupBy(*by).applyInPandas(run, schema + (", error string" if errors else ""))


MODELS = ("betabinom_EBmap", "betabinom_EBapprox", "betabinom_MLE", "dirmult_EBplugin", "wilcoxon")


def run_test(counts: DataFrame, model: str, contrasts: list[tuple[str, str]], table: list[tuple[str, str, str]] = COMPARISONS, trend: bool = False, alpha: float = 0.05, delta: float = 0.0, share_dispersion: str | None = None, filtering: bool = True) -> DataFrame:
    """From event counts (long type counts for dirmult_EBplugin) to adjusted and flagged results.

    Contrasts are (treated, reference) groups; samples of other groups are left out. Effects, filtering and adjustment are of each contrast alone, and so is
    wilcoxon, which tests the contrast's two groups; dirmult_EBplugin has one test over all groups. share_dispersion names the comparison whose estimates stand for those of all comparisons of an event. With trend,
    precisions are shrunk to their trend over baseMean, and betabinom_EBmap takes that trend and the spread around it as each event's prior.
    """
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    groups = sorted({g for pair in contrasts for g in pair})
    counts = counts.where(F.col("grp").isin(groups))
    if model == "dirmult_EBplugin":
        by = ["gene", "event"]
        prec = save(dm_precision(counts, by), "precision")
        means = base_mean_multinomial(counts)
        if trend:
            mod = moderate_trend(prec, means, by, "log_prec", "var_log_prec").withColumnRenamed("z_mod", "log_prec_mod")
        else:
            mod = moderate_precision(prec, [])
        middle = medians(mod, [], ["log_prec_mod"]).first()[0]
        rows = counts.join(mod.select(*by, "log_prec_mod"), by, "left").withColumn("log_prec_mod", F.coalesce("log_prec_mod", F.lit(middle)))
        results = dm_test(rows, by).join(means, by, "left").withColumn("contrast", F.lit("all"))
        return add_significant(adjust(save(results, "results"), alpha=alpha, filtering=filtering), alpha, delta)
    rows = save(keep_events(comparisons(counts, table), EVENT), "comparisons")  # read in every step
    means = base_mean(rows)
    used = pseudocount(rows)
    if model == "wilcoxon":
        results = reduce(DataFrame.unionByName, [wilcoxon_test(used.where(F.col("grp").isin(trt, ref)), first=ref).withColumn("contrast", F.lit(f"{trt}:{ref}")) for trt, ref in contrasts])
    elif model == "betabinom_MLE":
        results = wald_test(used, contrasts, model)
    else:
        # estimates of other comparisons than the shared one would be used nowhere
        phi = save(dispersion(used.where(F.col("comparison") == share_dispersion) if share_dispersion else used), "dispersion")
        if share_dispersion:
            shared = phi.drop("comparison")
            phi = means.select(*EVENT).join(shared, ["gene", "event"])
        if trend:
            z = phi.where("phi > 0 and phi < 1e10").withColumns({"z": F.log("phi"), "var_z": F.col("var_phi") / F.col("phi") / F.col("phi")})
            approx = moderate_trend(z, means, EVENT, "z", "var_z")
        else:
            approx = moderate_log(phi, ["comparison"])
        z_mod = approx.select(*EVENT, "z_mod")
        if model == "betabinom_EBmap":
            mean, sd = prior_of(phi)
            rows_with_prior = used
            if trend:
                spread = trend_prior(approx.join(phi.select(*EVENT, "identifiable"), EVENT, "left"))
                rows_with_prior = used.join(approx.select(*EVENT, F.col("z_trend").alias("prior_mean")), EVENT, "left").join(spread.withColumnRenamed("sd", "prior_sd"), "comparison", "left")
                rows_with_prior = rows_with_prior.withColumns({"prior_mean": F.coalesce("prior_mean", F.lit(mean)), "prior_sd": F.greatest(F.coalesce("prior_sd", F.lit(sd)), F.lit(1e-3))})
            mode = dispersion(rows_with_prior, prior=(mean, sd)).select(*EVENT, F.log("phi").alias("z_map"))
            z_mod = z_mod.join(mode, EVENT, "full").select(*EVENT, F.coalesce("z_map", "z_mod").alias("z_mod"))
        results = wald_test(impute(used.join(z_mod, EVENT, "left"), z_mod), contrasts, model)
    effects = reduce(DataFrame.unionByName, [lfc_summary(rows, ref, trt).withColumn("contrast", F.lit(f"{trt}:{ref}")) for trt, ref in contrasts])
    results = results.join(means, EVENT, "left").join(effects, [*EVENT, "contrast"], "left")
    return add_significant(adjust(save(results, "results"), alpha=alpha, by=["contrast"], filtering=filtering), alpha, delta)
