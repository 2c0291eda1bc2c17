"""False discovery: p-value adjustment, nested and filtered forms, and the combination of sides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import save
from .ranks import quantiles, ranked_values, running_best, same_group


def p_adjust(rows: DataFrame, by: list[str], p: str = "pvalue", out: str = "padj", method: str = "BH", small_groups: bool = False) -> DataFrame:
    """`rows` with adjusted p-values among the rows with the same `by`; null p-values are not counted and stay null.

    Methods: BH, BY, bonferroni, holm, hochberg, none. Groups are ranked in ranges and may have any size (see ranks.py); small_groups
    says that each is known to be small, as the tests of one gene, and is ranked in one task.
    """
    if method == "none":
        return rows.withColumn(out, F.col(p))
    if not small_groups:
        return _adjust_ranges(rows, by, p, out, method)
    known = F.col(p).isNotNull()
    group = W.partitionBy(*by, known)
    n, up = F.count(F.lit(1)).over(group), F.row_number().over(group.orderBy(p))
    ranked = rows.withColumn("__n", n).withColumn("__i", up)
    value = _step(F.col(p), F.col("__n"), F.col("__i"), method)
    if method == "bonferroni":
        adjusted = value
    elif method == "holm":
        adjusted = F.max(value).over(group.orderBy("__i").rowsBetween(W.unboundedPreceding, 0))
    else:
        adjusted = F.min(value).over(group.orderBy(F.col("__i").desc()).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn(out, F.when(known, F.least(adjusted, F.lit(1.0)))).drop("__n", "__i")


def _step(p: Column, n: Column, i: Column, method: str) -> Column:
    if method == "BH":
        return p * n / i
    if method == "BY":
        return p * n / i * F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, k: s + 1 / k)
    if method == "bonferroni":
        return F.least(p * n, F.lit(1.0))
    if method in ("holm", "hochberg"):
        return p * (n - i + 1)
    raise ValueError(f"unknown method {method}")


def _adjust_ranges(rows: DataFrame, by: list[str], p: str, out: str, method: str) -> DataFrame:
    values = ranked_values(rows, by, p)
    # of rows with the same p the last rank counts downwards, the first one upwards
    rank = F.col("__upto") - F.col("__c") + 1 if method == "holm" else F.col("__upto")
    values = values.withColumn("__v", _step(F.col(p), F.col("__total"), rank, method))
    if method == "bonferroni":
        done = values.withColumn("__best", F.col("__v"))
    else:
        done = running_best(values, by, p, "__v", largest_first=method != "holm", least=method != "holm")
    table = done.select(*(F.col(b).alias(f"__by_{b}") for b in by), F.col(p).alias("__p"), F.least("__best", F.lit(1.0)).alias(out))
    here = rows.drop(out)
    return here.join(table, same_group(here, table, by, [f"__by_{b}" for b in by]) & (here[p] == table["__p"]), "left").drop("__p", *(f"__by_{b}" for b in by))


def simes(rows: DataFrame, by: list[str], p: str = "pvalue") -> DataFrame:
    """by, simes: least of K p(k) / k over the K p-values of a group, not cut at 1; null if it has none."""
    order = W.partitionBy(*by, F.col(p).isNull())
    ranked = rows.withColumn("__k", F.row_number().over(order.orderBy(p))).withColumn("__n", F.count(p).over(order))
    return ranked.groupBy(*by).agg(F.min(F.col("__n") * F.col(p) / F.col("__k")).alias("simes"))


def nested_bh(rows: DataFrame, alpha: float = 0.05, by: list[str] | None = None, gene: str = "gene", p: str = "pvalue") -> DataFrame:
    """`rows` with padj_gene (BH over the genes' Simes p-values) and padj (BH within genes whose padj_gene is under alpha, else null); all of it for each value of `by`."""
    by = by or []
    genes = p_adjust(simes(rows, [*by, gene], p), by, "simes", "padj_gene").drop("simes")
    joined = rows.join(genes, [*by, gene], "left")
    within = p_adjust(joined.withColumn("__p", F.when(F.col("padj_gene") < alpha, F.col(p))), [*by, gene], "__p", "padj", small_groups=True)
    return within.drop("__p")


def filtered_p(rows: DataFrame, thetas: list[float], filter_by: str = "baseMean", p: str = "pvalue", method: str = "BH", by: list[str] | None = None) -> DataFrame:
    """A row of `rows` for each quantile theta of the filter (within `by`) that it reaches, with theta, cutoff and padj among those rows: the result is meant, so rows multiply. independent_filtering() does not go this way."""
    by = by or []
    q = quantiles(rows, by, filter_by, thetas).select(*(F.col(b).alias(f"__by_{b}") for b in by), F.col("at").alias("theta"), F.col("q").alias("cutoff"))
    each = rows.join(F.broadcast(q) if not by else q, same_group(rows, q, by, [f"__by_{b}" for b in by]) & (rows[filter_by] >= q["cutoff"])).drop(*(f"__by_{b}" for b in by))
    return p_adjust(each, [*by, "theta"], p, "padj", method)


def _lowess(x: np.ndarray, y: np.ndarray, f: float, rounds: int = 3) -> np.ndarray:
    """Robust local lines through a handful of points (the rejection counts of the thetas)."""
    n = len(x)
    k = min(n, max(2, int(f * n + 1e-7)))
    fit, robust = np.zeros(n), np.ones(n)
    for _ in range(rounds + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.sort(d)[k - 1]
            w = np.where(d <= 0.999 * h, (1 - np.clip(d / h, 0, 1) ** 3) ** 3 if h > 0 else 1.0, 0.0)
            w = np.where(d <= 0.001 * h, 1.0, w) * robust
            if w.sum() <= 0:
                fit[i] = y[i]
                continue
            w = w / w.sum()
            mean = (w * x).sum()
            spread = (w * (x - mean) ** 2).sum()
            slope = (w * (x - mean) * y).sum() / spread if np.sqrt(spread) > 0.001 * (x.max() - x.min()) else 0.0
            fit[i] = (w * y).sum() + slope * (x[i] - mean)
        r = np.abs(y - fit)
        six = 6 * np.median(r)
        if six < 1e-7 * r.mean() or six == 0:
            break
        u = r / six
        robust = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - np.clip(u, 0, 1) ** 2) ** 2, 0.0))
    return fit


def choose_theta(thetas: list[float], rejections: list[int]) -> int:
    """The first theta whose rejections exceed the fitted maximum less the fit's error (else 90 %, 80 % of it, else the first); the first if there are 10 or fewer."""
    n = np.array(rejections, float)
    if n.max() <= 10:
        return 0
    fit = _lowess(np.array(thetas), n, 0.2)
    some = n > 0
    top, rmse = fit.max(), float(np.sqrt(np.mean((n[some] - fit[some]) ** 2)))
    for least in (top - rmse, 0.9 * top, 0.8 * top):
        if (n > least).any():
            return int(np.argmax(n > least))
    return 0


def rejections(rows: DataFrame, by: list[str], p: str, step: str, n_steps: int, alpha: float, method: str) -> DataFrame:
    """(by, rejections array<bigint>): for each k below n_steps, how many of the rows whose `step` is above k have an adjusted p-value under alpha among them.

    Rows are counted once by (by, p-value, step); a running count for each k is a column, so no row is multiplied. Only p-values under alpha
    can be rejected; the others count in the totals alone.
    """
    each = lambda text: F.expr(f"array({', '.join(text(k) for k in range(n_steps))})")
    group = ", ".join(f"`{b}`" for b in by) or "0"  # as a window over the totals: a row for each range
    known = rows.where(F.col(p).isNotNull() & (F.col(step) > 0))
    sizes = known.groupBy(*by).agg(each(lambda k: f"count_if(`{step}` > {k})").alias("__sizes"))
    low = known.where(F.col(p) < alpha)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = low.groupBy(*by, p).agg(each(lambda k: f"count_if(`{step}` > {k})").alias("__c"))
    values = save(counted.repartitionByRange(n, *by, p).withColumn("__range", F.spark_partition_id()), "filter-counts")
    sums = values.groupBy(*by, "__range").agg(each(lambda k: f"sum(__c[{k}])").alias("__m"))
    before = each(lambda k: f"coalesce(sum(__m[{k}]) OVER (PARTITION BY {group} ORDER BY __range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    names = [f"__by_{b}" for b in by]
    starts = sums.select(*(F.col(b).alias(x) for b, x in zip(by, names, strict=True)), F.col("__range").alias("__range2"), before.alias("__before"))
    met = values.join(starts, same_group(values, starts, by, names) & (values["__range"] == starts["__range2"])).drop(*names, "__range2")
    if by:
        totals = sizes.withColumnsRenamed(dict(zip(by, names, strict=True)))
        met = met.join(totals, same_group(met, totals, by, names))
    else:
        met = met.crossJoin(F.broadcast(sizes))  # one row
    inside = f"PARTITION BY {group}, __range ORDER BY `{p}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ranked = met.withColumn("__upto", each(lambda k: f"sum(__c[{k}]) OVER ({inside}) + __before[{k}]"))

    def rejected(k: int) -> Column:
        i, own, total, value = F.col("__upto")[k], F.col("__c")[k], F.col("__sizes")[k], F.col(p)
        here = own > 0
        if method == "holm":
            fails = here & (_step(value, total, i - own + 1, method) >= alpha)
            return F.coalesce(F.min(F.when(fails, i - own)), F.max(i), F.lit(0))
        return F.coalesce(F.max(F.when(here & (_step(value, total, i, method) < alpha), i)), F.lit(0))

    return ranked.groupBy(*by).agg(F.array(*(rejected(k) for k in range(n_steps))).alias("rejections"))


def independent_filtering(rows: DataFrame, alpha: float = 0.05, filter_by: str = "baseMean", p: str = "pvalue", method: str = "BH", n_thetas: int = 50, by: list[str] | None = None) -> DataFrame:
    """`rows` with padj under the filter quantile that gains most, for each value of `by` alone; rows below it get null.

    Quantiles go from the share of zeros to 0.95 (1 beyond that). The driver reads n_thetas counts for each value of `by`, which are the contrasts of an experiment.
    """
    by = by or []
    shares = rows.groupBy(*by).agg(F.coalesce(F.avg((F.col(filter_by) == 0).cast("double")), F.lit(0.0)).alias("zero")).collect()
    key = lambda r: tuple(r[b] for b in by)
    thetas = {key(r): np.linspace(r.zero, 0.95 if r.zero < 0.95 else 1.0, n_thetas).tolist() for r in shares}
    points = sorted({t for line in thetas.values() for t in line})
    q = {(key(r), r["at"]): r.q for r in quantiles(rows, by, filter_by, points).collect()} if points else {}
    schema = ", ".join([*(f"`__by_{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema), "__cutoffs array<double>"])
    lines = [(*k, [q.get((k, t)) for t in line]) for k, line in thetas.items()]
    table = rows.sparkSession.createDataFrame(lines, schema)
    names = [f"__by_{b}" for b in by]
    stepped = rows.join(F.broadcast(table), same_group(rows, table, by, names)).drop(*names)  # a row for each contrast
    stepped = save(stepped.withColumn("__step", F.size(F.filter("__cutoffs", lambda c: F.coalesce(c <= F.col(filter_by), F.lit(False))))).drop("__cutoffs"), "filter-steps")
    counts = {key(r): r.rejections for r in rejections(stepped, by, p, "__step", n_thetas, alpha, method).collect()}
    chosen = [(*k, choose_theta(line, counts.get(k, [0] * n_thetas))) for k, line in thetas.items()]
    best = rows.sparkSession.createDataFrame(chosen, ", ".join([*(f"`__by_{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema), "__k int"]))
    kept = stepped.join(F.broadcast(best), same_group(stepped, best, by, names)).drop(*names)
    marked = kept.withColumn("__p", F.when(F.col("__step") > F.col("__k"), F.col(p))).drop("__step", "__k")
    return p_adjust(marked, by, "__p", "padj", method).drop("__p")


def adjust(rows: DataFrame, method: str = "nested_BH", alpha: float = 0.05, filtering: bool = False, by: list[str] | None = None) -> DataFrame:
    """Nested or plain adjustment for each value of `by`; with filtering, p-values under the filter's cutoff are null before a nested one."""
    if method != "nested_BH":
        return independent_filtering(rows, alpha, method=method, by=by) if filtering else p_adjust(rows, by or [], method=method)
    if filtering:
        rows = independent_filtering(rows, alpha, by=by).withColumn("pvalue", F.when(F.col("padj").isNotNull(), F.col("pvalue"))).drop("padj")
    return nested_bh(rows, alpha, by)


def add_significant(rows: DataFrame, padj_below: float = 0.05, delta: float = 0.0, min_dpi: float = 0.1) -> DataFrame:
    """`rows` with significant: padj under the threshold, and the effect gates that its columns allow; a missing effect passes."""
    ok = F.coalesce(F.col("padj") < padj_below, F.lit(False))
    if "lfc_diff_net" in rows.columns:
        ok &= F.coalesce(F.col("lfc_diff_net") > delta, F.lit(True))
    if "delta_pi" in rows.columns:
        ok &= F.coalesce(F.abs("delta_pi") >= min_dpi, F.lit(True))
    return rows.withColumn("significant", ok)


def combine_min_p(rows: DataFrame, by: list[str], p: str = "pvalue") -> DataFrame:
    """by, pvalue, parts, and the columns of the row with the smallest p-value (0 included) as primary_<name>; groups without p-values go.

    pvalue is the least p in (0, 1]; parts is the union of the rows' `parts`.
    """
    rest = [c for c in rows.columns if c not in (*by, "parts")]
    usable = F.when((F.col(p) > 0) & (F.col(p) <= 1), F.col(p))
    got = rows.where(F.col(p).isNotNull()).groupBy(*by).agg(
        F.min(usable).alias("min_p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("parts"), F.min(F.struct(p, *[c for c in rest if c != p])).alias("x")
    )
    return got.select(*by, F.col("min_p").alias("pvalue"), "parts", *(F.col(f"x.{c}").alias(f"primary_{c}") for c in rest))


def combine_fisher(rows: DataFrame, by: list[str], p: str = "pvalue") -> DataFrame:
    """by, k, statistic, pvalue: minus twice the sum of the logs of the k p-values in (0, 1], and its chi-square tail with 2k degrees, a finite sum."""
    got = rows.where((F.col(p) > 0) & (F.col(p) <= 1)).groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("k"), (-2 * F.sum(F.log(p))).alias("statistic"))
    half = F.col("statistic") / 2
    terms = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), lambda s, i: F.struct((s["term"] * half / i).alias("term"), (s["sum"] + s["term"]).alias("sum")))
    return got.withColumn("pvalue", F.least(F.exp(-half) * terms["sum"], F.lit(1.0)))


def combine_sides(rows: DataFrame, by: list[str], how: str = "min_p", method: str = "nested_BH", alpha: float = 0.05, delta: float = 0.0, min_dpi: float = 0.1, filtering: bool = True, p: str = "pvalue") -> DataFrame:
    """The sides of each event combined (how: min_p or fisher), with the primary side's columns under their own names, then adjusted and flagged anew.

    `by` starts with the gene's column. The filter and the effect gates read the primary side's baseMean, lfc_diff_net and delta_pi, where there are such.
    """
    if how not in ("min_p", "fisher"):
        raise ValueError("how must be min_p or fisher")
    stale = [c for c in ("padj", "padj_gene", "significant") if c in rows.columns]
    least = combine_min_p(rows.drop(*stale), by, p)
    least = least.drop(f"primary_{p}").withColumnsRenamed({c: c.removeprefix("primary_") for c in least.columns if c.startswith("primary_")})
    if how == "fisher":
        least = least.drop("pvalue").join(combine_fisher(rows, by, p), by, "left")
    return add_significant(adjust(least, method, alpha, filtering and "baseMean" in least.columns), alpha, delta, min_dpi)
