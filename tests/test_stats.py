"""Counts, statistics and false discovery on small fixtures."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forkline.functions import numerics as num
from forkline.functions import special
from forkline.operators import compare, counts, enrich, fdr, mapping, stats, trend


def test_columns_of_special_functions(spark):
    a, y = [1e-3, 0.3, 1.0, 2.5, 9.9, 50.0, 1e4, 1e9], [0.0, 1.0, 3.0, 40.0, 5000.0]
    rows = spark.createDataFrame([(p, q) for p in a for q in y], "a double, y double")
    got = rows.select("a", "y", special.log_rising(F.col("a"), F.col("y")).alias("l"), special.digamma_rise(F.col("a"), F.col("y")).alias("d"), special.trigamma_rise(F.col("a"), F.col("y")).alias("t")).collect()
    for r in got:
        log = sum(math.log(r.a + k) for k in range(int(r.y)))
        assert r.l == pytest.approx(log, rel=1e-11, abs=1e-11)
        assert r.d == pytest.approx(sum(1 / (r.a + k) for k in range(int(r.y))), rel=1e-10, abs=1e-16)
        assert r.t == pytest.approx(-sum(1 / (r.a + k) ** 2 for k in range(int(r.y))), rel=1e-9, abs=1e-24)
    x = [0.0, 1e-9, 0.5, 1.9999, 2.0, 3.0, 6.0, 20.0]
    tails = spark.createDataFrame([(v,) for v in x], "x double").select("x", special.erfc(F.col("x")).alias("e"), *(special.chi2_tail(F.col("x"), F.lit(k)).alias(f"c{k}") for k in range(1, 8))).collect()
    for r in tails:
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-12)
        for k in range(1, 8):
            assert r[f"c{k}"] == pytest.approx(float(num.chi2_tail(np.array([r.x]), k)[0]), rel=1e-10), k


def brute_rank_sum(x, y):
    """Two-sided: every choice of ranks counted, or the normal with ties."""
    from itertools import combinations

    both = sorted([*x, *y])
    m, n = len(x), len(y)
    u = sum(both.index(v) + (both.count(v) - 1) / 2 for v in x) - m * (m - 1) / 2
    if len(set(both)) == len(both):
        every = [sum(c) - m * (m - 1) // 2 for c in combinations(range(m + n), m)]
        tail = sum(v >= u for v in every) if u > m * n / 2 else sum(v <= u for v in every)
        return min(1.0, 2 * tail / len(every))
    ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    sigma = math.sqrt(m * n / 12 * (m + n + 1 - ties / ((m + n) * (m + n - 1))))
    return math.erfc(abs(max(abs(u - m * n / 2) - 0.5, 0) if u != m * n / 2 else 0) / sigma / math.sqrt(2)) if sigma else None


def test_rank_sums_against_every_choice(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for e in range(40):
        m, n = rng.randint(1, 6), rng.randint(1, 6)
        x, y = ([rng.randint(1, 100 if e % 2 else 6) for _ in range(k)] for k in (m, n))
        rows += [("g", e, "a", v, 101) for v in x] + [("g", e, "b", v, 101) for v in y]
        want[e] = (brute_rank_sum(x, y), sum(y) / n / 101 - sum(x) / m / 101)
    rows += [("g", 99, "a", 1, 0), ("g", 99, "b", 1, 10), ("g", 98, "a", 0, 10), ("g", 98, "b", 0, 10)]
    got = {r.event: (r.pvalue, r.effect_size) for r in stats.wilcoxon_test(spark.createDataFrame(rows, "gene string, event int, grp string, y long, n long"), ["gene", "event"]).collect()}
    assert set(got) == set(want)
    for e, (p, effect) in want.items():
        assert got[e] == (None if p is None else pytest.approx(p, rel=1e-9), pytest.approx(effect))
    table = num.rank_sum_tails(30, 40)
    assert table.low.iloc[-1] == 1 and table.high.iloc[0] == 1 and table.low.iloc[0] == pytest.approx(1 / math.comb(70, 30))


def event_rows(spark, n, event="e"):
    return spark.createDataFrame([("g", event, f"s{i}", "a" if i % 2 else "b", 1, 10) for i in range(n)], "gene string, event string, sample string, grp string, diff int, n int")


def test_events_need_five_rows(spark):
    assert stats.keep_events(event_rows(spark, 6).union(event_rows(spark, 4, "f")), ["gene", "event"]).count() == 6
    assert stats.keep_events(event_rows(spark, 5), ["gene", "event"]).count() == 5
    four = event_rows(spark, 5).withColumn("n", F.when(F.col("sample") != "s0", F.col("n")))
    assert stats.keep_events(four, ["gene", "event"]).count() == 0


def p_table(spark, ps):
    return spark.createDataFrame([(f"g{i % 2}", i, p, 1.0 + i) for i, p in enumerate(ps)], "gene string, event int, pvalue double, baseMean double")


@pytest.mark.parametrize("by", [[], ["c"]])
@pytest.mark.parametrize(
    ("method", "ps", "want"),
    [
        ("BH", [0.001, 0.01, 0.05, 0.20, 0.50], [0.005, 0.025, 0.05 * 5 / 3, 0.25, 0.5]),
        ("bonferroni", [0.01, 0.05, 0.10], [0.03, 0.15, 0.30]),
        ("holm", [0.01, 0.04, 0.03], [0.03, 0.06, 0.06]),
        ("hochberg", [0.01, 0.04, 0.03], [0.03, 0.04, 0.04]),
        ("BH", [0.04, None, 0.04, 0.9], [0.06, None, 0.06, 0.9]),
        ("holm", [0.04, None, 0.04, 0.9], [0.12, None, 0.12, 0.9]),
    ],
)
def test_adjustment(spark, by, method, ps, want):
    rows = p_table(spark, ps).withColumn("c", F.lit("x"))
    got = [r.padj for r in fdr.p_adjust(rows, by, method=method).orderBy("event").collect()]
    assert got == [None if w is None else pytest.approx(w) for w in want]


def test_adjustment_is_the_same_in_ranges_and_in_windows(spark):
    rng = random.Random(5)
    rows = p_table(spark, [None if rng.random() < 0.1 else round(rng.random(), 2) for _ in range(500)]).withColumn("c", F.lit(1))
    for method in ("BH", "BY", "holm", "hochberg", "bonferroni"):
        one, two = ({r.event: r.padj for r in fdr.p_adjust(rows, by, method=method).collect()} for by in ([], ["c"]))
        assert all((one[k] is None) == (two[k] is None) and (one[k] is None or abs(one[k] - two[k]) < 1e-12) for k in one), method


def test_nested_and_simes(spark):
    rows = spark.createDataFrame([("a", 1, 0.001), ("a", 2, 0.9), ("b", 1, 0.6), ("b", 2, 0.7), ("c", 1, None)], "gene string, event int, pvalue double")
    got = {(r.gene, r.event): (r.padj_gene, r.padj) for r in fdr.nested_bh(rows).collect()}
    assert got["a", 1] == (pytest.approx(0.004), pytest.approx(0.002)) and got["a", 2][1] == pytest.approx(0.9)
    assert got["b", 1] == (pytest.approx(0.7), None) and got["c", 1] == (None, None)


def brute_filtering(rows, alpha, method="BH"):
    """padj of (p, filter) rows, with every theta's rows adjusted anew."""
    known = sorted(f for _, f in rows if f is not None)
    zero = sum(f == 0 for f in known) / len(known)
    thetas = np.linspace(zero, 0.95 if zero < 0.95 else 1.0, 50).tolist()

    def adjusted(cut):
        keep = sorted((p, i) for i, (p, f) in enumerate(rows) if p is not None and f is not None and f >= cut)
        n, out, best = len(keep), {}, 1.0
        steps = list(enumerate(keep, 1))
        if method == "BH":
            for k, (p, i) in reversed(steps):
                best = min(best, p * n / k)
                out[i] = best
        else:
            best = 0.0
            for k, (p, i) in steps:
                best = max(best, p * (n - k + 1))
                out[i] = min(1.0, best)
        return out

    cuts = np.quantile(known, thetas)
    counts = [sum(v < alpha for v in adjusted(c).values()) for c in cuts]
    return adjusted(cuts[fdr.choose_theta(thetas, counts)]), counts


@pytest.mark.parametrize("method", ["BH", "holm"])
def test_filtering_of_each_contrast_alone(spark, method):
    rng = random.Random(2)
    made = []
    for c, power in (("x", 9), ("y", 3)):
        for i in range(300):
            f = float(rng.choice([0, 0, i, i // 3]))
            made.append((c, i, None if rng.random() < 0.05 else round(rng.random() ** (power if f > 100 else 1), 3), f))
    table = spark.createDataFrame(made, "contrast string, id int, pvalue double, baseMean double")
    got = {(r.contrast, r.id): r.padj for r in fdr.independent_filtering(table, 0.1, method=method, by=["contrast"]).collect()}
    for c in ("x", "y"):
        mine = [r for r in made if r[0] == c]
        want, counts = brute_filtering([(p, f) for _, _, p, f in mine], 0.1, method)
        assert max(counts) > 10 or method == "holm"
        assert all(got[c, r[1]] == (pytest.approx(want[k]) if k in want else None) for k, r in enumerate(mine))


def test_quantiles_and_medians(spark):
    from forkline.operators.ranks import medians, quantiles

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.1 else float(rng.randint(0, 20))) for _ in range(500)] + [("empty", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(7)
    at = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = {(r.g, r["at"]): r.q for r in quantiles(table, ["g"], "v", at).collect()}
    for g in ("a", "b", None):
        assert [got[g, p] for p in at] == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], at).tolist())
    assert {r.g: r.v for r in medians(table, ["g"], ["v"]).collect()} == {g: (None if g == "empty" else got[g, 0.5]) for g in ("a", "b", None, "empty")}
    assert medians(table, [], ["v"]).first()[0] == float(np.median([v for _, v in rows if v is not None]))


def test_contrasts_have_effects_and_flags_of_their_own(spark):
    """Of two contrasts one changes nothing and one from 20 to 60 in a hundred."""
    rng = np.random.default_rng(9)
    rows = [("g", e, f"{g}{s}", g, 100 - d, d, None) for e in range(12) for g, share in (("a", 20), ("b", 20), ("c", 60), ("left out", 50)) for s in range(5) for d in [int(rng.binomial(100, share / 100))]]
    table = spark.createDataFrame(rows, "gene string, event int, sample string, grp string, ref long, diff1 long, diff2 long")
    for model in ("betabinom_EBapprox", "wilcoxon"):
        got = stats.run_test(table, model, [("b", "a"), ("c", "a")]).collect()
        assert len(got) == 24, model
        for r in got:
            assert (r.delta_pi > 0.3 and r.significant) if r.contrast == "c:a" else (abs(r.delta_pi) < 0.15 and not r.significant), model


def test_combinations(spark):
    rows = spark.createDataFrame([("g", 0.02, [3], "x"), ("g", 0.5, [1, 3], "y"), ("h", 0.0, [2], "x"), ("i", None, [2], "x")], "gene string, pvalue double, parts array<int>, side string")
    got = {r.gene: (r.pvalue, r.parts, r.primary_side) for r in fdr.combine_min_p(rows, ["gene"]).collect()}
    assert got == {"g": (0.02, [1, 3], "x"), "h": (None, [2], "x")}
    fisher = fdr.combine_fisher(rows, ["gene"]).collect()
    assert len(fisher) == 1 and fisher[0].pvalue == pytest.approx(0.01 * (1 - math.log(0.01)))


def test_independent_filtering_keeps_what_stands_out(spark):
    rng = random.Random(1)
    rows = [(f"g{i}", i, rng.random() ** (8 if i % 4 == 0 and i > 200 else 1), float(i)) for i in range(400)]
    got = fdr.independent_filtering(spark.createDataFrame(rows, "gene string, event int, pvalue double, baseMean double")).collect()
    assert len(got) == 400 and any(r.padj is None for r in got) and any(r.padj is not None and r.padj < 0.05 for r in got)
    assert fdr.choose_theta([0.0, 0.5], [3, 4]) == 0


def test_significance_gates(spark):
    rows = spark.createDataFrame([(0.01, 1.0, 0.5), (0.01, -1.0, 0.5), (0.01, None, None), (0.01, 1.0, 0.01), (None, 1.0, 0.5), (0.2, 1.0, 0.5)], "padj double, lfc_diff_net double, delta_pi double")
    assert [r.significant for r in fdr.add_significant(rows).collect()] == [True, False, True, False, False, False]
    assert fdr.add_significant(rows.select("padj")).where("significant").count() == 4


def test_moderation(spark):
    rows = spark.createDataFrame([("g", i, float(p), v, "c") for i, (p, v) in enumerate(zip((2, 3, 4, 5, 6, -1, 2e10), (0.1, 0.2, 0.3, 0.4, 0.5, 1.0, 1.0), strict=True))], "gene string, event int, phi double, var_phi double, comparison string")
    got = stats.moderate_log(rows, ["comparison"]).collect()
    assert len(got) == 5
    for r in got:
        assert r.z == pytest.approx(math.log(r.phi)) and r.var_z == pytest.approx(r.var_phi / r.phi**2) and 0 <= r.w <= 1 and r.phi_mod == pytest.approx(math.exp(r.z_mod))
    assert stats.impute(rows.select("comparison", F.lit(None).cast("double").alias("z_mod")), stats.moderate_log(rows, ["comparison"])).where("z_mod is null").count() == 0


def plain_trend(x, z, at, span):
    """Local quadratics by sorting all distances."""
    q, out = max(3, int(span * len(x) + 1e-5)), []
    for p in at:
        d = np.abs(x - p)
        h = np.sort(d)[q - 1]
        w = np.sqrt(np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0) if h > 0 else (d == 0) * 1.0)
        out.append(np.linalg.lstsq(np.vander(x - p, 3, increasing=True) * w[:, None], z * w, rcond=None)[0][0])
    return out


@pytest.mark.parametrize("tied", [False, True])
def test_local_regression_like_plain_search(spark, tied):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(400) < 0.4, 2.0, rng.integers(0, 40, 400) / 4) if tied else rng.uniform(0, 8, 400)
    z = np.sin(x) + rng.normal(0, 0.1, 400)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, z, strict=True)], "x double, z double")
    knots = trend.knots_of(points, 20)
    for span in (0.02, 0.3, 0.5, 1.0):
        q = max(3, int(span * 400 + 1e-5))
        reach = trend.bandwidths(points, knots, q)
        assert reach == pytest.approx([float(np.sort(np.abs(x - p))[q - 1]) for p in knots]), span
        if span > 0.1:
            assert trend.fit(points, knots, reach) == pytest.approx(plain_trend(x, z, knots, span), abs=1e-6), span
    read = [r.v for r in points.sparkSession.createDataFrame([(-1.0,), (knots[0],), ((knots[0] + knots[1]) / 2,), (knots[-1],), (99.0,)], "x double").select(trend.read_off(F.col("x"), knots[:2] + knots[-1:], [1.0, 3.0, 7.0], -5.0).alias("v")).collect()]
    assert read == [-5.0, 1.0, 2.0, 7.0, -5.0]
    assert [r.t for r in points.limit(1).select(trend.local_trend(points.where("x = 2.0"), 0.5, 4.5, F.col("x")).alias("t")).collect()] == [4.5]


def test_trend_of_few_and_of_none(spark):
    """Fewer than ten estimates: their median; none at all: null. An event without an estimate takes the trend."""
    means = spark.createDataFrame([("g", e, "c", 10.0 * e) for e in range(5)], "gene string, event int, comparison string, baseMean double")
    est = spark.createDataFrame([("g", e, "c", float(e), e / 10) for e in range(1, 4)], "gene string, event int, comparison string, z double, var_z double")
    got = {r.event: r for r in stats.moderate_trend(est, means, stats.EVENT, "z", "var_z").collect()}
    assert len(got) == 5 and got[4].w == 0 and got[4].z_trend == 1.5 == got[1].z_trend  # the third is the noisiest tenth
    assert [r.z_trend for r in stats.moderate_trend(est.limit(0), means, stats.EVENT, "z", "var_z").collect()] == [None] * 5


def test_trend_prior_and_annotation(spark):
    rows = spark.createDataFrame([("c", 1.0, 0.0), ("c", -1.0, 0.0), ("d", 3.0, 3.0)], "comparison string, z double, z_trend double")
    got = {r.comparison: r.sd for r in stats.trend_prior(rows).collect()}
    assert got == {"c": pytest.approx(math.sqrt(2)), "d": pytest.approx(1.0)}
    # without a spread around the trend that of the estimates counts
    lone = stats.trend_prior(spark.createDataFrame([("c", 1.0, None), ("d", 4.0, None)], "comparison string, z double, z_trend double")).collect()
    assert [r.sd for r in lone] == [pytest.approx(3 / math.sqrt(2))] * 2
    results = spark.createDataFrame([("g", 1, 0.1), ("h", 1, 0.2)], "gene string, event int, pvalue double")
    table = spark.createDataFrame([("g", 1, "E001", "s1"), ("g", 1, "E001", "s2")], "gene string, event int, setdiff1 string, sample string")
    assert {(r.gene, r.setdiff1) for r in compare.annotate(results, table, ["setdiff1"]).collect()} == {("g", "E001"), ("h", None)}


def brute_precision(samples, prior=None):
    """(log phi, its variance, twice the gain over binomials) of (group, y, n) samples: the likelihood with the best means of its groups, climbed by thirds, and its curvature by differences."""

    def climb(f, low, high, rounds=80):
        for _ in range(rounds):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if f(a) > f(b) else (a, high)
        return (low + high) / 2

    rise = lambda a, y: sum(math.log(a + k) for k in range(y))

    def likelihood(x):
        phi, total = math.exp(x), 0.0
        for g in {g for g, _, _ in samples}:
            own = [(y, n) for h, y, n in samples if h == g]
            f = lambda e: sum(rise(phi / (1 + math.exp(-e)), y) + rise(phi / (1 + math.exp(e)), n - y) - rise(phi, n) for y, n in own)  # noqa: B023, E731
            total += f(climb(f, -8, 8, 50))
        return total - ((x - prior[0]) ** 2 / 2 / prior[1] ** 2 if prior else 0)

    x = climb(likelihood, -5.0, 18.0, 45)
    h = 0.05
    flat = 0.0
    for g in {g for g, _, _ in samples}:
        y, n = (sum(s[k] for s in samples if s[0] == g) for k in (1, 2))
        flat += y * math.log(y / n) + (n - y) * math.log(1 - y / n)
    return x, -h * h / (likelihood(x + h) - 2 * likelihood(x) + likelihood(x - h)), 2 * (likelihood(x) - flat)


def test_dispersion_against_plain_search(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for e in range(6):
        samples = []
        for i in range(8):
            g = "ab"[i % 2] if e != 3 else "a"
            n = int(rng.integers(5, 40))
            share = 0.3 if g == "a" else 0.6
            samples.append((g, int(rng.binomial(n, rng.beta(share * 4, (1 - share) * 4) if e != 2 else share)), n))
        want[e] = samples
        rows += [("g", e, "c", f"s{i}", g, y, n) for i, (g, y, n) in enumerate(samples)]
    rows += [("g", 90, "c", "s0", "a", 1, 5), ("g", 90, "c", "s1", "a", 0, 0)]
    table = spark.createDataFrame(rows, "gene string, event int, comparison string, sample string, grp string, y long, n long")
    got = {r.event: r for r in stats.dispersion(table).collect()}
    assert set(got) == set(want)
    for e, samples in want.items():
        x, var, gain = brute_precision(samples)
        assert got[e].identifiable == (gain > 3.8415)
        if x < 17:
            assert math.log(got[e].phi) == pytest.approx(x, abs=1e-3) and got[e].var_phi / got[e].phi ** 2 == pytest.approx(var, rel=0.02)
        else:
            assert got[e].phi > 1e6
    mode = {r.event: r for r in stats.dispersion(table.where("event < 3"), prior=(1.0, 0.5)).collect()}
    for e, r in mode.items():
        x, var, _ = brute_precision(want[e], (1.0, 0.5))
        assert math.log(r.phi) == pytest.approx(x, abs=1e-3) and r.var_phi / r.phi**2 == pytest.approx(var, rel=0.02)


def test_means_at_a_very_high_precision_are_pooled_shares(spark):
    rng = np.random.default_rng(3)
    rows = [("g", 1, "c", "ab"[i % 2], int(y)) for i, y in enumerate(rng.integers(1, 50, 12))]
    table = spark.createDataFrame(rows, "gene string, event int, comparison string, grp string, y long").withColumns({"n": F.lit(60), "z_mod": F.lit(math.log(1e8))})
    (test,) = stats.wald_test(table, [("b", "a")], "m").collect()
    share = {g: sum(r[4] for r in rows if r[3] == g) / 360 for g in "ab"}
    logit = lambda p: math.log(p / (1 - p))
    est = logit(share["b"]) - logit(share["a"])
    assert test.effect_size == pytest.approx(est, rel=1e-4)
    assert test.LRT == pytest.approx(est**2 / sum(1 / (360 * p * (1 - p)) for p in share.values()), rel=1e-3)
    assert stats.wald_test(table.where("grp = 'a'"), [("b", "a")], "m").count() == 0


def brute_dm(counts, groups, log_prec=None):
    """Dirichlet-multinomial by plain sums: the top of the log likelihood over a fine grid and its curvature, or at a given precision the ratio of one set of shares to one a group."""
    likelihood = lambda rows, shares, a: sum(math.lgamma(a) - math.lgamma(a + sum(r)) + sum(math.lgamma(a * p + c) - math.lgamma(a * p) for c, p in zip(r, shares, strict=True) if p > 0) for r in rows)
    share = lambda rows: [sum(c) / sum(map(sum, rows)) for c in zip(*rows, strict=True)]
    rows = [r for r in counts if sum(r)]
    if log_prec is not None:
        kept = [(r, g) for r, g in zip(counts, groups, strict=True) if sum(r)]
        parts = [[r for r, h in kept if h == g] for g in sorted({g for _, g in kept})]
        return 2 * (sum(likelihood(p, share(p), math.exp(log_prec)) for p in parts) - likelihood(rows, share(rows), math.exp(log_prec)))
    f = lambda x: likelihood(rows, share(rows), math.exp(x))
    low, high = -10.0, 12.0
    for _ in range(200):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if f(a) > f(b) else (a, high)
    x = (low + high) / 2
    h = 1e-3
    return x, -h * h / (f(x + h) - 2 * f(x) + f(x - h)), 2 * (f(x) - sum(c * math.log(p) for r in rows for c, p in zip(r, share(rows), strict=True) if c))


def test_dirichlet_multinomials_against_plain_sums(spark):
    rng = np.random.default_rng(11)
    rows, tables = [], {}
    for e in range(8):
        types = 2 + e % 3
        groups = [f"g{i % (2 + e % 2)}" for i in range(10)]
        shares = {g: rng.dirichlet(np.full(types, 3.0)) if e % 4 else np.full(types, 1 / types) for g in set(groups)}
        table = [rng.multinomial(rng.integers(5, 200), rng.dirichlet((2.0, 20.0)[e % 2] * shares[g])).tolist() for g in groups]
        if e == 5:
            table[3] = [0] * types
        tables[e] = (table, groups)
        rows += [("g", e, f"s{i}", g, f"t{k}", int(c) if c or e != 6 else None) for i, (r, g) in enumerate(zip(table, groups, strict=True)) for k, c in enumerate(r)]
    rows += [("g", 90, "s0", "g0", "t0", 5), ("g", 90, "s1", "g1", "t0", 5), ("g", 91, "s0", "g0", "t0", 5), ("g", 91, "s0", "g0", "t1", 5)]
    long = spark.createDataFrame(rows, "gene string, event int, sample string, grp string, type string, cnt long")
    got = {r.event: r for r in stats.dm_precision(long, ["gene", "event"]).collect()}
    assert set(got) <= set(tables) and len(got) >= 6
    for e, r in got.items():
        x, var, gain = brute_dm(*tables[e])
        assert r.log_prec == pytest.approx(x, abs=1e-3) and r.var_log_prec == pytest.approx(var, rel=1e-2) and r.identifiable == (gain > 3.8415)
    tested = {r.event: r for r in stats.dm_test(long.withColumn("log_prec_mod", F.lit(1.5)), ["gene", "event"]).collect()}
    assert set(tested) == set(tables)
    for e, r in tested.items():
        table, groups = tables[e]
        assert r.LRT == pytest.approx(max(0.0, brute_dm(table, groups, 1.5)), rel=1e-8, abs=1e-9) and r.df == (len(table[0]) - 1) * (len(set(groups)) - 1)
        assert r.pvalue == pytest.approx(float(num.chi2_tail(np.array([r.LRT]), r.df)[0]), rel=1e-8)
        share = lambda g: np.maximum(np.sum([t for t, h in zip(table, groups, strict=True) if h == g], 0) / np.sum([t for t, h in zip(table, groups, strict=True) if h == g]), 1e-10)  # noqa: E731, B023
        assert r.effect_size == pytest.approx(math.log(share("g1")[0] / share("g1")[-1]) - math.log(share("g0")[0] / share("g0")[-1]))


def usage(spark, shift):
    rng = np.random.default_rng(4)
    rows = []
    for e in range(12):
        for s in range(10):
            grp = "g2" if s >= 5 else "g1"
            d = int(rng.binomial(100, rng.beta(40, 60) if grp == "g1" or not shift else rng.beta(80, 20)))
            rows.append(("g", e, f"s{s}", grp, 100 - d, d, None))
    return spark.createDataFrame(rows, "gene string, event int, sample string, grp string, ref long, diff1 long, diff2 long")


@pytest.mark.parametrize("model", stats.MODELS)
def test_models(spark, model):
    events = usage(spark, True).withColumn("gene", F.lit("changed")).union(usage(spark, False).withColumn("gene", F.lit("same")))
    if model == "dirmult_EBplugin":
        events = counts.unpivot_counts(events, ["ref", "diff1"])
    got = stats.run_test(events, model, [("g2", "g1")]).collect()
    assert len(got) == 24 and all(0 <= r.pvalue <= 1 for r in got)
    hits = {gene: sum(r.pvalue < 0.05 for r in got if r.gene == gene) for gene in ("changed", "same")}
    assert hits["changed"] >= 11 and hits["same"] <= 4, model


def test_unknown_models_are_an_error(spark):
    with pytest.raises(ValueError):
        stats.run_test(usage(spark, True), "other", [])


def test_trend_and_filtering(spark):
    got = stats.run_test(usage(spark, True), "betabinom_EBapprox", [("g2", "g1")], trend=True, filtering=True)
    assert got.count() == 12 and got.where("padj is not null").count() > 0


def test_own_test_and_errors(spark):
    rows = event_rows(spark, 6).union(event_rows(spark, 6, "f"))

    def test(frame):
        if frame.event[0] == "f":
            raise RuntimeError
        import pandas as pd

        return pd.DataFrame({"event": [frame.event[0]], "total": [int(frame.n.sum())]})

    assert [tuple(r) for r in stats.apply_test(rows, ["gene", "event"], test, "event string, total long").collect()] == [("e", 60)]
    failed = {r.event: (r.total, r.error) for r in stats.apply_test(rows, ["gene", "event"], test, "event string, total long", errors=True).collect()}
    assert failed == {"e": (60, None), "f": (None, "RuntimeError: ")}


def test_prior_of_each_event(spark):
    rows = stats.pseudocount(stats.comparisons(usage(spark, True)))
    # a prior that is narrow settles the estimate, event by event
    means = rows.select(*stats.EVENT).distinct().withColumn("prior_mean", F.pmod(F.xxhash64(*stats.EVENT), F.lit(3)).cast("double") + 1)
    got = stats.dispersion(rows.join(means, stats.EVENT).withColumn("prior_sd", F.lit(1e-3))).join(means, stats.EVENT).collect()
    assert got and all(abs(math.log(r.phi) - r.prior_mean) < 0.05 for r in got) and len({r.prior_mean for r in got}) > 1
    done = stats.run_test(usage(spark, True), "betabinom_EBmap", [("g2", "g1")], trend=True)
    assert done.count() == 12


def test_counts_of_parts(spark):
    table = spark.createDataFrame([("g", 1, "s1", "a", 5), ("g", 2, "s1", "a", 7), ("g", 2, "s2", "b", 1), ("h", 1, "s1", "a", 0), ("h", 1, "s2", "b", 0)], "gene string, part int, sample string, grp string, cnt long")
    events = spark.createDataFrame([("g", 1, [1, 9], [2], None), ("g", 2, None, None, None), ("h", 1, [1], [1], [2]), ("z", 1, [1], [1], None)], "gene string, event int, ref array<int>, diff1 array<int>, diff2 array<int>")
    got = {(r.gene, r.event, r["sample"]): (r.ref, r.diff1, r.diff2) for r in counts.count_bipartitions(events, table).collect()}
    assert got == {("g", 1, "s1"): (5, 7, None), ("g", 1, "s2"): (0, 1, None)}
    both = {(r.event, r["sample"]): r.n for r in counts.count_both_sides(events.where("gene = 'g'"), table).collect()}
    assert both == {("1_s1", "s1"): 12, ("1_s1", "s2"): 1}


def test_junction_counts(spark):
    table = spark.createDataFrame([("c", 10, 20, "s1", "a", 3, 1), ("c", 10, 19, "s1", "a", 2, 0), ("c", 30, 40, "s2", "a", 1, 0)], "chrom string, start int, end int, sample string, grp string, n_uniq long, n_multi long")
    matrix = counts.junction_matrix(table, True)
    introns = spark.createDataFrame([("g", 1, 2, "c", 10, 20, ["t1"]), ("g", 2, 3, "c", 40, 30, ["t1", "t2"])], "gene string, a int, b int, chrom string, from_pos int, to_pos int, txs array<string>")
    events = spark.createDataFrame([("g", 1, [1, 2, 3], ["t1"], ["t2"]), ("x", 1, [1], ["t1"], ["t2"])], "gene string, event int, nodes array<int>, txs1 array<string>, txs2 array<string>")
    labels = counts.label_introns(events, introns)
    assert {(r.gene, r.diff1 is None, r.diff2 is None, r.ref is None) for r in labels.collect()} == {("g", False, True, False), ("x", True, True, True)}
    got = {r["sample"]: (r.diff1, r.diff2, r.ref) for r in counts.count_bipartition_junctions(labels, matrix).collect()}
    assert got == {"s1": (6, None, 0), "s2": (0, None, 1)}


def test_event_mapping(spark):
    edges = spark.createDataFrame(
        [("g", 1, 2, "ex", 100, 201, None, ["t1", "t2"]), ("g", 2, 3, "in", 201, 301, None, ["t1"]), ("g", 3, 4, "ex", 301, 401, None, ["t1"]), ("g", 4, 5, "in", 401, 501, None, ["t1"]), ("g", 2, 5, "in", 201, 501, None, ["t2"]), ("g", 5, 6, "ex", 501, 601, None, ["t1", "t2"]), ("g", 3, 4, "ex_part", 301, 401, 2, ["t1"])],
        "gene string, a int, b int, kind string, from_pos int, to_pos int, part int, txs array<string>",
    )
    events = spark.createDataFrame([("g", "SE_1", "SE", "+", 300, 400, 200, 500), ("g", "SE_2", "SE", "+", 300, 400, 200, 777), ("g", "MXE_1", "MXE", "+", 1, 2, 3, 4)], "gene string, event_id string, etype string, strand string, exonStart_0base int, exonEnd int, upstreamEE int, downstreamES int")
    bounded = mapping.boundaries(events)
    mapped = mapping.event_parts(bounded, edges)
    assert {r.event_id: r.parts for r in mapped.collect()} == {"SE_1": [2], "SE_2": None}
    assert [tuple(r) for r in mapping.coverage(mapped).collect()] == [("SE", 2, 1)]
    assert [tuple(r) for r in mapping.part_to_events(mapped).collect()] == [("g", 2, "SE_1")]
    assert [tuple(r) for r in mapping.event_to_parts(mapped).collect()] == [("g", "SE_1", "E002")]
    schema = "gene string, event int, diff1 array<int>, diff2 array<int>, ref array<int>, src_pos int, snk_pos int, pos1 array<int>, pos2 array<int>"
    where = spark.createDataFrame([("g", 1, 100, 201), ("g", 2, 301, 401), ("g", 3, 501, 601)], "gene string, part int, low int, high int")
    one, other, inside = [201, 301, 401, 501], [201, 501], [201, 301, 501]

    def matched(*rows):
        return {(r.event_id, r.event, r.side) for r in mapping.match_splits(bounded, spark.createDataFrame(list(rows), schema), where).collect()}

    # a boundary that no reference part ends at is no match; a single match stays whatever its source and sink
    assert matched(("g", 7, [2], None, [1, 3], 1, 2, one, other)) == {("SE_1", 7, 1)}
    assert matched(("g", 7, [2], None, [1], 201, 501, one, other)) == set()
    # several: source and sink first, then the side that alone has the exon's ends, then the first
    assert matched(("g", 1, [2], None, [1, 3], 1, 2, one, other), ("g", 2, None, [2], [1, 3], 201, 501, other, one)) == {("SE_1", 2, 2)}
    assert matched(("g", 1, [2], None, [1, 3], 201, 501, one, inside), ("g", 2, [2], None, [1, 3], 201, 501, one, other)) == {("SE_1", 2, 1)}
    assert matched(("g", 1, [2], None, [1, 3], 1, 2, one, other), ("g", 2, [2], None, [1, 3], 1, 2, one, other)) == set()


def test_matching_on_both_strands_and_of_retained_introns(spark):
    """Steps of ten positions; on the minus strand nodes are numbered from the right."""
    split = "gene string, event int, src int, snk int, groups array<struct<paths array<array<int>>, txs array<string>, diff array<int>, status string>>, ref array<int>"
    at = {g: {k: (100 + 10 * k if g == "p" else 200 - 10 * k) for k in range(1, 8)} for g in "pm"}
    nodes = spark.createDataFrame([(g, k, p) for g in "pm" for k, p in at[g].items()] + [(g, k, None) for g in "pm" for k in (0, 8)], "gene string, node int, position int")

    def one(gene, event, src, snk, inner1, diff1, inner2, diff2, ref):
        return gene, event, src, snk, [([inner1], ["a"], diff1, "parts"), ([inner2], ["b"], diff2, "parts" if diff2 else "none")], ref

    rows = [one(g, *rest) for g in "pm" for rest in ((1, 2, 5, [3, 4], [3], [], [], [1, 5]), (2, 1, 6, [], [3], [3, 4], [], [1, 2, 4, 5]), (3, 2, 5, [3], [3, 4], [4], [4], [1, 5]))]
    placed = mapping.placed_splits(spark.createDataFrame(rows, split), nodes)
    assert {(r.gene, r.event): (r.src_pos, sorted(r.pos1)) for r in placed.collect()}["m", 1] == (180, [150, 160, 170, 180])
    zero = lambda g, k: at[g][k] - 1
    low, high = (lambda g, a, b: min(zero(g, a), zero(g, b))), (lambda g, a, b: max(zero(g, a), zero(g, b)))
    strand = {"p": "+", "m": "-"}
    none = dict.fromkeys(("exonStart_0base", "exonEnd", "upstreamEE", "downstreamES", "riExonStart_0base", "riExonEnd", "upstreamES", "downstreamEE", "longExonStart_0base", "longExonEnd", "shortES", "shortEE", "flankingES", "flankingEE"))
    events = []
    for g in "pm":
        base = {"gene": g, "strand": strand[g]}
        events.append(base | none | {"event_id": f"SE_{g}", "etype": "SE", "exonStart_0base": low(g, 3, 4), "exonEnd": high(g, 3, 4), "upstreamEE": low(g, 2, 5), "downstreamES": high(g, 2, 5)})
        for name, end in (("RI", 6), ("RIx", 7)):
            events.append(base | none | {"event_id": f"{name}_{g}", "etype": "RI", "upstreamEE": low(g, 3, 4), "downstreamES": high(g, 3, 4), "riExonStart_0base": low(g, 1, end), "riExonEnd": high(g, 1, end), "upstreamES": low(g, 1, 6), "downstreamEE": high(g, 1, 6)})
    schema = "gene string, strand string, event_id string, etype string, " + ", ".join(f"{c} int" for c in none)
    table = spark.createDataFrame([tuple(e[c.split()[0]] for c in schema.split(", ")) for e in events], schema)
    matched = mapping.match_splits(mapping.boundaries(table), placed, mapping.step_positions(nodes))
    got = {r.event_id: (r.event, r.side, r.diffs, r.ref) for r in matched.collect()}
    # an exon whose ends are not those of the first and last reference part is no match
    assert got == {f"{k}_{g}": v for g in "pm" for k, v in (("SE", (1, 1, [3], [1, 5])), ("RI", (2, 1, [3], [1, 2, 4, 5])))}
    maps = {(r.gene, r.part, r.etype): (r.event_ids, r.ref_event_ids) for r in mapping.split_maps(matched).collect()}
    assert maps["p", 3, "SE"] == ("SE_p", None) and maps["m", 5, "RI"] == (None, "RI_m") and maps["m", 3, "RI"] == ("RI_m", None)


def test_crosswalks_and_sets(spark):
    schema = "gene string, event string, ref array<int>, alt array<int>"
    one = spark.createDataFrame([("g", "a", [1, 2], [3]), ("g", "b", [9], [8])], schema)
    two = spark.createDataFrame([("g", "x", [2, 1], [3]), ("g", "y", [2], [3, 4])], schema)
    assert {tuple(r) for r in compare.crosswalk_strict(one, two).collect()} == {("g", "a", "x"), ("g", "b", None)}
    assert {tuple(r) for r in compare.crosswalk_lenient(one, two).collect()} == {("g", "a", "x"), ("g", "a", "y"), ("g", "b", None)}
    assert compare.one_to_one(compare.crosswalk_lenient(one, two)).count() == 0
    sets = compare.gene_sets(spark.createDataFrame([("k", "a", True), ("k", "b", False)], "contrast string, gene string, up boolean"), spark.createDataFrame([("k", "b", "internal"), ("k", "c", "TSSTTS")], "contrast string, gene string, class string"))
    assert {r.gene: r.set for r in sets.collect()} == {"a": "DGE_only", "b": "both", "c": "splicing_only"}


def test_enrichment(spark):
    rng = random.Random(1)
    genes = spark.createDataFrame([(f"g{i}", rng.randint(1, 20), float(i), i < 40) for i in range(200)], "gene string, n_events long, total_expr double, is_sig boolean")
    members = spark.createDataFrame([(f"g{i}", "hit" if i < 30 else "miss") for i in range(100)], "gene string, term string")
    got = {r.term: r for r in enrich.over_representation(enrich.bias_model(genes), members).collect()}
    assert got["hit"].pvalue < 1e-6 and got["miss"].pvalue > 0.05
    top = enrich.significant_members(genes, members, enrich.over_representation(enrich.bias_model(genes), members), 1).collect()
    assert top[0].term == "hit" and len(top[0].genes.split("/")) == 30


def drawn_one_by_one(own, others, draws, odds):
    """The distribution of own balls among `draws`, draw after draw."""
    p = {0: 1.0}
    for j in range(draws):
        new = {}
        for x, q in p.items():
            mine, rest = odds * (own - x), others - (j - x)
            for y, share in ((x + 1, mine), (x, rest)):
                if share > 0:
                    new[y] = new.get(y, 0.0) + q * share / (mine + rest)
        p = new
    return p


def test_biased_urn_like_drawing(spark):
    cases = [(1, 1, 1, 3.0), (5, 7, 6, 1.0), (5, 7, 12, 2.0), (5, 7, 0, 2.0), (12, 0, 4, 1.0), (40, 160, 60, 4.5), (40, 160, 60, 0.05), (300, 700, 500, 1.7), (10, 2000, 1200, 30.0)]
    rows = [(k, m, n, d, w) for m, n, d, w in cases for k in range(-1, m + 2)]
    table = spark.createDataFrame(rows, "k int, m int, n int, d int, w double").select("*", special.biased_urn(*(F.col(c).cast("double") for c in "kmndw")).alias("p"))
    want = {c: drawn_one_by_one(*c) for c in cases}
    for r in table.collect():
        assert r.p == pytest.approx(want[r.m, r.n, r.d, r.w].get(r.k, 0.0), rel=1e-9, abs=1e-300), r


def test_over_representation_of_nothing(spark):
    """No members, nulls and genes without a weight; a term of all genes is not surprising."""
    genes = spark.createDataFrame([("a", True, 0.5), ("b", None, None), ("c", True, 0.2), (None, True, 0.2)], "gene string, is_sig boolean, pwf double")
    members = spark.createDataFrame([(g, "all") for g in "abc"] + [("a", "all"), ("a", None), (None, "all"), ("zz", "none"), ("a", "one")], "gene string, term string")
    got = {r.term: r for r in enrich.over_representation(genes, members, 1, 10).collect()}
    assert set(got) == {"all", "one"} and got["all"].pvalue == pytest.approx(1) and (got["all"].size, got["all"].n_sig) == (3, 2)
    assert 0 < got["one"].pvalue <= 1 and got["one"].gene_ratio == pytest.approx(1 / 3)
    assert enrich.over_representation(genes, members.limit(0), 1, 10).count() == 0


def test_a_shared_dispersion_is_estimated_alone(spark, monkeypatch):
    """Where one comparison's dispersion stands for all of an event, no other comparison is fitted."""

    class Seen(Exception):
        pass

    def seen(rows, *_, **__):
        raise Seen(sorted(r.comparison for r in rows.select("comparison").distinct().collect()))

    monkeypatch.setattr(stats, "dispersion", seen)
    rows = [(1, 1, s, "g1" if s < 3 else "g2", 20 + s, 10 + s, 5 + s) for s in range(6)]
    events = spark.createDataFrame(rows, "gene int, event int, sample int, grp string, ref long, diff1 long, diff2 long")
    with pytest.raises(Seen) as found:
        stats.run_test(events, "betabinom_EBapprox", [("g2", "g1")], table=stats.JUNCTION_COMPARISONS, share_dispersion="diff2_vs_diff1")
    assert found.value.args[0] == ["diff2_vs_diff1"]


@pytest.mark.parametrize("query", ["part_to_events", "event_to_parts"])
def test_events_are_mapped_where_the_gene_is(spark, query):
    """Lines and orders, and exons by gene (each twice in the plan, made once): nothing else is dealt. It was 12 times, behind a saved table of edges that was dealt for on its own."""
    import __spark_entry__ as entry

    plan = entry.queries()[query](spark, "/root/testdata/sf0.001").select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6 and "lineitem.parquet" in plan


def test_events_of_unknown_genes_and_repeated_ones(spark):
    """An event of a gene without a graph stays, without parts; each of two events of one name has the parts of its own region."""
    edges = spark.createDataFrame(
        [("g", 1, 2, "ex", 100, 201, None, ["t1", "t2"]), ("g", 2, 3, "in", 201, 301, None, ["t1"]), ("g", 3, 4, "ex", 301, 401, None, ["t1"]), ("g", 4, 5, "in", 401, 501, None, ["t1"]), ("g", 2, 5, "in", 201, 501, None, ["t2"]), ("g", 5, 6, "ex", 501, 601, None, ["t1", "t2"]), ("g", 3, 4, "ex_part", 301, 401, 2, ["t1"])],
        "gene string, a int, b int, kind string, from_pos int, to_pos int, part int, txs array<string>",
    )
    rows = [("x", "SE_1", "SE", 201, 501, 301, 401), ("g", "SE_1", "SE", 201, 501, 301, 401), ("g", "SE_1", "SE", 201, 501, 311, 401), ("g", "SE_3", "SE", None, 501, 301, 401)]
    bounded = spark.createDataFrame(rows, "gene string, event_id string, etype string, b1 int, b2 int, alt_low int, alt_hi int")
    found = sorted(((r.gene, r.event_id, r.parts) for r in mapping.event_parts(bounded, edges).collect()), key=str)
    assert found == [("g", "SE_1", None), ("g", "SE_1", [2]), ("x", "SE_1", None)]


def test_splits_meet_events_where_the_gene_is(spark):
    """Events and splits are dealt by gene and by nothing else until they have met; what splits have beside their parts comes along."""
    import re

    edges = [("SE_1", "SE", "+", 301, 401, 201, 501), ("SE_2", "SE", "+", 301, 401, 201, 777), ("RI_1", "RI", "-", 301, 401, 301, 401)]
    bounded = spark.createDataFrame([("g", *e) for e in edges] + [("x", *edges[0])], "gene string, event_id string, etype string, strand string, alt_low int, alt_hi int, b1 int, b2 int")
    splits = spark.createDataFrame([("g", 1, [2], None, [1, 3], "one"), ("g", 2, [1], [2], [3], "two"), ("g", 3, None, [3], [1], "three")], "gene string, event int, diff1 array<int>, diff2 array<int>, ref array<int>, whole string")
    where = mapping.step_positions(spark.createDataFrame([("g", k, p) for k, p in ((0, None), (1, 100), (2, 301), (3, 401), (4, 601), (6, 700), (7, 800), (8, None))], "gene string, node int, position int"))
    assert sorted((r.part, r.low, r.high) for r in where.collect()) == [(1, 100, 301), (2, 301, 401), (3, 401, 601), (6, 700, 800)]
    where = spark.createDataFrame([("g", 1, 100, 201), ("g", 2, 301, 401), ("g", 3, 501, 601)], "gene string, part int, low int, high int")
    met = mapping.met_splits(bounded, splits, where)
    plan = met.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(gene" in plan and not re.search(r"hashpartitioning\(gene#\d+, [a-z]", plan)
    assert sorted((r.event_id, r.event, r.side, r.whole) for r in met.collect()) == [("RI_1", 1, 1, "one"), ("RI_1", 2, 2, "two"), ("SE_1", 1, 1, "one")]
