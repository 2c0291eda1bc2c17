"""Bubbles, splits and graphs on small fixtures."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from forkline.functions import arrays as a
from forkline.operators import bubbles as b
from forkline.operators import counts, graph, intervals, splits
from forkline.sources.shared import save


def nodes(spark, paths):
    return spark.createDataFrame([(g, tx, n) for g, tx, ns in paths for n in ns], "gene string, tx string, node int")


SIMPLE = [("g", "tx1", [0, 1, 2, 4, 5]), ("g", "tx2", [0, 1, 3, 4, 5])]


def test_one_bubble(spark):
    got = b.detect_bubbles(b.tx_paths(nodes(spark, SIMPLE), 0, 5)).collect()
    assert [(r.src, r.snk, r.n_paths) for r in got] == [(1, 4, 2)]
    assert [(v.inner, v.txs) for v in got[0].variants] == [([2], ["tx1"]), ([3], ["tx2"])]


def test_no_bubble_on_one_path_or_with_a_shared_node(spark):
    assert b.detect_bubbles(b.tx_paths(nodes(spark, SIMPLE[:1]), 0, 5)).count() == 0
    shared = [("g", "a", [0, 1, 2, 3, 9]), ("g", "b", [0, 2, 4, 9])]
    assert {(r.src, r.snk) for r in b.detect_bubbles(b.tx_paths(nodes(spark, shared), 0, 9)).collect()} == {(0, 2), (2, 9)}


def test_direct_edge_is_a_variant(spark):
    got = b.detect_bubbles(b.tx_paths(nodes(spark, [("g", "a", [0, 1, 2, 9]), ("g", "b", [0, 2, 9])]), 0, 9)).collect()
    assert {(r.src, r.snk) for r in got} == {(0, 2)} and [v.inner for v in got[0].variants] == [[], [1]]


def test_bubbles_match_pairwise_definition(spark):
    rng = random.Random(3)
    paths = [("g", f"t{i}", [0, *sorted(rng.sample(range(1, 9), rng.randint(1, 6))), 9]) for i in range(12)]
    got = {(r.src, r.snk): r.n_paths for r in b.detect_bubbles(b.tx_paths(nodes(spark, paths), 0, 9)).collect()}
    want = {}
    for i, j in itertools.combinations(range(10), 2):
        ways = {tuple(x for x in p if i < x < j) for _, _, p in paths if i in p and j in p}
        if len(ways) >= 2 and not set.intersection(*map(set, ways)):
            want[i, j] = len(ways)
    assert got == want


@pytest.mark.parametrize(
    ("spans", "depth"),
    [([(1, 5), (7, 12)], [0, 0]), ([(1, 10), (3, 7), (12, 15)], [0, 1, 0]), ([(1, 20), (3, 15), (5, 10)], [0, 1, 2]), ([(1, 5), (1, 5)], [1, 1])],
)
def test_depths(spark, spans, depth):
    rows = spark.createDataFrame([("g", *s) for s in spans], "gene string, src int, snk int")
    got = {(r.src, r.snk): r.depth for r in b.depths(rows).collect()}
    assert [got[s] for s in spans] == depth


def test_depths_of_many_like_plain_counting(spark):
    """A hot gene, repeated intervals, sinks at and around powers of two."""
    rng = random.Random(11)
    rows = [(g, a, a + d) for g, n in (("hot", 300), ("g", 30), ("h", 1)) for _ in range(n) for a, d in [(rng.randint(0, 30), rng.choice((1, 2, 3, 4, 8, 16, 33)))]]
    got = {(r.gene, r.src, r.snk): r.depth for r in b.depths(spark.createDataFrame(rows, "gene string, src int, snk int")).collect()}
    assert got == {(g, s, t): sum(h == g and x <= s and y >= t for h, x, y in rows) - 1 for g, s, t in rows}
    assert b.depths(spark.createDataFrame([], "gene string, src int, snk int")).count() == 0


def test_containment_like_all_pairs(spark):
    rng = random.Random(12)
    sets = [(g, i, None if i == 0 else sorted(rng.sample(range(9), rng.randint(0, 5)) + [3] * (i % 2))) for g in ("a", "b") for i in range(40)]
    got = sorted(tuple(r) for r in graph.containment(spark.createDataFrame(sets, "gene string, path_id int, parts array<int>")).collect())
    assert got == sorted((g, i, j) for g, i, p in sets for h, j, q in sets if g == h and set(p or []) < set(q or []))


def test_node_types(spark):
    got = {r.node: r.type for r in b.node_types(b.tx_paths(nodes(spark, SIMPLE), 0, 5), 0, 5).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 5: 0}


def test_simple_paths(spark):
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 4), ("g", 1, 3), ("g", 3, 4), ("g", 1, 4)], "gene string, a int, b int")
    assert sorted(r.path for r in b.simple_paths(edges, 1, 4, 5).collect()) == [[1, 2, 4], [1, 3, 4], [1, 4]]


def bubble(spark, sets):
    rows = [("g", 1, 50, len(sets), [{"inner": [i + 2], "txs": [f"t{i}"], "parts": s, "rep": [0, *s, 50]} for i, s in enumerate(sets)])]
    return spark.createDataFrame(rows, "gene string, src int, snk int, n_paths int, variants array<struct<inner: array<int>, txs: array<string>, parts: array<int>, rep: array<int>>>")


def test_chain_has_two_splits(spark):
    got = splits.bipartitions(bubble(spark, [[1], [1, 2], [1, 2, 3]])).collect()
    assert sorted(r.mask for r in got) == [1, 3]
    one = next(r for r in got if r.mask == 3)
    assert (one.groups[0].diff, one.groups[1].diff, one.ref) == ([], [3], [0, 1, 50])


def test_two_nested_sets_have_one_split_and_disjoint_ones_all(spark):
    assert splits.bipartitions(bubble(spark, [[1], [1, 2]])).count() == 1
    assert splits.bipartitions(bubble(spark, [[1], [2], [3]])).count() == 3
    assert splits.bipartitions(bubble(spark, [[], []])).count() == 0
    assert b.contained_paths(bubble(spark, [[1, 2], [1, 2]])).count() == 0


def test_lower_sets_by_brute_force(spark):
    rng = random.Random(7)
    for _ in range(5):
        sets = [sorted(rng.sample(range(1, 6), rng.randint(0, 4))) for _ in range(5)]
        closed = lambda m: all(not (m >> j & 1) or m >> i & 1 for i in range(5) for j in range(5) if set(sets[i]) < set(sets[j]))  # noqa: B023, E731
        want = set()
        for m in range(1, 31, 2):
            if closed(m) or closed(31 - m):
                g1, g2 = ([set(sets[i]) for i in range(5) if (m >> i & 1) == k] for k in (1, 0))
                if set.intersection(*g1) - set.union(*g2) or set.intersection(*g2) - set.union(*g1):
                    want.add(m)
        assert {r.mask for r in splits.bipartitions(bubble(spark, sets)).collect()} == want


def test_many_nested_variants_are_split_exactly(spark):
    """25 nested variants have 26 lower sets, two of them trivial; those up to a variant stand against the rest."""
    got = splits.bipartitions(bubble(spark, [list(range(1, k + 1)) for k in range(1, 26)])).collect()
    assert sorted(r.mask for r in got) == [(1 << k) - 1 for k in range(1, 25)]
    # the largest first: the same splits, the first variant's side is the upper one
    back = splits.bipartitions(bubble(spark, [list(range(1, k + 1)) for k in range(25, 0, -1)])).collect()
    assert sorted(r.mask for r in back) == [(1 << k) - 1 for k in range(1, 25)]
    # 18 variants: two chains of nine side by side, so any pair of beginnings
    chains = [[*range(1, k + 1)] for k in range(1, 10)] + [[*range(21, k + 1)] for k in range(21, 30)]
    assert splits.bipartitions(bubble(spark, chains)).count() == len(brute_chains(9))
    with pytest.raises(Exception, match="more than 62 variants"):
        splits.bipartitions(bubble(spark, [[k] for k in range(63)])).count()


def brute_chains(n):
    """Splits of two chains of n by their lower sets (beginnings of i and j variants), those with a part of one side alone."""
    found = set()
    for i, j in itertools.product(range(n + 1), repeat=2):
        low = [set(range(1, k + 1)) for k in range(1, i + 1)] + [set(range(21, 21 + k)) for k in range(1, j + 1)]
        high = [set(range(1, k + 1)) for k in range(i + 1, n + 1)] + [set(range(21, 21 + k)) for k in range(j + 1, n + 1)]
        if low and high and (set.intersection(*low) - set.union(*high) or set.intersection(*high) - set.union(*low)):
            found.add(frozenset([frozenset(map(frozenset, low)), frozenset(map(frozenset, high))]))
    return found


def test_multinomial_states_and_pairs(spark):
    rows = splits.multinomial(bubble(spark, [[], [1], [2, 3]])).collect()
    assert [(g.status, g.diff) for g in rows[0].groups] == [("none", []), ("parts", [1]), ("parts", [2, 3])]
    assert splits.multinomial(bubble(spark, [[1], [1, 2]])).count() == 0
    assert splits.pairs(bubble(spark, [[1], [2], [3]])).count() == 3
    text = splits.as_text(splits.multinomial(bubble(spark, [[], [1], [2, 3]])), 4).first()
    assert (text.setdiff1, text.setdiff3, text.setdiff4, text.path2) == ("no_exon_part", "E002,E003", "", "1-3-50")


def test_dedupe_prefers_fewer_and_nearer_reference_parts(spark):
    rows = [("g", s, 9, ref, [{"paths": [], "txs": [], "diff": [5], "status": "parts"}, {"paths": [], "txs": [], "diff": [], "status": "empty"}]) for s, ref in ((1, [1, 2]), (2, [1]), (3, [4]))]
    table = spark.createDataFrame(rows, "gene string, src int, snk int, ref array<int>, groups array<struct<paths: array<array<int>>, txs: array<string>, diff: array<int>, status: string>>")
    got = splits.dedupe(table, ["src"]).collect()
    assert [(r.src, r.event) for r in got] == [(3, 1)]


def test_chosen_and_changed_paths(spark):
    table = bubble(spark, [[1], [2], [3]])
    chosen = spark.createDataFrame([("g", "t0")], "gene string, tx string")
    assert [(r.txs1, r.txs2) for r in splits.chosen_vs_rest(table, chosen).collect()] == [(["t0"], ["t1", "t2"])]
    constant = spark.createDataFrame([("g", "t2")], "gene string, tx string")
    got = splits.changed_vs_constant(table, chosen, constant).first()
    assert [g.diff for g in got.groups] == [[1], [3]]
    assert [(r.one, r.txs1, len(r.txs2)) for r in splits.one_vs_rest(table).orderBy("one").collect()] == [(1, ["t0"], 2), (2, ["t1"], 2), (3, ["t2"], 2)]


def test_strings(spark):
    row = spark.range(1).select(
        a.count_items(F.lit("")).alias("c0"), a.count_items(F.lit("E001")).alias("c1"), a.count_items(F.lit("E001,E002,E003")).alias("c3"), a.part_numbers(F.lit("E007,E012")).alias("n"), a.part_numbers(F.lit(None).cast("string")).alias("none"),
        a.part_labels(F.array(F.lit(12), F.lit(7))).alias("l"), a.canonical(F.lit(" b, a ,b")).alias("s"), a.strip_version(F.lit("G1.14")).alias("v"), a.proximity(F.array(F.lit(1), F.lit(9)), F.array(F.lit(4))).alias("p"),
        a.intersect_all(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))).alias("i"), a.intersect_all(F.array().cast("array<array<int>>")).alias("e"),
    ).first()
    assert tuple(row) == (0, 1, 3, [7, 12], [], "E007,E012", "a,b", "G1", 3.0, [2], [])


EXONS = [("g", "t1", "c", "+", 101, 200), ("g", "t1", "c", "+", 301, 400), ("g", "t1", "c", "+", 501, 600), ("g", "t2", "c", "+", 101, 200), ("g", "t2", "c", "+", 501, 600), ("h", "u", "c", "-", 550, 700)]
EXON_SCHEMA = "gene string, tx string, chrom string, strand string, start int, end int"


@pytest.mark.parametrize("strand", "+-")
def test_graph_of_a_skipped_exon(spark, strand):
    exons = spark.createDataFrame([(*e[:3], strand, *e[4:]) for e in EXONS[:5]], EXON_SCHEMA)
    n = graph.build_nodes(exons)
    e = graph.build_edges(exons, n)
    assert n.count() == 8
    kinds = {(r.a, r.b): r.kind for r in e.collect()}
    assert kinds == {(0, 1): "R", (1, 2): "ex", (2, 3): "in", (3, 4): "ex", (4, 5): "in", (2, 5): "in", (5, 6): "ex", (6, 7): "L"}
    found = b.detect_bubbles(graph.tx_paths(e)).collect()
    assert [(r.src, r.snk) for r in found] == [(2, 5)]
    assert sorted((v.inner, v.parts) for v in found[0].variants) == [([], []), ([3, 4], [3])]
    parts = intervals.exonic_parts(exons, ["gene"]).withColumn("part", F.row_number().over(b.W.partitionBy("gene").orderBy("start")))
    assert {(r.a, r.b) for r in graph.part_edges(parts, n).collect()} == {(1, 2), (3, 4), (5, 6)}
    assert not any(r.conflict for r in graph.node_types(e).collect())


def test_collapse_leaves_one_way(spark):
    paths = b.tx_paths(nodes(spark, [("g", "a", [0, 1, 2, 5, 6, 9]), ("g", "b", [0, 1, 3, 5, 6, 9]), ("g", "c", [0, 1, 2, 5, 7, 9])]), 0, 9)
    got = {r.tx: r.nodes for r in graph.collapse_bubbles(paths, b.detect_bubbles, 0, 9, save).collect()}
    assert got == {"a": [0, 1, 2, 5, 6, 9], "b": [0, 1, 2, 5, 6, 9], "c": [0, 1, 2, 5, 7, 9]}


def test_exonic_parts_are_disjoint_and_cover(spark):
    rng = random.Random(2)
    exons = [(f"g{rng.randint(0, 3)}", f"t{i}", "c", rng.choice("+-"), s := rng.randint(0, 40_000), s + rng.randint(0, 30_000)) for i in range(25)]
    got = intervals.exonic_parts(spark.createDataFrame(exons, EXON_SCHEMA)).collect()
    for strand in "+-":
        cover = {}
        for r in got:
            if r.strand == strand:
                assert not any(r.start <= e and s <= r.end for s, e in cover)
                cover[r.start, r.end] = r.txs
                assert r.txs == sorted({e[1] for e in exons if e[3] == strand and e[4] <= r.start and r.end <= e[5]})
        assert sum(e - s + 1 for s, e in cover) == len({x for e in exons if e[3] == strand for x in range(e[4], e[5] + 1)})


def test_gene_overlaps(spark):
    parts = spark.createDataFrame([("a", "c", "+", 1, 10), ("b", "c", "+", 10, 20), ("c", "c", "+", 21, 30), ("d", "c", "-", 1, 30), ("b", "c", "+", 40, 50)], "gene string, chrom string, strand string, start int, end int")
    groups = intervals.overlapping_genes(parts)
    assert {(r.gene, r.label) for r in groups.collect()} == {("a", "a"), ("b", "a")}
    kinds = spark.createDataFrame([("a", "protein_coding")], "gene string, biotype string")
    got = {r.gene: r.keep for r in intervals.resolve_overlaps(groups, parts, kinds).collect()}
    assert got == {"a": True, "b": False}
    merged = intervals.aggregate_genes(spark.createDataFrame([(["a", "b"], 1), (["b"], 2), (["z"], 3)], "genes array<string>, start int"))
    assert sorted((r.gene, r.start) for r in merged.collect()) == [("a+b", 1), ("a+b", 2), ("z", 3)]


def test_read_counting(spark):
    parts = spark.createDataFrame([("g", 1, "c", "+", 101, 200), ("g", 2, "c", "+", 301, 400), ("h", 1, "c", "-", 390, 500)], "gene string, part int, chrom string, strand string, start int, end int")
    reads = [("r1", 0, "c", 190, 50, "11M100N10M", 1), ("r2", 0, "c", 395, 50, "10M", 1), ("r3", 0, "c", 900, 50, "10M", None), ("r4", 4, "*", 0, 0, "*", None), ("r5", 0, "c", 110, 3, "5M", 1), ("r6", 0, "c", 110, 50, "5M", 2), ("r7", 16, "c", 450, 50, "5S5M", 1)]
    aln = spark.createDataFrame(reads, "read string, flag int, chrom string, pos int, mapq int, cigar string, nh int")
    got = {(r.gene, r.part, r.special): r.cnt for r in intervals.count_reads(aln, parts).collect()}
    assert got == {("g", 1, None): 1, ("g", 2, None): 1, ("h", 1, None): 1, (None, None, "_ambiguous"): 1, (None, None, "_empty"): 1, (None, None, "_notaligned"): 1, (None, None, "_lowaqual"): 1}
    stranded = {(r.gene, r.part): r.cnt for r in intervals.count_reads(aln, parts, "yes").collect() if r.gene}
    assert stranded == {("g", 1): 1, ("g", 2): 2, ("h", 1): 1}
    pairs = [("p1", 67, "c", 110, 50, "10M", 1), ("p1", 131, "c", 310, 50, "10M", 1), ("p2", 67, "c", 110, 50, "5M", 1), ("p2", 131, "d", 1, 50, "5M", 1), ("p3", 77, "*", 0, 0, "*", None), ("p3", 141, "*", 0, 0, "*", None)]
    got = {(r.gene, r.part, r.special): r.cnt for r in intervals.count_pairs(spark.createDataFrame(pairs, aln.schema), parts).collect()}
    assert got == {("g", 1, None): 1, ("g", 2, None): 1, ("h", 1, None): 0, (None, None, "_ambiguous_readpair_position"): 1, (None, None, "_notaligned"): 1}


def brute_collapse(paths, root, leaf):
    """paths {tx: (nodes, parts)} of one gene, collapsed bubble by bubble."""
    done = set()
    while True:
        found = []
        nodes = sorted({n for p, _ in paths.values() for n in p})
        for src in nodes:
            for snk in nodes:
                ways = {}
                for tx, (p, parts) in paths.items():
                    if src < snk and src in p and snk in p:
                        ways.setdefault(tuple(n for n in p if src < n < snk), []).append(tx)
                if len(ways) > 1 and not set.intersection(*map(set, ways)) and src != root and snk != leaf and (src, snk) not in done:
                    found.append((snk - src, src, snk, ways))
        if not found:
            return paths
        _, src, snk, ways = min(found, key=lambda f: f[:2])
        done.add((src, snk))
        inside = {tx: [n for n in p if src <= n <= snk] for tx, (p, _) in paths.items()}
        ranked = []
        for i, (inner, txs) in enumerate(sorted(ways.items())):
            way = [src, *inner, snk]
            users = {tx for s in zip(way, way[1:]) for tx, p in inside.items() if s in list(zip(p, p[1:]))}
            ranked.append((users <= set(txs), -len(txs), i, inner, txs))
        ranked.sort()
        keep, first = ranked[0][3], min(ranked[0][4])
        kept_parts = [x for x in paths[first][1] if src <= x < snk]
        for alone, _, _, _, txs in ranked[1:]:
            for tx in txs if alone else ():
                p, parts = paths[tx]
                paths = paths | {tx: (sorted({n for n in p if n <= src or n >= snk} | set(keep)), sorted({x for x in parts if x < src or x >= snk} | set(kept_parts)))}


def test_collapse_like_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for gene in range(12):
        for tx in range(rng.randint(2, 6)):
            inner = sorted(rng.sample(range(1, 9), 2 * rng.randint(1, 3)))
            rows += [(gene, 100 * gene + tx, n) for n in [0, *inner, 9]]
    paths = b.tx_paths(spark.createDataFrame(rows, "gene int, tx int, node int"), 0, 9).cache()
    before = {}
    for r in paths.collect():
        before.setdefault(r.gene, {})[r.tx] = (list(r.nodes), list(r.parts))
    got = {}
    for r in graph.collapse_bubbles(paths, b.detect_bubbles, 0, 9, save).collect():
        got.setdefault(r.gene, {})[r.tx] = (list(r.nodes), list(r.parts))
    want = {gene: brute_collapse(p, 0, 9) for gene, p in before.items()}
    assert got == want and got != before
    with pytest.raises(ValueError):
        graph.collapse_bubbles(paths, b.detect_bubbles, 0, 9, save, max_rounds=1)


def test_collapse_takes_no_round_for_a_bubble_that_nothing_leaves(spark):
    """Steps into 4 and 7 are also used by paths outside of the bubbles (1, 4) and (4, 7)."""
    rows = [("g", f"{x}{y}", [0, 1, x, 4, y, 7, 9]) for x in (2, 3) for y in (5, 6)] + [("g", "a", [0, 2, 4, 9]), ("g", "b", [0, 3, 4, 9]), ("g", "c", [0, 5, 7, 9]), ("g", "d", [0, 6, 7, 9])]
    paths = b.tx_paths(nodes(spark, rows), 0, 9)
    got = graph.collapse_bubbles(paths, b.detect_bubbles, 0, 9, save, max_rounds=1)
    assert {(r.tx, tuple(r.nodes)) for r in got.collect()} == {(tx, tuple(way)) for _, tx, way in rows}


def test_splits_without_transcripts_are_the_same(spark):
    """Splits that are only matched need no transcripts, and are found without listing them."""
    paths = b.tx_paths(nodes(spark, [("g", "a", [0, 1, 2, 5, 6, 9]), ("g", "b", [0, 1, 3, 5, 6, 9]), ("g", "c", [0, 1, 2, 5, 7, 9]), ("g", "d", [0, 1, 4, 9])]), 0, 9)
    for f in (splits.bipartitions, splits.multinomial):
        whole, bare = (f(b.detect_bubbles(paths, keep)).collect() for keep in (b.ALL, ("parts", "rep")))
        plain = lambda rows: sorted((r.src, r.snk, [(g.paths, g.diff, g.status) for g in r.groups], r.ref) for r in rows)
        assert plain(whole) == plain(bare) and all("txs" not in g.asDict() for r in bare for g in r.groups)
        assert whole or f is splits.multinomial


def exchanges(df):
    """Shuffles of a plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bubbles_shuffle_paths_alone(spark):
    """Ways between nodes are grouped where their gene's paths are."""
    paths = b.with_parts(spark.createDataFrame([("g", "a", [0, 1, 2, 9]), ("g", "c", [0, 2, 9])], "gene string, tx string, nodes array<int>"), 0, 9)
    found = b.detect_bubbles(paths)
    assert exchanges(found) == 1
    assert exchanges(b.order_by_depth(found.select("gene", "src", "snk"))) == 1
    assert exchanges(splits.dedupe(splits.pairs(found), ["src"])) == 1
    assert exchanges(splits.dedupe(splits.bipartitions(found), ["src"])) == 1
    assert [v.inner for v in b.detect_bubbles(paths, ()).where("src = 0 and snk = 2").first().variants] == [[], [1]]


def test_bipartitions_of_many_unrelated_variants(spark):
    """50 variants with a part each: 2 ** 49 sets in two, of which 50 have a part that tells the sides apart."""
    rows = [("g", 1, 90, 50, [{"inner": [i + 2], "txs": [f"t{i}"], "parts": [i + 2], "rep": [i + 2]} for i in range(50)])]
    found = splits.bipartitions(spark.createDataFrame(rows, "gene string, src int, snk int, n_paths int, variants array<struct<inner: array<int>, txs: array<string>, parts: array<int>, rep: array<int>>>"))
    got = {r.mask: [g["diff"] for g in r.groups] for r in found.collect()}
    every = (1 << 50) - 1
    assert got == {1 if i == 0 else every ^ (1 << i): [[2], []] if i == 0 else [[], [i + 2]] for i in range(50)}


def test_equal_intervals_count_each_other_without_other_columns(spark):
    rows = spark.createDataFrame([("g", 1, 9), ("g", 1, 9), ("g", 3, 4)], "gene string, src int, snk int")
    assert sorted((r.src, r.depth, r["rank"]) for r in b.order_by_depth(rows).collect()) == [(1, 1, 2), (1, 1, 3), (3, 2, 1)]


def test_junction_lists_count_each_junction_once(spark):
    """A junction that is listed, and is another one's with the end less one, counts once; lists are not searched through for repeats."""
    lists = spark.createDataFrame([("g", "all", [("c", 1, 10), ("c", 1, 9), ("c", 1, 10)])], "gene string, role string, parts array<struct<chrom: string, start: int, end: int>>")
    matrix = spark.createDataFrame([("c", 1, 10, 0, "x", 5), ("c", 1, 9, 0, "x", 7), ("c", 1, 8, 1, "x", 2), ("c", 1, 7, 1, "x", 90)], "chrom string, start int, end int, sample int, grp string, cnt int")
    found = counts.sum_junctions(lists, matrix, [])
    assert sorted((r.sample, r.cnt) for r in found.collect()) == [(0, 12), (1, 2)]
    assert "array_distinct" not in found._jdf.queryExecution().executedPlan().toString()


def _exchanges(df):
    """How often rows are dealt by key in the plan of rows that have not been asked for yet."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_graph_in_one_pass(spark):
    """The same nodes, edges and parts as step by step, on both strands, with exons that touch, overlap and are repeated; exons are dealt once."""
    more = [("h", "u", "c", "-", 100, 250), ("h", "v", "c", "-", 200, 300), ("h", "v", "c", "-", 301, 400), ("h", "w", "c", "-", 150, 700), ("k", "z", "d", "+", 5, 5)]
    exons = spark.createDataFrame(EXONS + more, EXON_SCHEMA)
    nodes = graph.build_nodes(exons)
    parts = intervals.number_parts(intervals.exonic_parts(exons, ["gene"]))
    rows = lambda df: sorted(map(str, df.collect()))
    edges = graph.build_graph(exons, parts=True)
    assert rows(edges) == rows(graph.build_edges(exons, nodes).union(graph.part_edges(parts, nodes)))
    assert rows(graph.build_graph(exons)) == rows(graph.build_edges(exons, nodes))
    assert rows(graph.node_positions(edges)) == rows(nodes.where("position is not null"))
    assert _exchanges(edges) == 1
    none = spark.createDataFrame([(None, "t", "c", "+", 1, 2)], EXON_SCHEMA)
    assert graph.build_graph(none, parts=True).count() == 0


def test_junctions_of_splits_are_counted_where_the_gene_is(spark):
    """As by way of lists: junctions with the end less one count once, samples without reads count 0, an event without either side goes."""
    introns = spark.createDataFrame(
        [("g", 1, 2, "c", 10, 20, ["t1"]), ("g", 1, 3, "c", 10, 19, ["t1"]), ("g", 2, 3, "c", 40, 30, ["t1", "t2"]), ("g", 2, 4, "c", 30, 50, ["t2"]), ("g", 3, 4, "c", 60, 70, ["t2", "t3"]), ("g", 0, 1, "c", None, 10, ["t1"]), ("h", 1, 2, "c", 10, 20, ["u", "v"])],
        "gene string, a int, b int, chrom string, from_pos int, to_pos int, txs array<string>",
    )
    splits = spark.createDataFrame(
        [("g", 1, [0, 1, 2, 3, 4], ["t1"], ["t2", "t3"]), ("g", 2, [2, 3, 4], ["t2"], ["t1"]), ("g", 3, [1, 2], ["t3"], ["t1"]), ("h", 1, [1, 2], ["u"], ["v"]), ("x", 1, [1, 2], ["a"], ["b"])],
        "gene string, event int, nodes array<int>, txs1 array<string>, txs2 array<string>",
    )
    table = [("c", 10, 20, "s1", "a", 3), ("c", 10, 19, "s1", "a", 2), ("c", 10, 18, "s2", "b", 5), ("c", 30, 40, "s2", "b", 1), ("c", 30, 49, "s1", "a", 7), ("d", 60, 70, "s3", "b", 9)]
    matrix = spark.createDataFrame(table, "chrom string, start int, end int, sample string, grp string, cnt long")
    names = ["gene", "event", "sample", "grp", "ref", "diff1", "diff2"]
    got = sorted(map(str, counts.count_split_junctions(splits, introns, matrix).select(*names).collect()))
    assert got == sorted(map(str, counts.count_bipartition_junctions(counts.label_introns(splits, introns), matrix).select(*names).collect()))
    assert len(got) == 9 and any("event=1, sample='s1', grp='a', ref=0, diff1=5, diff2=7" in r for r in got)


def test_junction_counts_of_transcripts_deal_rows_seldom(spark):
    """Lines and orders, exons by gene (each twice in the plan), introns and counts by place, and introns by gene: little else is dealt. It was 78 times."""
    import __spark_entry__ as entry

    assert _exchanges(entry.queries()["junction_bipartition"](spark, "/root/testdata/sf0.001")) <= 12


def test_unpivoted_junction_counts_deal_rows_seldom(spark):
    """Counts are turned where they are. It was 78 times, as in the wide table."""
    import __spark_entry__ as entry

    assert _exchanges(entry.queries()["junction_unpivot"](spark, "/root/testdata/sf0.001")) <= 12
