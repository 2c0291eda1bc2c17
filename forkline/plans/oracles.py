"""DuckDB SQL for the registered queries, written on their own from the operators' definitions."""

from __future__ import annotations

from .views import duck

#: The most variants of a bubble whose variants are taken one by one.
MAX_SINGLE = 20


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def _labels(column: str) -> str:
    return f"coalesce(array_to_string([('E' || lpad(x::VARCHAR, 3, '0')) FOR x IN list_sort({column})], ','), '')"


WAYS = """
ins AS (SELECT gene, tx, node, row_number() OVER (PARTITION BY gene, tx ORDER BY node) AS rn FROM v_tx_nodes WHERE node NOT IN (0, 11)),
steps AS (SELECT a.gene, a.tx, unnest(range(a.node, b.node)) AS part FROM ins a JOIN ins b ON a.gene = b.gene AND a.tx = b.tx AND b.rn = a.rn + 1 WHERE a.rn % 2 = 1),
ways AS (SELECT a.gene, a.tx, a.node AS src, b.node AS snk, coalesce(list(c.node ORDER BY c.node) FILTER (WHERE c.node IS NOT NULL), []) AS inn
  FROM v_tx_nodes a JOIN v_tx_nodes b ON a.gene = b.gene AND a.tx = b.tx AND a.node < b.node
  LEFT JOIN v_tx_nodes c ON c.gene = a.gene AND c.tx = a.tx AND c.node > a.node AND c.node < b.node GROUP BY a.gene, a.tx, a.node, b.node),
vars AS (SELECT gene, src, snk, inn, list(tx ORDER BY tx) AS txs, min(tx) AS rep, count(*) AS n_txs FROM ways GROUP BY gene, src, snk, inn),
vparts AS (SELECT v.gene, v.src, v.snk, v.inn, v.txs, v.rep, v.n_txs, coalesce(list(s.part ORDER BY s.part) FILTER (WHERE s.part IS NOT NULL), []) AS parts
  FROM vars v LEFT JOIN steps s ON s.gene = v.gene AND s.tx = v.rep AND s.part >= v.src AND s.part < v.snk GROUP BY v.gene, v.src, v.snk, v.inn, v.txs, v.rep, v.n_txs)"""

BUBBLES = """
sizes AS (SELECT gene, src, snk, count(*) AS n_paths FROM vars GROUP BY gene, src, snk HAVING count(*) >= 2),
common AS (SELECT DISTINCT c.gene, c.src, c.snk FROM (SELECT gene, src, snk, node, count(*) AS c FROM (SELECT gene, src, snk, unnest(inn) AS node FROM vars) GROUP BY gene, src, snk, node) c
  JOIN sizes s ON s.gene = c.gene AND s.src = c.src AND s.snk = c.snk AND c.c = s.n_paths),
bub AS (SELECT s.* FROM sizes s LEFT JOIN common c ON s.gene = c.gene AND s.src = c.src AND s.snk = c.snk WHERE c.gene IS NULL),
bvar AS (SELECT v.*, b.n_paths, row_number() OVER (PARTITION BY v.gene, v.src, v.snk ORDER BY v.inn) AS i FROM vparts v JOIN bub b ON v.gene = b.gene AND v.src = b.src AND v.snk = b.snk)"""


def _bits(column: str) -> str:
    """A list of small numbers as the bits of one number."""
    return f"coalesce(list_bit_or([(1::BIGINT << x::BIGINT) FOR x IN {column}]), 0)"


def _unbits(column: str) -> str:
    return f"[x FOR x IN range(0, 12) IF ({column} >> x) & 1 = 1]"


#: Variants of the bubbles that are split; bits are their parts, rep_bits all parts of their first path.
PRUNED = f"""
wholes AS (SELECT gene, tx, bit_or(1::BIGINT << part::BIGINT) AS rep_bits FROM steps GROUP BY gene, tx),
pvar AS (SELECT b.*, {_bits('b.parts')} AS bits, coalesce(w.rep_bits, 0) AS rep_bits FROM bvar b LEFT JOIN wholes w ON w.gene = b.gene AND w.tx = b.rep WHERE NOT (b.src = 0 AND b.snk = 11))"""

_BASE = _with(duck("v_tx_nodes"), WAYS)
_BUB = _with(duck("v_tx_nodes"), WAYS, BUBBLES)
_PRU = _with(duck("v_tx_nodes"), WAYS, BUBBLES, PRUNED)

#: Sides of splits -> distinguishing and reference parts; needs two_sides(gene, src, snk, id, all1, any1, rep1, n1, all2, any2, rep2, n2), bits of what all and any variants of a side have.
SIDES = f"""
told AS (SELECT *, all1 & ~any2 AS x1, all2 & ~any1 AS x2, (all1 & all2) | (rep1 & rep2 & ((1::BIGINT << snk::BIGINT) | CASE WHEN src > 0 THEN 1::BIGINT << (src - 1)::BIGINT ELSE 0 END)) AS r FROM two_sides),
split AS (SELECT gene, src, snk, id, {_unbits('r')} AS ref, {_unbits('x1')} AS diff1, {_unbits('x2')} AS diff2, any1 = 0 AS none1, any2 = 0 AS none2, n1, n2 FROM told WHERE x1 <> 0 OR x2 <> 0)"""

MASKS = f"""
masks AS (SELECT gene, src, snk, unnest(range(1, (1 << n_paths)::BIGINT - 1, 2)) AS id FROM (SELECT DISTINCT gene, src, snk, n_paths::INT AS n_paths FROM pvar)),
below AS (SELECT b.gene, b.src, b.snk, b.i, b.bits, b.rep_bits, b.n_txs, coalesce(bit_or(1::BIGINT << (a.i - 1)::BIGINT) FILTER (WHERE a.bits <> b.bits AND a.bits & ~b.bits = 0), 0) AS inside
  FROM pvar b JOIN pvar a ON a.gene = b.gene AND a.src = b.src AND a.snk = b.snk GROUP BY b.gene, b.src, b.snk, b.i, b.bits, b.rep_bits, b.n_txs),
placed AS (SELECT m.gene, m.src, m.snk, m.id, p.i, p.bits, p.rep_bits, p.n_txs, (m.id >> (p.i - 1)::BIGINT) & 1 = 1 AS first, p.inside & ~m.id <> 0 AS out1, p.inside & m.id <> 0 AS out2
  FROM masks m JOIN below p ON m.gene = p.gene AND m.src = p.src AND m.snk = p.snk),
two_sides AS (SELECT gene, src, snk, id, bit_and(bits) FILTER (WHERE first) AS all1, bit_or(bits) FILTER (WHERE first) AS any1, min_by(rep_bits, i) FILTER (WHERE first) AS rep1, sum(n_txs) FILTER (WHERE first) AS n1,
    bit_and(bits) FILTER (WHERE NOT first) AS all2, bit_or(bits) FILTER (WHERE NOT first) AS any2, min_by(rep_bits, i) FILTER (WHERE NOT first) AS rep2, sum(n_txs) FILTER (WHERE NOT first) AS n2
  FROM placed GROUP BY gene, src, snk, id HAVING NOT (bool_or(first AND out1) AND bool_or(NOT first AND out2)))"""

PAIRS = f"""
two_sides AS (SELECT a.gene, a.src, a.snk, a.i * 1000 + b.i AS id, a.bits AS all1, a.bits AS any1, a.rep_bits AS rep1, a.n_txs AS n1, b.bits AS all2, b.bits AS any2, b.rep_bits AS rep2, b.n_txs AS n2
  FROM pvar a JOIN pvar b ON a.gene = b.gene AND a.src = b.src AND a.snk = b.snk AND a.i < b.i WHERE a.n_paths <= {MAX_SINGLE})"""

MULTI = f"""
few AS (SELECT * FROM pvar WHERE n_paths <= {MAX_SINGLE}),
mp AS (SELECT p.gene, p.src, p.snk, p.i, unnest(p.parts) AS part FROM few p),
mc AS (SELECT gene, src, snk, part, count(*) AS c FROM mp GROUP BY gene, src, snk, part),
own AS (SELECT m.gene, m.src, m.snk, m.i, list(m.part ORDER BY m.part) AS diff FROM mp m JOIN mc c ON m.gene = c.gene AND m.src = c.src AND m.snk = c.snk AND m.part = c.part AND c.c = 1 GROUP BY m.gene, m.src, m.snk, m.i),
each AS (SELECT p.gene, p.src, p.snk, p.i, p.n_paths, p.rep, len(p.parts) AS n_parts, coalesce(o.diff, []) AS diff FROM few p LEFT JOIN own o ON p.gene = o.gene AND p.src = o.src AND p.snk = o.snk AND p.i = o.i),
mref AS (SELECT gene, src, snk, list(DISTINCT part ORDER BY part) AS ref FROM (
    SELECT c.gene, c.src, c.snk, c.part FROM mc c JOIN bub b ON b.gene = c.gene AND b.src = c.src AND b.snk = c.snk AND c.c = b.n_paths
    UNION ALL SELECT e.gene, e.src, e.snk, s.part FROM each e JOIN steps s ON s.gene = e.gene AND s.tx = e.rep AND s.part IN (e.src - 1, e.snk) GROUP BY e.gene, e.src, e.snk, s.part HAVING count(*) = max(e.n_paths)) GROUP BY gene, src, snk)"""

_SPLIT_OUT = f"{_labels('ref')} AS ref, {_labels('diff1')} AS diff1, {_labels('diff2')} AS diff2"

_COMP = ("v_comparisons",)
_RES = _with(duck("v_results"))


def _bh(table: str, by: str, p: str = "pvalue") -> str:
    """table with bh: adjusted p-values in each group of `by`, as a subquery."""
    over = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT * EXCLUDE (rn, cn), least(1.0, min({p} * cn / rn) OVER ({over}ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS bh FROM (
  SELECT *, row_number() OVER ({over}ORDER BY {p}) AS rn, count(*) OVER ({f'PARTITION BY {by}' if by else ''}) AS cn FROM {table} WHERE {p} IS NOT NULL))"""


def _combined(p: str) -> str:
    """Combined p-values of the sides (p: an SQL expression over groups of x(gene, event, pvalue)), BH over all, and the gate on the primary side."""
    return _RES + f""",
x AS (SELECT gene, event, pvalue, delta_pi, row_number() OVER (PARTITION BY gene, event ORDER BY pvalue, comparison, delta_pi) AS k FROM v_results WHERE pvalue IS NOT NULL),
c AS (SELECT gene, event, {p} AS pvalue, max(delta_pi) FILTER (WHERE k = 1) AS dpi FROM x GROUP BY gene, event)
SELECT c.gene, c.event, round(c.pvalue, 9) AS pvalue, round(a.bh, 9) AS padj, coalesce(a.bh < 0.5, false) AND coalesce(abs(c.dpi) >= 0.1, true) AS significant
FROM c LEFT JOIN {_bh('c', '')} a ON a.gene = c.gene AND a.event = c.event"""


_LISTS = "lists AS (SELECT gene, event, 'ref' AS role, unnest(ref) AS part FROM v_splits UNION ALL SELECT gene, event, 'diff1', unnest(diff1) FROM v_splits UNION ALL SELECT gene, event, 'diff2', unnest(diff2) FROM v_splits WHERE diff2 IS NOT NULL)"
_GRID = f"""{_LISTS},
samples AS (SELECT DISTINCT sample, grp FROM v_counts),
grid AS (SELECT s.gene, s.event, s.diff2 IS NULL AS one, p.sample, p.grp FROM v_splits s, samples p),
sums AS (SELECT l.gene, l.event, l.role, c.sample, sum(c.cnt) AS cnt FROM lists l JOIN v_counts c ON l.gene = c.gene AND l.part = c.part GROUP BY l.gene, l.event, l.role, c.sample),
wide AS (SELECT g.gene, g.event, g.sample, g.grp, coalesce(r.cnt, 0)::BIGINT AS ref, coalesce(a.cnt, 0)::BIGINT AS diff1, CASE WHEN NOT g.one THEN coalesce(b.cnt, 0)::BIGINT END AS diff2 FROM grid g
  LEFT JOIN sums r ON r.gene = g.gene AND r.event = g.event AND r.sample = g.sample AND r.role = 'ref'
  LEFT JOIN sums a ON a.gene = g.gene AND a.event = g.event AND a.sample = g.sample AND a.role = 'diff1'
  LEFT JOIN sums b ON b.gene = g.gene AND b.event = g.event AND b.sample = g.sample AND b.role = 'diff2')"""

_PHI = """
bm AS (SELECT gene, event, comparison, avg(n::DOUBLE) AS m FROM v_comparisons GROUP BY gene, event, comparison),
phi AS (SELECT gene, event, comparison, m / 7 - 2 AS phi, m % 5 + 0.5 AS var_phi, gene % 3 <> 0 AS ok FROM bm)"""

_EVENTS = """
tool AS (SELECT gene, list_extract(['SE', 'RI', 'A3SS', 'A5SS', 'MXE'], (tx % 5 + 1)::INT) AS etype, tx, strand, "start" AS s, "end" AS e FROM v_exons),
ev AS (SELECT *, etype || '_' || tx || '_' || s AS event_id FROM tool)"""

_TWO = """
two AS (SELECT a.gene, a.event, a.pvalue AS p_a, a.delta_pi AS e_a, b.pvalue AS p_b, b.delta_pi AS e_b FROM v_results a JOIN v_results b ON a.gene = b.gene AND a.event = b.event AND a.comparison = 'diff1_vs_ref' AND b.comparison = 'diff2_vs_ref')"""

_SETS = """
sets AS (SELECT gene, sample AS event, coalesce(list(DISTINCT part ORDER BY part) FILTER (WHERE part <= 3 AND cnt % 3 > 0), []) AS r, coalesce(list(DISTINCT part ORDER BY part) FILTER (WHERE part > 3 AND cnt % 3 > 0), []) AS x FROM v_counts GROUP BY gene, sample),
sa AS (SELECT * FROM sets WHERE event <= 6), sb AS (SELECT * FROM sets WHERE event > 6)"""

_GENES = """
ev AS (SELECT gene::VARCHAR AS gene, event, avg(baseMean) AS m, bool_or(pvalue < 0.5) AS s FROM v_results GROUP BY gene, event),
genes AS (SELECT gene, count(*) AS n_events, sum(m) AS total_expr, bool_or(coalesce(s, false)) AS is_sig FROM ev GROUP BY gene)"""


def _parts(keys: str) -> str:
    """Disjoint parts of v_exons within the given keys, by comparing every step with every exon of its key."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    return f"""
cuts AS (SELECT {keys}, "start" AS x FROM v_exons UNION SELECT {keys}, "end" + 1 FROM v_exons),
stp AS (SELECT *, lead(x) OVER (PARTITION BY {keys} ORDER BY x) - 1 AS y FROM cuts),
covered AS (SELECT {", ".join(f"p.{k}" for k in keys.split(", "))}, p.x, p.y, count(DISTINCT e.gene) AS n_genes, min(e.gene) AS g, count(DISTINCT e.tx) AS n_txs
  FROM stp p JOIN v_exons e ON {on("p", "e")} AND e."start" <= p.x AND e."end" >= p.y WHERE p.y IS NOT NULL GROUP BY {", ".join(f"p.{k}" for k in keys.split(", "))}, p.x, p.y)"""


ORACLES = {
    "bubble_detect": _BUB + """
SELECT gene, src, snk, n_paths::INT AS n_paths, string_agg(array_to_string(inn, ','), '|' ORDER BY i) AS paths, string_agg(array_to_string(txs, ','), '|' ORDER BY i) AS txs FROM bvar GROUP BY gene, src, snk, n_paths""",
    "tx_paths": _BASE + f"""
SELECT n.gene, n.tx, n.nodes, coalesce(s.parts, '') AS parts FROM (SELECT gene, tx, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes FROM v_tx_nodes GROUP BY gene, tx) n
LEFT JOIN (SELECT gene, tx, {_labels('list(part)')} AS parts FROM steps GROUP BY gene, tx) s ON n.gene = s.gene AND n.tx = s.tx""",
    "bubble_variants": _BASE + f" SELECT gene, src, snk, array_to_string(inn, ',') AS path, n_txs, {_labels('parts')} AS parts FROM vparts",
    "variant_codes": _BASE + """,
types AS (SELECT gene, node, max((rn + 1) % 2 + 1) AS t FROM ins GROUP BY gene, node),
one AS (SELECT gene, src, snk, inn, unnest(inn) AS node FROM vars),
cols AS (SELECT gene, src, snk, node, row_number() OVER (PARTITION BY gene, src, snk ORDER BY node) AS k FROM (SELECT DISTINCT gene, src, snk, node FROM one))
SELECT v.gene, v.src, v.snk, array_to_string(v.inn, ',') AS path, coalesce(c.code, '0') AS code FROM vars v LEFT JOIN (
  SELECT o.gene, o.src, o.snk, o.inn, string_agg(c.k || CASE WHEN t.t = 1 THEN '-' ELSE '^' END, '' ORDER BY o.node) AS code
  FROM one o JOIN cols c ON o.gene = c.gene AND o.src = c.src AND o.snk = c.snk AND o.node = c.node JOIN types t ON t.gene = o.gene AND t.node = o.node GROUP BY o.gene, o.src, o.snk, o.inn) c
ON v.gene = c.gene AND v.src = c.src AND v.snk = c.snk AND v.inn = c.inn""",
    "node_types": _BASE + """
SELECT gene, node, max((rn + 1) % 2 + 1)::INT AS type, min(rn % 2) <> max(rn % 2) AS conflict FROM ins GROUP BY gene, node UNION ALL SELECT DISTINCT gene, node, 0, false FROM v_tx_nodes WHERE node IN (0, 11)""",
    "bubble_depths": _BUB + """
SELECT gene, src, snk, depth, row_number() OVER (PARTITION BY gene ORDER BY depth DESC, src, snk)::INT AS rank FROM (
  SELECT a.gene, a.src, a.snk, count(*) - 1 AS depth FROM bub a JOIN bub b ON a.gene = b.gene AND b.src <= a.src AND b.snk >= a.snk GROUP BY a.gene, a.src, a.snk)""",
    "bubble_order": _BUB + " SELECT gene, src, snk, n_paths::INT AS n_paths, snk - src AS span, row_number() OVER (PARTITION BY gene ORDER BY snk - src, src, snk)::INT AS rank FROM bub",
    "path_edges": _with(duck("v_tx_nodes")) + """,
nx AS (SELECT gene, tx, node AS a, lead(node) OVER (PARTITION BY gene, tx ORDER BY node) AS b FROM v_tx_nodes)
SELECT gene, a, b, count(*)::INT AS n_txs, string_agg(tx::VARCHAR, ',' ORDER BY tx) AS txs FROM nx WHERE b IS NOT NULL GROUP BY gene, a, b""",
    "simple_paths": "WITH RECURSIVE " + duck("v_tx_nodes") + """,
nx AS (SELECT gene, tx, node AS a, lead(node) OVER (PARTITION BY gene, tx ORDER BY node) AS b FROM v_tx_nodes),
e AS (SELECT DISTINCT gene, a, b FROM nx WHERE b IS NOT NULL),
walk AS (SELECT gene, b AS node, '0,' || b AS path FROM e WHERE a = 0 UNION ALL SELECT w.gene, e.b, w.path || ',' || e.b FROM walk w JOIN e ON w.gene = e.gene AND w.node = e.a WHERE w.node < 11)
SELECT gene, path FROM walk WHERE node = 11""",
    "contained_paths": _PRU + " SELECT a.gene, a.src, a.snk, a.i::INT AS small, b.i::INT AS large FROM pvar a JOIN pvar b ON a.gene = b.gene AND a.src = b.src AND a.snk = b.snk WHERE len(a.parts) < len(b.parts) AND list_has_all(b.parts, a.parts)",
    "split_bipartition": _PRU + "," + MASKS + "," + SIDES + f" SELECT gene, src, snk, id::BIGINT AS mask, {_SPLIT_OUT}, n1::INT AS n1, n2::INT AS n2 FROM split",
    "split_pairs": _PRU + "," + PAIRS + "," + SIDES + f" SELECT gene, src, snk, (id // 1000)::INT AS one, (id % 1000)::INT AS two, {_SPLIT_OUT}, n1::INT AS n1, n2::INT AS n2 FROM split",
    "split_multinomial": _PRU + "," + MULTI + f"""
SELECT e.gene, e.src, e.snk, {_labels('r.ref')} AS ref, e.diffs FROM (
  SELECT gene, src, snk, string_agg(CASE WHEN n_parts = 0 THEN 'no_exon_part' ELSE {_labels('diff')} END, '|' ORDER BY i) AS diffs FROM each GROUP BY gene, src, snk HAVING bool_and(n_parts = 0 OR len(diff) > 0)) e
LEFT JOIN mref r ON e.gene = r.gene AND e.src = r.src AND e.snk = r.snk""",
    "one_vs_rest": _BUB + """
SELECT a.gene, a.src, a.snk, a.i::INT AS one, a.n_txs::INT AS n1, sum(b.n_txs)::INT AS n2, array_to_string(a.inn, ',') AS path1 FROM bvar a JOIN bvar b ON a.gene = b.gene AND a.src = b.src AND a.snk = b.snk AND a.i <> b.i
GROUP BY a.gene, a.src, a.snk, a.i, a.n_txs, a.inn""",
    "dedupe_events": _PRU + "," + MASKS + "," + SIDES + f""",
keyed AS (SELECT *, CASE WHEN none1 THEN [-1] ELSE diff1 END AS k1, CASE WHEN none2 THEN [-1] ELSE diff2 END AS k2, list_min([list_min([abs(x - y) FOR y IN list_concat(diff1, diff2)]) FOR x IN ref]) AS near FROM split),
firsts AS (SELECT *, row_number() OVER (PARTITION BY gene, k1, k2 ORDER BY len(ref), coalesce(near, 1000000), snk - src, src, id) AS f FROM keyed)
SELECT gene, src, snk, id::BIGINT AS mask, row_number() OVER (PARTITION BY gene ORDER BY k1, k2)::INT AS event, CASE WHEN src = 0 OR snk = 11 THEN 'TSSTTS' ELSE 'internal' END AS "class", {_SPLIT_OUT} FROM firsts WHERE f = 1""",
    "focal_report": _BUB + f"""
SELECT a.gene, a.src, a.snk, 'Binary' AS kind, {_labels('[x FOR x IN a.parts IF NOT list_contains(b.parts, x)]')} AS only1, {_labels('[x FOR x IN b.parts IF NOT list_contains(a.parts, x)]')} AS only2,
  {_labels('list_concat([x FOR x IN a.parts IF NOT list_contains(b.parts, x)], [x FOR x IN b.parts IF NOT list_contains(a.parts, x)])')} AS either
FROM bvar a JOIN bvar b ON a.gene = b.gene AND a.src = b.src AND a.snk = b.snk AND a.i = 1 AND b.i = 2 AND a.n_paths = 2
UNION ALL SELECT gene, src, snk, 'Complex', 'N/A', 'N/A', 'N/A' FROM bub WHERE n_paths > 2""",
    "gene_parts": _with(duck("v_exons"), _parts("chrom, strand, gene")) + ' SELECT gene, chrom, strand, x AS "start", y AS "end", n_txs FROM covered',
    "overlap_genes": "WITH RECURSIVE " + duck("v_exons") + """,
ex AS (SELECT DISTINCT gene, strand, ("start" % 30 + gene * 35 + floor(gene / 5) * 1000)::BIGINT AS x, ("start" % 30 + gene * 35 + floor(gene / 5) * 1000 + ("end" - "start") % 8)::BIGINT AS y FROM v_exons),
met AS (SELECT DISTINCT a.gene AS a, b.gene AS b FROM ex a JOIN ex b ON a.strand = b.strand AND a.x <= b.y AND b.x <= a.y AND a.gene <> b.gene),
reach AS (SELECT a AS gene, b AS to_ FROM met UNION SELECT r.gene, m.b FROM reach r JOIN met m ON r.to_ = m.a),
lab AS (SELECT gene, least(gene, min(to_)) AS label FROM reach GROUP BY gene),
n AS (SELECT gene, count(*) AS n_parts FROM ex GROUP BY gene),
j AS (SELECT l.gene, l.label, CASE WHEN s.s_nationkey % 3 = 0 THEN 'protein_coding' ELSE 'other' END AS biotype, n.n_parts FROM lab l JOIN n ON l.gene = n.gene JOIN supplier s ON s.s_suppkey = l.gene)
SELECT gene, label, biotype, n_parts, row_number() OVER (PARTITION BY label ORDER BY (biotype = 'protein_coding') DESC, n_parts DESC, gene) = 1 AS keep FROM j""",
    "count_bipartition": _with(duck("v_splits", "v_counts"), _GRID) + """,
ok AS (SELECT DISTINCT gene FROM (SELECT gene, event, avg(diff1) AS a, avg(diff2) AS b FROM wide GROUP BY gene, event) WHERE coalesce(a > 0 OR b > 0, true))
SELECT w.* FROM wide w JOIN ok ON w.gene = ok.gene""",
    "count_both_sides": _with(duck("v_splits", "v_counts"), _GRID) + """
SELECT gene, event || '_s1' AS event, sample, grp, ref, diff1 AS diff, ref + diff1 AS n FROM wide UNION ALL SELECT gene, event || '_s2', sample, grp, ref, diff2, ref + diff2 FROM wide WHERE diff2 IS NOT NULL""",
    "count_multinomial": _with(duck("v_splits", "v_counts"), _GRID) + """
SELECT gene, event, 'ref' AS type, sample, grp, ref AS cnt FROM wide UNION ALL SELECT gene, event, 'setdiff1', sample, grp, diff1 FROM wide UNION ALL SELECT gene, event, 'setdiff2', sample, grp, diff2 FROM wide WHERE diff2 IS NOT NULL""",
    "unpivot_counts": _with(duck("v_events")) + """
SELECT gene, event, sample, grp, 'ref' AS type, ref AS cnt FROM v_events UNION ALL SELECT gene, event, sample, grp, 'diff1', diff1 FROM v_events UNION ALL SELECT gene, event, sample, grp, 'diff2', diff2 FROM v_events""",
    "comparisons": _with(duck("v_events")) + """,
c AS (SELECT gene, event, 'diff1_vs_ref' AS comparison, sample, grp, diff1 AS diff, ref FROM v_events UNION ALL SELECT gene, event, 'diff2_vs_ref', sample, grp, diff2, ref FROM v_events
  UNION ALL SELECT gene, event, 'diff2_vs_diff1', sample, grp, diff2, diff1 FROM v_events)
SELECT gene, event, comparison, sample, grp, diff, CASE WHEN ref = 0 THEN 1 ELSE ref END AS ref, diff + CASE WHEN ref = 0 THEN 1 ELSE ref END AS n FROM c WHERE diff IS NOT NULL AND ref IS NOT NULL""",
    "base_mean": _with(duck(*_COMP)) + " SELECT gene, event, comparison, round(avg(n::DOUBLE), 6) AS baseMean FROM v_comparisons WHERE n IS NOT NULL GROUP BY gene, event, comparison HAVING count(*) >= 5",
    "lfc_summary": _with(duck(*_COMP)) + """,
m AS (SELECT gene, event, comparison, avg(diff::DOUBLE) FILTER (WHERE grp = 'g2') AS dt, avg(diff::DOUBLE) FILTER (WHERE grp = 'g1') AS dr, avg(ref::DOUBLE) FILTER (WHERE grp = 'g2') AS rt, avg(ref::DOUBLE) FILTER (WHERE grp = 'g1') AS rr
  FROM v_comparisons GROUP BY gene, event, comparison),
f AS (SELECT gene, event, comparison, log2((dt + 1) / (dr + 1)) AS a, log2((rt + 1) / (rr + 1)) AS b, dt / nullif(dt + rt, 0) AS pt, dr / nullif(dr + rr, 0) AS pr FROM m)
SELECT gene, event, comparison, round(a, 6) AS lfc_diff, round(b, 6) AS lfc_ref, round(abs(a) - abs(b), 6) AS lfc_diff_net, round(pt, 6) AS pi_trt, round(pr, 6) AS pi_ref, round(pt - pr, 6) AS delta_pi FROM f""",
    "moderate_log": _with(duck(*_COMP), _PHI) + """,
z AS (SELECT gene, event, comparison, ok, ln(phi) AS z, var_phi / (phi * phi) AS v FROM phi WHERE phi > 0 AND phi < 1e10),
few AS (SELECT comparison, count(*) FILTER (WHERE ok) < 10 AS few FROM z GROUP BY comparison),
p AS (SELECT z.comparison, median(z.z) AS bar, greatest(var_samp(z.z) - median(z.v), 0) AS tau FROM z JOIN few f ON z.comparison = f.comparison WHERE z.ok OR f.few GROUP BY z.comparison),
s AS (SELECT z.*, p.bar, coalesce(p.tau / nullif(p.tau + z.v, 0), 0) AS w FROM z JOIN p ON z.comparison = p.comparison)
SELECT gene, event, comparison, round(z, 6) AS z, round(v, 6) AS var_z, round(w, 6) AS w, round(w * z + (1 - w) * bar, 6) AS z_mod, round(exp(w * z + (1 - w) * bar), 6) AS phi_mod FROM s""",
    "moderate_precision": _with(duck(*_COMP), _PHI) + """,
z AS (SELECT gene, event, comparison, ln(phi) AS z, var_phi AS v, var_phi < 1000 AND abs(ln(phi)) < 50 AS valid, ok FROM phi WHERE phi > 0),
n AS (SELECT comparison, count(*) FILTER (WHERE valid AND ok) >= 10 AS many, count(*) FILTER (WHERE valid) >= 10 AS some, median(z) AS mid FROM z GROUP BY comparison),
p AS (SELECT z.comparison, median(z.z) AS bar, greatest(var_samp(z.z) - median(z.v), 0) AS tau FROM z JOIN n ON z.comparison = n.comparison WHERE z.valid AND (z.ok OR NOT n.many) GROUP BY z.comparison),
q AS (SELECT n.comparison, CASE WHEN n.some THEN p.bar ELSE n.mid END AS bar, CASE WHEN n.some THEN p.tau ELSE 0 END AS tau FROM n LEFT JOIN p ON n.comparison = p.comparison),
s AS (SELECT z.*, q.bar, coalesce(q.tau / nullif(q.tau + z.v, 0), 0) AS w FROM z JOIN q ON z.comparison = q.comparison)
SELECT gene, event, comparison, round(w, 6) AS w_prec, round(w * z + (1 - w) * bar, 6) AS log_prec_mod, round(greatest(least(1 / (1 + exp(w * z + (1 - w) * bar)), 1 - 1e-6), 1e-6), 6) AS rho_mod FROM s""",
    "wilcoxon_stat": _with(duck(*_COMP)) + """,
p AS (SELECT *, y::DOUBLE / n AS prop FROM v_comparisons WHERE n > 0),
r AS (SELECT *, rank() OVER (PARTITION BY gene, event, comparison ORDER BY prop) + (count(*) OVER (PARTITION BY gene, event, comparison, prop) - 1) / 2.0 AS k FROM p)
SELECT gene, event, comparison, grp, count(*) AS n_samples, round(sum(k)::DOUBLE, 6) AS rank_sum, round(avg(prop), 6) AS mean_prop FROM r GROUP BY gene, event, comparison, grp""",
    "bh_adjust": _RES + """,
r AS (SELECT gene, event, comparison, pvalue AS p, row_number() OVER (PARTITION BY comparison ORDER BY pvalue) AS i, count(*) OVER (PARTITION BY comparison) AS n FROM v_results WHERE pvalue IS NOT NULL),
a AS (SELECT gene, event, comparison, least(1, min(p * n / i) OVER (PARTITION BY comparison ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS bh, least(1, p * n) AS bonferroni,
  least(1, max(p * (n - i + 1)) OVER (PARTITION BY comparison ORDER BY i ROWS UNBOUNDED PRECEDING)) AS holm, least(1, min(p * (n - i + 1)) OVER (PARTITION BY comparison ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS hochberg FROM r)
SELECT v.gene, v.event, v.comparison, round(bh, 9) AS bh, round(bonferroni, 9) AS bonferroni, round(holm, 9) AS holm, round(hochberg, 9) AS hochberg FROM v_results v LEFT JOIN a ON v.gene = a.gene AND v.event = a.event AND v.comparison = a.comparison""",
    "bh_adjust_all": _RES + f" SELECT v.gene, v.event, v.comparison, round(a.bh, 9) AS padj FROM v_results v LEFT JOIN {_bh('v_results', '')} a ON v.gene = a.gene AND v.event = a.event AND v.comparison = a.comparison",
    "nested_bh": _RES + f""",
k AS (SELECT gene, pvalue * count(*) OVER (PARTITION BY gene) / row_number() OVER (PARTITION BY gene ORDER BY pvalue) AS s FROM v_results WHERE pvalue IS NOT NULL),
g AS (SELECT gene, min(s) AS pvalue FROM k GROUP BY gene), gg AS (SELECT gene, bh AS padj_gene FROM {_bh('g', '')}),
sel AS (SELECT v.gene, v.event, v.comparison, v.pvalue FROM v_results v JOIN gg ON v.gene = gg.gene WHERE gg.padj_gene < 0.5 AND v.pvalue IS NOT NULL),
w AS (SELECT gene, event, comparison, bh FROM {_bh('sel', 'gene')})
SELECT v.gene, v.event, v.comparison, round(gg.padj_gene, 9) AS padj_gene, round(w.bh, 9) AS padj, coalesce(w.bh < 0.5, false) AND coalesce(abs(v.delta_pi) >= 0.1, true) AS significant
FROM v_results v LEFT JOIN gg ON v.gene = gg.gene LEFT JOIN w ON v.gene = w.gene AND v.event = w.event AND v.comparison = w.comparison""",
    "filtered_p": _RES + f""",
t AS (SELECT unnest([0.0, 0.25, 0.5, 0.75])::DOUBLE AS theta), q AS (SELECT t.theta, CASE t.theta WHEN 0 THEN (SELECT quantile_cont(baseMean, 0.0) FROM v_results) WHEN 0.25 THEN (SELECT quantile_cont(baseMean, 0.25) FROM v_results)
  WHEN 0.5 THEN (SELECT quantile_cont(baseMean, 0.5) FROM v_results) ELSE (SELECT quantile_cont(baseMean, 0.75) FROM v_results) END AS cut FROM t),
x AS (SELECT v.gene, v.event, v.comparison, q.theta, v.pvalue FROM v_results v, q WHERE v.baseMean >= q.cut)
SELECT x.gene, x.event, x.comparison, x.theta, round(a.bh, 9) AS padj FROM x LEFT JOIN {_bh('x', 'theta')} a ON x.gene = a.gene AND x.event = a.event AND x.comparison = a.comparison AND x.theta = a.theta""",
    "minp_combine": _RES + """
SELECT gene, event, round(min(CASE WHEN pvalue > 0 AND pvalue <= 1 THEN pvalue END), 9) AS pvalue, min(comparison) FILTER (WHERE k = 1) AS primary_comparison, string_agg(DISTINCT part::VARCHAR, ',') AS parts
FROM (SELECT *, event % 7 AS part_, row_number() OVER (PARTITION BY gene, event ORDER BY pvalue, comparison) AS k FROM v_results WHERE pvalue IS NOT NULL) GROUP BY gene, event""",
    "fisher_combine": _RES + """,
s AS (SELECT gene, event, count(*)::INT AS k, -2 * sum(ln(pvalue)) AS x FROM v_results WHERE pvalue > 0 AND pvalue <= 1 GROUP BY gene, event)
SELECT gene, event, k, round(x, 6) AS statistic, round(least(1, exp(-x / 2) * CASE WHEN k = 1 THEN 1 ELSE 1 + x / 2 END), 9) AS pvalue FROM s""",
    "minp_adjusted": _combined("min(pvalue) FILTER (WHERE pvalue > 0 AND pvalue <= 1)"),
    "fisher_adjusted": _combined("exp(sum(ln(pvalue)) FILTER (WHERE pvalue > 0 AND pvalue <= 1)) * CASE WHEN count(*) FILTER (WHERE pvalue > 0 AND pvalue <= 1) > 1 THEN 1 - sum(ln(pvalue)) FILTER (WHERE pvalue > 0 AND pvalue <= 1) ELSE 1 END"),
    "junction_sum": _with(duck("v_exons")) + """,
x AS (SELECT gene, chrom, "start" AS s, "end" AS e FROM v_exons), m AS (SELECT chrom, s, e, (gene % 5)::INT AS sample, count(*) * 3 AS cnt FROM x GROUP BY chrom, s, e, gene % 5),
want AS (SELECT gene, chrom, s, e FROM x UNION SELECT gene, chrom, s, e - 1 FROM x),
sums AS (SELECT w.gene, m.sample, sum(m.cnt)::BIGINT AS cnt FROM want w JOIN m ON w.chrom = m.chrom AND w.s = m.s AND w.e = m.e GROUP BY w.gene, m.sample)
SELECT g.gene, p.sample, coalesce(s.cnt, 0) AS cnt FROM (SELECT DISTINCT gene FROM x) g JOIN (SELECT DISTINCT sample FROM m) p ON true LEFT JOIN sums s ON s.gene = g.gene AND s.sample = p.sample""",
    "event_bounds": _with(duck("v_exons"), _EVENTS) + """
SELECT gene, event_id, etype, strand,
  (CASE WHEN etype IN ('SE', 'RI') THEN s - 20 WHEN etype = 'A3SS' THEN CASE WHEN strand = '+' THEN s - 40 ELSE s - 50 END WHEN etype = 'A5SS' THEN CASE WHEN strand = '+' THEN s ELSE e END END + 1)::INT AS b1,
  (CASE WHEN etype IN ('SE', 'RI') THEN e + 20 WHEN etype = 'A3SS' THEN CASE WHEN strand = '+' THEN e ELSE s END WHEN etype = 'A5SS' THEN CASE WHEN strand = '+' THEN s - 50 ELSE s - 40 END END + 1)::INT AS b2,
  (CASE WHEN etype = 'SE' THEN s WHEN etype = 'RI' THEN s - 20 WHEN etype = 'A3SS' THEN CASE WHEN strand = '+' THEN s ELSE e - 3 END WHEN etype = 'A5SS' THEN CASE WHEN strand = '+' THEN e - 3 ELSE s END END + 1)::INT AS alt_low,
  (CASE WHEN etype = 'SE' THEN e WHEN etype = 'RI' THEN e + 20 WHEN etype = 'A3SS' THEN CASE WHEN strand = '+' THEN s + 3 ELSE e END WHEN etype = 'A5SS' THEN CASE WHEN strand = '+' THEN e ELSE s + 3 END END + 1)::INT AS alt_hi
FROM ev""",
    "read_counting": _with(duck("v_exons")) + """,
r AS (SELECT row_number() OVER () AS id, chrom, "start" AS x, "end" AS y, 5 + tx % 20 < 10 AS low FROM v_exons),
p AS (SELECT DISTINCT chrom, ("start" // 25)::INT AS k FROM v_exons),
parts AS (SELECT chrom || (k // 4) AS gene, k % 4 + 1 AS part, chrom, k * 25 AS a, k * 25 + 24 AS b FROM p),
h AS (SELECT r.id, q.gene, q.part FROM r JOIN parts q ON r.chrom = q.chrom AND r.x <= q.b AND q.a <= r.y WHERE NOT r.low),
n AS (SELECT id, count(DISTINCT gene) AS g FROM h GROUP BY id),
s AS (SELECT r.id, CASE WHEN r.low THEN '_lowaqual' WHEN n.g IS NULL THEN '_empty' WHEN n.g > 1 THEN '_ambiguous' END AS special FROM r LEFT JOIN n ON r.id = n.id),
c AS (SELECT h.gene, h.part, count(*) AS cnt FROM h JOIN s ON h.id = s.id AND s.special IS NULL GROUP BY h.gene, h.part)
SELECT q.gene, q.part, NULL::VARCHAR AS special, coalesce(c.cnt, 0) AS cnt FROM parts q LEFT JOIN c ON q.gene = c.gene AND q.part = c.part
UNION ALL SELECT NULL, NULL, special, count(*) FROM s WHERE special IS NOT NULL GROUP BY special""",
    "merge_maps": _with(duck("v_exons"), _EVENTS) + """,
m AS (SELECT gene, (e % 7)::INT AS part, etype, string_agg(DISTINCT event_id, ',' ORDER BY event_id) AS ids FROM ev WHERE etype <> 'MXE' GROUP BY gene, e % 7, etype)
SELECT gene, part, string_agg(ids, ',' ORDER BY CASE etype WHEN 'SE' THEN 1 WHEN 'RI' THEN 2 WHEN 'A3SS' THEN 3 ELSE 4 END) AS event_ids FROM m GROUP BY gene, part""",
    "integrate_counts": _RES + "," + _TWO + """,
f AS (SELECT p_a IS NOT NULL AS ta, p_b IS NOT NULL AS tb, coalesce(p_a < 0.2, false) AS sa, coalesce(p_b < 0.2, false) AS sb FROM two),
n AS (SELECT count(*) AS events, count(*) FILTER (WHERE ta) AS t1, count(*) FILTER (WHERE tb) AS t2, count(*) FILTER (WHERE ta AND tb) AS t3, count(*) FILTER (WHERE ta AND NOT tb) AS t4, count(*) FILTER (WHERE tb AND NOT ta) AS t5,
  count(*) FILTER (WHERE sa) AS s1, count(*) FILTER (WHERE sb) AS s2, count(*) FILTER (WHERE sa AND sb) AS s3, count(*) FILTER (WHERE sa AND NOT sb) AS s4, count(*) FILTER (WHERE sb AND NOT sa) AS s5 FROM f)
SELECT t1 AS events_tested_a, t2 AS events_tested_b, t3 AS events_tested_both, t4 AS events_tested_a_only, t5 AS events_tested_b_only, s1 AS events_sig_a, s2 AS events_sig_b, s3 AS events_sig_both, s4 AS events_sig_a_only, s5 AS events_sig_b_only,
  t1 AS parts_tested_a, t2 AS parts_tested_b, t3 AS parts_tested_both, t4 AS parts_tested_a_only, t5 AS parts_tested_b_only, s1 AS parts_sig_a, s2 AS parts_sig_b, s3 AS parts_sig_both, s4 AS parts_sig_a_only, s5 AS parts_sig_b_only, events FROM n""",
    "crosswalk_strict": _with(duck("v_counts"), _SETS) + " SELECT a.gene, a.event, b.event AS other FROM sa a LEFT JOIN sb b ON a.gene = b.gene AND a.r = b.r AND a.x = b.x",
    "crosswalk_lenient": _with(duck("v_counts"), _SETS) + " SELECT a.gene, a.event, b.event AS other FROM sa a LEFT JOIN sb b ON a.gene = b.gene AND list_has_any(a.r, b.r) AND list_has_any(a.x, b.x)",
    "crosswalk_one_to_one": _with(duck("v_counts"), _SETS) + """,
p AS (SELECT a.gene, a.event, b.event AS other, count(*) OVER (PARTITION BY a.gene, a.event) AS n, count(*) OVER (PARTITION BY a.gene, b.event) AS m FROM sa a JOIN sb b ON a.gene = b.gene AND a.r = b.r AND a.x = b.x)
SELECT gene, event, other FROM p WHERE n = 1 AND m = 1""",
    "compare_categories": _RES + "," + _TWO + """
SELECT event, CASE WHEN coalesce(p_a < 0.2, false) AND coalesce(p_b < 0.2, false) THEN 'Both' WHEN coalesce(p_a < 0.2, false) THEN 'A-only' WHEN coalesce(p_b < 0.2, false) THEN 'B-only' ELSE 'Neither' END AS category, sign(e_a) = sign(e_b) AS same_direction, count(*) AS n
FROM two GROUP BY 1, 2, 3""",
    "spearman": _RES + "," + _TWO + """,
c AS (SELECT * FROM two WHERE p_a IS NOT NULL AND p_b IS NOT NULL AND e_a IS NOT NULL AND e_b IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY event ORDER BY p_a) + (count(*) OVER (PARTITION BY event, p_a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY event ORDER BY p_b) + (count(*) OVER (PARTITION BY event, p_b) - 1) / 2.0 AS rb FROM c)
SELECT event, count(*) AS n, round(corr(-log10(p_a + 1e-300), -log10(p_b + 1e-300)), 6) AS pearson_p, round(corr(ra::DOUBLE, rb::DOUBLE), 6) AS spearman_p, round(corr(e_a, e_b), 6) AS pearson_effect FROM r GROUP BY event""",
    "part_min_p": _with(duck("v_results", "v_splits")) + """,
e AS (SELECT v.gene, v.event, v.pvalue, unnest(s.diff1) AS part FROM v_results v JOIN v_splits s ON v.gene = s.gene AND v.event = s.event WHERE v.comparison = 'diff1_vs_ref' AND v.pvalue IS NOT NULL)
SELECT gene, part, event, round(pvalue, 9) AS pvalue FROM (SELECT *, row_number() OVER (PARTITION BY gene, part ORDER BY pvalue, event) AS k FROM e) WHERE k = 1""",
    "gene_set_overlap": _RES + """,
a AS (SELECT s_suppkey AS gene, s_nationkey % 2 = 0 AS up FROM supplier WHERE s_acctbal > 2000),
b AS (SELECT gene, string_agg(DISTINCT CASE WHEN event = 1 THEN 'internal' ELSE 'TSSTTS' END, '+' ORDER BY CASE WHEN event = 1 THEN 'internal' ELSE 'TSSTTS' END) AS c FROM v_results WHERE pvalue < 0.5 GROUP BY gene)
SELECT 'g2:g1' AS contrast, CASE WHEN b.gene IS NULL THEN 'DGE_only' WHEN a.gene IS NULL THEN 'splicing_only' ELSE 'both' END AS "set", CASE WHEN a.up THEN 'up' WHEN NOT a.up THEN 'down' END AS direction, b.c AS "class", count(*) AS n
FROM a FULL JOIN b ON a.gene = b.gene GROUP BY 1, 2, 3, 4""",
    "gene_bias_summary": _RES + "," + _GENES + " SELECT gene, n_events, round(total_expr, 6) AS total_expr, is_sig FROM genes",
    "term_membership": _RES + "," + _GENES + """,
m AS (SELECT DISTINCT l_suppkey::VARCHAR AS gene, l_partkey % 50 AS term FROM lineitem),
t AS (SELECT m.term, count(*) AS size, count(*) FILTER (WHERE g.is_sig) AS n_sig, round(count(*) FILTER (WHERE g.is_sig) / count(*)::DOUBLE, 9) AS pvalue, string_agg(m.gene, '/' ORDER BY m.gene) FILTER (WHERE g.is_sig) AS genes
  FROM m JOIN genes g ON m.gene = g.gene GROUP BY m.term)
SELECT * FROM t ORDER BY pvalue, term LIMIT 10""",
}

from .graph_oracles import GRAPH  # noqa: E402
from .result_oracles import RESULT  # noqa: E402

ORACLES |= GRAPH | RESULT

#: erfc(x) for x >= 0, as an SQL expression: the series up to 2, the continued fraction beyond.
def _erfc(x: str) -> str:
    series = f"list_reduce([struct_pack(t := {x}, s := {x})] || [struct_pack(t := 0.0::DOUBLE, s := (2.0 * k + 1)::DOUBLE) FOR k IN range(1, 61)], lambda a, b: struct_pack(t := a.t * 2 * {x} * {x} / b.s, s := a.s + a.t * 2 * {x} * {x} / b.s)).s"
    deep = f"list_reduce([{x}] || [(81 - k)::DOUBLE FOR k IN range(1, 81)], lambda t, k: {x} + k / 2 / t)"
    return f"CASE WHEN {x} < 2 THEN 1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * {series} ELSE exp(-({x}) * ({x})) / (sqrt(pi()) * {deep}) END"


_LONG = """
long AS (SELECT gene, event, sample, grp, 'ref' AS type, ref::DOUBLE AS cnt FROM v_events UNION ALL SELECT gene, event, sample, grp, 'diff1', diff1 FROM v_events UNION ALL SELECT gene, event, sample, grp, 'diff2', diff2 FROM v_events WHERE diff2 IS NOT NULL),
cells AS (SELECT * FROM (SELECT *, sum(cnt) OVER (PARTITION BY gene, event, sample, grp) AS total FROM long) WHERE total > 0),
shares AS (SELECT *, sum(cnt) OVER (PARTITION BY gene, event, type) / sum(cnt) OVER (PARTITION BY gene, event) AS share, sum(cnt) OVER (PARTITION BY gene, event, grp, type) / sum(cnt) OVER (PARTITION BY gene, event, grp) AS own FROM cells),
facts AS (SELECT gene, event, count(DISTINCT sample) AS samples, count(DISTINCT type) AS types, count(DISTINCT grp) AS groups, count(DISTINCT type) FILTER (WHERE cnt > 0) AS some_types FROM cells GROUP BY gene, event)"""


def _rise(a: str, y: str) -> str:
    """ln gamma(a + y) - ln gamma(a) without loss where a is large, as DuckDB works it out."""
    return f"CASE WHEN {a} < 1e5 THEN lgamma({a} + {y}) - lgamma({a}) ELSE {y} * ln({a}) + ({a} + {y} - 0.5) * ({y} / {a} - ({y} / {a}) ** 2 / 2 + ({y} / {a}) ** 3 / 3 - ({y} / {a}) ** 4 / 4) - {y} END"


_MONTHS = """
ev3 AS (SELECT *, CASE WHEN sample <= 4 THEN 'a' WHEN sample <= 8 THEN 'b' ELSE 'c' END AS g3 FROM v_events),
cmp AS (SELECT gene, event, 'diff1_vs_ref' AS comparison, sample, g3 AS grp, diff1 AS diff, ref FROM ev3 WHERE diff1 IS NOT NULL UNION ALL SELECT gene, event, 'diff2_vs_ref', sample, g3, diff2, ref FROM ev3 WHERE diff2 IS NOT NULL),
big AS (SELECT gene, event, comparison, avg((diff + ref)::DOUBLE) AS base FROM cmp GROUP BY ALL HAVING count(*) >= 5),
ups AS (SELECT c.*, CASE WHEN c.ref = 0 THEN 1 ELSE c.ref END AS ref1 FROM cmp c JOIN big b ON b.gene = c.gene AND b.event = c.event AND b.comparison = c.comparison),
con AS (SELECT u.*, k.contrast, diff::DOUBLE / (diff + ref1) AS prop FROM ups u JOIN (VALUES ('b:a', 'b'), ('c:a', 'c')) k(contrast, trt) ON u.grp = 'a' OR u.grp = k.trt WHERE diff + ref1 > 0),
rk AS (SELECT *, rank() OVER (PARTITION BY gene, event, comparison, contrast ORDER BY prop) + (count(*) OVER (PARTITION BY gene, event, comparison, contrast, prop) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene, event, comparison, contrast, prop) AS same FROM con),
rs AS (SELECT gene, event, comparison, contrast, count(*) FILTER (WHERE grp = 'a') AS m, count(*) FILTER (WHERE grp <> 'a') AS n, (sum(r) FILTER (WHERE grp = 'a'))::DOUBLE AS w, sum(same * same - 1)::DOUBLE AS ties, avg(prop) FILTER (WHERE grp = 'a') AS p1, avg(prop) FILTER (WHERE grp <> 'a') AS p2
  FROM rk GROUP BY ALL HAVING count(DISTINCT grp) = 2 AND sum(diff) <> 0),
us AS (SELECT *, w - m * (m + 1) / 2 AS u FROM rs),
pairs AS (SELECT DISTINCT m, n FROM us WHERE ties = 0),
ways AS (SELECT m, n, 0::BIGINT AS k, 0::BIGINT AS i, 0::BIGINT AS u FROM pairs UNION ALL SELECT m, n, k + 1, i + b, u + CASE WHEN b = 1 THEN k - i ELSE 0 END FROM ways, (VALUES (0), (1)) v(b) WHERE k < m + n AND i + b <= m AND (k - i) + (1 - b) <= n),
dist AS (SELECT m, n, u, count(*)::DOUBLE AS c FROM ways WHERE k = m + n GROUP BY m, n, u),
tail AS (SELECT s.gene, s.event, s.comparison, s.contrast, sum(d.c) FILTER (WHERE d.u <= s.u) / sum(d.c) AS low, sum(d.c) FILTER (WHERE d.u >= s.u) / sum(d.c) AS high FROM us s JOIN dist d ON d.m = s.m AND d.n = s.n WHERE s.ties = 0 GROUP BY ALL),
zs AS (SELECT *, greatest(abs(u - m * n / 2.0) - 0.5, 0) / nullif(sqrt(m * n / 12.0 * (m + n + 1 - ties / ((m + n) * (m + n - 1)))), 0) / sqrt(2.0) AS z FROM us),
ps AS (SELECT z.gene, z.event, z.comparison, z.contrast, CASE WHEN z.ties = 0 THEN least(1.0, 2 * CASE WHEN z.u > z.m * z.n / 2.0 THEN t.high ELSE t.low END) WHEN z.z IS NOT NULL THEN least(1.0, {erfc}) END AS pvalue, z.p2 - z.p1 AS effect
  FROM zs z LEFT JOIN tail t ON t.gene = z.gene AND t.event = z.event AND t.comparison = z.comparison AND t.contrast = z.contrast),
eff AS (SELECT gene, event, comparison, contrast, avg(diff::DOUBLE) FILTER (WHERE grp <> 'a') AS dt, avg(diff::DOUBLE) FILTER (WHERE grp = 'a') AS dr, avg(ref::DOUBLE) FILTER (WHERE grp <> 'a') AS rt, avg(ref::DOUBLE) FILTER (WHERE grp = 'a') AS rr
  FROM (SELECT u.*, k.contrast FROM ups u JOIN (VALUES ('b:a', 'b'), ('c:a', 'c')) k(contrast, trt) ON u.grp = 'a' OR u.grp = k.trt) GROUP BY ALL),
sm AS (SELECT contrast, gene, min(s) AS pvalue FROM (SELECT contrast, gene, pvalue * count(*) OVER (PARTITION BY contrast, gene) / row_number() OVER (PARTITION BY contrast, gene ORDER BY pvalue) AS s FROM ps WHERE pvalue IS NOT NULL) GROUP BY ALL)"""

ORACLES |= {
    "wilcoxon_contrasts": "WITH RECURSIVE " + duck("v_events") + "," + _MONTHS.replace("{erfc}", _erfc("z.z")) + f""",
gg AS (SELECT contrast, gene, bh AS padj_gene FROM {_bh('sm', 'contrast')}),
sel AS (SELECT p.* FROM ps p JOIN gg ON gg.contrast = p.contrast AND gg.gene = p.gene WHERE gg.padj_gene < 0.5 AND p.pvalue IS NOT NULL),
w AS (SELECT contrast, gene, event, comparison, bh FROM {_bh('sel', 'contrast, gene')}),
fx AS (SELECT *, abs(log2((dt + 1) / (dr + 1))) - abs(log2((rt + 1) / (rr + 1))) AS net, dt / nullif(dt + rt, 0) - dr / nullif(dr + rr, 0) AS dpi FROM eff)
SELECT p.gene, p.event, p.comparison, p.contrast, round(p.pvalue, 8) AS pvalue, round(p.effect, 8) AS effect_size, round(b.base, 8) AS baseMean, round(f.net, 8) AS lfc_diff_net, round(f.dpi, 8) AS delta_pi, round(gg.padj_gene, 8) AS padj_gene, round(w.bh, 8) AS padj,
  coalesce(w.bh < 0.5, false) AND coalesce(f.net > 0, true) AND coalesce(abs(f.dpi) >= 0.1, true) AS significant
FROM ps p JOIN big b ON b.gene = p.gene AND b.event = p.event AND b.comparison = p.comparison LEFT JOIN fx f ON f.gene = p.gene AND f.event = p.event AND f.comparison = p.comparison AND f.contrast = p.contrast
  LEFT JOIN gg ON gg.contrast = p.contrast AND gg.gene = p.gene LEFT JOIN w ON w.contrast = p.contrast AND w.gene = p.gene AND w.event = p.event AND w.comparison = p.comparison""",
    "filter_rejections": _RES + f""",
q AS (SELECT comparison, k, quantile_cont(baseMean, k / 20.0) AS cut FROM v_results, (SELECT unnest(range(20)) AS k) WHERE baseMean IS NOT NULL GROUP BY comparison, k)""".replace("quantile_cont(baseMean, k / 20.0)", "list_extract(quantile_cont(baseMean, [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]), (k + 1)::BIGINT)") + f""",
x AS (SELECT v.comparison, q.k, v.pvalue FROM v_results v JOIN q ON q.comparison = v.comparison AND v.baseMean >= q.cut)
SELECT q.comparison, q.k::INT AS k, count(*) FILTER (WHERE a.bh < 0.7) AS n FROM q LEFT JOIN {_bh('x', 'comparison, k')} a ON a.comparison = q.comparison AND a.k = q.k GROUP BY q.comparison, q.k""",
    "dirmult_ratio": _with(duck("v_events"), _LONG) + f""",
lr AS (SELECT gene, event, greatest(2 * sum(CASE WHEN cnt > 0 THEN {_rise('(exp(event + 1.0) * own)', 'cnt')} - ({_rise('(exp(event + 1.0) * share)', 'cnt')}) ELSE 0 END), 0) AS x,
    list(DISTINCT [grp, type, greatest(own, 1e-10)::VARCHAR]) AS t FROM shares GROUP BY gene, event),
ends AS (SELECT gene, event, grp, max(own) FILTER (WHERE type = 'diff1') AS one, max(own) FILTER (WHERE type = 'ref') AS last FROM shares GROUP BY gene, event, grp),
lo AS (SELECT gene, event, arg_max(v, grp) - arg_min(v, grp) AS effect FROM (SELECT *, ln(greatest(one, 1e-10) / greatest(last, 1e-10)) AS v FROM ends) GROUP BY gene, event),
d AS (SELECT l.gene, l.event, l.x, ((f.types - 1) * (f.groups - 1))::INT AS df, o.effect FROM lr l JOIN facts f ON f.gene = l.gene AND f.event = l.event JOIN lo o ON o.gene = l.gene AND o.event = l.event WHERE f.samples >= 2 AND f.groups >= 2 AND f.some_types >= 2)
SELECT gene, event, round(x, 6) AS LRT, df, round(CASE df WHEN 2 THEN exp(-x / 2) ELSE {_erfc('sqrt(x / 2)')} END, 8) AS pvalue, round(effect, 6) AS effect_size FROM d""",
    "dirmult_precision": "WITH " + duck("v_events") + "," + _LONG + """,
ok AS (SELECT gene, event FROM facts WHERE samples >= 2 AND some_types >= 2),
terms AS (SELECT gene, event, 1.0::DOUBLE AS sg, share, cnt AS y, 1.0::DOUBLE AS k FROM shares WHERE cnt > 0 UNION ALL SELECT DISTINCT gene, event, -1.0, 1.0, total, count(*) OVER (PARTITION BY gene, event, total, type)::DOUBLE FROM cells WHERE type = 'ref'),
t AS (SELECT t.* FROM terms t JOIN ok ON ok.gene = t.gene AND ok.event = t.event),
g0 AS (SELECT gene, event, -10.0::DOUBLE AS lo, 12.0::DOUBLE AS hi FROM ok)""" + "".join(f""",
v{r} AS (SELECT g.gene, g.event, p.k, g.lo + (g.hi - g.lo) * (p.k / 12.0) AS x, g.lo, g.hi, sum(t.k * t.sg * ({_rise('(exp(g.lo + (g.hi - g.lo) * (p.k / 12.0)) * t.share)', 't.y')})) AS v FROM g{r} g JOIN t ON t.gene = g.gene AND t.event = g.event, (SELECT unnest(range(13)) AS k) p GROUP BY g.gene, g.event, p.k, g.lo, g.hi),
b{r} AS (SELECT gene, event, arg_max(k, v) AS i, max(v) AS best FROM v{r} GROUP BY gene, event),
g{r + 1} AS (SELECT v.gene, v.event, min(v.x) AS lo, max(v.x) AS hi, max(b.best) AS best, max(v.x) FILTER (WHERE v.k = b.i) AS x, max(v.v) FILTER (WHERE v.k = b.i - 1) AS l, max(v.v) FILTER (WHERE v.k = b.i + 1) AS rr, max((v.hi - v.lo) / 12) AS step
  FROM v{r} v JOIN b{r} b ON b.gene = v.gene AND b.event = v.event WHERE abs(v.k - b.i) <= 1 GROUP BY v.gene, v.event)""" for r in range(5)) + """,
top AS (SELECT gene, event, best, x + coalesce(CASE WHEN l - 2 * best + rr < 0 THEN 0.5 * (l - rr) / (l - 2 * best + rr) END, 0) * step AS x FROM g5),
sums AS (SELECT t.gene, t.event, o.x, o.best, exp(o.x) ** 2 * sum(t.k * t.sg * t.share ** 2 * (SELECT -sum(1 / (exp(o.x) * t.share + j) ** 2) FROM range(0, t.y::BIGINT) r(j))) AS bend, sum(CASE WHEN t.sg > 0 THEN t.k * t.y * ln(t.share) END) AS flat FROM top o JOIN t ON t.gene = o.gene AND t.event = o.event GROUP BY t.gene, t.event, o.x, o.best)
SELECT gene, event, round(x, 3) AS log_prec, round(-1 / bend, 3) AS var_log_prec, 2 * (best - flat) > 3.841458820694124 AND x < 12 - 1e-3 AS identifiable FROM sums WHERE bend < 0""",
}


def _log1p(u: str) -> str:
    return f"(CASE WHEN 1 + {u} = 1 THEN {u} ELSE ln(1 + {u}) * ({u}) / ((1 + {u}) - 1) END)"


def _exact_rise(a: str, y: str) -> str:
    """ln gamma(a + y) - ln gamma(a) by Stirling's series at a + 8, without loss for any a."""
    low, high = f"({a} + 8)", f"({a} + {y} + 8)"
    series = lambda x: f"(1 / (12 * {x}) - 1 / (360 * {x} ** 3) + 1 / (1260 * {x} ** 5) - 1 / (1680 * {x} ** 7))"
    steps = " * ".join(f"(1 + {y} / ({a} + {k}))" for k in range(8))
    return f"({y} * ln({low}) + ({high} - 0.5) * {_log1p(f'({y} / {low})')} - {y} + {series(high)} - {series(low)} - ln({steps}))"


def _digamma_rise(a: str, y: str) -> str:
    low, high = f"({a} + 8)", f"({a} + {y} + 8)"
    series = lambda x: f"(-1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) + 1 / (240 * {x} ** 8))"
    steps = " + ".join(f"{y} / (({a} + {k}) * ({a} + {y} + {k}))" for k in range(8))
    return f"({_log1p(f'({y} / {low})')} + {series(high)} - {series(low)} + {steps})"


def _trigamma_rise(a: str, y: str) -> str:
    low, high = f"({a} + 8)", f"({a} + {y} + 8)"
    series = lambda x: f"(1 / (2 * {x} ** 2) + 1 / (6 * {x} ** 3) - 1 / (30 * {x} ** 5) + 1 / (42 * {x} ** 7) - 1 / (30 * {x} ** 9))"
    steps = " + ".join(f"{y} * (2 * ({a} + {k}) + {y}) / (({a} + {k}) * ({a} + {y} + {k})) ** 2" for k in range(8))
    return f"(-{y} / ({low} * {high}) + {series(high)} - {series(low)} - ({steps}))"


def _newton(name: str, source: str, keys: str, steps: int) -> str:
    """Tables name0 ... name<steps> of `source` (keys, grp, y, z, n, phi) with the logit e of the group's mean; the last one has mu and the information h too."""
    over = f"OVER (PARTITION BY {keys}, grp)"
    out = f"{name}0 AS (SELECT *, ln((sum(y) {over} + 0.5) / (sum(n) {over} + 1) / (1 - (sum(y) {over} + 0.5) / (sum(n) {over} + 1))) AS e FROM {source})"
    for j in range(steps + 1):
        head = "* EXCLUDE (e, mu, s, t, h), greatest(-25, least(25, e + greatest(-2, least(2, CASE WHEN h > 1e-10 THEN s * phi * mu * (1 - mu) / h ELSE sign(s) * 0.5 END)))) AS e" if j < steps else "*"
        out += f""",
{name}{j + 1} AS (SELECT {head} FROM (SELECT *, -(t * (phi * mu * (1 - mu)) ** 2 + s * phi * mu * (1 - mu) * (1 - 2 * mu)) AS h FROM (
  SELECT * EXCLUDE (s0, t0), sum(s0) {over} AS s, sum(t0) {over} AS t FROM (
    SELECT *, {_digamma_rise("(mu * phi)", "y")} - {_digamma_rise("((1 - mu) * phi)", "z")} AS s0, {_trigamma_rise("(mu * phi)", "y")} + {_trigamma_rise("((1 - mu) * phi)", "z")} AS t0 FROM (SELECT *, 1 / (1 + exp(-e)) AS mu FROM {name}{j})))))"""
    return out


_KEYS = "gene, event, comparison"
_LL = f"{_exact_rise('(mu * phi)', 'y')} + {_exact_rise('((1 - mu) * phi)', 'z')} - {_exact_rise('phi', 'n')}"


def _grid_rounds(rounds: int, steps: int) -> str:
    """Grids of 13 log precisions, each between the neighbours of the last one's best; the last range is r<rounds>."""
    out = f"r0 AS (SELECT {_KEYS}, -5.0::DOUBLE AS lo, 18.0::DOUBLE AS hi FROM smp GROUP BY {_KEYS})"
    for r in range(rounds):
        out += f""",
p{r} AS (SELECT s.*, g.k, r.lo + (r.hi - r.lo) * g.k / 12.0 AS x, exp(r.lo + (r.hi - r.lo) * g.k / 12.0) AS phi FROM smp s JOIN r{r} r USING ({_KEYS}), (SELECT unnest(range(13)) AS k) g),
{_newton(f"w{r}_", f"p{r}", _KEYS + ", k", steps)},
l{r} AS MATERIALIZED (SELECT {_KEYS}, k, x, sum({_LL}) AS v FROM w{r}_{steps + 1} GROUP BY {_KEYS}, k, x),
r{r + 1} AS (SELECT {_KEYS}, min(x) AS lo, max(x) AS hi, max(x) FILTER (WHERE k = i) AS x, max(v) AS best, max(v) FILTER (WHERE k = i - 1) AS a, max(v) FILTER (WHERE k = i + 1) AS b FROM (SELECT *, arg_max(k, v) OVER (PARTITION BY {_KEYS}) AS i FROM l{r}) WHERE abs(k - i) <= 1 GROUP BY {_KEYS})"""
    return out


_ROUNDS = 6
ORACLES |= {
    "wald_fixed": "WITH " + duck("v_events") + "," + _MONTHS[: _MONTHS.index("big AS (")].rstrip().rstrip(",") + f""",
raw AS (SELECT {_KEYS}, grp, diff::DOUBLE AS y, ref::DOUBLE AS z, (diff + ref)::DOUBLE AS n, exp(event + 1.0) AS phi FROM cmp WHERE diff + ref > 0),
smp AS (SELECT * FROM raw QUALIFY count(*) OVER (PARTITION BY {_KEYS}) >= 2),
{_newton("f", "smp", _KEYS, 20)},
fit AS (SELECT {_KEYS}, grp, max(e) AS e, max(h) AS h, max(phi) AS phi, sum(y) AS y FROM f21 GROUP BY {_KEYS}, grp),
two_groups AS (SELECT a.*, b.e AS e2, b.h AS h2, b.grp || ':a' AS contrast FROM fit a JOIN fit b USING ({_KEYS}) JOIN (SELECT {_KEYS} FROM fit GROUP BY {_KEYS} HAVING sum(y) > 0) USING ({_KEYS}) WHERE a.grp = 'a' AND b.grp <> 'a' AND a.h > 0 AND b.h > 0),
w AS (SELECT *, (e2 - e) ** 2 / (1 / h + 1 / h2) AS q FROM two_groups)
SELECT {_KEYS}, contrast, round(q, 6) AS LRT, round({_erfc('sqrt(q / 2)')}, 6) AS pvalue, round(phi, 6) AS phi, round(e2 - e, 6) AS effect_size FROM w WHERE abs(e2 - e) < 5""",
    "dispersion": _with(duck(*_COMP)) + f""",
kept AS (SELECT {_KEYS} FROM v_comparisons WHERE n IS NOT NULL GROUP BY {_KEYS} HAVING count(*) >= 5),
raw AS (SELECT c.gene, c.event, c.comparison, grp, y::DOUBLE AS y, (n - y)::DOUBLE AS z, n::DOUBLE AS n FROM v_comparisons c JOIN kept USING ({_KEYS}) WHERE n > 0),
smp AS (SELECT * FROM raw QUALIFY count(*) OVER (PARTITION BY {_KEYS}) >= 2),
{_grid_rounds(_ROUNDS, 8)},
top AS (SELECT {_KEYS}, best, x + coalesce(CASE WHEN a - 2 * best + b < 0 THEN 0.5 * (a - b) / (a - 2 * best + b) END, 0) * (hi - lo) / 2 AS x FROM r{_ROUNDS}),
pf AS (SELECT s.*, t.x, t.best, exp(t.x) AS phi FROM smp s JOIN top t USING ({_KEYS})),
{_newton("c", "pf", _KEYS, 12)},
parts AS (SELECT {_KEYS}, grp, max(x) AS x, max(best) AS best, max(phi) AS phi, max(mu) AS mu, max(h) AS h, sum(y) AS y, sum(n) AS n,
    sum(mu * {_digamma_rise("(mu * phi)", "y")} + (1 - mu) * {_digamma_rise("((1 - mu) * phi)", "z")} - {_digamma_rise("phi", "n")}) AS g1,
    sum(mu ** 2 * {_trigamma_rise("(mu * phi)", "y")} + (1 - mu) ** 2 * {_trigamma_rise("((1 - mu) * phi)", "z")} - {_trigamma_rise("phi", "n")}) AS g2,
    sum({_digamma_rise("(mu * phi)", "y")} - {_digamma_rise("((1 - mu) * phi)", "z")} + phi * (mu * {_trigamma_rise("(mu * phi)", "y")} - (1 - mu) * {_trigamma_rise("((1 - mu) * phi)", "z")})) AS mixed FROM c13 GROUP BY {_KEYS}, grp),
sums AS (SELECT {_KEYS}, max(x) AS x, max(best) AS best, sum(phi ** 2 * g2 + phi * g1 + CASE WHEN h > 1e-10 THEN (phi * mu * (1 - mu) * mixed) ** 2 / h ELSE 0 END) AS curve,
    sum(CASE WHEN y > 0 THEN y * ln(y / n) ELSE 0 END + CASE WHEN n > y THEN (n - y) * ln(1 - y / n) ELSE 0 END) AS flat FROM parts GROUP BY {_KEYS}),
told AS (SELECT *, 2 * (best - flat) > 3.841458820694124 AS identifiable FROM sums)
SELECT {_KEYS}, CASE WHEN identifiable THEN round(x, 4) END AS log_phi, CASE WHEN identifiable THEN round(-1 / curve, 4) END AS var_log_phi, identifiable FROM told""",
}

ORACLES["dedupe_pairs"] = _PRU + "," + PAIRS + "," + SIDES + f""",
keyed AS (SELECT *, CASE WHEN none1 THEN [-1] ELSE diff1 END AS k1, CASE WHEN none2 THEN [-1] ELSE diff2 END AS k2, list_min([list_min([abs(x - y) FOR y IN list_concat(diff1, diff2)]) FOR x IN ref]) AS near FROM split),
firsts AS (SELECT *, row_number() OVER (PARTITION BY gene, k1, k2 ORDER BY len(ref), coalesce(near, 1000000), snk - src, src, id) AS f FROM keyed)
SELECT gene, src, snk, (id // 1000)::INT AS one, (id % 1000)::INT AS two, row_number() OVER (PARTITION BY gene ORDER BY k1, k2)::INT AS event, {_SPLIT_OUT} FROM firsts WHERE f = 1"""


def _trend(keys: str, span: float) -> str:
    """est(keys, z, v, ok) and means(keys, m) -> local quadratics at quantiles by ranking the distances of all rows to each, solved by Cramer's rule, and z shrunk to them."""
    det = lambda c: f"({c[0]} * (s2 * s4 - s3 * s3) - s1 * ({c[1]} * s4 - s3 * {c[2]}) + s2 * ({c[1]} * s3 - s2 * {c[2]}))"
    return f"""
rows AS (SELECT *, ln(m) AS x FROM est JOIN means USING ({keys}) WHERE m > 0),
marked AS (SELECT * REPLACE (ok OR (SELECT count(*) FILTER (WHERE ok) < 10 FROM rows) AS ok) FROM rows),
pts AS (SELECT x, z FROM marked WHERE ok AND v < (SELECT quantile_cont(v, 0.9) FROM rows)),
tot AS (SELECT count(*) AS n, median(z) AS middle FROM pts),
tau AS (SELECT greatest(var_samp(z) - median(v), 0) AS tau FROM marked WHERE ok),
knots AS (SELECT DISTINCT unnest(quantile_cont(x, [k / 200.0 for k in range(201)])) AS p FROM pts),
far AS (SELECT p, x, z, abs(x - p) AS d, row_number() OVER (PARTITION BY p ORDER BY abs(x - p)) AS k FROM pts, knots),
wide AS (SELECT p, max(d) AS h FROM far, tot WHERE k <= greatest(3, floor(n * {span} + 1e-5)) GROUP BY p),
wt AS (SELECT f.p, f.z, (f.x - f.p) / h AS u, pow(1 - pow(d / h, 3), 3) AS w FROM far f JOIN wide ON wide.p = f.p WHERE d < h),
eq AS (SELECT p, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * pow(u, 3)) AS s3, sum(w * pow(u, 4)) AS s4, sum(w * z) AS y0, sum(w * u * z) AS y1, sum(w * u * u * z) AS y2 FROM wt GROUP BY p),
ys AS (SELECT p, {det(("y0", "y1", "y2"))} / {det(("s0", "s1", "s2"))} AS y FROM eq),
seg AS (SELECT p, y, lead(p) OVER (ORDER BY p) AS p2, lead(y) OVER (ORDER BY p) AS y2 FROM ys),
everyone AS (SELECT *, ln(greatest(m, 1)) AS x FROM means),
read AS (SELECT e.*, coalesce(CASE WHEN s.p IS NOT NULL THEN s.y + (s.y2 - s.y) * (e.x - s.p) / (s.p2 - s.p) END, CASE WHEN e.x = (SELECT max(p) FROM ys) THEN (SELECT max_by(y, p) FROM ys) END, tot.middle) AS t
  FROM everyone e CROSS JOIN tot LEFT JOIN seg s ON e.x >= s.p AND e.x < s.p2),
told AS (SELECT {", ".join(f"r.{k.strip()}" for k in keys.split(","))}, r.t, e.z, coalesce(tau / nullif(tau + e.v, 0), 0) AS w FROM read r CROSS JOIN tau LEFT JOIN est e USING ({keys}))
SELECT {keys}, round(t, 6) AS z_trend, round(w, 6) AS w, round(w * z + (1 - w) * t, 6) AS z_mod FROM told"""


ORACLES["moderate_trend"] = _with(duck(*_COMP), _PHI) + """,
est AS (SELECT gene, event, comparison, ln(phi) AS z, var_phi / phi / phi AS v, ok FROM phi WHERE phi > 0), means AS (SELECT * FROM bm),""" + _trend("gene, event, comparison", 0.5)
ORACLES["moderate_trend_precision"] = _with(duck(*_COMP)) + """,
means AS (SELECT gene, event, avg(n::DOUBLE) AS m FROM v_comparisons GROUP BY gene, event),
est AS (SELECT gene, event, ln(m % 11 + 1) AS z, m % 3 / 4 + 0.1 AS v, gene % 4 > 0 AS ok FROM means WHERE gene % 5 > 0),""" + _trend("gene, event", 0.3)
# the weighted count's distribution draw by draw
ORACLES["enrichment_tail"] = (_RES + "," + _GENES + """,
w AS (SELECT split_part(gene, '.', 1) AS gene, is_sig, (split_part(gene, '.', 1)::INT % 9 + 1) / 10 AS pwf FROM genes),
known AS (SELECT DISTINCT l_suppkey::VARCHAR AS gene, l_partkey % 50 AS term FROM lineitem WHERE l_suppkey % 10 > 0),
urn AS (SELECT count(*) AS n_genes, count(*) FILTER (WHERE is_sig) AS draws, sum(pwf) AS weight FROM w WHERE gene IN (SELECT gene FROM known)),
terms AS (SELECT term, count(*) AS size, count(*) FILTER (WHERE is_sig) AS n_sig, sum(pwf) AS own FROM known JOIN w USING (gene) GROUP BY term HAVING count(*) >= 2),
kept AS (SELECT t.*, u.*, n_genes - size AS others, CASE WHEN n_genes > size THEN (own / size) / ((weight - own) / (n_genes - size)) ELSE 1 END AS odds FROM terms t, urn u),
drawn AS (SELECT term, size, others, draws, odds, n_sig, 0 AS j, [CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE 0 END for x in range(size + 1)] AS p FROM kept
  UNION ALL SELECT term, size, others, draws, odds, n_sig, j + 1, [
    p[x + 1] * coalesce(greatest(others - (j - x), 0) / nullif(odds * (size - x) + greatest(others - (j - x), 0), 0), 0)
    + CASE WHEN x > 0 THEN p[x] * odds * (size - x + 1) / (odds * (size - x + 1) + greatest(others - (j - x + 1), 0)) ELSE 0 END for x in range(size + 1)] FROM drawn WHERE j < draws),
tails AS (SELECT term, least(list_sum(p[n_sig + 1:]), 1) AS pvalue FROM drawn WHERE j = draws),
r AS (SELECT term, pvalue, row_number() OVER (ORDER BY pvalue) AS i, count(*) OVER () AS n FROM tails),
adj AS (SELECT term, pvalue, least(min(pvalue * n / i) OVER (ORDER BY i DESC), 1) AS padj FROM r)
SELECT term, size, k.n_sig, round(odds, 9) AS odds, round(pvalue, 9) AS pvalue, round(padj, 9) AS padj, round(k.n_sig / nullif((SELECT count(*) FILTER (WHERE is_sig) FROM w), 0), 9) AS gene_ratio FROM kept k JOIN adj USING (term)""").replace("WITH ", "WITH RECURSIVE ", 1)
