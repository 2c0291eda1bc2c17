"""DuckDB SQL for the queries that bring results and splits together."""

from __future__ import annotations

from .oracles import MAX_SINGLE, _BUB, _COMP, _GENES, _PHI, _PRU, _RES, _SPLIT_OUT, _TWO, MULTI, SIDES, _labels, _with
from .views import duck

_PART_TABLE = "pt AS (SELECT gene, part, round(min(pvalue), 9) AS part_p FROM v_results WHERE event <> 2 GROUP BY gene, part)"

_MULTI_KEPT = MULTI + """,
ok AS (SELECT gene, src, snk, list(CASE WHEN n_parts = 0 THEN 'no_exon_part' ELSE coalesce(array_to_string([('E' || lpad(x::VARCHAR, 3, '0')) FOR x IN list_sort(diff)], ','), '') END ORDER BY i) AS diffs FROM each GROUP BY gene, src, snk HAVING bool_and(n_parts = 0 OR len(diff) > 0)),
txt AS (SELECT e.gene, e.src, e.snk, list(array_to_string(e.txs, ', ') ORDER BY e.i) AS txs, list(array_to_string(list_concat([e.src], e.inn, [e.snk]), '-') ORDER BY e.i) AS paths FROM few e GROUP BY e.gene, e.src, e.snk)"""

_CHOSEN = """
txs AS (SELECT DISTINCT gene, tx FROM v_tx_nodes),
each_tx AS (SELECT gene, src, snk, i, inn, parts, rep, unnest(txs) AS tx FROM bvar),
marked AS (SELECT gene, src, snk, i, bool_or(tx % 3 = 0) AS a, bool_or(tx % 3 = 1) AS b FROM each_tx GROUP BY gene, src, snk, i)"""

RESULT = {
    "tests_of_parts": _with(duck("v_events", "v_results"), _PART_TABLE) + """,
ids AS (SELECT DISTINCT gene, gene || ':' || event || ':' || sample AS id, event % 7 AS part FROM v_events WHERE diff1 > 40)
SELECT i.gene, i.part, i.id AS event_id, p.part_p, length(i.id)::INT AS score FROM ids i LEFT JOIN pt p ON p.gene = i.gene AND p.part = i.part WHERE i.gene % 3 > 0""",
    "parts_of_tests": _with(duck("v_splits", "v_results"), _PART_TABLE) + """,
e AS (SELECT gene, event AS event_id, unnest(diff1) AS part FROM v_splits WHERE event < 3)
SELECT coalesce(e.gene, p.gene) AS gene, coalesce(e.part, p.part) AS part, e.event_id, p.part_p FROM e FULL JOIN pt p ON p.gene = e.gene AND p.part = e.part""",
    "annotate_results": _with(duck("v_splits", "v_results")) + f"""
SELECT r.gene, r.event, r.comparison, {_labels('s.ref').replace("coalesce(", "CASE WHEN s.gene IS NOT NULL THEN coalesce(")} END AS ref, {_labels('s.diff1').replace("coalesce(", "CASE WHEN s.gene IS NOT NULL THEN coalesce(")} END AS diff1
FROM v_results r LEFT JOIN v_splits s ON s.gene = r.gene AND s.event = r.event AND s.gene % 4 > 0""",
    "exclusive_counts": _RES + "," + _TWO + """
SELECT p_a IS NOT NULL AS tested_a, p_b IS NOT NULL AS tested_b, coalesce(p_a < 0.2, false) AS sig_a, coalesce(p_b < 0.2, false) AS sig_b, count(*) AS n FROM two GROUP BY 1, 2, 3, 4""",
    "override_expression": _RES + "," + _GENES + """
SELECT g.gene, g.n_events, round(coalesce(CASE WHEN s.s_acctbal > 0 THEN s.s_acctbal::DOUBLE END, g.total_expr), 6) AS total_expr, g.is_sig FROM genes g LEFT JOIN supplier s ON s.s_suppkey::VARCHAR = g.gene""",
    "map_ids": _RES + "," + _GENES + """
SELECT target, gene, n_events, is_sig FROM (SELECT 'id' || s.s_nationkey AS target, g.*, row_number() OVER (PARTITION BY s.s_nationkey ORDER BY g.n_events DESC, g.gene) AS k FROM genes g JOIN supplier s ON s.s_suppkey::VARCHAR = g.gene) WHERE k = 1""",
    "chosen_vs_rest": _BUB + "," + _CHOSEN + """
SELECT e.gene, e.src, e.snk, string_agg(e.tx::VARCHAR, ',' ORDER BY e.tx) FILTER (WHERE m.a) AS txs1, string_agg(e.tx::VARCHAR, ',' ORDER BY e.tx) FILTER (WHERE NOT m.a) AS txs2, count(DISTINCT e.i) FILTER (WHERE m.a)::INT AS n1, count(DISTINCT e.i) FILTER (WHERE NOT m.a)::INT AS n2
FROM each_tx e JOIN marked m ON m.gene = e.gene AND m.src = e.src AND m.snk = e.snk AND m.i = e.i GROUP BY e.gene, e.src, e.snk HAVING bool_or(m.a) AND bool_or(NOT m.a)""",
    "split_text": _PRU + "," + _MULTI_KEPT + ",\ndone AS (SELECT o.gene, o.src, o.snk, o.diffs, t.txs, t.paths, r.ref FROM ok o JOIN txt t ON t.gene = o.gene AND t.src = o.src AND t.snk = o.snk LEFT JOIN mref r ON r.gene = o.gene AND r.src = o.src AND r.snk = o.snk) SELECT gene, src, snk, "
    + _labels("ref") + " AS ref_ex_part, " + ", ".join(f"coalesce(diffs[{k}], '') AS setdiff{k}, coalesce(txs[{k}], '') AS transcripts{k}, coalesce(paths[{k}], '') AS path{k}" for k in range(1, MAX_SINGLE + 1)) + " FROM done",
    "two_sided": _PRU + "," + _MULTI_KEPT + f"""
SELECT o.gene, o.src, o.snk, {_labels('r.ref')} AS ref, replace(o.diffs[1], 'no_exon_part', '') AS diff1, replace(o.diffs[2], 'no_exon_part', '') AS diff2 FROM ok o LEFT JOIN mref r ON r.gene = o.gene AND r.src = o.src AND r.snk = o.snk""",
    "changed_vs_constant": _PRU.replace(" WHERE NOT (b.src = 0 AND b.snk = 11)", "") + "," + _CHOSEN + """,
sides AS (SELECT p.*, m.a AND NOT m.b AS one, m.b AND NOT m.a AS other FROM pvar p JOIN marked m ON m.gene = p.gene AND m.src = p.src AND m.snk = p.snk AND m.i = p.i),
two_sides AS (SELECT gene, src, snk, 1 AS id, bit_and(bits) FILTER (WHERE one) AS all1, bit_or(bits) FILTER (WHERE one) AS any1, min_by(rep_bits, i) FILTER (WHERE one) AS rep1, sum(n_txs) FILTER (WHERE one) AS n1,
  bit_and(bits) FILTER (WHERE other) AS all2, bit_or(bits) FILTER (WHERE other) AS any2, min_by(rep_bits, i) FILTER (WHERE other) AS rep2, sum(n_txs) FILTER (WHERE other) AS n2 FROM sides GROUP BY gene, src, snk HAVING bool_or(one) AND bool_or(other)),
""" + SIDES.lstrip() + f" SELECT gene, src, snk, {_SPLIT_OUT}, n1::INT AS n1, n2::INT AS n2 FROM split",
    "impute_means": _with(duck(*_COMP), _PHI) + """,
z AS (SELECT gene, event, comparison, CASE WHEN gene % 4 > 0 AND comparison = 'diff1_vs_ref' THEN phi END AS z FROM phi), m AS (SELECT comparison, median(z) AS m FROM z GROUP BY comparison)
SELECT z.gene, z.event, z.comparison, round(coalesce(z.z, m.m, (SELECT median(z) FROM z), 0), 6) AS z_mod FROM z JOIN m ON m.comparison = z.comparison""",
}
