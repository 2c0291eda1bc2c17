"""DuckDB SQL for the queries over graphs; exons are compared with every other one of their gene."""

from __future__ import annotations

from .oracles import BUBBLES, MASKS, MULTI, PRUNED, SIDES, WAYS
from .views import duck

EDGES = """
gx AS (SELECT gene, tx, CASE WHEN strand = '+' THEN "start" ELSE "end" + 1 END AS p, CASE WHEN strand = '+' THEN "end" + 1 ELSE "start" END AS q, CASE WHEN strand = '+' THEN 1 ELSE -1 END AS d FROM v_chains),
gn AS (SELECT gene, pos, row_number() OVER (PARTITION BY gene ORDER BY pos * d)::INT AS node FROM (SELECT gene, p AS pos, d FROM gx UNION SELECT gene, q, d FROM gx)),
gl AS (SELECT gene, max(node) + 1 AS leaf FROM gn GROUP BY gene),
gc AS (SELECT x.gene, x.tx, a.node AS a, b.node AS b, x.p, x.q FROM gx x JOIN gn a ON a.gene = x.gene AND a.pos = x.p JOIN gn b ON b.gene = x.gene AND b.pos = x.q),
gs AS (SELECT *, lead(a) OVER w AS na, lead(p) OVER w AS np, row_number() OVER w AS k FROM gc WINDOW w AS (PARTITION BY gene, tx ORDER BY a, b)),
ge AS (SELECT gene, tx, a, b, 'ex' AS kind, p AS from_pos, q AS to_pos FROM gs UNION ALL SELECT gene, tx, b, na, 'in', q, np FROM gs WHERE na IS NOT NULL
  UNION ALL SELECT gene, tx, 0, a, 'R', NULL, p FROM gs WHERE k = 1 UNION ALL SELECT s.gene, s.tx, s.b, l.leaf, 'L', s.q, NULL FROM gs s JOIN gl l ON l.gene = s.gene WHERE s.na IS NULL),
gd AS (SELECT gene, a, b, kind, from_pos, to_pos, count(*)::INT AS n_txs FROM ge GROUP BY ALL),
gp AS (SELECT c.gene, c.lo, c.hi, row_number() OVER (PARTITION BY c.gene ORDER BY c.lo)::INT AS part FROM (SELECT gene, pos AS lo, lead(pos) OVER (PARTITION BY gene ORDER BY pos) AS hi FROM gn) c
  WHERE c.hi IS NOT NULL AND EXISTS (SELECT 1 FROM v_chains v WHERE v.gene = c.gene AND v."start" <= c.lo AND v."end" + 1 >= c.hi)),
gt AS (SELECT DISTINCT p.gene, p.part, p.lo, p.hi, v.tx FROM gp p JOIN v_chains v ON v.gene = p.gene AND v."start" <= p.lo AND v."end" + 1 >= p.hi),
gk AS (SELECT p.gene, p.part, p.lo, p.hi, least(a.node, b.node) AS a, greatest(a.node, b.node) AS b FROM gp p JOIN gn a ON a.gene = p.gene AND a.pos = p.lo JOIN gn b ON b.gene = p.gene AND b.pos = p.hi)"""

_G = "WITH " + duck("v_chains") + "," + EDGES

#: Parts of all genes of a strand, and what a gene's own exons cover.
_PARTS = "WITH RECURSIVE " + duck("v_chains") + """,
cuts AS (SELECT chrom, strand, "start" AS x FROM v_chains UNION SELECT chrom, strand, "end" + 1 FROM v_chains),
stp AS (SELECT *, lead(x) OVER (PARTITION BY chrom, strand ORDER BY x) - 1 AS y FROM cuts),
covered AS (SELECT p.chrom, p.strand, p.x, p.y, list(DISTINCT e.gene::VARCHAR ORDER BY e.gene::VARCHAR) AS genes, count(DISTINCT e.tx)::INT AS n_txs FROM stp p JOIN v_chains e ON p.chrom = e.chrom AND p.strand = e.strand AND e."start" <= p.x AND e."end" >= p.y
  WHERE p.y IS NOT NULL GROUP BY p.chrom, p.strand, p.x, p.y)"""
_NUMBERED = """
SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY x, y)::INT AS part, chrom, strand, x AS "start", y AS "end", n_txs, min(x) OVER (PARTITION BY gene) AS gene_start, max(y) OVER (PARTITION BY gene) AS gene_end FROM named"""

#: All exons and introns between the nodes that follow each other along a transcript.
_WALK = """
chain AS (SELECT gene, tx AS path_id, a, b, (row_number() OVER (PARTITION BY gene, tx ORDER BY a, b) - 1)::INT AS pos FROM ge WHERE kind IN ('ex', 'in')),
wk AS (SELECT c.gene, c.path_id, c.a, c.b, d.kind, c.pos FROM chain c JOIN gd d ON d.gene = c.gene AND d.a = c.a AND d.b = c.b)"""

_INTRON = """
intron AS (SELECT gene, a, b, 'c' || gene % 5 AS chrom, least(from_pos, to_pos) AS lo, greatest(from_pos, to_pos) AS hi, tx FROM ge WHERE kind = 'in'),
nodes AS (SELECT DISTINCT gene, tx, unnest([a, b]) AS node FROM ge WHERE kind IN ('ex', 'in')),
others AS (SELECT gene, count(DISTINCT tx) AS n FROM nodes GROUP BY gene),
inside AS (SELECT n.gene, n.tx AS event, i.chrom, i.lo, i.hi, bool_or(i.tx = n.tx) AS one, bool_or(i.tx <> n.tx) AS two FROM nodes n JOIN intron i ON i.gene = n.gene AND i.a = n.node JOIN nodes m ON m.gene = n.gene AND m.tx = n.tx AND m.node = i.b GROUP BY ALL),
role AS (SELECT gene, event, chrom, lo, hi, CASE WHEN one AND two THEN 'ref' WHEN one THEN 'diff1' ELSE 'diff2' END AS role FROM inside)"""

_JUNCTIONS = _INTRON + """,
matrix AS (SELECT chrom, lo, hi, (tx % 4)::INT AS sample, sum(tx % 3)::BIGINT AS cnt FROM intron GROUP BY ALL),
have AS (SELECT gene, event, bool_or(role = 'diff1') AS has1, bool_or(role = 'diff2') AS has2 FROM role GROUP BY gene, event HAVING bool_or(role <> 'ref')),
want AS (SELECT gene, event, role, chrom, lo, hi FROM role UNION SELECT gene, event, role, chrom, lo, hi - 1 FROM role),
sums AS (SELECT w.gene, w.event, m.sample, sum(m.cnt) FILTER (WHERE w.role = 'ref') AS ref, sum(m.cnt) FILTER (WHERE w.role = 'diff1') AS diff1, sum(m.cnt) FILTER (WHERE w.role = 'diff2') AS diff2
  FROM want w JOIN matrix m ON m.chrom = w.chrom AND m.lo = w.lo AND m.hi = w.hi GROUP BY ALL),
wide AS (SELECT e.gene, e.event, p.sample, 'g' AS grp, coalesce(s.ref, 0)::BIGINT AS ref, CASE WHEN e.has1 THEN coalesce(s.diff1, 0)::BIGINT END AS diff1, CASE WHEN e.has2 THEN coalesce(s.diff2, 0)::BIGINT END AS diff2
  FROM have e CROSS JOIN (SELECT DISTINCT sample FROM matrix) p LEFT JOIN sums s ON s.gene = e.gene AND s.event = e.event AND s.sample = p.sample)"""

_EVENTS = """
xe AS (SELECT * FROM gd WHERE kind = 'ex'), xi AS (SELECT * FROM gd WHERE kind = 'in'),
evs AS (
  SELECT x.gene, 'SE_' || x.gene || '_' || x.a || '_' || x.b AS event_id, 'SE' AS etype, least(arg_max(i.from_pos, i.a), arg_min(o.to_pos, o.b)) AS b1, greatest(arg_max(i.from_pos, i.a), arg_min(o.to_pos, o.b)) AS b2,
    least(x.from_pos, x.to_pos) AS alt_low, greatest(x.from_pos, x.to_pos) AS alt_hi FROM xe x JOIN xi i ON i.gene = x.gene AND i.b = x.a JOIN xi o ON o.gene = x.gene AND o.a = x.b GROUP BY x.gene, x.a, x.b, x.from_pos, x.to_pos
  UNION ALL SELECT DISTINCT i.gene, 'RI_' || i.gene || '_' || i.a || '_' || i.b, 'RI', least(i.from_pos, i.to_pos), greatest(i.from_pos, i.to_pos), least(i.from_pos, i.to_pos), greatest(i.from_pos, i.to_pos)
    FROM xi i JOIN xe x ON x.gene = i.gene AND x.a < i.a AND i.b < x.b
  UNION ALL SELECT l.gene, 'A3SS_' || l.gene || '_' || f.a || '_' || l.a || '_' || s.a || '_' || l.b, 'A3SS', f.from_pos, l.to_pos, least(l.from_pos, s.from_pos), greatest(l.from_pos, s.from_pos)
    FROM xe l JOIN xe s ON s.gene = l.gene AND s.b = l.b AND l.a < s.a JOIN xi f ON f.gene = l.gene AND f.b = l.a JOIN xi g ON g.gene = l.gene AND g.b = s.a AND g.a = f.a
  UNION ALL SELECT l.gene, 'A5SS_' || l.gene || '_' || l.a || '_' || s.b || '_' || l.b || '_' || f.b, 'A5SS', l.from_pos, f.to_pos, least(l.to_pos, s.to_pos), greatest(l.to_pos, s.to_pos)
    FROM xe l JOIN xe s ON s.gene = l.gene AND s.a = l.a AND s.b < l.b JOIN xi f ON f.gene = l.gene AND f.a = l.b JOIN xi g ON g.gene = l.gene AND g.a = s.b AND g.b = f.b),
ends AS (SELECT DISTINCT gene, unnest([from_pos, to_pos]) AS pos, tx FROM ge WHERE kind IN ('ex', 'in')),
loc AS (SELECT e.gene, e.event_id, x.tx FROM evs e JOIN ends x ON x.gene = e.gene AND x.pos = e.b1 JOIN ends y ON y.gene = e.gene AND y.pos = e.b2 AND y.tx = x.tx),
own AS (SELECT l.event_id, t.part, l.tx FROM loc l JOIN evs e ON e.event_id = l.event_id JOIN gt t ON t.gene = e.gene AND t.tx = l.tx AND t.lo >= e.alt_low AND t.hi <= e.alt_hi),
told AS (SELECT n.event_id FROM (SELECT event_id, count(*) AS n FROM loc GROUP BY event_id) n JOIN (SELECT event_id, count(DISTINCT tx) AS m FROM own GROUP BY event_id) m ON m.event_id = n.event_id AND m.m < n.n),
mapped AS (SELECT e.gene, e.event_id, e.etype, p.parts FROM evs e LEFT JOIN (SELECT event_id, list(DISTINCT part ORDER BY part) AS parts FROM own WHERE event_id IN (SELECT event_id FROM told) GROUP BY event_id) p ON p.event_id = e.event_id)"""


#: Splits of the graphs' bubbles (root 0, leaf 11), numbered; sp has the positions on the paths of the first side and of all others.
_CHAIN_WAYS = "cn AS (SELECT gene, tx, a AS node FROM ge UNION SELECT gene, tx, CASE WHEN kind = 'L' THEN 11 ELSE b END FROM ge)," + (WAYS + "," + BUBBLES + "," + PRUNED).replace("v_tx_nodes", "cn")
_NUMBERED_SIDES = MASKS + "," + SIDES + """,
keyed AS (SELECT *, CASE WHEN none1 THEN [-1] ELSE diff1 END AS k1, CASE WHEN none2 THEN [-1] ELSE diff2 END AS k2, list_min([list_min([abs(x - y) FOR y IN list_concat(diff1, diff2)]) FOR x IN ref]) AS near FROM split),
firsts AS (SELECT *, row_number() OVER (PARTITION BY gene, k1, k2 ORDER BY len(ref), coalesce(near, 1000000), snk - src, src, id) AS f FROM keyed),
numbered AS (SELECT gene, src, snk, id, diff1, diff2, ref, row_number() OVER (PARTITION BY gene ORDER BY k1, k2)::INT AS event FROM firsts WHERE f = 1),
way AS (SELECT n.gene, n.event, n.src, n.snk, p.first, v.inn FROM numbered n JOIN placed p ON p.gene = n.gene AND p.src = n.src AND p.snk = n.snk AND p.id = n.id JOIN bvar v ON v.gene = n.gene AND v.src = n.src AND v.snk = n.snk AND v.i = p.i)"""
_NUMBERED_MULTI = MULTI + """,
whole AS (SELECT gene, src, snk, list(diff ORDER BY i) AS diffs FROM each GROUP BY gene, src, snk HAVING bool_and(n_parts = 0 OR len(diff) > 0)),
numbered AS (SELECT w.gene, w.src, w.snk, w.diffs[1] AS diff1, w.diffs[2] AS diff2, coalesce(r.ref, []) AS ref, row_number() OVER (PARTITION BY w.gene ORDER BY w.src, w.snk)::INT AS event FROM whole w LEFT JOIN mref r ON r.gene = w.gene AND r.src = w.src AND r.snk = w.snk),
way AS (SELECT n.gene, n.event, n.src, n.snk, v.i = 1 AS first, v.inn FROM numbered n JOIN bvar v ON v.gene = n.gene AND v.src = n.src AND v.snk = n.snk)"""
_MATCH = """,
stp AS (SELECT a.gene, a.node AS part, least(a.pos, b.pos) AS low, greatest(a.pos, b.pos) AS high FROM gn a JOIN gn b ON b.gene = a.gene AND b.node = a.node + 1),
sp AS (SELECT w.gene, w.event, list(DISTINCT n.pos) FILTER (WHERE w.first) AS pos1, list(DISTINCT n.pos) FILTER (WHERE NOT w.first) AS pos2 FROM (SELECT gene, event, first, unnest(list_concat([src, snk], inn)) AS node FROM way) w JOIN gn n ON n.gene = w.gene AND n.node = w.node GROUP BY w.gene, w.event),
sd AS (SELECT gene, event, 1 AS side, diff1 AS parts FROM numbered UNION ALL SELECT gene, event, 2, diff2 FROM numbered),
reach AS (SELECT d.gene, d.event, d.side, min(s.low) AS alt_low, max(s.high) AS alt_hi FROM (SELECT gene, event, side, unnest(parts) AS part FROM sd) d JOIN stp s ON s.gene = d.gene AND s.part = d.part GROUP BY ALL),
fl AS (SELECT d.gene, d.event, min(s.low) AS first_low, arg_min(s.high, s.low) AS first_high, max(s.low) AS last_low, arg_max(s.high, s.low) AS last_high FROM (SELECT gene, event, unnest(ref) AS part FROM numbered) d JOIN stp s ON s.gene = d.gene AND s.part = d.part GROUP BY ALL),
ev AS (SELECT gene, event_id, etype, b1, b2, alt_low, alt_hi, b1 AS e1, b2 AS e2 FROM evs WHERE etype <> 'RI'
  UNION ALL SELECT DISTINCT i.gene, 'RI_' || i.gene || '_' || i.a || '_' || i.b || '_' || x.a || '_' || x.b, 'RI', least(i.from_pos, i.to_pos), greatest(i.from_pos, i.to_pos), least(i.from_pos, i.to_pos), greatest(i.from_pos, i.to_pos), least(x.from_pos, x.to_pos), greatest(x.from_pos, x.to_pos)
    FROM xi i JOIN xe x ON x.gene = i.gene AND x.a < i.a AND i.b < x.b),
met AS (SELECT e.*, r.event, r.side, sp.pos1, sp.pos2, n.diff1, n.diff2, n.ref, CASE WHEN etype IN ('SE', 'RI') THEN [e.alt_low, e.alt_hi] WHEN (etype = 'A3SS') = (e.gene % 2 = 0) THEN [e.alt_low] ELSE [e.alt_hi] END AS own,
    coalesce(a.pos IN (e.e1, e.e2), false) AND coalesce(z.pos IN (e.e1, e.e2), false) AS exact
  FROM ev e JOIN reach r ON r.gene = e.gene AND r.alt_low = e.alt_low AND r.alt_hi = e.alt_hi JOIN numbered n ON n.gene = r.gene AND n.event = r.event LEFT JOIN fl f ON f.gene = r.gene AND f.event = r.event JOIN sp ON sp.gene = r.gene AND sp.event = r.event
    LEFT JOIN gn a ON a.gene = n.gene AND a.node = n.src LEFT JOIN gn z ON z.gene = n.gene AND z.node = n.snk
  WHERE CASE etype WHEN 'SE' THEN f.first_high = e.b1 AND f.last_low = e.b2 WHEN 'RI' THEN f.first_low = e.e1 AND f.last_high = e.e2
    WHEN 'A3SS' THEN CASE WHEN e.gene % 2 = 0 THEN f.first_high ELSE f.last_low END = e.b1 ELSE CASE WHEN e.gene % 2 = 0 THEN f.last_low ELSE f.first_high END = e.b2 END),
one AS (SELECT * FROM (SELECT *, count(DISTINCT event) OVER (PARTITION BY gene, event_id) AS n FROM met) WHERE n = 1 OR exact),
two AS (SELECT * FROM (SELECT * EXCLUDE (n), count(DISTINCT event) OVER (PARTITION BY gene, event_id) AS m FROM one) WHERE m = 1 OR list_has_all(pos1, own) AND NOT list_has_any(pos2, own) OR list_has_all(pos2, own) AND NOT list_has_any(pos1, own)),
matched AS (SELECT *, list_sort(list_distinct(list_concat(diff1, diff2))) AS diffs FROM (SELECT *, row_number() OVER (PARTITION BY gene, event_id ORDER BY event, side) AS k FROM two) WHERE k = 1)"""
_SITES = _EVENTS[: _EVENTS.index("ends AS (")].rstrip().rstrip(",")
_MATCHED = {kind: _G + "," + _CHAIN_WAYS + "," + numbered + "," + _SITES.strip() + _MATCH for kind, numbered in (("bipartition", _NUMBERED_SIDES), ("multinomial", _NUMBERED_MULTI))}


def _labels(column: str) -> str:
    return f"array_to_string([('E' || lpad(x::VARCHAR, 3, '0')) FOR x IN {column}], ',')"


_names = "string_agg(chrom || ':' || lo || ':' || hi, ',' ORDER BY lo, hi) FILTER (WHERE role = '{0}') AS {0}"

GRAPH = {
    "exonic_parts": _PARTS + ", named AS (SELECT *, genes[1] AS gene FROM covered WHERE len(genes) = 1)" + _NUMBERED,
    "exonic_parts_merged": _PARTS + """,
met AS (SELECT DISTINCT a, b FROM (SELECT unnest(genes) AS a, genes FROM covered), unnest(genes) AS u(b)),
reach AS (SELECT a, b FROM met UNION SELECT r.a, m.b FROM reach r JOIN met m ON r.b = m.a),
names AS (SELECT a, string_agg(b, '+' ORDER BY b) AS gene FROM reach GROUP BY a),
named AS (SELECT c.*, n.gene FROM covered c JOIN names n ON n.a = c.genes[1])""" + _NUMBERED,
    "biotype_counts": "WITH RECURSIVE " + duck("v_chains") + "," + EDGES + """,
met AS (SELECT DISTINCT a.gene AS a, b.gene AS b FROM v_chains a JOIN v_chains b ON a.chrom = b.chrom AND a.strand = b.strand AND a."start" <= b."end" AND b."start" <= a."end" AND a.gene <> b.gene),
reach AS (SELECT a, b FROM met UNION SELECT r.a, m.b FROM reach r JOIN met m ON r.b = m.a),
lab AS (SELECT a AS gene, least(a, min(b)) AS label FROM reach GROUP BY a), n AS (SELECT gene, count(*) AS n_parts FROM gp GROUP BY gene),
kinds AS (SELECT c_custkey AS gene, CASE WHEN c_nationkey % 3 = 0 THEN 'protein_coding' ELSE 'kind' || c_nationkey % 5 END AS biotype FROM customer WHERE c_nationkey < 20),
r AS (SELECT l.gene, coalesce(k.biotype, 'unknown') AS biotype, row_number() OVER (PARTITION BY l.label ORDER BY (coalesce(k.biotype, 'unknown') = 'protein_coding') DESC, n.n_parts DESC, l.gene) AS i FROM lab l LEFT JOIN n ON n.gene = l.gene LEFT JOIN kinds k ON k.gene = l.gene)
SELECT biotype, count(*) AS n_genes, count(*) FILTER (WHERE i = 1) AS n_kept FROM r GROUP BY biotype""",
    "several_transcripts": "WITH " + duck("v_chains") + " SELECT * FROM v_chains WHERE gene IN (SELECT gene FROM v_chains GROUP BY gene HAVING count(DISTINCT tx) >= 12)",
    "pair_counting": _G + """,
mate AS (SELECT tx, chrom AS c, strand, "start" AS s, (("end" - "start" + 1) // 2)::INT AS h, "start" = min("start") OVER (PARTITION BY tx) AS first FROM v_chains WHERE tx % 19 <> 0),
blk AS (SELECT tx, strand, CASE WHEN tx % 13 = 0 AND NOT first THEN 'other' ELSE c END AS chrom, unnest([s, s + h + 2]) AS x, unnest([s + h - 1, s + 2 * h - 1]) AS y FROM mate),
unit AS (SELECT tx, CASE WHEN tx % 11 = 0 THEN '_notaligned' WHEN count(DISTINCT chrom) > 1 THEN '_ambiguous_readpair_position' WHEN tx % 17 + 5 < 10 THEN '_lowaqual' END AS sp FROM blk GROUP BY tx),
hit AS (SELECT DISTINCT b.tx, p.gene, p.part FROM blk b JOIN unit u ON u.tx = b.tx AND u.sp IS NULL JOIN gp p ON b.x < p.hi AND p.lo <= b.y JOIN (SELECT DISTINCT gene, chrom, strand FROM v_chains) g ON g.gene = p.gene AND g.chrom = b.chrom AND g.strand = b.strand),
genes AS (SELECT tx, count(DISTINCT gene) AS g FROM hit GROUP BY tx),
named AS (SELECT u.tx, coalesce(u.sp, CASE WHEN g.g IS NULL THEN '_empty' WHEN g.g > 1 THEN '_ambiguous' END) AS special FROM unit u LEFT JOIN genes g ON g.tx = u.tx),
c AS (SELECT h.gene, h.part, count(*) AS cnt FROM hit h JOIN named n ON n.tx = h.tx AND n.special IS NULL GROUP BY h.gene, h.part)
SELECT p.gene, p.part, NULL::VARCHAR AS special, coalesce(c.cnt, 0) AS cnt FROM gp p LEFT JOIN c ON c.gene = p.gene AND c.part = p.part UNION ALL SELECT NULL, NULL, special, count(*) FROM named WHERE special IS NOT NULL GROUP BY special""",
    "graph_edges": _G + " SELECT gene, a, b, kind, from_pos, to_pos, a || '-' || b || ':' || kind AS name, n_txs FROM gd",
    "graph_parts": _G + """
SELECT k.gene, k.a, k.b, k.part, CASE WHEN k.gene % 2 = 0 THEN k.lo ELSE k.hi END AS from_pos, CASE WHEN k.gene % 2 = 0 THEN k.hi ELSE k.lo END AS to_pos, count(*)::INT AS n_txs FROM gk k JOIN gt t ON t.gene = k.gene AND t.part = k.part GROUP BY ALL""",
    "graph_transcripts": "WITH " + duck("v_chains") + " SELECT DISTINCT gene, tx FROM v_chains",
    "graph_tx_nodes": _G + " SELECT DISTINCT gene, tx, unnest([a, b]) AS node FROM ge",
    "graph_tx_paths": _G + f""",
n AS (SELECT gene, tx, list(DISTINCT node ORDER BY node) AS nodes FROM (SELECT gene, tx, unnest([a, b]) AS node FROM ge) GROUP BY gene, tx), s AS (SELECT gene, tx, unnest(range(a, b)) AS part FROM ge WHERE kind = 'ex')
SELECT n.gene, n.tx, array_to_string(n.nodes, ',') AS nodes, {_labels('s.parts')} AS parts FROM n JOIN (SELECT gene, tx, list(part ORDER BY part) AS parts FROM s GROUP BY gene, tx) s ON s.gene = n.gene AND s.tx = n.tx""",
    "graph_part_steps": _G + " SELECT gene, unnest(range(a, b))::INT AS step, part FROM gk",
    "graph_node_types": _G + """,
t AS (SELECT gene, a AS node, 1 AS t FROM gd WHERE kind = 'ex' UNION ALL SELECT gene, b, 2 FROM gd WHERE kind = 'ex')
SELECT gene, node, max(t)::INT AS type, min(t) <> max(t) AS conflict FROM t GROUP BY gene, node UNION ALL SELECT gene, 0, 0, false FROM gl UNION ALL SELECT gene, leaf, 0, false FROM gl""",
    "graph_node_paths": _G + """,
m AS (SELECT gene, tx, list(DISTINCT node ORDER BY node) AS nodes FROM (SELECT gene, tx, unnest([a, b]) AS node FROM ge WHERE kind = 'in' UNION ALL SELECT k.gene, t.tx, unnest([k.a, k.b]) FROM gk k JOIN gt t ON t.gene = k.gene AND t.part = k.part) GROUP BY gene, tx)
SELECT m.gene, m.tx, w.nodes, array_to_string(m.nodes, ',') AS part_nodes FROM m JOIN (SELECT gene, tx, array_to_string(list(DISTINCT node ORDER BY node), ',') AS nodes FROM (SELECT gene, tx, unnest([a, b]) AS node FROM ge WHERE kind IN ('ex', 'in')) GROUP BY gene, tx) w ON w.gene = m.gene AND w.tx = m.tx""",
    "walk_edges": _G + "," + _WALK + " SELECT gene, path_id, pos, a, b, kind FROM wk",
    "walk_parts": _G + "," + _WALK + """
SELECT w.gene, w.path_id, w.pos, k.a AS pa, k.part, w.kind FROM wk w JOIN gk k ON k.gene = w.gene AND k.a >= w.a AND k.b <= w.b WHERE w.kind = 'ex' UNION ALL SELECT gene, path_id, pos, a, NULL, kind FROM wk WHERE kind <> 'ex'""",
    "walk_users": _G + "," + _WALK + """
SELECT gene, path_id, string_agg(tx::VARCHAR, ',' ORDER BY tx) AS txs FROM (SELECT DISTINCT w.gene, w.path_id, e.tx FROM wk w JOIN ge e ON e.gene = w.gene AND e.a = w.a AND e.b = w.b AND e.kind = w.kind) GROUP BY gene, path_id""",
    "path_containment": _G + """,
s AS (SELECT gene, tx, list(part) AS parts FROM (SELECT gene, tx, unnest(range(a, b)) AS part FROM ge WHERE kind = 'ex') GROUP BY gene, tx)
SELECT x.gene, x.tx AS small, y.tx AS large FROM s x JOIN s y ON y.gene = x.gene WHERE len(x.parts) < len(y.parts) AND list_has_all(y.parts, x.parts)""",
    "intron_labels": _G + "," + _INTRON + f"""
SELECT n.gene, n.event, r.diff1, r.diff2, r.ref FROM (SELECT DISTINCT gene, tx AS event FROM nodes) n LEFT JOIN (SELECT gene, event, {_names.format('diff1')}, {_names.format('diff2')}, {_names.format('ref')} FROM role GROUP BY gene, event) r ON r.gene = n.gene AND r.event = n.event""",
    "junction_bipartition": _G + "," + _JUNCTIONS + " SELECT * FROM wide",
    "junction_unpivot": _G + "," + _JUNCTIONS + "".join(f"{' UNION ALL' if i else ''} SELECT gene, event, sample, grp, '{c}' AS type, {c} AS cnt FROM wide" for i, c in enumerate(("ref", "diff1", "diff2"))),
    "map_events": _G + "," + _EVENTS + f" SELECT gene, event_id, etype, {_labels('parts')} AS parts FROM mapped",
    "map_coverage": _G + "," + _EVENTS + " SELECT etype, count(*) AS n_events, count(parts) AS n_mapped FROM mapped GROUP BY etype",
    "part_to_events": _G + "," + _EVENTS + " SELECT gene, part, string_agg(event_id, ',' ORDER BY event_id) AS event_ids FROM (SELECT gene, event_id, unnest(parts) AS part FROM mapped) GROUP BY gene, part",
    "event_to_parts": _G + "," + _EVENTS + f"""
SELECT gene, event_id, {_labels('list_sort(list(DISTINCT part))')} AS parts FROM (SELECT gene, regexp_replace(event_id, '^[^_]+_', '') AS event_id, unnest(parts) AS part FROM mapped) GROUP BY gene, event_id""",
    "source_exons": "WITH " + duck("v_chains") + " SELECT gene::VARCHAR AS gene, tx::VARCHAR AS tx, chrom, strand, \"start\", \"end\" FROM v_chains WHERE chrom IN ('c0', 'c1', 'c3')",
    "source_parts": _G + """
SELECT p.gene, p.part, 'c' || p.gene % 5 AS gene_chrom, CASE WHEN p.gene % 2 = 0 THEN '+' ELSE '-' END AS strand, p.lo AS "start", p.hi - 1 AS "end", count(*)::INT AS n_txs FROM gp p JOIN gt t ON t.gene = p.gene AND t.part = p.part GROUP BY ALL""",
    "source_counts": "WITH " + duck("v_counts") + " SELECT gene, part, grp || '_m' || sample AS sample, grp, cnt FROM v_counts",
    "source_alignments": "WITH " + duck("v_chains") + """
SELECT tx::VARCHAR AS "read", CASE WHEN strand = '+' THEN 0 ELSE 16 END AS flag, chrom, "start" AS pos, 60 AS mapq, CASE WHEN tx % 2 = 0 THEN 1 END AS nh, unnest(["start", "start" + 5]) AS "start", unnest(["start" + 2, "start" + 8]) AS "end" FROM v_chains""",
    "source_events": "WITH " + duck("v_exons") + """,
e AS (SELECT list_extract(['SE', 'RI', 'A3SS', 'A5SS'], (tx % 4 + 1)::INT) AS etype, (tx * 10 + "start" % 10)::VARCHAR AS id, gene::VARCHAR AS g FROM v_exons) SELECT etype || '_' || id AS event_id, etype, g AS GeneID, CASE WHEN etype = 'RI' THEN g END AS onlyRI FROM e""",
    "sink_tables": "WITH " + duck("v_counts") + " SELECT grp, sample, sum(cnt)::BIGINT AS cnt, count(*) AS n, sum(cnt)::BIGINT AS text_cnt FROM v_counts GROUP BY grp, sample",
}
GRAPH |= {f"match_{kind}": text + f" SELECT gene, event_id, etype, event, side, {_labels('diffs')} AS parts, {_labels('list_sort(ref)')} AS ref_parts FROM matched" for kind, text in _MATCHED.items()}
GRAPH["match_maps"] = _MATCHED["bipartition"] + """,
uses AS (SELECT gene, etype, event_id, unnest(diffs) AS step, false AS is_ref FROM matched UNION ALL SELECT gene, etype, event_id, unnest(ref), true FROM matched),
numbers AS (SELECT gene, unnest(range(a, b)) AS step, part FROM gk)
SELECT u.gene, n.part, u.etype, string_agg(event_id, ',' ORDER BY event_id) FILTER (WHERE NOT is_ref) AS event_ids, string_agg(event_id, ',' ORDER BY event_id) FILTER (WHERE is_ref) AS ref_event_ids
FROM (SELECT DISTINCT * FROM uses) u JOIN numbers n ON n.gene = u.gene AND n.step = u.step GROUP BY u.gene, n.part, u.etype"""
