"""Tables of the model made from the test tables; each is one SQL text, read by Spark and by DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROOT, LEAF = 0, 11
TABLES = ("orders", "lineitem", "part", "supplier", "customer")

#: name -> SQL over {tables} and earlier {views}; {days} is the number of days since 1992-01-01.
VIEWS = {
    "v_tx_nodes": """
SELECT DISTINCT o.o_custkey AS gene, o.o_orderkey AS tx, CAST(l.l_partkey % 10 + 1 AS INT) AS node FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey
UNION ALL SELECT DISTINCT o.o_custkey, o.o_orderkey, 0 FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey
UNION ALL SELECT DISTINCT o.o_custkey, o.o_orderkey, 11 FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey""",
    "v_chains": """
SELECT gene, tx, 'c' || CAST(gene % 5 AS STRING) AS chrom, CASE WHEN gene % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CAST(place + CASE WHEN gene % 2 = 0 THEN a * 10 + 1 ELSE 121 - b * 10 END AS INT) AS start, CAST(place + CASE WHEN gene % 2 = 0 THEN b * 10 ELSE 120 - a * 10 END AS INT) AS "end"
FROM (SELECT gene, tx, floor(gene / 10) * 90 + floor(gene / 30) * 200 AS place, node AS a, lead(node) OVER (PARTITION BY gene, tx ORDER BY node) AS b,
  row_number() OVER (PARTITION BY gene, tx ORDER BY node) AS k FROM {v_tx_nodes} WHERE node > 0) w WHERE k % 2 = 1 AND b IS NOT NULL""",
    "v_counts": """
SELECT l_suppkey AS gene, CAST(l_linenumber AS INT) AS part, CAST(month(l_shipdate) AS INT) AS sample, CASE WHEN month(l_shipdate) <= 6 THEN 'g1' ELSE 'g2' END AS grp,
  CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS cnt FROM {lineitem} GROUP BY l_suppkey, l_linenumber, month(l_shipdate), CASE WHEN month(l_shipdate) <= 6 THEN 'g1' ELSE 'g2' END""",
    "v_exons": """
SELECT DISTINCT l_suppkey AS gene, l_orderkey AS tx, l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
  CAST({days} AS INT) AS start, CAST({days} + CAST(l_quantity AS INT) AS INT) AS "end" FROM {lineitem}""",
    "v_splits": """
SELECT DISTINCT l_suppkey AS gene, 1 AS event, array(1, 2) AS ref, array(3) AS diff1, array(4) AS diff2 FROM {lineitem}
UNION ALL SELECT DISTINCT l_suppkey, 2, array(1), array(2, 5), array(6, 7) FROM {lineitem}
UNION ALL SELECT DISTINCT l_suppkey, 3, array(4), array(5), NULL FROM {lineitem}""",
    "v_events": """
SELECT c.gene, s.event, c.sample, c.grp,
  CAST(sum(CASE WHEN s.event = 1 AND c.part IN (1, 2) OR s.event = 2 AND c.part = 1 OR s.event = 3 AND c.part = 4 THEN c.cnt ELSE 0 END) AS BIGINT) AS ref,
  CAST(sum(CASE WHEN s.event = 1 AND c.part = 3 OR s.event = 2 AND c.part IN (2, 5) OR s.event = 3 AND c.part = 5 THEN c.cnt ELSE 0 END) AS BIGINT) AS diff1,
  CASE WHEN s.event < 3 THEN CAST(sum(CASE WHEN s.event = 1 AND c.part = 4 OR s.event = 2 AND c.part IN (6, 7) THEN c.cnt ELSE 0 END) AS BIGINT) END AS diff2
FROM {v_counts} c JOIN (SELECT 1 AS event UNION ALL SELECT 2 UNION ALL SELECT 3) s ON c.part >= s.event - 3 GROUP BY c.gene, s.event, c.sample, c.grp""",
    "v_comparisons": """
SELECT gene, event, 'diff1_vs_ref' AS comparison, sample, grp, diff1 AS diff, ref, diff1 + ref AS n, diff1 AS y FROM {v_events} WHERE diff1 IS NOT NULL
UNION ALL SELECT gene, event, 'diff2_vs_ref', sample, grp, diff2, ref, diff2 + ref, diff2 FROM {v_events} WHERE diff2 IS NOT NULL""",
    "v_results": """
SELECT gene, event, comparison, 'g2:g1' AS contrast, base_mean AS baseMean, delta_pi, exp(-20 * abs(delta_pi)) AS pvalue, event % 7 AS part FROM (
  SELECT gene, event, comparison, avg(CAST(n AS DOUBLE)) AS base_mean,
    sum(CASE WHEN grp = 'g2' THEN CAST(diff AS DOUBLE) ELSE 0.0 END) / nullif(sum(CASE WHEN grp = 'g2' THEN CAST(n AS DOUBLE) ELSE 0.0 END), 0.0)
    - sum(CASE WHEN grp = 'g1' THEN CAST(diff AS DOUBLE) ELSE 0.0 END) / nullif(sum(CASE WHEN grp = 'g1' THEN CAST(n AS DOUBLE) ELSE 0.0 END), 0.0) AS delta_pi
  FROM {v_comparisons} GROUP BY gene, event, comparison) r""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder."""
    text = VIEWS[name].replace('"end"', "`end`").replace("{days}", "datediff(l_shipdate, DATE '1992-01-01')")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    used |= {v: view(spark, sf_dir, v) for v in VIEWS if f"{{{v}}}" in text}
    return spark.sql(text, **used)


def duck(*names: str) -> str:
    """The views as common table expressions of DuckDB, without WITH."""
    needed: list[str] = []

    def add(name: str) -> None:
        for v in VIEWS:
            if f"{{{v}}}" in VIEWS[name]:
                add(v)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    fill = {t: t for t in (*TABLES, *VIEWS)} | {"days": "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"}
    return ",\n".join(f"{n} AS ({VIEWS[n].format(**fill).replace('array(', 'list_value(')})" for n in needed)
