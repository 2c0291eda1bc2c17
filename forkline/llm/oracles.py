"""SQL for DuckDB of those queries that SQL can express over whole tables."""

from __future__ import annotations

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, {_SPACES}), {_AZ}) AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.top AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP9 = f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(translate(coalesce(text, ''), {_SPACES}, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size FROM t GROUP BY text_sha256),
k AS (SELECT text_sha256, doc_id AS keep_id FROM (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS r FROM t) WHERE r = 1)
SELECT t.doc_id, k.keep_id, g.group_size, t.doc_id = k.keep_id AS kept, t.text_sha256
FROM t JOIN g ON t.text_sha256 = g.text_sha256 JOIN k ON t.text_sha256 = k.text_sha256"""

OP10 = f"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), {_AZ}) AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) v(verdict, rhost, rpath)),
own AS (SELECT * FROM (
  SELECT u.page_id, u.url, u.host, u.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id, u.url ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC, r.verdict) AS k
  FROM u LEFT JOIN rules r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)) WHERE k = 1),
tags AS (SELECT url AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)[ \\t\\r\\n][^>]*>')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
targets AS (SELECT a, CASE
    WHEN regexp_matches(tag, '(?is)rel\\s*=\\s*["'']?\\s*canonical') THEN regexp_extract(tag, '(?is)href\\s*=\\s*["'']?\\s*([^"''>\\s]+)', 1)
    WHEN regexp_matches(tag, '(?is)http-equiv\\s*=\\s*["'']?\\s*refresh') THEN regexp_extract(tag, '(?is)url\\s*=\\s*["'']?\\s*([^"''>\\s;]+)', 1) END AS b FROM tags),
links AS (SELECT a, b FROM targets WHERE b LIKE '%://%' AND a <> b UNION SELECT b, a FROM targets WHERE b LIKE '%://%' AND a <> b),
reach AS (SELECT DISTINCT a AS x, a AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
met AS (SELECT r.x, bool_or(o.verdict = 'allow') AS allowed, bool_or(o.verdict = 'block') AS blocked FROM reach r JOIN own o ON o.url = r.y GROUP BY r.x)
SELECT o.page_id, o.host, o.path, o.rule,
  coalesce(o.verdict, CASE WHEN coalesce(m.blocked, false) AND NOT coalesce(m.allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM own o LEFT JOIN met m ON m.x = o.url"""

OP8 = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
windows AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2)::BIGINT)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i AS pos, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT d.doc_id, d.w, s.n, unnest(range(1, greatest(len(d.w) - s.n + 2, 1)::BIGINT)) AS i FROM docs d, sizes s)),
hits AS (SELECT DISTINCT g.doc_id, g.pos, g.n, w.item_id FROM grams g JOIN windows w ON w.n = g.n AND w.win = g.win),
covered AS (SELECT DISTINCT doc_id, unnest(range(pos, (pos + n)::BIGINT)) AS pos FROM hits),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id),
n2 AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN n2 ON d.doc_id = n2.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id"""


def _share(children: str, parent: str, name: str) -> str:
    """Budgets of the children in a table with parent_budget, capacity and weight, as in mixing.share_out()."""
    by = f"PARTITION BY {parent} " if parent else ""
    return f"""(SELECT *, CASE WHEN is_full THEN capacity WHEN weight > 0 THEN
      (parent_budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({by}), 0.0)) * weight / sum(CASE WHEN NOT is_full THEN weight END) OVER ({by}) ELSE 0.0 END AS budget
  FROM (SELECT *, coalesce(capacity / weight <= (parent_budget - taken) / still, false) AS is_full FROM (
    SELECT *, coalesce(sum(capacity) OVER ({by}ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS taken,
      sum(weight) OVER ({by}ORDER BY capacity / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still FROM {children})))"""


OP4 = f"""
WITH rows_ AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE WHEN source = 'src0' THEN 'web' WHEN length(source) = 4 THEN 'forum' ELSE 'books' END AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens FROM rows_ GROUP BY domain, lang, source),
total AS (SELECT sum(tokens) AS parent_budget FROM leaves),
d0 AS (SELECT l.domain, sum(l.tokens) * 2 AS capacity, max(t.parent_budget) AS parent_budget,
  max(CASE l.domain WHEN 'web' THEN 0.5::DOUBLE WHEN 'forum' THEN 0.3::DOUBLE WHEN 'books' THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM leaves l, total t GROUP BY l.domain),
d1 AS (SELECT domain, budget FROM {_share("d0", "", "domain")}),
g0 AS (SELECT l.domain, l.lang, sum(l.tokens) * 2 AS capacity, max(d1.budget) AS parent_budget,
  max(CASE l.lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 2.0::DOUBLE WHEN 'fr' THEN 2.0::DOUBLE WHEN 'es' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM leaves l JOIN d1 ON l.domain = d1.domain GROUP BY l.domain, l.lang),
g1 AS (SELECT domain, lang, budget FROM {_share("g0", "domain", "lang")}),
s0 AS (SELECT l.domain, l.lang, l.source, l.tokens * 2 AS capacity, g1.budget AS parent_budget, 1.0::DOUBLE AS weight FROM leaves l JOIN g1 ON l.domain = g1.domain AND l.lang = g1.lang),
s1 AS (SELECT domain, lang, source, budget FROM {_share("s0", "domain, lang", "source")}),
plan AS (SELECT l.domain, l.lang, l.source, floor(floor(s1.budget) / l.tokens)::BIGINT AS whole, floor(s1.budget)::BIGINT % l.tokens::BIGINT AS rest
  FROM leaves l JOIN s1 ON l.domain = s1.domain AND l.lang = s1.lang AND l.source = s1.source WHERE floor(s1.budget) > 0 AND l.tokens > 0),
ordered AS (SELECT r.*, p.whole, p.rest, sum(r.n_tokens) OVER (PARTITION BY r.domain, r.lang, r.source
    ORDER BY md5('7:' || p.whole::VARCHAR || ':' || coalesce(r.doc_id::VARCHAR, '')), r.n_tokens RANGE UNBOUNDED PRECEDING) AS running
  FROM rows_ r JOIN plan p ON r.domain = p.domain AND r.lang = p.lang AND r.source = p.source)
SELECT doc_id, lang, source, n_tokens, domain, unnest(range(0, (whole + CASE WHEN rest > 0 AND running <= rest THEN 1 ELSE 0 END)::BIGINT))::INTEGER AS epoch FROM ordered"""


def _moment_rate(f: str, n: str) -> str:
    return f"({f} * alike + (1 - alike) * mean) / ({n} * alike + (1 - alike))"


OP11 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1)::BIGINT)) AS i FROM t)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) v(k) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS again FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT t.r, doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(lines.again, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines FROM t LEFT JOIN lines ON t.r = lines.r LEFT JOIN covered ON t.r = covered.r),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 10 * n_symbols > n_words AS symbols,
  word_chars < 3 * n_words OR word_chars > 10 * n_words AS word_length, 10 * n_dup_lines > 3 * n_lines AS lines FROM m),
each AS (SELECT r, host, unnest(['short', 'repeats', 'symbols', 'word_length', 'lines', 'any']) AS rule, unnest([short, repeats, symbols, word_length, lines, short OR repeats OR symbols OR word_length OR lines]) AS failed FROM f),
sums AS (SELECT host, rule, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE failed))::DOUBLE AS bad FROM each GROUP BY host, rule),
moments AS (SELECT rule, sum(bad) / sum(n) AS mean, sum(bad * bad / n) - sum(bad) / sum(n) * sum(bad) AS spread, count(*) - 1 AS free, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room FROM sums GROUP BY rule),
priors AS (SELECT rule, mean, CASE WHEN mean > 0 AND mean < 1 AND room > 0 THEN greatest(0.0, least(1.0, (spread / (mean * (1 - mean)) - free) / room)) ELSE 0.0 END AS alike FROM moments),
rates AS (SELECT host, s.rule, n, bad, {_moment_rate("bad", "n")} AS rate FROM sums s JOIN priors p ON s.rule = p.rule),
hosts AS (SELECT host, max(n)::BIGINT AS host_docs, (max(bad) FILTER (WHERE rule = 'any'))::BIGINT AS host_failures, bool_or(rule = 'any' AND rate >= 0.5) AS host_rejected,
  coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (WHERE rule <> 'any' AND rate >= 0.2), '') AS strict_rules FROM rates GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, host_docs, host_failures, host_rejected, strict_rules,
  NOT (short OR repeats) AND NOT host_rejected AND NOT (symbols AND contains(strict_rules, 'symbols')) AND NOT (word_length AND contains(strict_rules, 'word_length')) AND NOT (lines AND contains(strict_rules, 'lines')) AS kept
FROM f JOIN hosts h ON f.host IS NOT DISTINCT FROM h.host"""

#: The 256 remainders of crc32, and the unsigned crc32 of a text's UTF-8 bytes.
_CRC_TABLE = "table_ AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) ORDER BY b) AS crc FROM (SELECT unnest(range(256)) AS b))"


def _crc(text: str) -> str:
    h = f"hex(encode({text}))"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length({h}), 2), lambda i: ('0x' || substr({h}, (i + 1)::BIGINT, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, table_.crc[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"""


OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY doc_id, run),
hashed AS (SELECT run, k, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, table_ WHERE length(run) >= 5),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, count(DISTINCT other) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.root = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN forms ON walk.root = forms.word WHERE forms.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON f.word = e.word"""

OP13 = f"""
WITH {_CRC_TABLE},
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS said,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
plan AS (SELECT l.c, l.h, l.c - l.c % 20 AS source, least(l.h, coalesce(s.n, 0)) AS taken FROM (SELECT c, {_crc("c::VARCHAR")} % 4 AS h FROM lengths, table_) l LEFT JOIN lengths s ON l.c - l.c % 20 = s.c),
rebuilt AS (
  SELECT t.c, t.i - p.h + p.taken AS d, said, words FROM turns t JOIN plan p ON t.c = p.c WHERE t.i > p.h
  UNION ALL SELECT p.c, t.i, said, words FROM turns t JOIN plan p ON t.c = p.source WHERE t.i <= p.taken),
paths AS (
  SELECT c, d, words, md5(string_agg(said, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS key FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM plan),
known AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS above, lead(key) OVER (PARTITION BY c ORDER BY d) IS NULL AS is_end FROM paths),
nodes AS (SELECT d, key, min(above) AS above, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE is_end) AS ends FROM known GROUP BY d, key),
kids AS (SELECT d - 1 AS d, above AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(k.n, 0) AS n_children, (n.n_convs - 1) * n.words AS saved FROM nodes n LEFT JOIN kids k ON n.d = k.d AND n.key = k.key),
totals AS (SELECT p.d, p.key, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves, sum(o.saved)::BIGINT AS saved_tokens FROM own o JOIN paths p ON p.c = o.conv_id AND p.d <= o.d GROUP BY p.d, p.key)
SELECT o.conv_id, o.d::BIGINT AS depth, a.conv_id AS parent_conv_id, o.n_convs, o.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(o.ends, '')) AS ends_sha256
FROM own o JOIN totals t ON o.d = t.d AND o.key = t.key LEFT JOIN own a ON a.d = o.d - 1 AND a.key = o.above"""

ORACLES = {"op1_line_dedup": OP1, "op4_mixing": OP4, "op8_decontamination": OP8, "op9_exact_dedup": OP9, "op10_url_filter": OP10, "op11_host_rules": OP11, "op12_spelling_variants": OP12, "op13_prefix_trie": OP13}
