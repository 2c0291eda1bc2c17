"""URL filters with redirect equivalence: rules judge urls, and components of redirect and canonical links carry block decisions to aliases.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .components import components

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Up to as many rules are written into the plan as one expression; more are joined, with the same result.
INLINE_RULES = 256


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule (host and path together, then host) that fits, or null."""

    def fits(rule: Rule) -> Column:
        return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])

    def value(rule: Rule) -> Column:
        return F.struct(F.lit(rule[1] + rule[2]).alias("rule"), F.lit(rule[0]).alias("verdict"))

    # of rules that are alike in both lengths and text, allow goes first
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow"))
    nothing = F.lit(None).cast("struct<rule: string, verdict: string>")
    return reduce(lambda chain, r: F.when(fits(r), value(r)).otherwise(chain), reversed(ordered), nothing)


def joined_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """`rows` (host, path, ...) with `own` as rule_of() gives it, for any number of rules (verdict, host, path).

    Each distinct host and path looks for its host's endings among the rules' hosts, then for its path's beginnings of
    the lengths that such a host's rules have: equal-key joins in which a url meets each rule once.
    """
    named = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min("verdict").alias("verdict"))  # allow goes first
    lengths = named.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.select("host", "path").distinct().select("host", "path", F.explode(endings).alias("rule_host")).join(lengths, "rule_host")
    asked = asked.select("host", "path", "rule_host", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).withColumn("rule_path", F.substr("path", F.lit(1), F.col("n")))
    fits = asked.join(named, ["rule_host", "rule_path"])
    value = F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = fits.groupBy("host", "path").agg(F.max_by(value, F.struct(F.length("rule_host") + F.col("n"), F.length("rule_host"))).alias("own"))
    return rows.join(best, ["host", "path"], "left")


def with_rules(rows: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """`rows` (host, path, ...) with `own`, the rule that decides each and its verdict, or null."""
    if isinstance(rules, DataFrame):
        return joined_rules(rows, rules)
    if len(rules) > INLINE_RULES:
        return joined_rules(rows, rows.sparkSession.createDataFrame(rules, "verdict string, host string, path string"))
    return rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))


def node_of(url: Column) -> Column:
    """A url as a node of the links: &amp; decoded, the fragment cut, scheme and host with A-Z in lower case, / for an empty path."""
    plain = F.regexp_replace(F.regexp_replace(url, "(?i)&(?:amp|#38|#x26);", "&"), r"(?s)#.*$", "")
    head = F.regexp_extract(plain, r"(?s)^([^:/?#]+://[^/?#]*)", 1)
    rest = F.substr(plain, F.length(head) + 1)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(head == "", plain).otherwise(F.concat(F.translate(head, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path))


def resolve(base: Column, target: Column) -> Column:
    """The node that `target` names on the page `base` (a node); null for other schemes and where `base` has no ://.

    Whole, //host, /path, ?query and relative targets, with . and .. steps taken out of the path.
    """
    plain = F.regexp_replace(F.regexp_replace(target, "(?i)&(?:amp|#38|#x26);", "&"), r"(?s)#.*$", "")
    scheme = F.regexp_extract(base, r"(?s)^([^:/?#]+:)//", 1)
    host = F.regexp_extract(base, r"(?s)^([^:/?#]+://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^([^:/?#]+://[^/?#]*/(?:[^?#]*/)?)", 1)
    whole = plain.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://")
    full = (
        F.when(whole, plain)
        .when((scheme == "") | plain.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(plain == "", base)
        .when(plain.startswith("//"), F.concat(scheme, plain))
        .when(plain.startswith("/"), F.concat(host, plain))
        .when(plain.startswith("?"), F.concat(page, plain))
        .otherwise(F.concat(folder, plain))
    )
    node = node_of(full)
    top, query = F.regexp_extract(node, r"(?s)^([^:/?#]+://[^/?#]*)", 1), F.regexp_extract(node, r"(?s)^[^?]*(\?.*)$", 1)
    steps = F.split(F.regexp_extract(node, r"(?s)^[^:/?#]+://[^/?#]*/([^?]*)", 1), "/")
    up = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    taken = F.aggregate(steps, F.array().cast("array<string>"), up)
    slash = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(taken) > 0), "/").otherwise("")
    dotted = node.rlike(r"(?s)^[^?]*/\.\.?(?:[/?]|$)")
    return F.when(dotted, F.concat(top, F.lit("/"), F.array_join(taken, "/"), slash, query)).otherwise(node)


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): the nodes of a page's url and of the url that its canonical link or its refresh redirect names, resolved on the page's url."""
    tags = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)))
    tag = F.col("tag")
    attribute = r"""(?is)\b%s\s*=\s*["']?\s*([^"'>\s]+)"""
    canonical = F.when(tag.rlike(r"""(?is)\brel\s*=\s*["']?\s*canonical\b"""), F.regexp_extract(tag, attribute % "href", 1))
    # ; ends a refresh target, but not that of an &amp;
    opened = F.regexp_replace(tag, "(?i)&(?:amp|#38|#x26);", "&")
    refresh = F.when(tag.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""), F.regexp_extract(opened, r"""(?is)\burl\s*=\s*["']?\s*([^"'>\s;]+)""", 1))
    found = pages.where(F.col(html).isNotNull() & F.col(url).isNotNull()).select(node_of(F.col(url)).alias("a"), tags.alias("tag"))
    named = found.select("a", F.coalesce(canonical, refresh).alias("target")).where("target <> ''")
    return named.select("a", resolve(F.col("a"), F.col("target")).alias("b")).where("b is not null and a <> b")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row for each row of `pages` (page_id, url, html, ...).

    `rules` is a list, or a table (verdict, host, path) of any size. A rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins and decides.
    Urls without a rule take the decision of their component over canonical links, refresh redirects and `redirects`
    (a, b: urls; optional): allow if a member is allowed by a rule, else block if a member is blocked, else allow.
    Urls that differ in the case of scheme and host, in &amp; or in the fragment only are one node. A null url, or one without ://, has an empty host and path, no rule and the
    verdict allow. Nulls in other columns, repeated rows and further columns are harmless.
    """
    url = F.col("url")
    rows = with_rules(pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")), rules)
    edges = alias_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("a")), node_of(F.col("b"))))
    nodes = components(store(edges.distinct(), "aliases"))
    # targets need not be pages themselves, so rules judge the nodes; a hub's aliases are aggregated before the shuffle
    node = F.col("node")
    decided = with_rules(nodes.select("root", host_of(node).alias("host"), path_of(node).alias("path")), rules)
    verdicts = decided.groupBy("root").agg(F.bool_or(F.col("own.verdict") == "allow").alias("allowed"), F.bool_or(F.col("own.verdict") == "block").alias("blocked"))
    blocked = nodes.join(verdicts.where("blocked and not coalesce(allowed, false)"), "root").select("node", F.lit("block").alias("inherited"))
    judged = rows.join(blocked, node_of(rows.url) == blocked.node, "left")
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict"))
