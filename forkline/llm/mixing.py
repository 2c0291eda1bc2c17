"""Mixing sources to target weights by hierarchical budgeting over domain, language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart

LEVELS = ("domain", "lang", "source")
#: Leaves up to this number are broadcast to the documents, more are joined by shuffle.
BROADCAST_LEAVES = 20_000


def words_in(text: str = "text") -> Column:
    """Words of a text: runs outside [\\x20\\x09-\\x0D]; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]], default: float = 1.0) -> Column:
    known = weights.get(level) or {}
    if not known:
        return F.lit(default)
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(default)).cast("double")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `budget`: each parent's `parent_budget` dealt to its children by `weight`, none above its `capacity`.

    What a full child can't take goes to its siblings by their weights. Children are ordered by capacity for each unit
    of weight; the k-th is full if it is even when all before it are, and the open ones share the rest.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = W.partitionBy(*parent).orderBy("ratio", name)
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everyone = W.partitionBy(*parent)
    ranked = children.withColumn("ratio", ratio).withColumn("taken", F.coalesce(F.sum("capacity").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(onward))
    level = (F.col("parent_budget") - F.col("taken")) / F.col("open")
    full = ranked.withColumn("full", F.coalesce((F.col("open") > 0) & (F.col("ratio") <= level), F.lit(False)))
    rest = F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(everyone), F.lit(0.0))
    weights = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone)
    budget = F.when(F.col("full"), F.col("capacity")).when(F.col("weight") > 0, rest * F.col("weight") / weights).otherwise(0.0)
    return full.withColumn("rest", rest).withColumn("budget", budget).drop("ratio", "taken", "open", "full", "rest", "parent_budget")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], fraction: float, max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens, n_rows) -> with `budget` (long), top down: siblings make up a shortage, and only what all of them lack goes up."""
    # what lies under a weight of 0 at any level is nothing that a sibling or an ancestor could be given
    counts = [_weight(level, weights) > 0 for level in LEVELS]
    table = leaves.withColumn("capacity", F.when(counts[0] & counts[1] & counts[2], F.col("tokens") * max_epochs).otherwise(0).cast("double"))
    total = table.agg(F.sum("tokens")).first()[0] or 0
    parent: list[str] = []
    above = None
    for level in LEVELS:
        keys = [*parent, level]
        nodes = table.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        nodes = nodes.withColumn("parent_budget", F.lit(float(total) * fraction)) if above is None else nodes.join(above, parent)
        above = share_out(nodes, parent, level).select(*keys, F.col("budget").alias("parent_budget"))
        parent = keys
    return leaves.join(above, list(LEVELS)).withColumn("budget", F.floor("parent_budget")).drop("parent_budget")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], fraction: float = 1.0, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """`docs` (doc_id, lang, source, n_tokens, ...) mixed to weights: a row for each document and epoch in which it is taken, with `domain` and `epoch`.

    `weights` gives, for each of domain, lang and source, a node's weight among its siblings (1 where none is given).
    All in all `fraction` times the tokens are asked for; a leaf gives at most `max_epochs` times its own. A leaf's
    budget is met by whole epochs and a prefix of one more, in the order of md5(seed:epoch:doc_id) (ties: fewer tokens
    first, equal rows together): documents whose running total is within the budget. Null lang, source or doc_id count as the empty string;
    leaves without tokens or budget give nothing; an empty table gives an empty result. Further columns are passed on, whatever their names.

    Only sums leave the documents: for each leaf, and for each bucket of a leaf's order; n documents make the root of n
    buckets, so that a window over a leaf's buckets and one over the documents of a bucket both see the root of n rows.
    The latter runs over ids and sizes in the one bucket only in which the leaf's prefix ends; it gives the key
    up to which the leaf's documents are taken, and texts are never shuffled.
    """
    marked = docs.withColumns({"domain": F.coalesce(domain, F.lit("")), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    return apart(marked, lambda rows: _mixed(rows, weights, fraction, max_epochs, seed))


def _mixed(rows: DataFrame, weights: dict[str, dict[str, float]], fraction: float, max_epochs: int, seed: int) -> DataFrame:
    names = [f"`{c}`" for c in rows.columns if c not in ("domain", "epoch")]
    leaf = list(LEVELS)
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    plan = budgets(leaves, weights, fraction, max_epochs).where("budget > 0 and tokens > 0")
    plan = plan.select(
        *leaf,
        F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("__whole"),
        (F.col("budget") % F.col("tokens")).alias("__rest"),
        F.ceil(F.sqrt("n_rows")).alias("__buckets"),
    ).cache()
    few = plan.count() <= BROADCAST_LEAVES
    near = lambda table: F.broadcast(table) if few else table
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    place = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("__buckets"))
    rows = rows.join(near(plan), leaf).withColumn("__key", key).withColumn("__bucket", place)
    slim = rows.where("__rest > 0").select(*leaf, "__bucket", "__key", "n_tokens", "__rest")
    # the buckets that a prefix takes whole, and the one in which it ends
    sums = slim.groupBy(*leaf, "__bucket", "__rest").agg(F.sum("n_tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy(*leaf).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__before", before)
    last = sums.where("__before + held <= __rest").groupBy(*leaf).agg(F.max("__bucket").alias("__last"))
    ends = sums.where("__before <= __rest and __before + held > __rest").groupBy(*leaf).agg(F.min("__bucket").alias("__bucket"), F.min_by("__before", "__bucket").alias("__before"))
    running = F.sum("n_tokens").over(W.partitionBy(*leaf).orderBy("__key", "n_tokens"))  # equal rows go together
    edge = slim.join(near(ends), [*leaf, "__bucket"]).withColumn("__running", running).where("__before + __running <= __rest")
    cuts = edge.groupBy(*leaf).agg(F.max(F.struct("__key", "n_tokens")).alias("__cut"))
    taken = plan.select(*leaf).join(last, leaf, "left").join(cuts, leaf, "left").cache()
    taken.count()
    prefix = (F.col("__rest") > 0) & (F.coalesce(F.col("__bucket") <= F.col("__last"), F.lit(False)) | F.coalesce(F.struct("__key", "n_tokens") <= F.col("__cut"), F.lit(False)))
    copies = F.col("__whole") + prefix.cast("int")
    done = rows.join(near(taken), leaf).withColumn("__copies", copies).where("__copies > 0")
    return done.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).select(*names, "domain", "epoch")
