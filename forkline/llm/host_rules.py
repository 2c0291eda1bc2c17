"""Quality rules of hosts: a host's rule failures, shrunk by an empirical beta prior, decide over its documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_bytes

#: The counts of measure(), each a bigint.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules that a document fails on its own.
BASE_RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
#: Rules whose failures are held against a document where its host is known for them.
HOST_RULES = {"symbols": "10 * n_symbols > n_words", "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words", "lines": "10 * n_dup_lines > 3 * n_lines"}
#: Shrunken rates: documents of a host that fail any rule, from which all of its documents go; that fail one rule, from which those go that fail it too.
REJECT, STRICT = 0.5, 0.2
ANY = "any"

_SYMBOLS = b"#*$%&|<>"
#: White space, and the bytes that go on a code point: what is left of a text without them is a byte for each code point of its words.
_UNCOUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))


def _repeated(words: list[bytes]) -> int:
    """Words within three-word windows that the list has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(numbers) == n:
        return 0
    at = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    pair = np.unique(at[:-1] * n + at[1:], return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * n + at[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of a text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return len(words), len(text.translate(None, _UNCOUNTED)), symbols, len(lines) - len(set(lines)), _repeated(words), len(lines)


def measures(docs: DataFrame, host: Column) -> DataFrame:
    """(doc_id, host, MEASURES) for each row of `docs` (doc_id, text, ...), from whole texts; a null text has no words, a null host stays null. Without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in batch.column(2).to_pylist()]
            counts = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts], ["doc_id", "host", *MEASURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def host_rates(measured: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(host, rule, docs, failures, rate) for each host and each of `rules` (SQL over MEASURES), and for ANY of them.

    rate is the posterior mean under a beta prior that has the corpus's own rate as its mean and, by moments, the spread
    between hosts that chance within them does not explain: hosts that are alike all get the corpus's rate, a host of few documents is drawn to it most.
    Failures are added up before they are shuffled; a prior is one row for each rule.
    """
    failing = {name: F.coalesce(F.expr(rule), F.lit(False)) for name, rule in rules.items()}
    whole = F.lit(False)
    for rule in failing.values():
        whole |= rule
    failing[ANY] = whole
    sums = measured.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *(F.count_if(rule).alias(name) for name, rule in failing.items()))
    each = sums.select("host", "docs", F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("failures")) for name in failing))).alias("x")).select("host", "docs", "x.*")
    n, f = F.col("docs").cast("double"), F.col("failures").cast("double")
    moments = each.groupBy("rule").agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("fp"), (F.count(F.lit(1)) - 1).alias("free"))
    mean = F.col("f") / F.col("n")
    # within-host correlation of failures: 1 / (alpha + beta + 1)
    spread = F.col("fp") - mean * F.col("f")
    room = F.col("n") - F.col("nn") / F.col("n") - F.col("free")
    usable = (mean > 0) & (mean < 1) & (room > 0)
    alike = F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.try_divide(spread, mean * (1 - mean)) - F.col("free")) / F.when(room > 0, room)))).otherwise(0.0)
    priors = moments.select(F.col("rule").alias("prior_rule"), mean.alias("mean"), alike.alias("alike"))
    rate = (f * F.col("alike") + (1 - F.col("alike")) * F.col("mean")) / (n * F.col("alike") + (1 - F.col("alike")))
    # as many rows as there are rules
    return each.join(F.broadcast(priors), F.col("rule") == F.col("prior_rule")).select("host", "rule", "docs", "failures", rate.alias("rate"))


def host_verdicts(rates: DataFrame, reject: float = REJECT, strict: float = STRICT) -> DataFrame:
    """(host, host_docs, host_failures, host_rejected, strict_rules): one row for each host of host_rates()."""
    whole = F.col("rule") == ANY
    return rates.groupBy("host").agg(
        F.max("docs").alias("host_docs"), F.max(F.when(whole, F.col("failures"))).alias("host_failures"), F.bool_or(whole & (F.col("rate") >= reject)).alias("host_rejected"),
        F.array_sort(F.collect_set(F.when(~whole & (F.col("rate") >= strict), F.col("rule")))).alias("strict_rules"),
    )


def judge(docs: DataFrame, host: Column | str = "source", base: dict[str, str] = BASE_RULES, rules: dict[str, str] = HOST_RULES, reject: float = REJECT, strict: float = STRICT) -> DataFrame:
    """(doc_id, host, MEASURES, base_failed, failed_rules, host_docs, host_failures, host_rejected, strict_rules, kept): one row for each row of `docs` (doc_id, text, the columns of `host`, ...).

    Words are runs outside [\\x20\\x09-\\x0D]. A document goes if it fails a base rule; if so many documents of its host fail some rule that the
    shrunken rate reaches `reject`; or if it fails a rule of which its host's shrunken rate reaches `strict`. A document that fails
    no rule is lost only with the whole of its host.
    A null or empty text has no words and fails the base rules; a null host is one host, and a null doc_id stays null. Repeated rows are judged
    alike and each count for the host; an empty table gives an empty result; other columns are ignored, whatever their names.
    Measures are stored once, as narrow rows, and hosts are joined to them; no text is shuffled.
    """
    measured = store(measures(docs, F.col(host) if isinstance(host, str) else host), "text-measures")
    everything = base | rules
    verdicts = host_verdicts(host_rates(measured, everything), reject, strict).withColumnRenamed("host", "judged_host")
    met = measured.join(verdicts, F.col("host").eqNullSafe(F.col("judged_host")), "left").drop("judged_host")
    failed = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in everything.items())))
    base_failed = F.coalesce(F.expr(" or ".join(f"({rule})" for rule in base.values())), F.lit(False))
    marked = met.withColumns({"base_failed": base_failed, "failed_rules": failed})
    kept = ~F.col("base_failed") & ~F.col("host_rejected") & ~F.arrays_overlap("failed_rules", "strict_rules")
    return marked.withColumn("kept", F.coalesce(kept, F.lit(False)))


def keep_good(docs: DataFrame, host: Column | str = "source", **settings) -> DataFrame:
    """The rows of `docs` that judge() keeps, with all their own columns; rows that share a doc_id stay or go together, with the kept ones, and rows without an id are judged as one."""
    judged = judge(docs, host, **settings).groupBy(F.col("doc_id").alias("judged")).agg(F.bool_or("kept").alias("ok")).where("ok")
    other = judged.select([F.col(c).alias(f"{c} {'_' * max(map(len, docs.columns))}") for c in judged.columns])
    return docs.join(other, docs["doc_id"].cast("long").eqNullSafe(other[other.columns[0]]), "left_semi")
