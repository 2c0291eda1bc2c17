"""The registered queries of the thirteen operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, host_rules, license_scan, line_dedup, mixing, prefix_trie, quality, simhash, spelling, suffix_tree_lm, token_count, url_filter
from .common import read_table, store

#: Rules of the URL filter: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Target weights among siblings; nodes that aren't listed weigh 1.
WEIGHTS = {"domain": {"web": 0.5, "forum": 0.3, "books": 0.2}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def domain_of(source: str = "source") -> Column:
    """The domain of a source: src0 is web, other sources of one digit are forums, the rest are books."""
    return F.when(F.col(source) == "src0", "web").when(F.length(source) == 4, "forum").otherwise("books")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_digests(read_table(spark, sf_dir, "documents"), 40, 5)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_texts(read_table(spark, sf_dir, "documents"), quality.crc_mod() != 1)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.words_in().alias("n_tokens"))
    return mixing.mix(store(rows, "token-counts"), domain_of(), WEIGHTS)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=4, bits=4)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, sf_dir, "documents"))
    unsure = F.filter("hits", lambda h: ~h["confirmed"])
    return found.select("doc_id", "n_paragraphs", F.array_join("families", ",").alias("families"), F.size("hits").alias("n_hits"), F.size(unsure).alias("n_unconfirmed"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 10)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(read_table(spark, sf_dir, "documents"), "source")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failures", "host_rejected", F.array_join("strict_rules", ",").alias("strict_rules"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


_FUNCTIONS = (
    op1_line_dedup, op2_token_counts, op3_suffix_tree_lm, op4_mixing, op5_simhash, op6_license_scan, op7_quality, op8_decontamination, op9_exact_dedup, op10_url_filter, op11_host_rules, op12_spelling_variants, op13_prefix_trie,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
