"""The registered query of every corpus operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xtalframe.llm import decontamination, lexical_search, line_dedup, ngram_join, quality_rules, secret_scan, sentencepiece_codec, sharding, simhash, suffix_dedup, token_alignment, token_counts, toxicity
from xtalframe.llm.common import ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf)

    QUERIES[fn.__name__] = run
    return run


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@query
def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What every document keeps when repeated 100-byte strings go."""
    return suffix_dedup.remove_repeats(_documents(spark, sf), length=100).drop("kept")


@query
def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Base secrets and linked weak candidates of every document."""
    return secret_scan.scan_secrets(_documents(spark, sf))


@query
def op3_minimax_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Forty shards of near-equal bytes; equal texts stay together."""
    return sharding.minimax_shards(_documents(spark, sf), shards=40)


@query
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score and verdict of every document."""
    return toxicity.toxicity(_documents(spark, sf), table(spark, sf, "labels"))


@query
def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    found = decontamination.contamination(_documents(spark, sf), table(spark, sf, "benchmark"), size=10)
    return found.drop("text_key", "items")


@query
def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Unigram pieces and best score of every document."""
    return token_counts.count_tokens(_documents(spark, sf))


@query
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines kept and dropped of every document."""
    return line_dedup.digests(_documents(spark, sf), least=40, documents=5)


@query
def op8_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Set size and component of every document, four-word shingles at 0.85."""
    found = ngram_join.near_duplicates(_documents(spark, sf), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op9_quality_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements, failure bits and the current policy's verdict."""
    rows = quality_rules.ledger(_documents(spark, sf))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"),
        quality_rules.passes("v2").alias("kept"),
        quality_rules.passes("v1").alias("kept_v1"),
        "n_lines",
        F.col("fail_bits"),
        quality_rules.only_failure("v2").alias("dropped_only_by"),
    )


@query
def quality_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """For every policy and rule: documents kept, kept without the rule, and
    dropped by this rule alone."""
    return quality_rules.ablation(quality_rules.ledger(_documents(spark, sf)))


@query
def op10_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and digests of ids and decoded text of every document."""
    return sentencepiece_codec.digests(_documents(spark, sf))


@query
def op11_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of three-word shingles and component at two bits."""
    found = simhash.near_duplicates(_documents(spark, sf), words=3, bits=2)
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return lexical_search.search(_documents(spark, sf), table(spark, sf, "benchmark"), top=50)


@query
def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and links between byte-level and piece tokens of every document."""
    return token_alignment.align(_documents(spark, sf))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
