"""Quality rules as a ledger: measurements and one bit per failed rule."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xtalframe.llm.common import texts

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
_INDEX_BITS = 31
_INDEX = (1 << _INDEX_BITS) - 1


def _n(name: str) -> Column:
    return F.col(name)


#: Rule -> failed, over the measurements. A rule's bit is its place here; new
#: rules go to the end so that stored bits keep their meaning.
RULES: Mapping[str, Column] = {
    "few_words": lambda: _n("n_words") < 50,
    "repeated_words": lambda: 100 * _n("n_repeat_words") > 50 * _n("n_words"),
    "symbols": lambda: _n("n_symbols") > _n("n_words"),
    "repeated_lines": lambda: 100 * _n("n_dup_lines") > 60 * _n("n_lines"),
    "short_words": lambda: _n("word_chars") < 2 * _n("n_words"),
    "long_words": lambda: _n("word_chars") > 25 * _n("n_words"),
}

#: Policy version -> the rules it applies.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": tuple(RULES),
}


def mask(rules) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in set(rules))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def _repeat_words(df: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``words``: sort the windows' hashes, each packed
    with its place; only windows beside an equal hash are compared as words."""

    def packed(i):
        h = F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
        return F.shiftleft(h, _INDEX_BITS).bitwiseOR(i.cast("long"))

    def beside(x, j, array, same):
        there = lambda k: F.get(array, k)
        return F.coalesce(same(x, there(j - 1)), F.lit(False)) | F.coalesce(same(x, there(j + 1)), F.lit(False))

    def triple(x):
        i = x.bitwiseAND(F.lit(_INDEX)).cast("int")
        return F.struct(
            F.get("words", i).alias("a"), F.get("words", i + 1).alias("b"), F.get("words", i + 2).alias("c"), i.alias("i")
        )

    none = F.array().cast("array<long>")
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), packed))
    same_hash = lambda x, y: F.shiftright(x, _INDEX_BITS) == F.shiftright(y, _INDEX_BITS)
    same_words = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    return (
        df.withColumn("_w", F.sort_array(F.coalesce(windows, none)))
        .withColumn("_s", F.filter("_w", lambda x, j: beside(x, j, "_w", same_hash)))
        .withColumn("_t", F.sort_array(F.transform("_s", triple)))
        .withColumn("_r", F.filter("_t", lambda x, j: beside(x, j, "_t", same_words)))
        .withColumn("_i", F.sort_array(F.transform("_r", lambda x: x["i"])))
        .withColumn(
            "n_repeat_words",
            # each window covers 3 words, or as many as lie before the next one
            _sum(F.transform("_i", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("_i", j + 1) - i, F.lit(3))).cast("long"))),
        )
        .drop("_w", "_s", "_t", "_r", "_i")
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements every rule reads, all from one pass over the
    text and within the row: no shuffle, no Python."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    df = (
        texts(docs)
        .withColumn("words", F.array_remove(F.split("text", SPACE), ""))
        .withColumn("_lines", lines)
        .select(
            "doc_id",
            "words",
            F.size("words").cast("long").alias("n_words"),
            F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
            (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        )
    )
    return _repeat_words(df).drop("words")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``fail_bits``: every rule evaluated once per row.

    Null text counts as empty and fails ``few_words``; repeated rows and null
    doc_ids are kept as rows of their own. A measurement that equals a rule's
    bound passes. Very long texts take memory in proportion to their words.
    Columns besides doc_id and text are not looked at. An empty table has no rows.
    """
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(rule(), F.lit(1 << k)).otherwise(0).cast("long") for k, rule in enumerate(RULES.values())],
    )
    return measure(docs).withColumn("fail_bits", bits)


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy, from its bits alone."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def only_failure(policy: str) -> Column:
    """The one rule of the policy that a ledger row fails, null if it fails none
    or several: a number with a single bit has no bit in common with one less."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long"))
    single = (failed != 0) & (failed.bitwiseAND(failed - 1) == 0)
    names = F.array(*[F.lit(r) for r in RULES])
    return F.when(single, F.get(names, F.bit_count(failed - 1)))


def ablation(rows: DataFrame) -> DataFrame:
    """For every policy and each of its rules: rows kept, rows kept without the
    rule, and rows that only this rule drops, all from bits alone. The ledger
    shrinks to one count per distinct bit pattern first (2**rules at most, with
    partial sums); policies then meet those few patterns. An empty ledger gives
    no rows."""
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p, r, mask(rules), mask([r])) for p, rules in POLICIES.items() for r in rules]
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("policy", "rule", "mask", "bit"), c)]) for c in cases])
    each = patterns.select("fail_bits", "n", F.explode(listed).alias("c")).select("fail_bits", "n", "c.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask").cast("long"))
    without = failed.bitwiseAND(F.bitwise_not(F.col("bit").cast("long")))
    kept = F.sum(F.when(failed == 0, F.col("n")).otherwise(0))
    spared = F.sum(F.when(without == 0, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        kept.alias("kept"), spared.alias("kept_without"), (spared - kept).alias("dropped_by_rule_alone")
    )
