"""Benchmark passages in documents: prefix-filtered join over item windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xtalframe.llm.common import Aside, text_key, texts, written
from xtalframe.operators.skew import left_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Prefix tokens broadcast at once; a row holds one word and one window.
BROADCAST_ROWS = 50_000
#: Rows of one word or window that one task may hold in a join.
ROWS_A_KEY = 1000


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows of ``size`` consecutive words of every item; an item
    with fewer words is one window. Columns item_id, window."""
    words = items.select(
        F.col("item_id").cast("string").alias("item_id"),
        word_list(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"),
    ).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    return (
        words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item_id", F.slice("words", F.col("at") + 1, F.lit(size)).alias("window"))
        .distinct()
    )


def _blocks(small: DataFrame, rows: int, most: int) -> list[DataFrame]:
    """The small side in parts of about ``most`` rows, each fit to broadcast:
    dealt by all its columns, so that windows of one rarest word spread too."""
    n = -(-rows // most) or 1
    if n == 1:
        return [small]
    return [small.where(F.pmod(F.xxhash64(*small.columns), F.lit(n)) == k) for k in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def matches(words: DataFrame, items: DataFrame, size: int, block: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_key, item_id, start, length of every window in a document.

    A window occurs only where all its words do, so its rarest word, by the
    corpus's own counts, is a prefix that every occurrence must hold. Document
    words that are such prefixes become candidates; the window's place around
    its prefix word gives the one start to test, length and position bound it,
    and the words at the place decide. The prefix side is broadcast in blocks
    of bounded size, the documents are never shuffled for the match.
    """
    windows = written(item_windows(items, size), "item-windows")
    tokens = written(windows.select(F.explode("window").alias("token")).distinct(), "item-tokens")
    counted = [
        words.select(F.explode("words").alias("token")).join(F.broadcast(part), "token").groupBy("token").count()
        for part in _blocks(tokens, tokens.count(), block)
    ]
    counts = _union(counted).withColumnRenamed("count", "n")
    asked = windows.select("window", F.posexplode("window").alias("offset", "token")).distinct()
    # words that very many windows have are spread over tasks
    rarest = (
        left_join(asked, counts, ["token"], "inner", share=ROWS_A_KEY)
        .groupBy("window")
        # a window with a word that no document has can't occur
        .agg(F.min(F.struct("n", "token", "offset")).alias("r"), F.countDistinct("token").alias("found"))
        .where(F.col("found") == F.size(F.array_distinct("window")))
        .select("window", F.col("r.token").alias("token"), F.col("r.offset").alias("offset"))
    )
    prefixes = written(rarest, "window-prefixes")
    each = words.where(F.size("words") > 0).select("doc_id", "text_key", "words", F.posexplode("words").alias("at", "token"))
    start = F.col("at") - F.col("offset")
    length = F.size("window")
    found = [
        each.join(F.broadcast(part), "token")
        .where((start >= 0) & (start + length <= F.size("words")))
        .where(F.slice("words", start + 1, length) == F.col("window"))
        .select("doc_id", "text_key", "window", start.alias("start"), length.alias("length"))
        for part in _blocks(prefixes, prefixes.count(), block)
    ]
    # and so are windows that very many documents hold
    held = written(_union(found), "window-places")
    return left_join(held, windows, ["window"], "inner", share=ROWS_A_KEY).select("doc_id", "text_key", "item_id", "start", "length")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, block: int = BROADCAST_ROWS) -> DataFrame:
    """Per row: n_words, n_hit, n_items, items_sha256, contaminated, and the
    items found.

    Null and empty texts and items have no words: such a document is clean,
    such an item matches nothing. Rows that repeat a doc_id with another text
    are judged apart; equal rows give equal results. Words that are rarest alike
    are ordered by their text. Only doc_id and text of the documents and item_id
    and text of the items are read. Very long texts take memory in proportion to
    their words. Empty tables give no rows, or rows without a hit.
    """
    # the words are read three times; written once they need no splitting again
    words = written(
        texts(docs).select("doc_id", text_key().alias("text_key"), word_list(F.col("text")).alias("words")), "words"
    )
    found = matches(words, items, size, block)
    spans = F.sort_array(F.collect_set(F.struct("start", "length")))
    by_row = found.groupBy("doc_id", "text_key").agg(
        spans.alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items")
    )
    # longest end so far and words covered, over spans in order of their start
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
        (acc["n"] + F.greatest(s["start"] + s["length"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"),
    )
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    hits = by_row.select(
        F.col("doc_id").alias("_id"),
        F.col("text_key").alias("_key"),
        F.aggregate("spans", none, step, lambda acc: acc["n"]).cast("long").alias("_hit"),
        F.col("items").alias("_items"),
    )
    rows = words.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
    joined = rows.join(hits, rows["doc_id"].eqNullSafe(hits["_id"]) & (rows["text_key"] == hits["_key"]), "left")
    listed = F.coalesce("_items", F.array().cast("array<string>"))
    n_hit = F.coalesce("_hit", F.lit(0))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "text_key",
        listed.alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns kept."""
    return Aside(docs).without(contamination(docs, items, size).where("contaminated"))
