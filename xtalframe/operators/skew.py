"""Left joins whose hot keys spread over many tasks.

A key that a large part of the rows of either side holds makes one cell of a
join: all its rows, and all its pairs, meet in one task. Here such a cell is cut
into a grid. Left rows fall into ``a`` parts and are repeated for the ``b`` parts
of the right side, and the other way round, so that each pair meets in exactly
one part of the grid, and no part holds more than its share of either side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xtalframe.session import stored

#: Rows of a key that one task may hold, of either side.
SHARE = 100_000
#: Keys that can be hot on a side at most: the share grows with the table beyond.
HOT_KEYS = 10_000
#: Rows that one part of a key may make in a join with a far larger result.
PAIRS = 2**22


def _row_hash(df: DataFrame) -> Column:
    """A hash of the row that recomputing it does not change."""
    plain = [F.to_json(f"`{c}`") if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t or t.startswith("map")]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def hot_keys(df: DataFrame, keys: Sequence[str], share: int, name: str) -> DataFrame:
    """The keys with more rows than ``share`` allows, and into how many parts
    each goes. There are at most ``HOT_KEYS``: the share is no smaller than that
    part of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.struct(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))).scalar()
    allowed = F.greatest(F.lit(share).cast("double"), total["n"] / HOT_KEYS)
    return counts.where(F.col("_n") > allowed).select(*keys, F.ceil(F.col("_n") / allowed).cast("int").alias(name))


def hot_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], share: int, pairs: int) -> tuple[DataFrame, int]:
    """Like ``hot_keys`` for both sides at once, where the rows that come out
    count: into how many parts the rows of a key go on the left (``_a``) and on
    the right (``_b``), so that no part has more than ``share`` rows of a side or
    ``pairs`` rows out; and the number of tasks for all rows that come out.
    """
    counted = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    none = F.lit(0).cast("bigint")
    both = counted(left, "_l").join(counted(right, "_r"), list(keys), "full").select(*keys, F.coalesce("_l", none).alias("_l"), F.coalesce("_r", none).alias("_r"))
    both = stored(both.withColumn("_out", F.col("_l").cast("double") * F.col("_r")), "key-counts")
    rows = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_l", "_r", "_out")]).first()
    a, b = (F.greatest(F.ceil(F.col(c) / max(share, rows[c] / HOT_KEYS)), F.lit(1)) for c in ("_l", "_r"))
    most = max(pairs, rows["_out"] / HOT_KEYS)
    cut = both.select(*keys, "_l", "_r", "_out", a.alias("_a"), b.alias("_b"))
    more = F.greatest(F.ceil(F.col("_out") / (F.col("_a") * F.col("_b") * most)), F.lit(1))
    # the side with more rows a part is cut, the other one repeated
    wide = F.col("_l") / F.col("_a") >= F.col("_r") / F.col("_b")
    parts = cut.select(*keys, F.when(wide, F.col("_a") * more).otherwise(F.col("_a")).cast("int").alias("_a"), F.when(wide, F.col("_b")).otherwise(F.col("_b") * more).cast("int").alias("_b"))
    return parts.where("_a > 1 OR _b > 1"), math.ceil(rows["_out"] / most)


def left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", share: int = SHARE, pairs: int | None = None
) -> DataFrame:
    """``left`` joined with ``right`` on equal ``keys`` (of the same names, kept
    once); a left row without partner keeps one row of nulls, or goes with
    ``how="inner"``.

    Keys are counted first, with partial sums in the tasks; the hot ones, a
    bounded number, are broadcast. Left rows with a null key have no partner;
    they are spread over tasks instead of meeting in one. Rows are dealt by a
    hash of their values, so computing them anew deals them alike.

    ``pairs``: for joins whose result is much larger than what goes in. No part
    of a key makes more rows than that, and there are tasks for as many: sizes
    of inputs, by which Spark makes fewer and larger tasks, say nothing there.
    """
    keys = list(keys)
    names = [*left.columns, *[c for c in right.columns if c not in keys]]
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(f"`{k}`").isNull()
    right = right.where(~some_null)
    if how == "inner":
        left = left.where(~some_null)
    tasks = 0
    if pairs is None:
        hot = (
            hot_keys(left.where(~some_null), keys, share, "_a")
            .join(hot_keys(right, keys, share, "_b"), keys, "full")
            .select(*keys, F.coalesce("_a", F.lit(1)).alias("_a"), F.coalesce("_b", F.lit(1)).alias("_b"))
        )
    else:
        hot, tasks = hot_pairs(left.where(~some_null), right, keys, share, pairs)
    own = F.xxhash64(F.col("_row"), F.lit(1))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        marked = df.withColumn("_row", _row_hash(df)).join(F.broadcast(hot), keys, "left")
        marked = marked.withColumns({n: F.coalesce(n, F.lit(1)) for n in ("_a", "_b")})
        part = F.when(some_null, own).otherwise(F.pmod(own, F.col(mine).cast("bigint")))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other).cast("bigint") - 1))
        return marked.withColumn(f"_part{mine}", part).withColumn(f"_part{other}", every).drop("_row", mine)

    ours = dealt(left, "_a", "_b")
    theirs = dealt(right, "_b", "_a").drop("_a").withColumn("_found", F.lit(True))
    cells = [*keys, "_part_a", "_part_b"]
    if tasks > 1:
        tasks = max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        ours, theirs = (df.repartition(tasks, *cells) for df in (ours, theirs))
    joined = ours.join(theirs, cells, how)
    if how != "inner":
        # a key that is cut on the right has partners in some part of every left
        # row's; where it has none in another, that says nothing
        joined = joined.where(F.col("_found") | (F.col("_b") == 1))
    return joined.select(*[F.col(f"`{n}`") for n in names])
