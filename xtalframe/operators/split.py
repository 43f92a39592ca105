"""Row numbers and exact-size, repeatable splits without a global sort.

Both work on ordered, disjoint groups of rows whose sizes are counted: range
partitions for row numbers, digest buckets for splits. The count table has a
fixed maximum size, so cumulative offsets over it are cheap whatever the data.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xtalframe.session import stored

_HEX_DIGITS = 4  # 65,536 buckets


def _given(key: str) -> Column:
    """The key; a null one stops the job, since such a row has no place."""
    return F.when(F.col(key).isNull(), F.raise_error(F.lit(f"null in key column {key}"))).otherwise(F.col(key))


_PLACE_BITS = 33  # of monotonically_increasing_id: the place within a partition


def row_ids(df: DataFrame, key: str | list[str], name: str = "row_number") -> DataFrame:
    """1-based position of each row in order of ``key``: any orderable column,
    or several, unique together. Null keys raise.

    Rows are range partitioned and sorted within partitions, one shuffle, and
    stored with their place there: limits of ranges are sampled, so places must
    not be computed twice. A partition's offset is the number of rows in those
    before it; offsets are one row a partition, which bounds what is broadcast.
    """
    keys = [key] if isinstance(key, str) else list(key)
    given = df.withColumns({k: _given(k) for k in keys})
    sorted_rows = given.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_place", _PLACE_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        rows.join(F.broadcast(before), part == F.col("_part"))
        .withColumn(name, F.col("_before") + within + 1)
        .drop("_place", "_part", "_before")
    )


def unknown_ids(df: DataFrame, key: str | list[str], material_id: str = "material_id") -> DataFrame:
    """Fill a missing id column with ``Unknown_ID_<position>``; rows that are
    skipped later keep their number."""
    if material_id in df.columns:
        return df
    numbered = row_ids(df, key, "_position")
    return numbered.withColumn(
        material_id, F.concat(F.lit("Unknown_ID_"), F.col("_position").cast("string"))
    ).drop("_position")


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _assign(df: DataFrame, key: str, seed: int, cuts: Column, names: list[str]) -> DataFrame:
    """Label rows by where their rank in digest order falls among the cuts.

    ``cuts`` is an array expression of cumulative sizes over a column ``_n``
    (all rows). The key column is read once and its digests are stored; they
    are counted by bucket, and only the bucket that a cut falls into, about 1 in
    65,536 rows, is ranked to find the row that opens the next part. Those rows,
    one for each cut, are the whole plan: labelling compares with them, so
    whoever uses the split adds no shuffle and no further read.
    """
    digests = stored(df.select(_given(key).alias("key"), _digest(key, seed).alias("digest")), "digests")
    bucket = F.substring("digest", 1, _HEX_DIGITS)
    counts = digests.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("size"))
    # at most 16**4 rows from here on
    ordered = Window.orderBy("bucket")
    plan = counts.select(
        "bucket",
        (F.sum("size").over(ordered) - F.col("size")).alias("start"),
        F.sum("size").over(ordered).alias("end"),
        F.sum("size").over(Window.partitionBy()).alias("_n"),
    )
    asked = plan.select("bucket", "start", "end", F.posexplode(cuts).alias("cut", "at")).where("at >= start AND at < end")
    inside = digests.withColumn("bucket", bucket).join(F.broadcast(asked.select("bucket").distinct()), "bucket", "left_semi")
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("digest", "key")) - 1)
    opening = ranked.join(F.broadcast(asked), "bucket").where("start + rank = at").select("cut", "digest", "key")
    opens = {r["cut"]: r for r in opening.collect()}  # one row for each cut at most
    digest = _digest(key, seed)
    passed = F.lit(0)
    for r in opens.values():  # a cut at the very end opens nothing
        place, its_key = F.lit(r["digest"]), F.lit(r["key"])
        passed = passed + F.when((digest > place) | ((digest == place) & (F.col(key) >= its_key)), 1).otherwise(0)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), passed + 1)
    return df.withColumn("split", label)


def split_sizes(n: Column, train: float, val: float, test: float) -> tuple[Column, Column, Column]:
    """Exact sizes (train, val, test) for ``n`` rows, in the same double
    arithmetic as two successive ceiling splits."""
    rest = val + test
    n_rest = F.ceil(F.lit(rest) * n) if rest > 0 else F.lit(0).cast("bigint")
    n_test = F.ceil(F.lit(test / rest) * n_rest) if rest > 0 else F.lit(0).cast("bigint")
    return n - n_rest, n_rest - n_test, n_test


def split_three_way(
    df: DataFrame,
    key: str,
    train: float = 0.7,
    val: float = 0.2,
    test: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` (train / val / test) with exact sizes, repeatable by seed.

    ``key`` must be unique; null keys raise. Rows are ranked by a digest of seed and key, so
    membership does not depend on partitioning or row order. The key column is
    read when this is called, and the rows once where the result is used.
    """
    if abs(train + val + test - 1.0) > 1e-9:
        warnings.warn(f"ratios {train}, {val}, {test} do not sum to 1", UserWarning, stacklevel=2)
    n_train, n_val, _ = split_sizes(F.col("_n"), train, val, test)
    return _assign(df, key, seed, F.array(n_train, n_train + n_val), ["train", "val", "test"])


def split_two_way(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` (train / test) with ``ceil(test_size * n)`` test rows; a
    table of at most one row is all train."""
    n = F.col("_n")
    n_train = F.when(n > 1, n - F.ceil(F.lit(test_size) * n)).otherwise(n)
    return _assign(df, key, seed, F.array(n_train), ["train", "test"])


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def union_splits(*splits: DataFrame) -> DataFrame:
    """All rows of several splits, matched by column name."""
    first, *rest = splits
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def split_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found in both splits; empty for a proper split."""
    return left.select(key).join(right.select(key), key, "left_semi")
