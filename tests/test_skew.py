"""Joins on keys that a third of all rows hold."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from xtalframe.operators import candidates as C
from xtalframe.operators.skew import hot_keys, left_join


@pytest.fixture
def many_partitions(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(kept, ("false", "40", "-1")):
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def plain_left_join(left, right):
    out = []
    for k, a in left:
        found = [b for j, b in right if j == k and k is not None]
        out += [(k, a, b) for b in found or [None]]
    return Counter(out)


@pytest.mark.parametrize("share", [1, 3, 100_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_against_plain_join(spark, share, how):
    left = [("x" if i % 3 == 0 else None if i % 7 == 0 else f"k{i}", i) for i in range(40)] + [("x", 0), ("x", 0), ("alone", 1)]
    right = [("x" if i % 2 else f"k{i}" if i % 5 else None, i) for i in range(30)] + [("x", 1), ("x", 1), ("other", 2)]
    got = left_join(
        spark.createDataFrame(left, "k string, a bigint"), spark.createDataFrame(right, "k string, b bigint"), ["k"], how, share
    )
    want = plain_left_join(left, right)
    if how == "inner":
        want = Counter({r: n for r, n in want.items() if r[2] is not None})
    assert got.columns == ["k", "a", "b"] and Counter(map(tuple, got.collect())) == want


def test_hot_keys_are_few_whatever_the_share(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in hot_keys(df, ["k"], 100, "n").collect()] == [(0, 10)]
    assert left_join(df.limit(0), df.withColumn("b", F.lit(1)), ["k"]).collect() == []
    assert left_join(df.limit(2), df.limit(0).withColumn("b", F.lit(1)), ["k"]).count() == 2


def test_one_system_with_a_third_of_all_entries(spark, many_partitions):
    """Complete, and no task has ten times what the median task has."""
    n = 30_000
    formula = F.when(F.col("id") % 3 == 0, "Fe2O3").otherwise(F.concat(F.lit("Ba"), (F.col("id") % 997 + 1).cast("string"), F.lit("Ti")))
    entries = C.add_formula_keys(
        spark.range(n).select(
            F.col("id").alias("row_id"), F.concat(F.lit("mp-"), F.col("id")).alias("material_id"),
            F.when(F.col("id") % 3 == 0, formula).otherwise(F.concat(F.lit("X"), (F.col("id") % 900).cast("string"))).alias("formula_pretty"),
            F.lit(False).alias("deprecated"),
        ),
        "formula_pretty",
    ).withColumn("chemsys", F.when(F.col("row_id") % 3 == 0, F.col("chemsys")).otherwise(F.concat(F.lit("s"), F.col("row_id") % 2000)))
    asked = C.add_formula_keys(spark.createDataFrame([("Fe2O3",), ("Fe4O6",), ("Fe1O1",), ("Cu",)], "composition string"), "composition")
    more = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("composition"), F.concat(F.lit("s"), "id").alias("chemsys"), F.lit("?").alias("formula_key"))
    pairs = C.join_candidates_chemsys(asked.unionByName(more), entries, share=250).withColumn("task", F.spark_partition_id())
    rows = pairs.select("composition", "material_id", "formula_match", "task").collect()
    count = Counter(r["composition"] for r in rows if r["material_id"])
    assert {c: count[c] for c in ("Fe2O3", "Fe4O6", "Fe1O1", "Cu")} == {"Fe2O3": n // 3, "Fe4O6": n // 3, "Fe1O1": n // 3, "Cu": 0}
    assert sum(r["formula_match"] for r in rows) == 2 * n // 3
    assert sum(r["material_id"] is None for r in rows) == 1 + 2000 - sum(f"c{k}" in count for k in range(2000))
    tasks = sorted(Counter(r["task"] for r in rows).values())
    assert len(tasks) == 40 and tasks[-1] <= 10 * tasks[20]


def test_one_element_set_with_a_third_of_all_entries(spark, many_partitions):
    n = 30_000
    have = spark.range(n).select(
        F.col("id").alias("entry_id"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("Fe"), F.lit("O"))).otherwise(
            F.array(F.lit("Ba"), F.concat(F.lit("U"), (F.col("id") % 50).cast("string")), F.lit("O"))
        ).alias("elements"),
    )
    asked = spark.createDataFrame([("a", ["O"]), ("b", ["O", "Fe"]), ("c", ["Ba"]), ("d", ["U7", "Ba"]), ("e", ["Xe"])], "composition string, elements array<string>")
    pairs = C.join_candidates_elements(asked, have, share=250).withColumn("task", F.spark_partition_id()).select("composition", "entry_id", "task").collect()
    count = Counter(r["composition"] for r in pairs if r["entry_id"] is not None)
    u7 = sum(k % 50 == 7 and k % 3 != 0 for k in range(n))
    assert count == {"a": n, "b": n // 3, "c": n - n // 3, "d": u7}
    assert [r["entry_id"] for r in pairs if r["composition"] == "e"] == [None]
    tasks = sorted(Counter(r["task"] for r in pairs).values())
    assert tasks[-1] <= 10 * tasks[len(tasks) // 2]


def test_best_entries_are_fetched_by_address(spark):
    """No aggregate or sort carries an entry; stored and given addresses agree."""
    from tests.conftest import SF
    from xtalframe.plans import derived as V

    rows = V.entry_lists(spark, SF)
    by_file = C.best_entry_oqmd(rows, address=["row_file", "row_index"])
    plan = by_file._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Aggregate" in line:
            assert "sites" not in line and "unit_cell" not in line
    stored = C.best_entry_oqmd(rows.drop("row_file", "row_index"))
    assert sorted(map(str, by_file.collect())) == sorted(map(str, stored.collect()))


def test_pairs_of_a_key_that_is_hot_on_neither_side(spark):
    """Complete, and no task makes a large part of all rows, though hardly
    anything goes in."""
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, "x").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("a"))
    right = spark.range(500).select(F.when(F.col("id") % 2 == 0, "x").otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("k"), F.col("id").alias("b"))
    rows = [r.asDict() for r in left_join(left, right, ["k"], pairs=500).withColumn("task", F.spark_partition_id()).collect()]
    want = plain_left_join([tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()])
    assert Counter((r["k"], r["a"], r["b"]) for r in rows) == want
    tasks = Counter(r["task"] for r in rows)
    assert len(rows) > 25_000 and max(tasks.values()) < len(rows) / 8
    assert left_join(left.limit(0), right, ["k"], pairs=500).collect() == []
