"""Connected components of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xtalframe.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node can reach.

    Alternating large-star and small-star: every node hangs its larger
    neighbours, then itself and its smaller ones, under the smallest it sees.
    Each round is written to the shared folder. Least values are aggregated
    before the join, so a node with very many links costs no more than its
    links. Every round lowers some end or is the last, so there is no bound on
    their number. ``links`` has two long columns; equal ends and repeats don't matter.
    """
    u, v = links.columns
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = written(
        links.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct(), "links"
    )
    before = None
    while True:
        both = edges.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(pair("b", "m"), pair("a", "m"))).alias("e"))
        edges = written(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
