"""Graph-network scoring as joins and aggregates over node and edge tables.

Nodes: ``structure_id, node`` and feature columns. Edges: ``structure_id,
source_node_index, target_node_index, distance``; messages run from source to
target. Keys are (structure, block of nodes), never the structure alone, so one
huge graph spreads over its blocks and a small one stays together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from xtalframe.session import joined_in_buckets, stored, stored_by

PLACE = ["structure_id", "block", "node"]
BUCKETS = ["structure_id", "block"]
#: Nodes of a block, a power of two, and messages of a bucket.
BLOCK, BUCKET = 4096, 2**19


def _with_loops(nodes: DataFrame, edges: DataFrame, features: Sequence[str], weighted: bool) -> DataFrame:
    """Messages of one layer before scaling: every edge, and every node to
    itself with weight 1. Only the loops carry features."""
    none = [F.lit(None).cast("double").alias(f) for f in features]
    weight = F.col("distance") if weighted else F.lit(1.0)
    along = edges.select(
        "structure_id",
        F.col("source_node_index").alias("node"),
        F.col("target_node_index").alias("target"),
        weight.cast("double").alias("weight"),
        *none,
    )
    loops = nodes.select(
        "structure_id",
        "node",
        F.col("node").alias("target"),
        F.lit(1.0).alias("weight"),
        *[F.col(f).cast("double").alias(f) for f in features],
    )
    return along.unionAll(loops)


class Messages(NamedTuple):
    """Messages of all layers where they are used.

    A place is (structure, block of ``BLOCK`` nodes, node). ``near`` has the
    messages that stay in their block, loops among them, in buckets of structure
    and block: joins and sums by either end read them as they lie. ``far`` has
    the others, with ``target_block``, in buckets of the block they leave from;
    it is None where no graph is larger than a block.
    """

    near: DataFrame
    far: DataFrame | None
    buckets: int


def _block(df: DataFrame, node: str) -> Column:
    """The block of a node; a node that is no whole number is one by itself."""
    if isinstance(df.schema[node].dataType, IntegralType):
        return F.shiftright(F.col(node).cast("bigint"), BLOCK.bit_length() - 1)
    return F.xxhash64(F.col(node).cast("string"))


def graph_messages(nodes: DataFrame, edges: DataFrame, features: Sequence[str], weighted: bool = True) -> Messages:
    """Edges and loops, stored in buckets of the block they leave from. Nodes and
    edges are read, and edges found, once for degrees and all layers; the number
    of buckets goes with that of the messages, so that a task's share does not."""
    found = stored(_with_loops(nodes, edges, features, weighted), "found")
    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, math.ceil(found.count() / BUCKET))
    rows = found.withColumns({"block": _block(found, "node"), "target_block": _block(found, "target")})
    rows = stored_by(rows.withColumn("far", ~F.col("block").eqNullSafe(F.col("target_block"))), "messages", *BUCKETS, buckets=buckets)
    far = rows.where("far")
    return Messages(rows.where("NOT far").drop("far", "target_block"), None if far.isEmpty() else far.select(*PLACE, "target_block", "target", "weight"), buckets)


def turned_messages(messages: Messages) -> Messages:
    """The same messages the other way round, in buckets of the block where they
    leave then: those that stay in their block lie there already."""
    near, far, buckets = messages
    back = near.select("structure_id", "block", F.col("target").alias("node"), F.col("node").alias("target"), "weight")
    if far is not None:
        turned = far.select("structure_id", F.col("target_block").alias("block"), F.col("target").alias("node"), F.col("block").alias("target_block"), F.col("node").alias("target"), "weight")
        far = stored_by(turned, "messages_back", *BUCKETS, buckets=buckets)
    return Messages(back, far, buckets)


def _arriving(near: DataFrame, far: DataFrame | None, sums: dict[str, Column], own: dict[str, Column]) -> DataFrame:
    """``sums`` of the messages and ``own`` values of the loops by the place that
    they reach. Only sums of messages between blocks are shuffled."""
    here = near.groupBy("structure_id", "block", F.col("target").alias("node")).agg(*[c.alias(n) for n, c in (sums | own).items()])
    if far is None:
        return here
    there = far.groupBy("structure_id", F.col("target_block").alias("block"), F.col("target").alias("node")).agg(*[c.alias(f"_{n}") for n, c in sums.items()])
    both = lambda n: F.coalesce(F.col(n) + F.col(f"_{n}"), F.col(n), F.col(f"_{n}")).alias(n)
    return here.join(there, PLACE, "left").select(*PLACE, *[both(n) for n in sums], *own)


def node_degrees(messages: Messages, features: Sequence[str]) -> DataFrame:
    """Nodes with their features and ``inv_sqrt_deg``: degree is 1 for the self
    loop plus the weights coming in."""
    own = {f: F.max(f) for f in features} | {"_own": F.count_if(F.col("node") == F.col("target"))}
    return (
        _arriving(messages.near, messages.far, {"_deg": F.sum("weight")}, own)
        .where("_own > 0")  # an edge to a node that isn't there has no node
        .select(*PLACE, (1 / F.sqrt("_deg")).alias("inv_sqrt_deg"), *features)
    )


def _propagate(nodes: DataFrame, messages: Messages, features: Sequence[str]) -> DataFrame:
    """One propagation for nodes that already carry ``inv_sqrt_deg``.

    out_i = s_i * sum_j w_ji * s_j * x_j over edges and the loop, s = deg^-1/2.
    One join on the node a message leaves from and one aggregate by the node it
    reaches, both in the block where messages and nodes lie; the loop brings
    that node's own s_i along.
    """
    own = F.when(F.col("node") == F.col("target"), F.col("inv_sqrt_deg"))
    near = messages.near.select(*PLACE, "target", "weight").join(nodes, PLACE)
    far = None if messages.far is None else messages.far.join(nodes, PLACE)
    sums = {f: F.sum(F.col("weight") * F.col("inv_sqrt_deg") * F.col(f)) for f in features}
    return (
        _arriving(near, far, sums, {"inv_sqrt_deg": F.max(own)})
        .where(F.col("inv_sqrt_deg").isNotNull())
        .select(*PLACE, "inv_sqrt_deg", *[(F.col("inv_sqrt_deg") * F.col(f)).alias(f) for f in features])
    )


def neighbor_aggregate(
    nodes: DataFrame, edges: DataFrame, features: Sequence[str], weighted: bool = True
) -> DataFrame:
    """One graph-convolution propagation with self loops and symmetric
    normalisation; ``weighted=False`` counts every edge as 1."""
    messages = graph_messages(nodes, edges, features, weighted)
    with joined_in_buckets(nodes.sparkSession):
        return stored(_propagate(node_degrees(messages, features), messages, features).drop("block", "inv_sqrt_deg"), "propagated")


def graph_mean_pool(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean of the node features per structure."""
    return nodes.groupBy("structure_id").agg(*[F.avg(f).alias(f) for f in features])


def _linear(
    df: DataFrame,
    keep: Sequence[str],
    features: Sequence[str],
    weights: Sequence[Sequence[float]],
    bias: Sequence[float],
    prefix: str,
    relu: bool,
) -> tuple[DataFrame, list[str]]:
    """``features @ weights + bias`` as plain arithmetic, one column per output."""
    names = [f"{prefix}{j}" for j in range(len(bias))]
    columns = []
    for j, name in enumerate(names):
        value: Column = F.lit(float(bias[j]))
        for i, f in enumerate(features):
            value = value + F.col(f) * F.lit(float(weights[i][j]))
        # NaN must stay NaN: greatest() would keep it too, but by sort order.
        columns.append((F.when(value < 0, F.lit(0.0)).otherwise(value) if relu else value).alias(name))
    return df.select(*keep, *columns), names


def gcn_score(
    nodes: DataFrame,
    edges: DataFrame,
    features: Sequence[str],
    weights: dict[str, Sequence],
    weighted: bool = True,
) -> DataFrame:
    """Score every structure with a given two-layer network.

    ``weights``: w1, b1, w2, b2, w_out (per hidden unit), b_out. Propagation
    and the linear map commute, so the first layer propagates the few input
    features rather than the hidden units. Degrees are computed once and
    travel with the nodes.
    """
    keep = [*PLACE, "inv_sqrt_deg"]
    messages = graph_messages(nodes, edges, features, weighted)
    x = _propagate(node_degrees(messages, features), messages, features)
    h, names = _linear(x, keep, features, weights["w1"], weights["b1"], "h", True)
    h = _propagate(h, messages, names)
    h, names = _linear(h, keep, names, weights["w2"], weights["b2"], "k", True)
    with joined_in_buckets(nodes.sparkSession):
        pooled = stored(graph_mean_pool(h, names), "pooled")
    out, _ = _linear(
        pooled,
        ["structure_id"],
        names,
        [[w] for w in weights["w_out"]],
        [weights["b_out"]],
        "score",
        False,
    )
    return out.withColumnRenamed("score0", "score")


def target_select(graphs: DataFrame, index: int, y: str = "y") -> DataFrame:
    """Pick ``y[index]`` as ``target``; rows without that entry are dropped."""
    target = F.try_element_at(F.col(y), F.lit(index + 1))
    return graphs.where(F.size(y) > index).withColumn("target", target)


def graph_validate(graphs: DataFrame) -> DataFrame:
    """Keep graphs that have node features, an edge index and targets."""
    return graphs.where(
        (F.size("x") > 0) & (F.size("edge_index") == 2) & (F.size("y") > 0)
    )
