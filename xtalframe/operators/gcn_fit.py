"""Fitting the graph network: gradients as joins and aggregates.

An epoch is one pass over all training graphs: a propagation forward, one
backward along the reversed edges, and sums. What comes to the driver is one
number for each weight and two losses; graphs of any size and number stay in
node and edge rows, spread by (structure, node).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from copy import deepcopy
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xtalframe.operators.gcn import BUCKETS, PLACE, Messages, _linear, _propagate, graph_messages, node_degrees, turned_messages
from xtalframe.session import joined_in_buckets, stored, stored_by


class Epoch(NamedTuple):
    number: int
    loss: float  # mean squared error of the training graphs, before the update
    validation: float | None


class Adam:
    """Moment estimates for one number each, by its place in the weights."""

    def __init__(self, rate: float, decay: tuple[float, float] = (0.9, 0.999), small: float = 1e-8):
        self.rate, self.decay, self.small = rate, decay, small
        self.mean: dict = {}
        self.square: dict = {}
        self.steps = 0

    def update(self, weights: dict, gradient: dict) -> dict:
        self.steps += 1
        a, b = self.decay
        out = deepcopy(weights)
        for place, g in gradient.items():
            self.mean[place] = m = a * self.mean.get(place, 0.0) + (1 - a) * g
            self.square[place] = s = b * self.square.get(place, 0.0) + (1 - b) * g * g
            step = self.rate * (m / (1 - a**self.steps)) / (math.sqrt(s / (1 - b**self.steps)) + self.small)
            name, *at = place
            if not at:
                out[name] -= step
            elif len(at) == 1:
                out[name][at[0]] -= step
            else:
                out[name][at[0]][at[1]] -= step
        return out


class Network(NamedTuple):
    """What all epochs share: messages either way, and the first propagation."""

    features: list[str]
    forward: Messages
    backward: Messages
    inputs: DataFrame


def prepare(nodes: DataFrame, edges: DataFrame, features: Sequence[str], weighted: bool = True) -> Network:
    """Store messages for either direction, and the propagated input features,
    which no weight changes, in the same buckets."""
    forward = graph_messages(nodes, edges, features, weighted)
    inputs = _propagate(node_degrees(forward, features), forward, features)
    return Network(list(features), forward, turned_messages(forward), _kept(inputs, forward, "inputs"))


def _kept(nodes: DataFrame, messages: Messages, purpose: str) -> DataFrame:
    """Nodes stored in the buckets of the messages that reach them."""
    with joined_in_buckets(nodes.sparkSession):
        return stored_by(nodes, purpose, *BUCKETS, buckets=messages.buckets, placed=True)


def _positive(value: Column) -> Column:
    return F.when(value > 0, 1.0).otherwise(0.0)


def _outer(left: Sequence[str], right: Sequence[str], name: str) -> dict[tuple, Column]:
    return {(name, i, j): F.sum(F.col(a) * F.col(b)) for i, a in enumerate(left) for j, b in enumerate(right)}


def _each(columns: Sequence[str], name: str) -> dict[tuple, Column]:
    return {(name, j): F.sum(c) for j, c in enumerate(columns)}


def _sums(df: DataFrame, wanted: dict[tuple, Column]) -> dict[tuple, float]:
    """One row of sums, to the driver."""
    row = df.agg(*[c.alias(f"v{k}") for k, c in enumerate(wanted.values())]).first()
    return {place: float(row[k] or 0.0) for k, place in enumerate(wanted)}


def gradient(network: Network, targets: DataFrame, weights: dict) -> tuple[dict, float, float | None]:
    """Gradient of the mean squared error over the training graphs, that error,
    and the error of the validation graphs.

    ``targets``: structure_id, y and, optionally, ``split``: only ``train`` rows
    (all without the column) count for the gradient, ``val`` rows for the other
    error. Graphs without a target are left out.
    """
    keep, x = [*PLACE, "inv_sqrt_deg"], network.features
    hidden, h = _linear(network.inputs, keep, x, weights["w1"], weights["b1"], "h", True)
    # every node of the inputs is reached, by its own loop at least
    state = _kept(_propagate(hidden, network.forward, h), network.forward, "state")
    active, k = _linear(state, ["structure_id"], h, weights["w2"], weights["b2"], "k", True)
    pooled = active.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in k])
    score = F.lit(float(weights["b_out"]))
    for c, w in zip(k, weights["w_out"]):
        score = score + F.col(c) * float(w)
    split = F.col("split") if "split" in targets.columns else F.lit("train")
    wanted = targets.where(F.col("y").isNotNull()).select("structure_id", F.col("y").cast("double").alias("y"), split.alias("split"))
    graphs = stored(pooled.join(wanted, "structure_id").withColumn("error", score - F.col("y")), "graph_errors")
    train = graphs.where("split = 'train'")
    of = lambda s: F.when(F.col("split") == s, F.col("error") * F.col("error"))
    sizes = graphs.agg(F.count_if(F.col("split") == "train").alias("n"), F.avg(of("train")).alias("loss"), F.avg(of("val")).alias("val")).first()
    if not sizes["n"]:
        raise ValueError("no training graph has a target")
    scale = 2.0 / sizes["n"]
    found = {("b_out",): F.sum("error") * scale, **{("w_out", j): F.sum(F.col("error") * F.col(c)) * scale for j, c in enumerate(k)}}
    out = _sums(train, found)

    # back to the second layer's inputs; errors of graphs go to the blocks of
    # their nodes, and what is worked out from both is not stored
    blocks = network.inputs.select(*BUCKETS).distinct()
    errors = blocks.join(train.select("structure_id", "n", "error"), "structure_id").repartition(network.forward.buckets, *BUCKETS)
    share = F.col("error") * scale / F.col("n")
    before, z = _linear(state, [*keep, *h], h, weights["w2"], weights["b2"], "z", False)
    deltas = [(share * float(w) * _positive(F.col(c))).alias(f"d{j}") for j, (c, w) in enumerate(zip(z, weights["w_out"]))]
    d = [f"d{j}" for j in range(len(z))]
    delta = before.join(errors, BUCKETS).select(*keep, *h, *deltas)
    out |= _sums(delta, {**_outer(h, d, "w2"), **_each(d, "b2")})

    # back along the edges to the first layer
    back = [sum((F.col(d[j]) * float(weights["w2"][i][j]) for j in range(len(d))), F.lit(0.0)).alias(f"e{i}") for i in range(len(h))]
    e = [f"e{i}" for i in range(len(h))]
    reached = _propagate(delta.select(*keep, *back), network.backward, e).drop("inv_sqrt_deg")
    first, u = _linear(network.inputs, [*PLACE, *x], x, weights["w1"], weights["b1"], "u", False)
    steps = first.join(reached, PLACE).select(*x, *[(F.col(a) * _positive(F.col(b))).alias(f"g{j}") for j, (a, b) in enumerate(zip(e, u))])
    g = [f"g{j}" for j in range(len(u))]
    out |= _sums(steps, {**_outer(x, g, "w1"), **_each(g, "b1")})
    return out, sizes["loss"], sizes["val"]


def fit_gcn(
    nodes: DataFrame,
    edges: DataFrame,
    features: Sequence[str],
    targets: DataFrame,
    weights: dict,
    epochs: int = 5,
    rate: float = 0.001,
    weighted: bool = True,
) -> tuple[dict, list[Epoch]]:
    """Fit a two-layer network from given first ``weights`` (see ``gcn_score``)
    by Adam over whole epochs; the fitted weights and each epoch's losses.

    With validation graphs the weights of the epoch with the least validation
    error are returned, else the last ones. Inputs and messages are computed and
    stored once for all epochs.
    """
    network = prepare(nodes, edges, features, weighted)
    adam, history, best = Adam(rate), [], (math.inf, weights)
    for number in range(epochs):
        with joined_in_buckets(nodes.sparkSession):
            slopes, loss, validation = gradient(network, targets, weights)
        history.append(Epoch(number, loss, validation))
        if validation is not None and validation < best[0]:
            best = validation, weights
        weights = adam.update(weights, slopes)
    return (best[1] if best[0] < math.inf else weights), history


def first_weights(features: int, channels: int = 16, seed: int = 42) -> dict:
    """Small random weights in the usual range for the layer's size."""
    import random

    rng = random.Random(seed)

    def layer(rows: int, columns: int) -> list[list[float]]:
        bound = math.sqrt(6.0 / (rows + columns))
        return [[rng.uniform(-bound, bound) for _ in range(columns)] for _ in range(rows)]

    return {
        "w1": layer(features, channels),
        "b1": [0.0] * channels,
        "w2": layer(channels, channels),
        "b2": [0.0] * channels,
        "w_out": [row[0] for row in layer(channels, 1)],
        "b_out": 0.0,
    }
