"""Structures to atom graphs.

Two input forms. *Nested*: one row per structure, ``structure_id``, ``cell``
and ``sites`` (array of index, element, three fractions). *Rows*: one row per
site next to one row per cell.

Neighbour search is exact in both forms and avoids building all pairs of a
large structure:

* Nested structures of up to ``SMALL`` sites pair up within their own row: at
  most SMALL*(SMALL-1)/2 pairs, no join and no shuffle.
* Everything else is binned into a grid at least one cutoff wide and joined on
  (structure, bin) with the 27 surrounding bins. Distant pairs are never
  built, and the bins of one huge structure spread over many tasks; crowded
  bins are split further by a salt.

Both work on the reduced lattice, in which a fixed set of images has the nearest
one, however the cell is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xtalframe.elements import join_elements
from xtalframe.functions.lattice import METRIC, TURN, image_heights, min_image_squares, turned, with_reduced_lattice, wrap

CUTOFF = 3.0
SMALL = 64
BIN_LOAD = 4096

_EDGE = ["structure_id", "source_node_index", "target_node_index", "distance"]


def site_index(structures: DataFrame) -> DataFrame:
    """One row per site with its 0-based index, from nested structures."""
    return structures.select(
        "structure_id", F.posexplode("sites").alias("site_index", "site")
    ).select("structure_id", "site_index", "site.element", "site.frac")


def structure_nodes(structures: DataFrame) -> DataFrame:
    """One node per site: atomic number, electronegativity, site index.

    An unknown element has a null atomic number and electronegativity 0.0; a
    noble gas without a Pauling value has NaN.
    """
    return join_elements(site_index(structures)).select(
        "structure_id",
        F.col("site_index").alias("original_site_index"),
        "atomic_number",
        F.coalesce("electronegativity", F.lit(0.0)).alias("electronegativity"),
    )


def _within(pairs: DataFrame, cutoff: float) -> DataFrame:
    """Edges from pairs with columns p/q (structs idx, x, y, z) and the metric.

    The distance is built up over several selects whose columns are each used
    more than once, so the optimiser keeps them apart and every number is
    computed once, in generated methods small enough to be compiled. Passing
    it through a one-element ``explode`` keeps the filter above: pushed down,
    it would repeat the whole expression.
    """
    ids = ["structure_id", "source_node_index", "target_node_index"]
    nan = F.lit(float("nan"))
    differences = pairs.select(
        "structure_id",
        F.col("p.idx").alias("source_node_index"),
        F.col("q.idx").alias("target_node_index"),
        *[F.coalesce(m, nan).alias(m) for m in METRIC],
        *[F.coalesce(F.col(f"q.{c}") - F.col(f"p.{c}"), nan).alias(f"d{c}") for c in "xyz"],
    )
    kept = [*ids, *METRIC, "dx", "dy", "dz"]
    squares = differences.select(*kept, *[s.alias(f"s{i}") for i, s in enumerate(min_image_squares())])
    nearest = squares.select(*kept, F.least(*[f"s{i}" for i in range(9)]).alias("near"))
    distance = F.sqrt(F.greatest(F.col("near"), F.lit(0.0)))
    return nearest.select(*ids, F.explode(F.array(distance)).alias("distance")).where(
        F.col("distance") <= cutoff
    )


def _pairs_in_row(nested: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of each structure from its own ``sites``: ``structure_id``,
    ``lattice`` and ``sites``. Places are worked out for each pair, in compiled
    projections, rather than for each site in a lambda, which is not compiled.
    """
    turns = [F.col(f"lattice.{t}").alias(t) for t in TURN]
    numbers = nested.select("structure_id", *_metric(), *turns, "sites")
    kept = ["structure_id", *METRIC, *TURN]
    first = numbers.select(*kept, "sites", F.posexplode("sites").alias("at", "first"))
    rest = F.slice("sites", F.col("at") + 2, F.greatest(F.size("sites"), F.lit(1)))
    pairs = first.select(*kept, "at", "first", F.posexplode(rest).alias("after", "second"))
    lattice = {t: F.col(t) for t in TURN}
    p = _point(F.col("at"), *_fractions(F.col("first")), lattice)
    q = _point(F.col("at") + 1 + F.col("after"), *_fractions(F.col("second")), lattice)
    return _within(pairs.select("structure_id", *METRIC, p.alias("p"), q.alias("q")), cutoff)


def _steps(bins: Column) -> Column:
    """Offsets to the distinct neighbouring bins along a periodic axis."""
    return (
        F.when(bins == 1, F.array(F.lit(0)))
        .when(bins == 2, F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    )


def _pairs_on_grid(
    rows: DataFrame, cutoff: float, small: int = SMALL, bin_load: int = BIN_LOAD
) -> DataFrame:
    """Pairs by a join on (structure, bin, salt).

    ``rows``: structure_id, metric, ``n_sites`` and the point struct ``p``.
    Two sites within the cutoff are at most one bin apart on every axis, since
    a bin is at least one cutoff wide between its faces. The right side is
    repeated into the neighbouring bins, the left side stays where it is, so
    each pair meets once. Structures of at most ``small`` sites are one bin:
    nothing is repeated for them.
    """
    heights = image_heights()
    with_bins = rows.withColumns(
        {
            f"n{axis}": F.when(F.col("n_sites") <= small, F.lit(1)).otherwise(
                F.greatest(F.floor(h / (cutoff * (1 + 1e-9))), F.lit(1)).cast("int")
            )
            for axis, h in zip("xyz", heights)
        }
    )
    per_bin = F.col("n_sites") / (F.col("nx").cast("double") * F.col("ny") * F.col("nz"))
    binned = with_bins.select(
        "structure_id",
        *METRIC,
        "p",
        "nx",
        "ny",
        "nz",
        *[
            F.least(
                F.floor(F.col(f"p.{axis}") * F.col(f"n{axis}")).cast("int"), F.col(f"n{axis}") - 1
            ).alias(f"b{axis}")
            for axis in "xyz"
        ],
        F.greatest(F.ceil(per_bin / bin_load), F.lit(1)).cast("int").alias("salts"),
    )
    keys = ["structure_id", "bx", "by", "bz", "salt"]
    left = binned.select(
        "structure_id",
        "bx",
        "by",
        "bz",
        F.pmod(F.xxhash64("p.idx"), F.col("salts")).cast("int").alias("salt"),
        "p",
    )
    right = binned
    for axis in "xyz":
        right = right.withColumn("step", F.explode(_steps(F.col(f"n{axis}")))).withColumn(
            f"b{axis}", F.pmod(F.col(f"b{axis}") + F.col("step"), F.col(f"n{axis}"))
        )
    right = right.select(
        "structure_id",
        "bx",
        "by",
        "bz",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        *METRIC,
        F.col("p").alias("q"),
    )
    pairs = left.join(right, keys).where(F.col("p.idx") < F.col("q.idx"))
    return _within(pairs.select("structure_id", *METRIC, "p", "q"), cutoff)


def _metric() -> list[Column]:
    return [F.col(f"lattice.{m}").alias(m) for m in METRIC]


def _point(idx: Column, x: Column, y: Column, z: Column, lattice: Column | dict[str, Column] | None = None) -> Column:
    """A site in fractions of the reduced lattice, in columns beside it."""
    x, y, z = turned(F.col("lattice") if lattice is None else lattice, x, y, z)
    return F.struct(
        idx.alias("idx"), wrap(x).alias("x"), wrap(y).alias("y"), wrap(z).alias("z")
    )


def _fractions(site: Column) -> tuple[Column, Column, Column]:
    return site["frac"][0], site["frac"][1], site["frac"][2]


def structure_edges(
    structures: DataFrame,
    cutoff: float = CUTOFF,
    small: int = SMALL,
    symmetric: bool = False,
) -> DataFrame:
    """Neighbour pairs of nested structures: one edge per pair i < j whose
    shortest periodic distance is at most ``cutoff``; never a site with its own
    image. ``symmetric`` adds the reverse of every edge.
    """
    base = with_reduced_lattice(structures.where(F.col("cell").isNotNull() & (F.size("sites") > 1)).select("structure_id", "cell", "sites"))
    in_row = _pairs_in_row(base.where(F.size("sites") <= small), cutoff)
    large = base.where(F.size("sites") > small).select(
        "structure_id", "lattice", F.size("sites").alias("n_sites"), F.posexplode("sites").alias("at", "site")
    )
    point = _point(F.col("at"), *_fractions(F.col("site"))).alias("p")
    on_grid = _pairs_on_grid(large.select("structure_id", *_metric(), "n_sites", point), cutoff, small)
    edges = in_row.unionByName(on_grid)
    return symmetric_edges(edges) if symmetric else edges


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Edges in both directions, without a second scan of the input."""
    ends = F.array(
        F.struct(F.col("source_node_index").alias("s"), F.col("target_node_index").alias("t")),
        F.struct(F.col("target_node_index").alias("s"), F.col("source_node_index").alias("t")),
    )
    return edges.select("structure_id", F.explode(ends).alias("e"), "distance").select(
        "structure_id",
        F.col("e.s").alias("source_node_index"),
        F.col("e.t").alias("target_node_index"),
        "distance",
    )


def pair_join_within(
    sites: DataFrame, cells: DataFrame, cutoff: float = CUTOFF, small: int = SMALL
) -> DataFrame:
    """Neighbour pairs of structures given as rows.

    ``sites``: structure_id, idx (any ordered type), x, y, z. ``cells``:
    structure_id, cell. Site counts come from a pre-aggregated pass over the
    key column alone. The join that attaches a cell to its sites is followed by
    a shuffle on the grid key, so adaptive execution is free to split a
    structure that holds a large part of all rows; the grid key then spreads it.
    """
    counts = sites.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_sites"))
    several = cells.select("structure_id", "cell").join(counts, "structure_id").where(F.col("n_sites") > 1)
    sized = with_reduced_lattice(several).drop("cell")
    point = _point(F.col("idx"), F.col("x"), F.col("y"), F.col("z"))
    placed = sites.select("structure_id", "idx", "x", "y", "z").join(sized, "structure_id")
    return _pairs_on_grid(placed.select("structure_id", *_metric(), "n_sites", point.alias("p")), cutoff, small)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair, low index first, smallest distance kept.

    For edge lists from elsewhere; :func:`structure_edges` never repeats a pair.
    """
    low = F.least("source_node_index", "target_node_index")
    high = F.greatest("source_node_index", "target_node_index")
    return (
        edges.where(F.col("source_node_index") != F.col("target_node_index"))
        .select("structure_id", low.alias("source_node_index"), high.alias("target_node_index"), "distance")
        .groupBy("structure_id", "source_node_index", "target_node_index")
        .agg(F.min("distance").alias("distance"))
    )


def graph_counts(structures: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges per structure; a structure without edges counts 0."""
    per_structure = edges.groupBy("structure_id").agg(F.count(F.lit(1)).alias("num_edges"))
    nodes = structures.select(
        "structure_id", F.coalesce(F.size("sites"), F.lit(0)).cast("bigint").alias("num_nodes")
    )
    return nodes.join(per_structure, "structure_id", "left").select(
        "structure_id", "num_nodes", F.coalesce("num_edges", F.lit(0)).alias("num_edges")
    )


def composition_stats(structures: DataFrame) -> DataFrame:
    """Per structure: sites, distinct elements, sorted element list, total mass
    and element amounts.

    Sites are counted per element before anything is gathered, so a group
    holds at most one row per element of the periodic table. Structures with
    an unknown element have a null mass.
    """
    per_element = (
        structures.where(F.size("sites") > 0)
        .select("structure_id", F.explode("sites.element").alias("element"))
        .groupBy("structure_id", "element")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stats = join_elements(per_element).groupBy("structure_id").agg(
        F.sum("n").alias("num_sites"),
        F.count(F.lit(1)).cast("int").alias("num_elements"),
        F.array_sort(
            F.collect_list(
                F.struct(F.col("element").alias("symbol"), F.col("n").cast("double").alias("amount"))
            )
        ).alias("amounts"),
        F.sum(F.col("n") * F.col("atomic_mass")).alias("mass"),
        F.count_if(F.col("atomic_mass").isNull()).alias("unknown"),
    )
    return stats.select(
        "structure_id",
        "num_sites",
        "num_elements",
        F.transform("amounts", lambda a: a["symbol"]).alias("symbols"),
        "amounts",
        F.when(F.col("unknown") == 0, F.col("mass")).alias("total_mass"),
    )


def collect_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as one ordered array per structure."""
    node = F.struct(
        F.col("original_site_index"), F.col("atomic_number"), F.col("electronegativity")
    )
    return nodes.groupBy("structure_id").agg(
        F.transform(
            F.array_sort(F.collect_list(node)),
            lambda n: F.struct(
                n["atomic_number"].alias("atomic_number"),
                n["electronegativity"].alias("electronegativity"),
                n["original_site_index"].cast("int").alias("original_site_index"),
            ),
        ).alias("nodes")
    )


def collect_edges(edges: DataFrame) -> DataFrame:
    """Edges as one ordered array per structure."""
    edge = F.struct(
        F.col("source_node_index").cast("int").alias("source_node_index"),
        F.col("target_node_index").cast("int").alias("target_node_index"),
        F.col("distance"),
    )
    return edges.groupBy("structure_id").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def collect_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nested graphs: ``structure_id, nodes, edges``, one row per structure.

    For graphs that a reader takes whole. A nested graph is a row of memory, as
    its nested structure was; node and edge tables have no such bound.
    """
    joined = collect_nodes(nodes).join(collect_edges(edges), "structure_id", "left")
    none = F.array().cast(joined.schema["edges"].dataType)
    return joined.select("structure_id", "nodes", F.coalesce("edges", none).alias("edges"))
