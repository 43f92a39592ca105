"""Processed structure rows to a graph dataset with status, targets and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xtalframe.elements import SYMBOLS
from xtalframe.functions.dos import energy_per_site
from xtalframe.functions.lattice import cell_volume
from xtalframe.functions.once import compute_once
from xtalframe.functions.structure_text import checked_sites, parse_cell
from xtalframe.operators.graph import collect_graph, structure_edges, structure_nodes
from xtalframe.schemas import SITES
from xtalframe.session import stored
from xtalframe.sources.graphs import GraphTables

OK = "ok"


def known_elements(sites: Column) -> Column:
    """Whether there are sites and every one holds a known element."""
    return (F.size(sites) > 0) & F.forall(sites, lambda s: F.coalesce(s["element"].isin(*SYMBOLS), F.lit(False)))


def with_structure(rows: DataFrame) -> DataFrame:
    """Parse cell and sites text and add ``status``, first match wins:

    ``missing_structure_json``, ``structure_json_parse_error`` (no JSON, wrong
    shape or length, no numbers, no species), ``structure_creation_error`` (a
    site without element or coordinates, a cell without volume),
    ``processing_error`` (unknown element), ``missing_targets`` (null; NaN is
    a value), ``ok``. No row is dropped.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    incomplete = lambda s: (
        s["xyz"].isNull() | F.try_element_at(s["species"], F.lit(1))["element"].isNull()
    )
    listed = lambda raw: F.struct(
        F.coalesce(
            (F.size(raw) > 0)
            & F.forall(raw, lambda s: F.coalesce(F.size(s["species"]) > 0, F.lit(False))),
            F.lit(False),
        ).alias("listed"),
        F.coalesce(F.exists(raw, incomplete), F.lit(False)).alias("incomplete"),
    )
    # the text of the sites is read once for what it lists and for the sites
    read = compute_once(rows, {"cell": parse_cell(F.col("oqmd_unit_cell_json")), "_raw": F.from_json("oqmd_sites_json", SITES)})
    cells = compute_once(read, {"sites": checked_sites(F.col("_raw")), "_shape": listed(F.col("_raw"))}).drop("_raw")
    flat = ~(cell_volume(F.col("cell")) > 0) | F.isnan(cell_volume(F.col("cell")))
    status = (
        F.when(blank("oqmd_unit_cell_json") | blank("oqmd_sites_json"), "missing_structure_json")
        .when(F.col("cell").isNull() | ~F.col("_shape.listed"), "structure_json_parse_error")
        .when(F.col("_shape.incomplete") | flat, "structure_creation_error")
        .when(F.col("sites").isNull(), "structure_json_parse_error")
        .when(~known_elements(F.col("sites")), "processing_error")
        .when(
            F.col("oqmd_band_gap").isNull() | F.col("oqmd_delta_e").isNull(), "missing_targets"
        )
        .otherwise(OK)
    )
    return compute_once(cells, {"status": status}).drop("_shape")


def skip_report(with_status: DataFrame) -> DataFrame:
    """Rows per status."""
    return with_status.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


def graph_targets(with_status: DataFrame) -> DataFrame:
    """Add ``y``: band gap and formation energy per site."""
    energy = energy_per_site(F.col("oqmd_delta_e"), F.size("sites"))
    return with_status.withColumn("y", F.array(F.col("oqmd_band_gap"), energy))


def graph_tables(with_status: DataFrame, cutoff: float = 3.0, symmetric: bool = False) -> GraphTables:
    """Graphs, nodes and edges of all ``ok`` structures, as rows.

    ``material_id`` must be unique. The targets ``y`` are band gap and formation
    energy per site. Parsed structures are stored, so that their text is read
    and parsed once for the three tables.
    """
    ok = graph_targets(with_status.where(F.col("status") == OK)).select(F.col("material_id").alias("structure_id"), "cell", "sites", "y")
    ok = stored(ok, "structures")
    nodes = structure_nodes(ok).select(
        F.col("structure_id").alias("material_id"), F.col("original_site_index").alias("node"), "atomic_number", "electronegativity"
    )
    edges = structure_edges(ok, cutoff, symmetric=symmetric).withColumnRenamed("structure_id", "material_id")
    targets = F.transform("y", lambda v: v.cast("float")).alias("y")
    return GraphTables(ok.select(F.col("structure_id").alias("material_id"), targets), nodes, edges)


def nested_graphs(tables: GraphTables) -> DataFrame:
    """An export for readers that take a graph whole: one tensor-shaped row each.

    ``x``: [atomic number, electronegativity] per node; ``edge_index``: sources
    and targets; ``edge_attr``: one distance per edge; ``y``, and ``split`` where
    there is one. No edges gives empty arrays. A nested graph is a row of
    memory; the tables have no such bound.
    """
    nodes = tables.nodes.select(
        F.col("material_id").alias("structure_id"), F.col("node").alias("original_site_index"), "atomic_number", "electronegativity"
    )
    graphs = collect_graph(nodes, tables.edges.select("source_node_index", "target_node_index", "distance", F.col("material_id").alias("structure_id")))
    as_floats = lambda *v: F.array(*[x.cast("float") for x in v])
    kept = [c for c in ("y", "split") if c in tables.graphs.columns]
    return graphs.join(tables.graphs.select(F.col("material_id").alias("structure_id"), *kept), "structure_id").select(
        F.col("structure_id").alias("material_id"),
        F.transform(
            "nodes", lambda n: as_floats(n["atomic_number"], n["electronegativity"])
        ).alias("x"),
        F.array(
            F.transform("edges", lambda e: e["source_node_index"].cast("bigint")),
            F.transform("edges", lambda e: e["target_node_index"].cast("bigint")),
        ).alias("edge_index"),
        F.transform("edges", lambda e: as_floats(e["distance"])).alias("edge_attr"),
        *kept,
    )


def graph_rows(with_status: DataFrame, cutoff: float = 3.0, symmetric: bool = False) -> DataFrame:
    """Nested rows of all ``ok`` structures."""
    return nested_graphs(graph_tables(with_status, cutoff, symmetric))
