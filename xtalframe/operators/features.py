"""Property documents to the flat feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xtalframe.elements import element_values
from xtalframe.functions.dos import dos_at_fermi, is_metal
from xtalframe.functions.formula import reduced_formula
from xtalframe.functions.lattice import (
    cell_volume,
    crystal_system,
    density,
    image_constants,
    pairs_within,
    turned,
    volume_per_atom,
    with_reduced_lattice,
    wrap,
)
from xtalframe.functions.once import compute_once
from xtalframe.functions.structure_text import cif_to_structure
from xtalframe.operators.clean import id_fallback
from xtalframe.operators.graph import (
    CUTOFF,
    SMALL,
    collect_edges,
    collect_nodes,
    composition_stats,
    structure_edges,
    structure_nodes,
)
from xtalframe.operators.graph_dataset import known_elements
from xtalframe.schemas import FEATURES, conform_schema


def derive_targets(df: DataFrame) -> DataFrame:
    """Copy the four properties to their ``target_*`` columns."""
    return df.withColumns(
        {
            "target_band_gap": F.col("band_gap_mp"),
            "target_formation_energy": F.col("formation_energy_per_atom_mp"),
            "target_is_metal": F.col("is_metal"),
            "target_dos_at_fermi": F.col("dos_at_fermi"),
        }
    )


def with_parsed_cif(docs: DataFrame, cif: str = "cif_string_mp") -> DataFrame:
    """Add ``cell`` and ``sites`` from CIF text; both null unless it parses."""
    parsed = compute_once(docs, {"_cif": cif_to_structure(F.col(cif))})
    return parsed.withColumns({"cell": F.col("_cif.cell"), "sites": F.col("_cif.sites")}).drop("_cif")


def property_columns(docs: DataFrame) -> DataFrame:
    """Gap, energy, metal flag and density of states; long field names win over
    the short ones."""

    def either(name: str, short: str) -> Column:
        return F.coalesce(*[F.col(c) for c in (name, short) if c in docs.columns])

    return docs.withColumns(
        {
            "band_gap_mp": either("band_gap_mp", "band_gap"),
            "formation_energy_per_atom_mp": either(
                "formation_energy_per_atom_mp", "formation_energy_per_atom"
            ),
            "dos_at_fermi": dos_at_fermi(F.col("dos_object_mp")),
        }
    ).withColumn("is_metal", is_metal(F.col("band_gap_mp")))


def _within_rows(base: DataFrame, cutoff: float, usable: Column) -> DataFrame:
    """Statistics, nodes and edges of structures of few sites, each from its own
    row: nothing is exploded or shuffled. Null where not ``usable``."""
    of = lambda s: s["element"]
    frac = lambda s: [s["frac"][k] for k in range(3)]
    sites = F.when(usable, F.col("sites"))
    rows = compute_once(with_reduced_lattice(base), {"_sites": sites})
    symbols = F.array_sort(F.array_distinct(F.transform("_sites", of)))
    point = lambda s: F.struct(*[wrap(v).alias(n) for n, v in zip("xyz", turned(F.col("lattice"), *frac(s)))])
    value = lambda s: element_values(s["element"])
    rows = compute_once(
        rows,
        {
            "symbols": symbols,
            "_points": F.transform("_sites", point),
            "_values": F.transform("_sites", value),
            "_images": image_constants("lattice"),
        },
    )
    amount = lambda e: F.size(F.filter("_sites", lambda s: s["element"] == e)).cast("double")
    amounts = F.transform("symbols", lambda e: F.struct(e.alias("symbol"), amount(e).alias("amount")))
    nodes = F.transform(
        "_values",
        lambda v, i: F.struct(
            v["atomic_number"].alias("atomic_number"),
            F.coalesce(v["electronegativity"], F.lit(0.0)).alias("electronegativity"),
            i.alias("original_site_index"),
        ),
    )
    rows = compute_once(rows, {"amounts": amounts, "graph_nodes": nodes, "graph_edges": pairs_within("_points", "_images", cutoff)})
    mass = F.aggregate("amounts", F.lit(0.0), lambda m, a: m + a["amount"] * element_values(a["symbol"])["atomic_mass"])
    return rows.withColumns(
        {
            "num_sites": F.size("_sites").cast("bigint"),
            "num_elements": F.size("symbols"),
            "total_mass": mass,
            "_edges": F.size("graph_edges").cast("bigint"),
        }
    ).drop("_sites", "_points", "_values", "_images", "lattice")


def _by_joins(base: DataFrame, cutoff: float) -> DataFrame:
    """The same for structures of any size, over site and edge rows."""
    key = "supercon_composition"
    structures = base.select(F.col(key).alias("structure_id"), "cell", "sites")
    named = lambda df: df.withColumnRenamed("structure_id", key)
    edges = named(collect_edges(structure_edges(structures, cutoff))).withColumnRenamed("edges", "graph_edges")
    nodes = named(collect_nodes(structure_nodes(structures))).withColumnRenamed("nodes", "graph_nodes")
    return (
        base.join(named(composition_stats(structures)), key, "left")
        .join(edges.withColumn("_edges", F.size("graph_edges").cast("bigint")), key, "left")
        .join(nodes, key, "left")
    )


def feature_table(docs: DataFrame, cutoff: float = CUTOFF, graphs: bool = True, small: int = SMALL) -> DataFrame:
    """One feature row per document, in the column order of ``FEATURES``.

    ``docs``: unique ``supercon_composition``, ``material_id``, ``cell``,
    ``sites``, ``spacegroup_number``, gap and energy, ``dos_object_mp``,
    ``critical_temperature_tc``. A missing structure, or one with an unknown
    element, nulls the structural columns only. ``graphs=False`` leaves the
    nested node and edge columns null and keeps the counts.

    Structures of up to ``small`` sites are worked out within their row, so such
    documents go through one map-only pass; larger ones go through site rows, a
    grid join and aggregates.
    """
    key = "supercon_composition"
    base = property_columns(id_fallback(docs, "material_id", key))
    usable = F.coalesce(F.col("cell").isNotNull() & (F.size("sites") > 0) & known_elements(F.col("sites")), F.lit(False))
    large = (F.size("sites") > small) & usable
    joined = _within_rows(base.where(~large), cutoff, usable).unionByName(_by_joins(base.where(large), cutoff), allowMissingColumns=True)
    if not graphs:
        joined = joined.withColumns({c: F.lit(None).cast(FEATURES[c].dataType) for c in ("graph_nodes", "graph_edges")})

    has = F.col("num_sites").isNotNull()
    cell = F.col("cell")
    lattice = {
        f"lattice_{k}_pg": F.when(has, cell[k]) for k in ("a", "b", "c", "alpha", "beta", "gamma")
    }
    filled = joined.withColumns(
        {
            "formula_pretty": reduced_formula(F.col("amounts")),
            "elements": F.array_join("symbols", ","),
            "volume_pg": F.when(has, cell_volume(cell)),
            "volume_per_atom_pg": F.when(has, volume_per_atom(cell, F.col("num_sites"))),
            "density_pg": density(F.col("total_mass"), cell_volume(cell)),
            "spacegroup_number_pg": F.when(has, F.col("spacegroup_number").cast("int")),
            "crystal_system_pg": F.when(has, crystal_system(F.col("spacegroup_number"))),
            "num_sites_pg": F.col("num_sites").cast("int"),
            "num_graph_nodes": F.col("num_sites"),
            "num_graph_edges": F.when(has, F.coalesce("_edges", F.lit(0))),
            **lattice,
        }
    )
    if graphs:
        none = F.array().cast(FEATURES["graph_edges"].dataType)
        filled = filled.withColumn("graph_edges", F.when(has, F.coalesce("graph_edges", none)))
    return conform_schema(derive_targets(filled), FEATURES)
