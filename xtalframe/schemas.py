"""Explicit schemas of every named table.

Nothing in this package infers a schema from data. Descriptions and units are
kept as column metadata, readable through ``df.schema[name].metadata``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
}


def fields(text: str) -> T.StructType:
    """``"a string, b double"`` to a schema, without needing a session."""
    pairs = [item.split() for item in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


def _with(schema: T.StructType, **nested: T.DataType) -> T.StructType:
    """A schema with further nested fields at its end."""
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in nested.items()]])


NODES = T.ArrayType(
    fields("atomic_number int, electronegativity double, original_site_index int")
)
EDGES = T.ArrayType(fields("source_node_index int, target_node_index int, distance double"))

# Column names and their order are an interchange format shared
# with existing files.
_FEATURE_COLUMNS = [
    ("material_id", "string", "entry id, e.g. mp-123"),
    ("supercon_composition", "string", "composition the entry was matched to"),
    ("critical_temperature_tc", "double", "critical temperature, K"),
    ("band_gap_mp", "double", "band gap, eV"),
    ("formation_energy_per_atom_mp", "double", "formation energy, eV/atom"),
    ("is_metal", "boolean", "band gap is exactly zero; null when unknown"),
    ("dos_at_fermi", "double", "total density of states at the Fermi level, 1/eV"),
    ("formula_pretty", "string", "reduced formula"),
    ("num_elements", "int", "distinct elements"),
    ("elements", "string", "sorted symbols joined by a comma"),
    ("density_pg", "double", "density, g/cm3"),
    ("volume_pg", "double", "cell volume, A3"),
    ("volume_per_atom_pg", "double", "cell volume per site, A3"),
    ("spacegroup_number_pg", "int", "space group number"),
    ("crystal_system_pg", "string", "crystal system"),
    ("lattice_a_pg", "double", "cell length a, A"),
    ("lattice_b_pg", "double", "cell length b, A"),
    ("lattice_c_pg", "double", "cell length c, A"),
    ("lattice_alpha_pg", "double", "cell angle alpha, degrees"),
    ("lattice_beta_pg", "double", "cell angle beta, degrees"),
    ("lattice_gamma_pg", "double", "cell angle gamma, degrees"),
    ("num_sites_pg", "int", "sites in the cell"),
    ("target_band_gap", "double", "model target: band gap, eV"),
    ("target_formation_energy", "double", "model target: formation energy, eV/atom"),
    ("target_is_metal", "boolean", "model target: metal flag"),
    ("target_dos_at_fermi", "double", "model target: density of states, 1/eV"),
    ("graph_nodes", NODES, "atoms of the graph"),
    ("graph_edges", EDGES, "neighbour pairs of the graph"),
    ("num_graph_nodes", "bigint", "atoms in the graph"),
    ("num_graph_edges", "bigint", "neighbour pairs in the graph"),
]

# Header of a manually entered row.
MANUAL_ENTRY_COLUMNS = [
    "material_id",
    "band_gap_mp",
    "formation_energy_per_atom_mp",
    "is_metal",
    "dos_at_fermi",
    "formula_pretty",
    "num_elements",
    "elements",
    "density_pg",
    "volume_pg",
    "volume_per_atom_pg",
    "spacegroup_number_pg",
    "crystal_system_pg",
    "lattice_a_pg",
    "lattice_b_pg",
    "lattice_c_pg",
    "lattice_alpha_pg",
    "lattice_beta_pg",
    "lattice_gamma_pg",
    "num_sites_pg",
    "num_graph_nodes",
    "num_graph_edges",
    "target_band_gap",
    "target_formation_energy",
    "target_is_metal",
    "target_dos_at_fermi",
]


def _field(name: str, kind: str | T.DataType, comment: str) -> T.StructField:
    dtype = _TYPES[kind] if isinstance(kind, str) else kind
    return T.StructField(name, dtype, True, {"comment": comment})


FEATURES = T.StructType([_field(*c) for c in _FEATURE_COLUMNS])

MANUAL_ENTRY_TEXT = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in MANUAL_ENTRY_COLUMNS]
)

MANUAL_ENTRY = T.StructType([FEATURES[c] for c in MANUAL_ENTRY_COLUMNS])

TC_TABLE = fields("composition string, critical_temperature_tc double")

SITES = T.ArrayType(
    T.StructType(
        [
            T.StructField("species", T.ArrayType(fields("element string, occu double"))),
            T.StructField("xyz", T.ArrayType(T.DoubleType())),
        ]
    )
)

CANDIDATES = fields(
    "material_id string, formula_pretty string, nelements int, composition_reduced string, "
    "chemsys string, deprecated boolean, theoretical boolean, band_gap double, "
    "formation_energy_per_atom double, energy_above_hull double, volume double, density double"
)

ELEMENT_SET_ENTRY = _with(
    fields(
        "name string, entry_id bigint, spacegroup string, ntypes int, band_gap double, "
        "delta_e double, stability double, prototype string, icsd_id bigint"
    ),
    unit_cell=T.ArrayType(T.DoubleType()),
    sites=SITES,
)

PROCESSED_STRUCTURES = fields(
    "supercon_composition string, oqmd_entry_id bigint, oqmd_formula string, "
    "oqmd_spacegroup string, oqmd_delta_e double, oqmd_stability double, oqmd_band_gap double, "
    "oqmd_prototype string, oqmd_unit_cell_json string, oqmd_sites_json string, "
    "oqmd_icsd_id bigint"
)

DOS = _with(
    fields("efermi double"),
    energies=T.ArrayType(T.DoubleType()),
    densities=T.MapType(T.StringType(), T.ArrayType(T.DoubleType())),
)

PROPERTY_DOC = _with(
    fields(
        "material_id string, cif_string_mp string, spacegroup_number int, band_gap_mp double, "
        "band_gap double, formation_energy_per_atom_mp double, "
        "formation_energy_per_atom double, critical_temperature_tc double"
    ),
    dos_object_mp=DOS,
)

_FLOATS = T.ArrayType(T.FloatType())

GRAPH = T.StructType(
    [
        *fields("material_id string").fields,
        T.StructField("x", T.ArrayType(_FLOATS)),
        T.StructField("edge_index", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("edge_attr", T.ArrayType(_FLOATS)),
        T.StructField("y", _FLOATS),
        T.StructField("split", T.StringType()),
    ]
)

PREDICTIONS = fields("material_id string, y_true double, y_pred double")


def conform_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Force the columns of ``schema``: order, type and metadata.

    A column absent from ``df`` becomes a typed null, an extra one is dropped.
    A value that does not fit the type becomes null (``try_cast``), never an
    error in the middle of a job.
    """

    def one(field: T.StructField) -> Column:
        if field.name not in df.columns:
            value = F.lit(None).cast(field.dataType)
        elif df.schema[field.name].dataType == field.dataType:
            value = F.col(field.name)
        else:
            value = F.col(field.name).try_cast(field.dataType)
        return value.alias(field.name, metadata=field.metadata or {})

    return df.select([one(f) for f in schema.fields])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Return ``df`` unchanged, or raise ``ValueError`` naming the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}; found {df.columns}")
    return df
