"""Golden cases for cleaning, candidates, documents, splits, metrics, models, sinks."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from xtalframe import schemas as SC
from xtalframe.functions import structure_text as ST
from xtalframe.functions.dos import dos_at_fermi
from xtalframe.operators import candidates as C
from xtalframe.operators import clean as CL
from xtalframe.operators import features as FE
from xtalframe.operators import graph_dataset as GD
from xtalframe.operators.gcn import graph_validate
from xtalframe.operators.graph import structure_edges
from xtalframe.operators import manual as MA
from xtalframe.operators import metrics as ME
from xtalframe.operators import models as MO
from xtalframe.operators import split as S
from xtalframe.session import shared_folder
from xtalframe.sources import graphs as GR
from xtalframe.sources import tables as IO


def test_clean_tc(spark):
    rows = [("Fe1", "1.5"), ("C1S1", "bad"), ("Si1", ""), (None, "3"), ("O2", "0"), ("O2", "-1"), ("H2", "1.0d"), ("N2", "NaN")]
    df = spark.createDataFrame(rows, "`chemical formula` string, `Tc (of this sample) recommended` string")
    assert [tuple(r) for r in CL.clean_tc(df).collect()] == [("Fe1", 1.5)]
    report = CL.clean_tc_report(df).first()
    assert tuple(report) == (8, 5, 2, 1, 1)
    with pytest.raises(ValueError, match="missing"):
        CL.clean_tc(df.drop("chemical formula"))


def test_top_n_keeps_duplicates(spark):
    df = spark.createDataFrame([("a", "2"), ("b", "5"), ("b", "5"), ("c", "x")], "composition string, tc string")
    assert [r["tc"] for r in CL.top_n_by_value(df, "tc", 2).collect()] == [5.0, 5.0]
    assert CL.top_n_by_value(df, "tc").count() == 3


MP = [
    (1, "mp-1", "Fe", 0.0, -0.1, False),
    (2, "mp-8", "Fe2", 0.0, -0.1, False),
    (3, "mp-9", "Fe", None, -9.0, False),
    (4, "mp-3", "Fe2O3", 0.2, -2.5, None),
    (5, "mp-4", "FeO", None, -9.5, False),
    (6, "mp-5", "Fe3O4", 0.0, -9.9, True),
    (7, "mp-6", "FeO", 0.2, -2.5, False),
]


def mp(spark):
    df = spark.createDataFrame(MP, "row_id int, material_id string, formula string, energy_above_hull double, formation_energy_per_atom double, deprecated boolean")
    return C.add_formula_keys(df, "formula")


def test_best_entry_mp(spark):
    comps = C.add_formula_keys(spark.createDataFrame([("Fe4",), ("O1Fe1",), ("O3Fe2",), ("Cu",), ("?",)], "composition string"), "composition")
    best = {r["composition"]: r["entry"] and r["entry"]["material_id"] for r in C.best_entry_mp(comps, mp(spark)).collect()}
    # null hull loses; equal energies go to the formula match, then to input order
    assert best == {"Fe4": "mp-1", "O1Fe1": "mp-6", "O3Fe2": "mp-3", "Cu": None, "?": None}
    pairs = C.join_candidates_chemsys(comps, mp(spark)).where("composition = 'O1Fe1'")
    assert {r["material_id"] for r in pairs.collect()} == {"mp-3", "mp-4", "mp-6"}
    assert {r[0] for r in C.candidate_ids(comps, mp(spark)).collect()} == {"mp-1", "mp-8", "mp-9", "mp-3", "mp-4", "mp-6"}


CELL6 = [5.0, 5.0, 5.0, 90.0, 90.0, 90.0]
SITE = {"species": [{"element": "Fe", "occu": 1.0}], "xyz": [0.0, 0.0, 0.0]}


def entry(i, delta_e=0.0, stability=0.0, cell=CELL6, sites=(SITE,)):
    return {"name": f"e{i}", "entry_id": i, "delta_e": delta_e, "stability": stability, "unit_cell": cell, "sites": list(sites)}


def test_best_entry_by_validity(spark):
    no_xyz = {"species": SITE["species"]}
    bad = [
        entry(1, -9, cell=CELL6[:5]),
        entry(2, -9, cell=["x"] * 6),
        entry(3, -9, sites=()),
        entry(4, -9, sites=(no_xyz,)),
        entry(5, -9, sites=({**SITE, "xyz": [0.0, 0.0]},)),
        entry(6, -9, sites=({**SITE, "species": []},)),
        entry(7, -9, sites=({**SITE, "species": [{"occu": 1.0}]},)),
    ]
    docs = {
        "win": bad + [entry(8, -1, None), entry(9, -1, 2.0), entry(10, None, 0.0)],
        "bad": bad,
        "none": None,
        "empty": [],
    }
    folder = shared_folder(spark, "lists")
    text = spark.createDataFrame([(json.dumps(docs),)], "value string")
    text.write.text(folder)
    from pyspark.sql import types as T

    read = IO.scan_doc_map(spark, folder, T.ArrayType(SC.ELEMENT_SET_ENTRY))
    rows = C.explode_entry_map(read.withColumnRenamed("doc", "entries"))
    best = {r["supercon_composition"]: r["oqmd_entry_id"] for r in C.best_entry_oqmd(rows).collect()}
    assert best == {"win": 9, "bad": None, "none": None, "empty": None}
    assert C.best_entry_oqmd(rows).columns == SC.PROCESSED_STRUCTURES.names


@pytest.mark.parametrize("mode", ["contains", "exact", "subset"])
def test_element_sets_against_brute_force(spark, mode):
    wanted = [("q1", ["O"]), ("q2", ["Fe", "O"]), ("q3", ["Ba", "O", "Ti"]), ("q4", ["Xe"]), ("q5", None)]
    have = [(1, ["O"]), (2, ["Fe", "O"]), (3, ["Ba", "O", "Ti"]), (4, ["Fe", "O", "Ti"]), (5, ["Ba", "O"]), (6, ["O"])]
    test = {"contains": lambda q, e: set(q) <= set(e), "exact": lambda q, e: q == e, "subset": lambda q, e: set(e) <= set(q)}[mode]
    expected = {(n, i) for n, q in wanted if q for i, e in have if test(q, e)}
    expected |= {(n, None) for n, q in wanted if not q or not any(test(q, e) for _, e in have)}
    got = C.join_candidates_elements(
        spark.createDataFrame(wanted, "composition string, elements array<string>"),
        spark.createDataFrame(have, "entry_id int, elements array<string>"),
        mode,
    )
    assert {(r["composition"], r["entry_id"]) for r in got.collect()} == expected


GRID = [-2.0, 0.5, 1.5, 4.0]
UP, DOWN = [1.0, 2.0, 4.0, 0.5], [0.25, 0.75, 0.25, 1.0]


def spectrum(fermi, *spins):
    return {"efermi": fermi, "energies": GRID, "densities": dict(zip(("1", "-1"), spins))}


# interpolated, both spins, on the grid, at its end, beyond it, without a level, absent
DOS = [
    (spectrum(0.9, UP), 2.8),
    (spectrum(0.9, UP, DOWN), 3.35),
    (spectrum(1.5, UP), 4.0),
    (spectrum(4.0, UP, DOWN), 1.5),
    (spectrum(9.0, UP), 0.0),
    (spectrum(None, UP), None),
    (None, None),
]


def test_dos(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(DOS)], "i int, t string")
    got = df.select("i", dos_at_fermi(ST.parse_dos(F.col("t"))).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [None if v is None else pytest.approx(v) for _, v in DOS]


def sites_json(*items):
    return json.dumps([{"species": [{"element": e, "occu": 1.0}], "xyz": list(x)} for e, x in items])


BOX = "[4.1, 4.3, 5.2, 90, 90, 90]"
PAIR = sites_json(("K", (0.1, 0.2, 0.3)), ("F", (0.6, 0.2, 0.3)))
PROCESSED = [
    (11, BOX, PAIR, 5.1, -6.4),
    (12, "[[4, 0, 0], [0, 5, 0], [0, 0, 6]]", sites_json(("Mg", (0, 0, 0)), ("O", (0.25, 0.2, 0.25))), 0.75, 0.3),
    (14, BOX, '[{"species": ', 0.9, 0.9),
    (15, "[2.6, 2.6, 2.6, 90, 90, 90]", sites_json(("Ni", (0.5, 0.5, 0.5))), float("nan"), 1.2),
    (17, " ", PAIR, 0.9, 0.9),
    (18, BOX, PAIR, None, -1.0),
]


def test_graph_dataset(spark):
    df = spark.createDataFrame(PROCESSED, "row_id bigint, oqmd_unit_cell_json string, oqmd_sites_json string, oqmd_band_gap double, oqmd_delta_e double")
    rows = GD.with_structure(S.unknown_ids(df, "row_id"))
    report = {r["status"]: r["n_rows"] for r in GD.skip_report(rows).collect()}
    assert report == {"ok": 3, "structure_json_parse_error": 1, "missing_structure_json": 1, "missing_targets": 1}
    graphs = GD.graph_rows(rows)
    got = {r["material_id"]: r for r in graphs.collect()}
    assert set(got) == {f"Unknown_ID_{i}" for i in (1, 2, 4)}
    assert got["Unknown_ID_1"]["y"] == [pytest.approx(5.1), pytest.approx(-3.2)]
    assert got["Unknown_ID_1"]["edge_index"] == [[0], [1]] and got["Unknown_ID_4"]["edge_index"] == [[], []]
    assert got["Unknown_ID_1"]["edge_attr"] == [[pytest.approx(2.05)]]
    assert got["Unknown_ID_2"]["edge_attr"] == [[pytest.approx(math.sqrt(4.25))]]
    assert got["Unknown_ID_2"]["x"] == [[12.0, pytest.approx(1.31)], [8.0, pytest.approx(3.44)]]
    assert math.isnan(got["Unknown_ID_4"]["y"][0])
    tables = GD.graph_tables(rows)
    folder = shared_folder(spark, "graphs")
    GR.sink_graph_dataset(tables, S.split_three_way(graphs.select("material_id"), "material_id", 0.4, 0.3, 0.3), folder)
    assert [GR.scan_graph_dataset(spark, folder, s).graphs.count() for s in ("train", "val", "test")] == [1, 1, 1]
    for table in GR.scan_graph_dataset(spark, folder, "val"):
        assert "PartitionFilters: [isnotnull(split" in table._jdf.queryExecution().executedPlan().toString()
    back = {r["material_id"]: r for r in GD.nested_graphs(GR.scan_graph_dataset(spark, folder)).drop("split").collect()}
    assert str(sorted(back.items())) == str(sorted(got.items()))  # NaN too
    one = GR.scan_graph(spark, folder, "Unknown_ID_1")
    assert one.graphs.first()["num_edges"] == one.edges.count() == 1 and one.nodes.count() == 2
    assert "PartitionFilters: [isnotnull(part" in one.edges._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="no graphs"):
        GR.scan_graph_dataset(spark, folder, "absent")


def test_ten_million_edges_of_one_graph(spark):
    """One graph beside small ones: stored in many files, each a bounded stretch
    of its nodes, and read back without a row that holds it."""
    n = 10_000_000
    node = lambda df: df.select(F.col("id").alias("node"), F.lit(26).alias("atomic_number"), F.lit(1.83).alias("electronegativity"))
    big, small = F.lit("big").alias("material_id"), F.concat(F.lit("g"), F.col("g")).alias("material_id")
    few = spark.range(50).withColumnRenamed("id", "g")
    nodes = node(spark.range(n // 10)).select(big, "*").unionByName(few.select(small, F.explode(F.array(F.lit(0), F.lit(1))).alias("node")).withColumns({"atomic_number": F.lit(8), "electronegativity": F.lit(3.44)}))
    edges = spark.range(n).select(big, F.floor(F.col("id") / 10).alias("source_node_index"), (F.floor(F.col("id") / 10) + F.col("id") % 10 + 1).alias("target_node_index"), F.lit(2.5).alias("distance"))
    edges = edges.unionByName(few.select(small, F.lit(0).alias("source_node_index"), F.lit(1).alias("target_node_index"), F.lit(1.5).alias("distance")))
    graphs = nodes.select("material_id").distinct().withColumn("y", F.array(F.lit(1.0).cast("float")))
    splits = graphs.select("material_id", F.when(F.col("material_id") == "big", "train").otherwise("test").alias("split"))
    folder = shared_folder(spark, "graphs")
    GR.sink_graph_dataset(GR.GraphTables(graphs, nodes, edges), splits, folder)
    one = GR.scan_graph(spark, folder, "big")
    assert one.graphs.select("num_nodes", "num_edges", "split").first() == (n // 10, n, "train")
    per_file = one.edges.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min("source_node_index").alias("a"), F.max("source_node_index").alias("b")).orderBy("a").collect()
    assert len(per_file) >= 4 and sum(r["n"] for r in per_file) == n and max(r["n"] for r in per_file) <= n // 2
    assert one.edges.agg(F.sum("target_node_index")).first()[0] == edges.where("material_id = 'big'").agg(F.sum("target_node_index")).first()[0]
    tests = GR.scan_graph_dataset(spark, folder, "test")
    assert tests.edges.count() == 50 and GD.nested_graphs(tests).count() == 50


def test_large_graph_stays_whole(spark):
    """1,500 sites: one row, and every edge through rows, sink, scan and check."""
    rng = random.Random(4)
    sites = sites_json(*[("Fe", tuple(rng.random() for _ in range(3))) for _ in range(1500)])
    df = spark.createDataFrame([("big", "[22, 23, 24, 90, 90, 90]", sites, 1.0, -1.0), ("small", BOX, PAIR, 1.0, -1.0)], "material_id string, oqmd_unit_cell_json string, oqmd_sites_json string, oqmd_band_gap double, oqmd_delta_e double")
    rows = GD.with_structure(df)
    structures = rows.select(F.col("material_id").alias("structure_id"), "cell", "sites")
    n_edges = {r["structure_id"]: r["count"] for r in structure_edges(structures).groupBy("structure_id").count().collect()}
    folder = shared_folder(spark, "graphs")
    GR.sink_graph_dataset(GD.graph_tables(rows), rows.select("material_id", F.lit("train").alias("split")), folder)
    kept = graph_validate(GD.nested_graphs(GR.scan_graph_dataset(spark, folder))).collect()
    assert {r["material_id"]: (len(r["x"]), len(r["edge_attr"])) for r in kept} == {"big": (1500, n_edges["big"]), "small": (2, 1)}
    assert n_edges["big"] > 1500


@pytest.mark.parametrize(
    ("n", "ratios", "sizes"),
    [
        (4, (0.5, 0.25, 0.25), (2, 1, 1)),
        (10, (0.7, 0.2, 0.1), (6, 2, 2)),
        (100, (0.7, 0.2, 0.1), (69, 20, 11)),
        (15000, (0.7, 0.2, 0.1), (10499, 3000, 1501)),
        (1000, (0.6, 0.2, 0.2), (600, 200, 200)),
        (7, (1.0, 0.0, 0.0), (7, 0, 0)),
    ],
)
def test_split_sizes(spark, n, ratios, sizes):
    parts = S.split_three_way(spark.range(n), "id", *ratios)
    counts = {r["split"]: r["n_rows"] for r in S.split_counts(parts).collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == sizes
    assert parts.select("id").distinct().count() == n


def test_split_is_repeatable_and_seeded(spark):
    one = {r["id"]: r["split"] for r in S.split_three_way(spark.range(500).repartition(7), "id").collect()}
    two = {r["id"]: r["split"] for r in S.split_three_way(spark.range(0, 500, 1, 3), "id").collect()}
    other = {r["id"]: r["split"] for r in S.split_three_way(spark.range(500), "id", seed=1).collect()}
    assert one == two != other
    assert S.split_two_way(spark.range(1), "id").first()["split"] == "train"


@pytest.mark.parametrize("numbered", [S.split_three_way, S.split_two_way, S.row_ids])
def test_null_keys_are_refused(spark, numbered):
    df = spark.createDataFrame([(k if k % 7 else None,) for k in range(1, 21)], "id bigint")
    with pytest.raises(Exception, match="null in key column id"):
        numbered(df, "id").collect()


def test_row_ids(spark):
    df = spark.createDataFrame([(k * k - 50,) for k in range(300)], "k bigint").repartition(5)
    got = {r["k"]: r["row_number"] for r in S.row_ids(df, "k").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(got))}


def test_row_ids_of_text_and_several_columns(spark):
    rows = [(f"k{(i * 37) % 1000:03d}", -i % 3, {"a": i}) for i in range(1000)]
    df = spark.createDataFrame(rows, "a string, b bigint, m map<string,bigint>").repartition(7)
    by_text = {r["a"]: (r["n"], r["m"]) for r in S.row_ids(df, "a", "n").collect()}
    assert by_text == {a: (i + 1, m) for i, (a, _, m) in enumerate(sorted(rows, key=lambda r: r[0]))}
    by_two = {(r["b"], r["a"]): r["n"] for r in S.row_ids(df, ["b", "a"], "n").collect()}
    assert by_two == {k: i + 1 for i, k in enumerate(sorted(by_two))}
    assert S.row_ids(df.limit(0), "a").collect() == []


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 3.0, 3.0), ("d", 4.0, 6.0)], SC.PREDICTIONS)
    m = ME.regression_metrics(df).first()
    assert (m["n"], m["mae"], m["rmse"], m["r2"]) == (4, 0.5, 1.0, pytest.approx(0.2))
    assert tuple(ME.top_errors(df, 1).first()) == ("d", 4.0, 6.0, 2.0)
    base = ME.baseline_compare(df, df).first()
    assert (base["baseline_mae"], base["baseline_rmse"]) == (1.0, pytest.approx(1.118034, abs=1e-6))
    assert ME.baseline_compare(df.drop("y_pred"), df).first()["model_mae"] is None
    c = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "label int, pred int")
    got = ME.classification_metrics(c).first()
    assert (got["accuracy"], got["f1_weighted"]) == (pytest.approx(0.6), pytest.approx((0.5 * 2 + 0.8 * 2 + 0) / 5))


def test_manual_rows(spark):
    good = {"material_id": " m-1 ", "target_band_gap": "1.5", "target_formation_energy": "-1", "target_is_metal": "True", "is_metal": "N/A", "num_elements": "2"}
    rows = [good, {**good, "material_id": " "}, {**good, "target_is_metal": "N/A"}, {**good, "density_pg": "x", "target_band_gap": ""}]
    df = spark.createDataFrame([tuple(r.get(c) for c in SC.MANUAL_ENTRY_COLUMNS) for r in rows], SC.MANUAL_ENTRY_TEXT)
    checked = MA.validate_manual_row(df)
    assert [r["reasons"] for r in checked.collect()] == [
        [],
        ["material_id is required"],
        ["target_is_metal is required"],
        ["target_band_gap is required", "density_pg is not a number"],
    ]
    ok = MA.accepted(checked)
    assert ok.columns == SC.MANUAL_ENTRY_COLUMNS and ok.first()["material_id"] == "m-1"


DOCS = [
    ("Cu-full", {"material_id": "mp-9", "band_gap_mp": 0.35, "dos_object_mp": spectrum(0.9, UP), "critical_temperature_tc": 7.1}),
    ("Pb-null", None),
    ("Zn-bare", {"material_id": "mp-77", "band_gap": 0.0, "critical_temperature_tc": 21.0}),
    ("Hg-anon", {"material_id": "", "band_gap_mp": 2.2}),
]

CIF = """data_Cu
_symmetry_space_group_name_H-M   'P 1'
_cell_length_a   3.61(2)
_cell_length_b   3.61
_cell_length_c   3.61
_cell_angle_alpha   90.0
_cell_angle_beta   90.0
_cell_angle_gamma   90.0
loop_
 _symmetry_equiv_pos_site_id
 _symmetry_equiv_pos_as_xyz
  1  'x, y, z'
loop_
 _atom_site_type_symbol
 _atom_site_label
 _atom_site_fract_x
 _atom_site_fract_y
 _atom_site_fract_z
 _atom_site_occupancy
  Cu  Cu0  0.0  0.0  0.0  1
  Cu  Cu1  0.5  0.5  0.0  1
  Cu  Cu2  0.5  0.0  0.5  1
  Cu  Cu3  0.0  0.5  0.5  1
"""


def test_feature_table(spark):
    docs = [(k, d if d is None else {**d, "cif_string_mp": CIF if k == "Cu-full" else None, "spacegroup_number": 225}) for k, d in DOCS]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("supercon_composition", T.StringType()), T.StructField("doc", SC.PROPERTY_DOC)])
    flat = spark.createDataFrame(docs, schema).where("doc IS NOT NULL").select("supercon_composition", "doc.*")
    table = FE.feature_table(FE.with_parsed_cif(flat))
    assert table.columns == SC.FEATURES.names
    got = {r["supercon_composition"]: r for r in table.collect()}
    cu = got["Cu-full"]
    assert (cu["formula_pretty"], cu["elements"], cu["num_sites_pg"], cu["crystal_system_pg"]) == ("Cu", "Cu", 4, "cubic")
    assert cu["density_pg"] == pytest.approx(8.97, abs=0.01)
    assert cu["num_graph_edges"] == 6 and len(cu["graph_edges"]) == 6 and len(cu["graph_nodes"]) == 4
    assert (cu["dos_at_fermi"], cu["is_metal"], cu["target_band_gap"]) == (pytest.approx(2.8), False, 0.35)
    missing = got["Zn-bare"]
    assert missing["is_metal"] is True and missing["volume_pg"] is None and missing["num_graph_nodes"] is None
    assert got["Hg-anon"]["material_id"] == "no_mpid_Hg-anon"
    folder = shared_folder(spark, "features")
    IO.sink_table(table, folder, SC.FEATURES)
    header = spark.read.text(folder).where("value LIKE 'material_id,%'").first()[0]
    assert header.split(",") == SC.FEATURES.names


def test_empty_table_keeps_header(spark):
    folder = shared_folder(spark, "empty")
    IO.sink_table(spark.createDataFrame([], SC.TC_TABLE), folder)
    assert spark.read.text(folder).first()[0] == "composition,critical_temperature_tc"
    assert IO.scan_csv(spark, folder, SC.TC_TABLE).count() == 0
    with pytest.warns(UserWarning, match="cannot read"):
        assert IO.scan_csv(spark, folder + "-absent", SC.TC_TABLE).count() == 0


def test_cif_variants(spark):
    texts = [CIF, CIF.replace("'P 1'", "'Fm-3m'"), CIF.replace("3.61(2)", "?"), None, CIF.replace("'x, y, z'", "'-x, -y, -z'")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", ST.cif_to_structure(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r["r"]["status"] for r in got] == ["ok", "unsupported_symmetry", "parse_error", "missing", "ok"]
    assert [s["frac"] for s in got[0]["r"]["sites"]][1] == [0.5, 0.5, 0.0]


def test_cif_is_read_once(spark):
    """Every word and tag is looked up once, and by no search that ends in an
    exception; what words and tags mean stays."""
    tree = str(ST.cif_to_structure(F.col("t")))
    assert "array_position" not in tree
    assert tree.count("_cell_length_a") == 1 and tree.count("_space_group_IT_number") <= 1
    head = "data_x\r\n" + "".join(f"_cell_length_{n} 4(1)\r\n" for n in "abc") + "".join(f"_cell_angle_{n} 90.\r\n" for n in ("alpha", "beta", "gamma"))
    tags = ["_atom_site_fract_x", "_atom_site_fract_x", "_ATOM_site_fract_y", "_atom_site_label", "_atom_site_fract_z"]
    text = head + "loop_\r\n" + "\r\n".join(tags) + "\r\n 0.5(2)\t1.0  .25 Fe2+\t-1e-1 \r\n# none\r\n0 0 x O1 0\r\n"
    got = spark.createDataFrame([(0, text), (1, text.replace("0 0 x O1 0", "_other 1"))], "i int, t string").select("i", ST.cif_to_structure(F.col("t")).alias("r"))
    bad, good = [r["r"] for r in got.orderBy("i").collect()]
    assert bad["status"] == "parse_error" and bad["sites"] is None
    assert good["status"] == "ok" and tuple(good["cell"]) == (4.0, 4.0, 4.0, 90.0, 90.0, 90.0)
    assert [tuple(s) for s in good["sites"]] == [(0, "Fe", [0.5, 0.25, -0.1])]


def cif_with(operations, sites, group="'F m -3 m'"):
    lines = "\n".join(f"  {k + 1} '{o}'" for k, o in enumerate(operations))
    atoms = "\n".join(f"  {e}{k} {e} {x} {y} {z}" for k, (e, x, y, z) in enumerate(sites))
    cell = "\n".join(f"_cell_length_{n} 5.0" for n in "abc") + "\n" + "\n".join(f"_cell_angle_{n} 90" for n in ("alpha", "beta", "gamma"))
    return (
        f"data_x\n_symmetry_space_group_name_H-M {group}\n{cell}\nloop_\n _symmetry_equiv_pos_site_id\n _symmetry_equiv_pos_as_xyz\n{lines}\n"
        f"loop_\n _atom_site_label\n _atom_site_type_symbol\n _atom_site_fract_x\n _atom_site_fract_y\n _atom_site_fract_z\n{atoms}\n"
    )


def test_symmetry_operations(spark):
    shifts = [(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)]
    word = {0: "", 0.5: "+1/2"}
    face = [f"x{word[a]},y{word[b]},z{word[c]}" for a, b, c in shifts]
    both = face + [f"-X{word[a]}, 1/2-y, -z{word[c]}" if b else f"-x{word[a]},-y,-z{word[c]}" for a, b, c in shifts]
    texts = [
        cif_with(face, [("Na", 0, 0, 0), ("Cl", 0.5, 0.5, 0.5)]),
        cif_with(both, [("Na", 0, 0, 0), ("O", 0.1, 0.2, 0.3)]),
        cif_with(["x,y,z", "x-y, x, z+0.25", "-z,2*x,1/3+y"], [("Fe", 0.1, 0.7, 0.9999999)]),
        cif_with(["x,y,z", "x,y"], [("Fe", 0, 0, 0)]),
        cif_with(["x,y,z", "x,y,z+1/0"], [("Fe", 0, 0, 0)]),
        cif_with(["x,y,z"], [("Fe", 1.25, -0.25, 0)], "'P 1'"),
        cif_with(["x,y,z"], [("Fe", 0, 0, 0)]),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["r"] for r in df.select("i", ST.cif_to_structure(F.col("t")).alias("r")).orderBy("i").collect()]
    assert [r["status"] for r in got] == ["ok", "ok", "ok", "parse_error", "parse_error", "ok", "unsupported_symmetry"]
    salt = [(s["element"], tuple(s["frac"])) for s in got[0]["sites"]]
    assert salt == [("Na", s) for s in shifts] + [("Cl", tuple((0.5 + x) % 1 for x in s)) for s in shifts]
    oxygen = [s["frac"] for s in got[1]["sites"] if s["element"] == "O"]
    assert [s["idx"] for s in got[1]["sites"]] == list(range(12)) and len(oxygen) == 8
    assert oxygen[5] == [pytest.approx(0.9), pytest.approx(0.3), pytest.approx(0.2)]
    assert [s["frac"] for s in got[2]["sites"]] == [
        [pytest.approx(0.1), pytest.approx(0.7), pytest.approx(0.9999999)],
        [pytest.approx(0.4), pytest.approx(0.1), pytest.approx(0.2499999)],
        [pytest.approx(0.0000001, abs=1e-6), pytest.approx(0.2), pytest.approx(1 / 30)],
    ]
    assert [s["frac"] for s in got[5]["sites"]] == [[1.25, -0.25, 0.0]]  # as written


def test_tsv(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("#meta\nname\tchemical formula\ttc\na\tFe1\t1.5\nb\t\t2\n")
    df = IO.scan_tsv_preamble(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [("a", "Fe1", "1.5"), ("b", None, "2")]


def test_preparation_and_models(spark):
    rows = [
        (f"m{i}", float(i % 3), float(i), None if i == 4 else i * 0.5, None, "Fe" if i % 2 else "O", "cubic" if i % 3 else None, 0.1 * i, -0.2 * i, i % 2 == 0, 1.0 * i)
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, "material_id string, num_elements double, density_pg double, volume_pg double, lattice_a_pg double, elements string, crystal_system_pg string, target_band_gap double, target_formation_energy double, target_is_metal boolean, target_dos_at_fermi double")
    numeric = ["num_elements", "density_pg", "volume_pg", "lattice_a_pg"]
    scaled = MO.numeric_prep(df, df, numeric)
    stats = scaled.agg(F.avg("volume_pg"), F.stddev_pop("volume_pg")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)
    assert MO.most_frequent(df, "elements").first()["value"] == "Fe"
    prep, gap, metrics = MO.fit_main_regressor(df, "target_band_gap", numeric=numeric)
    assert metrics.first()["n"] == 8 and metrics.first()["mae"] < 1
    unseen = prep.transform(df.limit(1).withColumn("elements", F.lit("Zz"))).first()["features"]
    assert unseen.size == 3 + 2 + 1  # the column without values is left out
    assert list(unseen.toArray()[3:5]) == [0.0, 0.0]
    dos_prep, dos, _ = MO.fit_dos_regressor(df, numeric=numeric)
    _, metal, _ = MO.fit_metal_classifier(df, prep=prep)
    models = MO.PropertyModels(main=prep, band_gap=gap, is_metal=metal, dos_prep=dos_prep, dos=dos)
    folder = shared_folder(spark, "models")
    MO.save_models(models, folder)
    back = MO.load_models(folder)
    assert back.main.numeric == prep.numeric and back.main.modes == prep.modes and back.main.sizes == prep.sizes
    again = back.main.transform(df).select("material_id", F.col("features").alias("f"))
    assert again.join(prep.transform(df), "material_id").where("f != features").count() == 0
    for r in MO.score_properties(df, models).collect():
        assert (r["predicted_dos_at_fermi"] is not None) == r["predicted_is_metal"]
        assert r["predicted_formation_energy"] is None and 0.5 <= r["predicted_probability"] <= 1


def test_wide_category_dictionary(spark):
    """Far more categories than rows a partition: places follow the order of the
    values, nothing but their number reaches the driver, and a category that a
    third of the rows share costs no more than its rows."""
    n = 200_000
    name = F.concat(F.lit("e"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("string"), 12, "0"))
    train = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(name).alias("elements"))
    prep = MO.fit_preprocessor(train, [], ["elements"])
    assert prep.modes == {"elements": "hot"} and prep.width == train.select("elements").distinct().count()
    order = prep.dictionaries["elements"].orderBy("value").select("position").collect()
    assert [r[0] for r in order] == list(range(prep.width))
    test = train.limit(50).unionByName(spark.createDataFrame([(-1, "never seen"), (-2, None)], "id bigint, elements string"))
    vectors = {r["id"]: r["features"] for r in prep.transform(test).collect()}
    assert {v.size for v in vectors.values()} == {prep.width} and len(vectors[-1].indices) == 0
    assert vectors[-2] == vectors[0] and list(vectors[0].values) == [1.0] and list(vectors[0].indices) == [prep.width - 1]
