"""Neighbour search, lattice and network scoring against brute force."""

import copy
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from xtalframe.functions import lattice as L
from xtalframe.functions import structure_text as ST
from xtalframe.operators import gcn as N
from xtalframe.operators import gcn_fit as GF
from xtalframe.session import joined_in_buckets
from xtalframe.operators import graph as G

SCHEMA = (
    "structure_id string, cell struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>, "
    "sites array<struct<idx:int,element:string,frac:array<double>>>"
)


def structure(name, cell, sites):
    return (name, tuple(map(float, cell)), [(i, e, [float(v) for v in f]) for i, (e, f) in enumerate(sites)])


SQUARE = (90, 90, 90)
OBLIQUE = (2.574, 4.36, 9.696, 90, 133.95, 90)
GOLDEN = [
    structure("alone", (6, 6.5, 9, *SQUARE), [("Ar", (0.3, 0.3, 0.3))]),
    structure("thin", (1.9, 5, 5.5, *SQUARE), [("Pb", (0.2, 0.4, 0.6))]),  # its own image is near
    structure("far", (5, 6, 7, *SQUARE), [("K", (0.1, 0.2, 0.3)), ("Br", (0.6, 0.7, 0.8))]),
    structure("bond", (4, 5, 6, *SQUARE), [("Mg", (0.1, 0.1, 0.1)), ("O", (0.5, 0.4, 0.3))]),
    structure("across", (7, 7.5, 8, *SQUARE), [("Ti", (0.05, 0.5, 0.5)), ("Ti", (0.9, 0.5, 0.4))]),
    structure("outside", (6, 6, 6, *SQUARE), [("Zn", (1.25, -0.5, 2.0)), ("S", (0.5, 0.75, 0.125))]),
]


def matrix(cell):
    a, b, c, al, be, ga = cell
    al, be, ga = map(math.radians, (al, be, ga))
    star = (math.cos(al) * math.cos(be) - math.cos(ga)) / (math.sin(al) * math.sin(be))
    star = math.acos(star)
    return np.array(
        [
            [a * math.sin(be), 0, a * math.cos(be)],
            [-b * math.sin(al) * math.cos(star), b * math.sin(al) * math.sin(star), b * math.cos(al)],
            [0, 0, c],
        ]
    )


def brute(row, cutoff=3.0):
    _, cell, sites = row
    m, out = matrix(cell), {}
    f = [np.array(s[2]) - np.floor(s[2]) for s in sites]
    images = np.array(list(itertools.product(range(-5, 6), repeat=3))) @ m
    for i, j in itertools.combinations(range(len(f)), 2):
        d = float(np.sqrt((((f[j] - f[i]) @ m + images) ** 2).sum(1).min()))
        if d <= cutoff:
            out[(i, j)] = d
    return out


def edges_of(df):
    out = {}
    for r in df.collect():
        key = (r["source_node_index"], r["target_node_index"])
        assert key not in out.setdefault(r["structure_id"], {})
        out[r["structure_id"]][key] = r["distance"]
    return out


def random_structure(name, n, cell, seed):
    rng = random.Random(seed)
    return structure(name, cell, [("Fe", [rng.uniform(-1, 2) for _ in range(3)]) for _ in range(n)])


def test_golden_edges_and_nodes(spark):
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    got = edges_of(G.structure_edges(df))
    expected = {"bond": math.sqrt(1.6**2 + 1.5**2 + 1.2**2), "across": math.sqrt(1.05**2 + 0.8**2), "outside": math.sqrt(1.5**2 + 1.5**2 + 0.75**2)}
    assert got == {k: {(0, 1): pytest.approx(d, abs=1e-9)} for k, d in expected.items()}
    nodes = {(r["structure_id"], r["original_site_index"]): r for r in G.structure_nodes(df).collect()}
    assert nodes[("alone", 0)]["atomic_number"] == 18
    assert math.isnan(nodes[("alone", 0)]["electronegativity"])
    counts = {r["structure_id"]: (r["num_nodes"], r["num_edges"]) for r in G.graph_counts(df, G.structure_edges(df)).collect()}
    assert counts["thin"] == (1, 0) and counts["bond"] == (2, 1)


def test_oblique_and_thin_cells(spark):
    """Nearest images beyond the neighbouring cells are found, in either way."""
    cells = [OBLIQUE, (2.5, 2.5, 30, 40, 140, 105), (1.1, 9, 9, 90, 90, 90), (9, 1.1, 1.4, 75, 90, 90), (3, 3, 3, 33, 33, 33), (8, 1.2, 8, 90, 150, 90)]
    rows = [random_structure(f"o{i}", 12, c, 50 + i) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, SCHEMA)
    sites = df.select("structure_id", F.explode("sites").alias("s")).select(
        "structure_id", "s.idx", *[F.col("s.frac")[i].alias(n) for i, n in enumerate("xyz")]
    )
    both = [G.structure_edges(df), G.pair_join_within(sites, df.select("structure_id", "cell"), small=1)]
    for got in map(edges_of, both):
        for row in rows:
            assert got.get(row[0], {}) == {k: pytest.approx(d, abs=1e-8) for k, d in brute(row).items()}


def test_reduced_lattices(spark):
    """Any setting: the same lattice by vectors that nothing shortens, and the
    same distances as by all images within reach."""
    rng = random.Random(12)
    cells = []
    while len(cells) < 300:
        lengths = [rng.choice([1.0, 1.3, 4.0, 9.0, 40.0]) * rng.uniform(0.9, 1.1) for _ in range(3)]
        angles = [rng.uniform(25, 155) for _ in range(3)]
        cos = [math.cos(math.radians(x)) for x in angles]
        if 1 - sum(c * c for c in cos) + 2 * math.prod(cos) > 0.01:
            cells.append((*lengths, *angles))
    cells += [(3.0, 3.0, 3.0, 60.0, 60.0, 60.0), (3.0, 3.0, 3.0, 109.4712206, 109.4712206, 109.4712206), (5.0, 5.0, 5.0, 90.0, 90.0, 90.0), (1.0, 1000.0, 2.0, 90.0, 90.0, 140.0)]
    rows = [(str(i), c, [{"idx": k, "element": "Fe", "frac": [rng.uniform(-2, 2) for _ in range(3)]} for k in range(2)]) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, SCHEMA)
    reduced = {r["structure_id"]: r["lattice"] for r in L.with_reduced_lattice(df).collect()}
    edges = edges_of(G.structure_edges(df, cutoff=1e9))
    for name, c, sites in rows:
        a, b, g = (math.cos(math.radians(x)) for x in c[3:])
        metric = np.array([[c[0] ** 2, c[0] * c[1] * g, c[0] * c[2] * b], [c[0] * c[1] * g, c[1] ** 2, c[1] * c[2] * a], [c[0] * c[2] * b, c[1] * c[2] * a, c[2] ** 2]])
        lat = reduced[name]
        turn = np.array([[lat[f"t{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)])
        assert np.allclose(turn, np.rint(turn)) and abs(abs(np.linalg.det(turn)) - 1) < 1e-6
        new = np.array([[lat[f"g{min(i, j)}{max(i, j)}"] for j in (1, 2, 3)] for i in (1, 2, 3)])
        assert np.allclose(turn @ new @ turn.T, metric, rtol=1e-6, atol=1e-6 * np.abs(metric).max())
        steps = np.array(np.meshgrid(*[[-1, 0, 1]] * 3)).reshape(3, -1).T
        steps = steps[np.abs(steps).sum(1) > 1]
        sums = np.einsum("ni,ij,nj->n", steps, new, steps)
        assert (sums >= (1 - 1e-6) * np.max(np.where(steps != 0, np.diag(new), 0), 1)).all()
        # all images within reach, in the reduced lattice and far beyond its neighbours
        delta = (np.array(sites[1]["frac"]) - np.array(sites[0]["frac"])) @ turn
        delta -= np.rint(delta)
        wide = np.array(np.meshgrid(*[range(-4, 5)] * 3)).reshape(3, -1).T + delta
        assert edges[name][0, 1] == pytest.approx(math.sqrt(np.einsum("ni,ij,nj->n", wide, new, wide).min()), rel=1e-6, abs=1e-7)


@pytest.mark.parametrize("n", [63, 64, 65])
def test_around_the_size_of_in_row_pairs(spark, n):
    row = random_structure("r", n, (8, 9, 10, 85, 95, 100), n)
    got = edges_of(G.structure_edges(spark.createDataFrame([row], SCHEMA)))
    assert got["r"] == {k: pytest.approx(d, abs=1e-9) for k, d in brute(row).items()}


CELLS = [(9, 9.5, 14, 80, 95, 110), (3.2, 7, 12, 90, 90, 120), (6.5, 6.5, 6.5, 70, 70, 70), (4, 4, 4, 90, 90, 90)]


@pytest.mark.parametrize("small", [64, 1])
def test_both_ways_equal_brute_force(spark, small):
    """In-row pairs and the grid join find exactly the brute-force pairs."""
    rows = [random_structure(f"r{i}", 30, c, i) for i, c in enumerate(CELLS)]
    got = edges_of(G.structure_edges(spark.createDataFrame(rows, SCHEMA), small=small))
    for row in rows:
        expected = brute(row)
        assert set(got[row[0]]) == set(expected)
        for pair, d in expected.items():
            assert got[row[0]][pair] == pytest.approx(d, abs=1e-9)


def test_one_huge_structure_among_small_ones(spark, monkeypatch):
    """A structure with most of all rows, crowded into salted bins."""
    rows = [random_structure("big", 400, (9, 9, 9, 90, 90, 90), 1), *GOLDEN]
    df = spark.createDataFrame(rows, SCHEMA)
    sites = df.select("structure_id", F.explode("sites").alias("s")).select(
        "structure_id", "s.idx", *[F.col("s.frac")[i].alias(n) for i, n in enumerate("xyz")]
    )
    expected = brute(rows[0])
    by_rows = edges_of(G.pair_join_within(sites, df.select("structure_id", "cell")))
    assert set(by_rows["big"]) == set(expected)
    lattices = L.with_reduced_lattice(df).select("structure_id", "lattice", F.size("sites").alias("n_sites"))
    point = G._point(F.col("idx"), F.col("x"), F.col("y"), F.col("z")).alias("p")
    placed = sites.join(lattices, "structure_id").select("structure_id", *G._metric(), "n_sites", point)
    salted = edges_of(G._pairs_on_grid(placed, 3.0, bin_load=5))
    assert set(salted["big"]) == set(expected)
    assert {k: set(v) for k, v in salted.items()} == {k: set(v) for k, v in by_rows.items()}


def test_matrix_round_trip(spark):
    df = spark.createDataFrame([(c,) for c in [tuple(map(float, c)) for c in CELLS]], "cell struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>")
    m = L.lattice_matrix(F.col("cell"))
    got = df.select("cell", F.array(*[F.array(*r) for r in m]).alias("m"), L.lattice_params(F.array(*[F.array(*r) for r in m])).alias("back"), L.cell_volume(F.col("cell")).alias("v"))
    for r in got.collect():
        assert np.allclose(np.array(r["m"]), matrix(tuple(r["cell"])))
        assert np.allclose(tuple(r["back"]), tuple(r["cell"]))
        assert r["v"] == pytest.approx(abs(np.linalg.det(matrix(tuple(r["cell"])))))


def test_symmetric_and_distinct(spark):
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    both = G.structure_edges(df, symmetric=True)
    assert both.count() == 6
    assert edges_of(G.distinct_edges(both)) == edges_of(G.structure_edges(df))


def test_network_score_equals_numpy(spark):
    rng = np.random.default_rng(0)
    weights = {
        "w1": rng.normal(size=(2, 4)).tolist(),
        "b1": rng.normal(size=4).tolist(),
        "w2": rng.normal(size=(4, 4)).tolist(),
        "b2": rng.normal(size=4).tolist(),
        "w_out": rng.normal(size=4).tolist(),
        "b_out": 0.3,
    }
    nodes, edges, expected = [], [], {}
    for g in range(10):
        n = int(rng.integers(1, 7))
        x = rng.normal(size=(n, 2))
        pairs = [(i, j, float(rng.uniform(1, 3))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        nodes += [(f"g{g}", i, float(x[i, 0]), float(x[i, 1])) for i in range(n)]
        edges += [(f"g{g}", i, j, w) for i, j, w in pairs]
        a = np.eye(n)
        for i, j, w in pairs:
            a[j, i] = w
        s = 1 / np.sqrt(a.sum(axis=1))
        a = s[:, None] * a * s[None, :]
        h = np.maximum(a @ (x @ np.array(weights["w1"])) + weights["b1"], 0)
        h = np.maximum(a @ (h @ np.array(weights["w2"])) + weights["b2"], 0)
        expected[f"g{g}"] = float(h.mean(axis=0) @ weights["w_out"] + weights["b_out"])
    nd = spark.createDataFrame(nodes, "structure_id string, node int, x0 double, x1 double")
    ed = spark.createDataFrame(edges, "structure_id string, source_node_index int, target_node_index int, distance double")
    got = {r["structure_id"]: r["score"] for r in N.gcn_score(nd, ed, ["x0", "x1"], weights).collect()}
    assert got == {k: pytest.approx(v) for k, v in expected.items()}


def small_network(seed):
    """Graphs of a few nodes, directed edges with weights, targets."""
    rng = np.random.default_rng(seed)
    nodes, edges, targets = [], [], []
    for g in range(6):
        n = int(rng.integers(1, 7))
        nodes += [(g, k, float(rng.normal()), float(rng.normal())) for k in range(n)]
        edges += [(g, int(a), int(b), float(rng.uniform(0.5, 2))) for a in range(n) for b in range(n) if a != b and rng.random() < 0.4]
        targets.append((g, float(rng.normal()) if g != 4 else None, "val" if g == 5 else "train"))
    return nodes, edges, targets


def network_errors(nodes, edges, targets, w):
    out = {}
    for g, y, split in targets:
        x = np.array([r[2:] for r in nodes if r[0] == g])
        a = np.eye(len(x))
        for h, s, t, d in edges:
            if h == g:
                a[t, s] += d
        root = 1 / np.sqrt(a.sum(1))
        a = root[:, None] * a * root[None, :]
        h = np.maximum(a @ x @ np.array(w["w1"]) + w["b1"], 0)
        k = np.maximum(a @ h @ np.array(w["w2"]) + w["b2"], 0)
        if y is not None:
            out[g] = (k.mean(0) @ np.array(w["w_out"]) + w["b_out"] - y, split)
    loss = lambda s: float(np.mean([e * e for e, part in out.values() if part == s]))
    return loss("train"), loss("val")


def test_gradients_equal_differences(spark):
    nodes, edges, targets = small_network(3)
    w = GF.first_weights(2, 3, seed=1)
    w["b1"], w["b2"], w["b_out"] = [0.3, -0.1, 0.2], [0.2, 0.1, -0.05], 0.4
    n = spark.createDataFrame(nodes, "structure_id bigint, node int, x0 double, x1 double")
    e = spark.createDataFrame(edges, "structure_id bigint, source_node_index int, target_node_index int, distance double")
    t = spark.createDataFrame(targets, "structure_id bigint, y double, split string")
    network = GF.prepare(n, e, ["x0", "x1"])
    got, loss, validation = GF.gradient(network, t, w)
    assert (loss, validation) == (pytest.approx(network_errors(nodes, edges, targets, w)[0]), pytest.approx(network_errors(nodes, edges, targets, w)[1]))
    assert len(got) == 2 * 3 + 3 + 3 * 3 + 3 + 3 + 1

    def moved(place, by):
        v = copy.deepcopy(w)
        name, *at = place
        if not at:
            v[name] += by
        elif len(at) == 1:
            v[name][at[0]] += by
        else:
            v[name][at[0]][at[1]] += by
        return network_errors(nodes, edges, targets, v)[0]

    for place, slope in got.items():
        assert slope == pytest.approx((moved(place, 1e-6) - moved(place, -1e-6)) / 2e-6, abs=1e-6), place


def test_fitting_lowers_the_error(spark):
    nodes, edges, targets = small_network(8)
    n = spark.createDataFrame(nodes, "structure_id bigint, node int, x0 double, x1 double")
    e = spark.createDataFrame(edges, "structure_id bigint, source_node_index int, target_node_index int, distance double")
    t = spark.createDataFrame([(g, y, "train") for g, y, _ in targets], "structure_id bigint, y double, split string")
    w, history = GF.fit_gcn(n, e, ["x0", "x1"], t.drop("split"), GF.first_weights(2, 4), epochs=4, rate=0.02)
    losses = [h.loss for h in history]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.95 * losses[0]
    assert all(h.validation is None for h in history)
    scored = {r["structure_id"]: r["score"] for r in N.gcn_score(n, e, ["x0", "x1"], w).collect()}
    errors = [scored[g] - y for g, y, _ in targets if y is not None]
    assert sum(x * x for x in errors) / len(errors) < losses[-1]
    with pytest.raises(ValueError, match="no training graph"):
        GF.fit_gcn(n, e, ["x0", "x1"], t.withColumn("split", F.lit("val")), GF.first_weights(2, 4), epochs=1)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_sites_are_worked_out_in_compiled_columns(spark, tmp_path):
    rows = spark.sql(
        "SELECT 1L structure_id, named_struct('a', 4D, 'b', 5D, 'c', 6D, 'alpha', 90D, 'beta', 90D, 'gamma', 120D) cell,"
        " array(named_struct('idx', 0, 'element', 'Fe', 'frac', array(0D, 0D, 0D)), named_struct('idx', 1, 'element', 'O', 'frac', array(0.9D, 0.1D, 0D))) sites"
    )
    rows.write.parquet(str(tmp_path / "s"))
    edges = G.structure_edges(spark.read.parquet(str(tmp_path / "s")))
    assert "transform(sites" not in _plan(edges)
    ((i, j, distance),) = edges.select("source_node_index", "target_node_index", "distance").collect()
    # -0.1 a + 0.1 b at 120 degrees: 0.16 + 0.25 + 0.2
    assert (i, j) == (0, 1) and abs(distance - 0.61**0.5) < 1e-12


def test_text_of_sites_is_parsed_once(spark):
    from xtalframe.operators import graph_dataset

    rows = spark.sql("SELECT 'm' material_id, uuid() oqmd_unit_cell_json, uuid() oqmd_sites_json, 1D oqmd_band_gap, 1D oqmd_delta_e")
    analyzed = graph_dataset.with_structure(rows)._jdf.queryExecution().analyzed().toString()
    assert analyzed.count("from_json(ArrayType(StructType(StructField(species") == 1


@pytest.mark.parametrize("block", [2, 4096])
def test_network_over_blocks_of_nodes(spark, monkeypatch, block):
    """Edges within and between blocks: the same propagation, gradient and error.
    Where blocks hold whole graphs, only graphs and found messages are shuffled."""
    monkeypatch.setattr(N, "BLOCK", block)
    n = spark.createDataFrame([(s, k, 0.25 * s + k, 1.0 / (k + s)) for s in (1, 2, 3) for k in range(7)], "structure_id bigint, node int, x0 double, x1 double")
    e = spark.createDataFrame([(s, a, (3 * a + s) % 7, 1.0 + a / 8) for s in (1, 2, 3) for a in range(7)] + [(1, 6, 9, 1.0), (1, 9, 6, 1.0)], "structure_id bigint, source_node_index int, target_node_index int, distance double")
    nodes = {(r[0], r[1]): [r[2], r[3]] for r in n.collect()}
    messages = [(r[0], r[1], r[2], r[3]) for r in e.collect()] + [(s, k, k, 1.0) for s, k in nodes]
    degree = {v: sum(w for s, _, t, w in messages if (s, t) == v) for v in nodes}
    want = {v: [sum(w * (degree[s, a] * degree[v]) ** -0.5 * nodes[s, a][j] for s, a, t, w in messages if (s, t) == v and (s, a) in nodes) for j in (0, 1)] for v in nodes}
    got = {(r["structure_id"], r["node"]): [r["x0"], r["x1"]] for r in N.neighbor_aggregate(n, e, ["x0", "x1"]).collect()}
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-12) for v in want)

    w = {"w1": [[0.5, 0.25], [0.125, -0.5]], "b1": [0.1, 0.6], "w2": [[0.5, 0.25], [-0.5, 0.75]], "b2": [0.05, 0.15], "w_out": [0.8, -0.6], "b_out": 0.25}
    t = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "structure_id bigint, y double")
    network = GF.prepare(n, e, ["x0", "x1"])
    slopes, loss, _ = GF.gradient(network, t, w)
    up, down = (GF.gradient(network, t, w | {"w1": [[0.5, 0.25 + step], [0.125, -0.5]]})[1] for step in (1e-6, -1e-6))
    assert slopes[("w1", 0, 1)] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    if block == 4096:
        hidden, h = N._linear(network.inputs, [*N.PLACE, "inv_sqrt_deg"], ["x0", "x1"], w["w1"], w["b1"], "h", True)
        broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with joined_in_buckets(spark):
            for messages in (network.forward, network.backward):
                plan = N._propagate(hidden, messages, h)._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" in plan and "Exchange" not in plan
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_written_out_structures(spark, tmp_path):
    """Sites of the test view are compiled columns, with the rows that its
    formula gives, also for no key and keys below zero."""
    from xtalframe.plans import derived as V

    keys = [None, -9, -8, *range(17), 2**40 + 5]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    view = V.structures(spark, str(tmp_path))
    assert "slice(array(" in view._jdf.queryExecution().optimizedPlan().toString()
    got = {r["structure_id"]: r["sites"] for r in view.collect()}
    assert got.pop(None) is None and len(got) == len(keys) - 1
    for k, sites in got.items():
        n = int(math.fmod(k, 8))
        wanted = []
        for i in range(0, n + 1) if n >= 0 else range(0, n - 1, -1):
            at = [math.fmod(k * a + i * b, m) / m + (math.fmod(k, 3) - 1) for a, b, m in ((7, 13, 97), (11, 29, 89), (5, 31, 101))]
            place = int(math.fmod(k + i * 3, 40))  # element_at counts from the end below zero
            wanted.append((i, V.SYMBOLS[place if place >= 0 else place + 1], at))
        assert [tuple(s) for s in sites] == wanted


def test_cell_of_lists_is_read_as_such(spark):
    texts = ["[1,2,3,90,90,90]", "[1,[2],3,4,5,6]", " [ [1,0,0], [0,2,0], [0,0,4] ] ", "[[1,2,3,90,90,90]]", "[[1,0,0],[0,2,0],[0,0,null]]", None, "x[[1]]"]
    tree = ST.parse_cell(F.col("t"))
    assert "rlike" in str(tree).lower()  # no attempt to read lists as numbers
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(tree).collect()]
    assert tuple(got[0]) == (1.0, 2.0, 3.0, 90.0, 90.0, 90.0) and tuple(got[2]) == pytest.approx((1.0, 2.0, 4.0, 90.0, 90.0, 90.0))
    assert [v is None for v in got] == [False, True, False, True, True, True, True]
