"""Independent SQL for the registered queries, in the DuckDB dialect.

Written from the definitions, not from the Spark code: windows where the
operators use argmin aggregates, plain joins where they pre-aggregate, 125
image rows per pair where they use a closed form.
"""

from __future__ import annotations

from xtalframe.elements import ELEMENTS
from xtalframe.plans.derived import SYMBOLS

_LIST = "[" + ",".join(f"'{s}'" for s in SYMBOLS) + "]"


def _sym(n: str) -> str:
    return f"({_LIST})[(({n}) % 40 + 1)]"


def _triple(u: str) -> list[str]:
    return [_sym(u), _sym(f"{u}*3 + {u}//40"), _sym(f"{u}*7 + 3")]


def _formula(u: str, e: str) -> str:
    a, b, c = _triple(u)
    return (
        f"({a} || (({e})%4 + 1) || {b} || ((({e})//4)%3 + 1) || {c} || "
        f"CASE WHEN ({e})%10 = 0 THEN '0.5' ELSE '' END)"
    )


_EL = (
    "el(element, atomic_number, electronegativity, atomic_mass) AS (VALUES "
    + ", ".join(
        f"('{s}', {z}, {'CAST(' + chr(39) + 'nan' + chr(39) + ' AS DOUBLE)' if en != en else f'{en}::DOUBLE'}, {m}::DOUBLE)"
        for s, z, en, m in ELEMENTS
    )
    + ")"
)

_TC = f"""tc AS (
  SELECT event_id AS row_id,
    CASE WHEN event_id%23 <> 0 THEN {_formula('user_id', 'event_id')} END AS composition,
    CASE WHEN event_id%17=0 THEN 'N/A' WHEN event_id%13=0 THEN '' WHEN event_id%11=0 THEN '-1.5'
         WHEN event_id%29=0 THEN 'NaN' WHEN event_id%31=0 THEN '1.0d'
         ELSE CAST(value AS VARCHAR) END AS tc_text
  FROM events),
tn AS (SELECT *, CASE WHEN regexp_full_match(tc_text, '\\s*[+-]?[0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?\\s*')
  THEN TRY_CAST(tc_text AS DOUBLE) END AS tc FROM tc)"""

_ENTRIES = f"""ent AS (
  SELECT o_orderkey AS row_id, 'mp-' || o_orderkey AS material_id,
    {_formula('o_custkey', '(o_orderkey*3+1)')} AS formula_pretty,
    CASE WHEN o_orderkey%9<>0 THEN (o_orderkey%5)/10.0::DOUBLE END AS energy_above_hull,
    CASE WHEN o_orderkey%13<>0 THEN -((o_orderkey%7)/2.0::DOUBLE) END AS formation_energy_per_atom,
    CASE WHEN o_orderkey%50<>0 THEN o_orderstatus='P' END AS deprecated
  FROM orders)"""


def _keys(name: str, source: str, column: str) -> str:
    """Chemical system and reduced-formula key per distinct formula of a relation."""
    return f"""{name}_parts AS (
  SELECT f, p.s AS sym, sum(coalesce(TRY_CAST(p.a AS DOUBLE), 1.0::DOUBLE)) AS amt
  FROM (SELECT f, unnest(list_transform(range(len(ss)), lambda i: {{'s': ss[i+1], 'a': aa[i+1]}})) AS p
    FROM (SELECT {column} AS f, regexp_extract_all({column}, '([A-Z][a-z]?)([0-9.]*)', 1) AS ss,
      regexp_extract_all({column}, '([A-Z][a-z]?)([0-9.]*)', 2) AS aa
      FROM (SELECT DISTINCT {column} FROM {source} WHERE {column} IS NOT NULL)))
  GROUP BY f, p.s),
{name} AS (
  SELECT f, chemsys, array_to_string(list_transform(l, lambda x: x.sym || ':' || CAST(x.amt/g AS VARCHAR)), '|') AS fkey
  FROM (SELECT f, string_agg(sym, '-' ORDER BY sym) AS chemsys,
      CASE WHEN bool_and(amt=floor(amt)) THEN list_reduce(list(CAST(amt AS BIGINT)), lambda x, y: gcd(x, y)) ELSE 1 END AS g,
      list({{'sym': sym, 'amt': amt}} ORDER BY sym) AS l
    FROM {name}_parts GROUP BY f))"""


_PAIRS = f"""WITH {_TC}, {_ENTRIES}, {_keys('ck', 'tc', 'composition')}, {_keys('ek', 'ent', 'formula_pretty')},
cand AS (
  SELECT c.f AS composition, e.*, coalesce(c.fkey = k.fkey, false) AS formula_match
  FROM ck c LEFT JOIN (ent e JOIN ek k ON k.f = e.formula_pretty)
    ON k.chemsys = c.chemsys AND NOT coalesce(e.deprecated, false))"""

_BEST_ORDER = (
    "coalesce(energy_above_hull, 'inf'::DOUBLE), coalesce(formation_energy_per_atom, 'inf'::DOUBLE)"
)

_SETS = f"""q AS (SELECT 'c' || s_suppkey AS composition,
    list_sort(list_distinct([{', '.join(_triple('s_suppkey'))}])) AS elements FROM supplier),
e AS (SELECT o_orderkey AS entry_id,
    list_sort(list_distinct([{', '.join(_triple('o_custkey'))}, {_sym('o_orderkey')}])) AS elements,
    CASE WHEN o_orderkey%9<>0 THEN (o_orderkey%11)/4.0::DOUBLE END AS delta_e,
    CASE WHEN o_orderkey%7<>0 THEN (o_orderkey%3)/8.0::DOUBLE END AS stability FROM orders)"""

_ENTRY_LISTS = f"""lists AS (
  SELECT 'part-' || l_partkey AS comp, l_partkey % 19 <> 0 AS has_entry,
    (l_partkey%19<>0 AND l_orderkey%11 NOT IN (0,1) AND l_partkey%13 NOT IN (0,1,2)) AS valid,
    l_orderkey*100 + l_linenumber AS entry_id,
    CASE WHEN l_orderkey%9<>0 THEN l_extendedprice/10000 - 5 END AS delta_e,
    CASE WHEN l_suppkey%7<>0 THEN l_discount END AS stability,
    {_sym('l_partkey')} || {_sym('l_suppkey')} AS name, l_returnflag AS spacegroup, l_tax AS band_gap, l_linestatus AS prototype,
    '[{{"species":[{{"element":"' || {_sym('l_partkey')} || '","occu":1.0}}],"xyz":[0.0,0.5,' || CAST((l_partkey%10)/10.0::DOUBLE AS VARCHAR)
      || ']}},{{"species":[{{"element":"' || {_sym('l_suppkey')} || '","occu":1.0}}],"xyz":[0.0,0.5,' || CAST((l_partkey%10)/10.0::DOUBLE AS VARCHAR) || ']}}]' AS sites,
    l_partkey AS icsd
  FROM lineitem),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY (NOT valid),
    coalesce(delta_e, 'inf'::DOUBLE), coalesce(stability, 'inf'::DOUBLE), entry_id) AS rn FROM lists) WHERE rn = 1)"""

_CELLS = """cells AS (
  SELECT o_orderkey AS id, 4 + (o_orderkey%7)/2.0::DOUBLE AS a, 4.5 + (o_orderkey%5)/2.0::DOUBLE AS b,
    5 + (o_orderkey%3)/2.0::DOUBLE AS c,
    CASE WHEN o_orderkey%4=1 THEN 80.0::DOUBLE ELSE 90.0::DOUBLE END AS alpha,
    CASE WHEN o_orderkey%6=2 THEN 100.0::DOUBLE ELSE 90.0::DOUBLE END AS beta,
    CASE WHEN o_orderkey%5=0 THEN 120.0::DOUBLE ELSE 90.0::DOUBLE END AS gamma
  FROM orders),
vol AS (SELECT id, a*b*c*sqrt(1 - pow(cos(radians(alpha)),2) - pow(cos(radians(beta)),2) - pow(cos(radians(gamma)),2)
    + 2*cos(radians(alpha))*cos(radians(beta))*cos(radians(gamma))) AS v FROM cells)"""

_SITES = f"""sites AS (
  SELECT id, i, element, x - floor(x) AS x, y - floor(y) AS y, z - floor(z) AS z FROM (
    SELECT o_orderkey AS id, i, {_sym('o_orderkey + i*3')} AS element,
      ((o_orderkey*7 + i*13)%97)/97.0::DOUBLE + (o_orderkey%3 - 1) AS x,
      ((o_orderkey*11 + i*29)%89)/89.0::DOUBLE + (o_orderkey%3 - 1) AS y,
      ((o_orderkey*5 + i*31)%101)/101.0::DOUBLE + (o_orderkey%3 - 1) AS z
    FROM (SELECT o_orderkey, unnest(range(0, o_orderkey%8 + 1)) AS i FROM orders)))"""


def _edges(name: str, sites: str, index: str = "i") -> str:
    return f"""{name} AS (
  SELECT id, i, j, min(sqrt(greatest(0, a*a*dx*dx + b*b*dy*dy + c*c*dz*dz
      + 2*a*b*cos(radians(gamma))*dx*dy + 2*a*c*cos(radians(beta))*dx*dz + 2*b*c*cos(radians(alpha))*dy*dz))) AS d
  FROM (SELECT p.id, p.{index} AS i, q.{index} AS j, q.x - p.x + nx AS dx, q.y - p.y + ny AS dy, q.z - p.z + nz AS dz
    FROM {sites} p JOIN {sites} q ON p.id = q.id AND p.{index} < q.{index},
      (SELECT unnest(range(-2, 3)) AS nx), (SELECT unnest(range(-2, 3)) AS ny), (SELECT unnest(range(-2, 3)) AS nz)) w
  JOIN cells USING (id) GROUP BY id, i, j HAVING d <= 3.0)"""


_EDGES = _edges("edges", "sites")

_GNODES = """nodes AS (SELECT id, i, atomic_number/100.0::DOUBLE AS x0, electronegativity AS x1
  FROM sites JOIN el USING (element)),
deg AS (SELECT n.id, n.i, 1 + coalesce(sum(d), 0) AS deg FROM nodes n LEFT JOIN edges e ON e.id=n.id AND e.j=n.i GROUP BY n.id, n.i)"""


def _layer(out: str, src: str, columns: list[str]) -> str:
    sums = ", ".join(
        f"n.{c}/g.deg + coalesce(sum(e.d*m.{c}/sqrt(h.deg*g.deg)), 0) AS {c}" for c in columns
    )
    return f"""{out} AS (SELECT n.id, n.i, {sums}
  FROM {src} n JOIN deg g ON g.id=n.id AND g.i=n.i
  LEFT JOIN edges e ON e.id=n.id AND e.j=n.i
  LEFT JOIN {src} m ON m.id=e.id AND m.i=e.i
  LEFT JOIN deg h ON h.id=e.id AND h.i=e.i
  GROUP BY n.id, n.i, g.deg, {', '.join('n.' + c for c in columns)})"""


def _dense(out: str, src: str, columns: list[str], w: list, b: list, names: list[str]) -> str:
    exprs = []
    for j, name in enumerate(names):
        total = " + ".join([f"{float(b[j])}::DOUBLE"] + [f"{c}*({float(w[i][j])}::DOUBLE)" for i, c in enumerate(columns)])
        exprs.append(f"greatest({total}, 0.0::DOUBLE) AS {name}")
    return f"{out} AS (SELECT id, i, {', '.join(exprs)} FROM {src})"


_TEXT_STATUS = """texts AS (
  SELECT o_orderkey AS k, o_orderkey%8 + 1 AS n,
    CASE WHEN o_orderkey%29=0 OR o_orderkey%31=0 THEN 'missing_structure_json'
      WHEN o_orderkey%37=0 OR o_orderkey%41=0 OR o_orderkey%43=0 OR o_orderkey%47=0 OR o_orderkey%53=0 THEN 'structure_json_parse_error'
      WHEN o_orderkey%59=0 THEN 'structure_json_parse_error'
      WHEN o_orderkey%61=0 THEN 'structure_creation_error'
      WHEN o_orderkey%67=0 THEN 'processing_error'
      WHEN o_orderkey%71=0 OR o_orderkey%79=0 THEN 'missing_targets'
      ELSE 'ok' END AS status,
    CASE WHEN o_orderkey%73=0 THEN 'nan'::DOUBLE ELSE (o_orderkey%9)/4.0::DOUBLE END AS gap,
    -((o_orderkey%13)/2.0::DOUBLE) AS energy
  FROM orders)"""

# Cells given as a 3x3 matrix in the texts are orthogonal, whatever the angles.
_TEXT_CELLS = _CELLS.replace(
    "WHEN o_orderkey%4=1", "WHEN o_orderkey%3<>0 AND o_orderkey%4=1"
).replace("WHEN o_orderkey%6=2", "WHEN o_orderkey%3<>0 AND o_orderkey%6=2").replace(
    "WHEN o_orderkey%5=0", "WHEN o_orderkey%3<>0 AND o_orderkey%5=0"
)

_DOS = """raw AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey%11<>0 THEN (o_orderkey%9)/2.0::DOUBLE - 2.5 END AS ef,
    -1.0::DOUBLE - o_orderkey%3 AS e1, 0.0::DOUBLE AS e2, 1.0::DOUBLE + o_orderkey%2 AS e3,
    (o_orderkey%5)/10.0::DOUBLE + CASE WHEN o_orderkey%2=0 THEN (o_orderkey%3)/10.0::DOUBLE ELSE 0 END AS d1,
    (o_orderkey%7)/5.0::DOUBLE + CASE WHEN o_orderkey%2=0 THEN (o_orderkey%2)/5.0::DOUBLE ELSE 0 END AS d2,
    (o_orderkey%4)/2.0::DOUBLE + CASE WHEN o_orderkey%2=0 THEN (o_orderkey%6)/2.0::DOUBLE ELSE 0 END AS d3
  FROM orders),
dos AS (SELECT k, CASE WHEN k%13=0 OR ef IS NULL THEN NULL WHEN ef<e1 OR ef>e3 THEN 0.0
    WHEN ef<=e2 THEN d1 + (ef-e1)/(e2-e1)*(d2-d1) ELSE d2 + (ef-e2)/(e3-e2)*(d3-d2) END AS dos FROM raw)"""

_DOCS = """docs AS (
  SELECT o_orderkey AS k, 'comp' || o_orderkey AS comp,
    CASE WHEN o_orderkey%2=0 THEN (o_orderkey%5)/2.0::DOUBLE END AS gap_long,
    CASE WHEN o_orderkey%3<>0 THEN (o_orderkey%4)/4.0::DOUBLE END AS gap_short,
    coalesce(CASE WHEN o_orderkey%2=1 THEN -((o_orderkey%6)/3.0::DOUBLE) END, o_totalprice / -100000) AS fe,
    CASE WHEN o_orderkey%7<>0 THEN (o_orderkey%300)/2.0::DOUBLE END AS tc,
    CASE WHEN o_orderkey%17=0 OR o_orderkey%19=0 THEN 'no_mpid_comp' || o_orderkey ELSE 'mp-' || o_orderkey END AS mid
  FROM orders WHERE o_orderkey%23<>0)"""

_SYSTEM = """CASE WHEN {n}<1 THEN NULL WHEN {n}<=2 THEN 'triclinic' WHEN {n}<=15 THEN 'monoclinic'
  WHEN {n}<=74 THEN 'orthorhombic' WHEN {n}<=142 THEN 'tetragonal' WHEN {n}<=167 THEN 'trigonal'
  WHEN {n}<=194 THEN 'hexagonal' WHEN {n}<=230 THEN 'cubic' END"""

_STATS = """stats AS (SELECT id, count(*) AS num_sites, CAST(count(DISTINCT element) AS INTEGER) AS num_elements,
  string_agg(DISTINCT element, ',' ORDER BY element) AS elements, sum(atomic_mass) AS mass
  FROM sites JOIN el USING (element) GROUP BY id)"""

_MANUAL = """raw AS (SELECT event_id AS e,
    CASE WHEN event_id%14=0 THEN NULL ELSE 'm-' || event_id END AS material_id,
    CASE WHEN event_id%5=0 THEN NULL WHEN event_id%7=0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS band_gap_mp,
    CASE WHEN event_id%3=0 THEN 'True' WHEN event_id%3=1 THEN NULL ELSE 'maybe' END AS is_metal,
    CASE WHEN event_id%9=0 THEN NULL ELSE CAST(value AS VARCHAR) END AS target_band_gap,
    CASE WHEN event_id%16=0 THEN 'x1' ELSE '-1.25' END AS target_formation_energy,
    CASE WHEN event_id%10=0 THEN NULL WHEN event_id%2=0 THEN 'True' ELSE 'False' END AS target_is_metal
  FROM events),
judged AS (SELECT *, list_filter([
    CASE WHEN material_id IS NULL THEN 'material_id is required' END,
    CASE WHEN target_band_gap IS NULL THEN 'target_band_gap is required' END,
    CASE WHEN target_is_metal IS NULL THEN 'target_is_metal is required' END,
    CASE WHEN band_gap_mp='bad' THEN 'band_gap_mp is not a number' END,
    CASE WHEN target_formation_energy='x1' THEN 'target_formation_energy is not a number' END,
    CASE WHEN is_metal='maybe' THEN 'is_metal is not True or False' END], lambda r: r IS NOT NULL) AS reasons FROM raw)"""

_SCORES = """s AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT)) AS material_id,
    l_orderkey, l_extendedprice/1000 AS y_true, l_quantity*1.5::DOUBLE AS y_pred FROM lineitem)"""

_DIRTY = """dirty AS (SELECT row_id, composition || CASE row_id%6 WHEN 0 THEN '-delta' WHEN 1 THEN ' (vac)2' WHEN 2 THEN '-Y'
    WHEN 3 THEN 'x=' WHEN 4 THEN 'X1' ELSE '+y ' END AS text FROM tc WHERE composition IS NOT NULL)"""

_MODEL = """m AS (SELECT 'part-' || p_partkey AS material_id, p_partkey AS p,
    CAST(p_partkey%5 + 1 AS DOUBLE) AS num_elements,
    CASE WHEN p_partkey%11<>0 THEN q END AS density_pg, CASE WHEN p_partkey%12<>0 THEN price/1000 END AS volume_pg,
    price/(p_partkey%5 + 1) AS volume_per_atom_pg, CAST(p_partkey%230 + 1 AS DOUBLE) AS spacegroup_number_pg,
    p_size/5.0::DOUBLE AS lattice_a_pg, p_size/4.0::DOUBLE + 1 AS lattice_b_pg, p_retailprice/500 AS lattice_c_pg,
    90.0::DOUBLE AS lattice_alpha_pg, 90 + disc*100 AS lattice_beta_pg, 90.0::DOUBLE AS lattice_gamma_pg, CAST(p_partkey%8 + 1 AS DOUBLE) AS num_sites_pg,
    CASE WHEN p_partkey%14<>0 THEN p_brand END AS elements, CASE WHEN p_partkey%15<>0 THEN lower(p_type) END AS crystal_system_pg
  FROM part LEFT JOIN (SELECT l_partkey, avg(l_quantity) AS q, avg(l_extendedprice) AS price, avg(l_discount) AS disc FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"""

_PREP = [
    "num_elements", "density_pg", "volume_pg", "volume_per_atom_pg", "spacegroup_number_pg", "lattice_a_pg",
    "lattice_b_pg", "lattice_c_pg", "lattice_alpha_pg", "lattice_beta_pg", "lattice_gamma_pg", "num_sites_pg",
]


# Formulas that are always written as the molecule.
_MOLECULES = "LiO Li2O2 NaO Na2O2 KO K2O2 HO H2O2 CsO Cs2O2 RbO Rb2O2 O O2 N N2 F F2 Cl Cl2 H H2".split()
_MOLECULE = "CASE formula " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(_MOLECULES[::2], _MOLECULES[1::2])) + " ELSE formula END"


def _display(parts: str) -> str:
    """shown(f, formula): symbols by electronegativity, the last two in brackets
    where their amounts have a factor of their own and they lie close enough.
    Elements without a value come last, by symbol."""
    digits = lambda x: f"CASE WHEN {x} = 1 THEN '' WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST(round({x}, 8) AS VARCHAR) END"
    return f"""named AS (
  SELECT f, sym, amt, electronegativity AS en, row_number() OVER (PARTITION BY f ORDER BY CASE WHEN isnan(electronegativity) THEN 1e9 ELSE electronegativity END, sym) AS r,
    count(*) OVER (PARTITION BY f) AS n FROM {parts} JOIN el ON element = sym WHERE abs(amt) > 1e-8),
factor AS (SELECT f, CASE WHEN bool_and(amt = floor(amt)) THEN list_reduce(list(CAST(amt AS BIGINT)), lambda x, y: gcd(x, y)) ELSE 1 END AS g FROM named GROUP BY f),
tail AS (SELECT f, CASE WHEN bool_and(amt/g = floor(amt/g)) THEN list_reduce(list(CAST(amt/g AS BIGINT)), lambda x, y: gcd(x, y)) ELSE 1 END AS h,
    max(en) FILTER (r = n) - max(en) FILTER (r = n - 1) AS gap FROM named JOIN factor USING (f) WHERE r > n - 2 AND n >= 3 GROUP BY f),
shown AS (SELECT f, {_MOLECULE} AS formula FROM (
  SELECT f, string_agg(CASE WHEN h <> 1 AND gap < 1.65 AND r > n - 2
      THEN CASE WHEN r = n - 1 THEN '(' ELSE '' END || sym || {digits('(amt/g/h)')} || CASE WHEN r = n THEN ')' || {digits('h')} ELSE '' END
      ELSE sym || {digits('(amt/g)')} END, '' ORDER BY r) AS formula
  FROM named JOIN factor USING (f) LEFT JOIN tail USING (f) GROUP BY f))"""


def _split3(table: str, key: str, train: float, val: float, test: float) -> str:
    rest, share = val + test, test / (val + test)
    return f"""ranked AS (SELECT {key}, row_number() OVER (ORDER BY md5('42:' || {key}), {key}) AS rn, count(*) OVER () AS n FROM {table}),
sized AS (SELECT *, CAST(ceil({rest!r}::DOUBLE*n) AS BIGINT) AS n_rest, CAST(ceil({share!r}::DOUBLE*ceil({rest!r}::DOUBLE*n)) AS BIGINT) AS n_test FROM ranked),
parts AS (SELECT {key}, CASE WHEN rn <= n - n_rest THEN 'train' WHEN rn <= n - n_test THEN 'val' ELSE 'test' END AS split FROM sized)"""


def _split2(table: str, key: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || {key}), {key}) AS rn, count(*) OVER () AS n FROM {table}),
parts AS (SELECT *, CASE WHEN rn <= n - CAST(ceil(0.2::DOUBLE*n) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ranked)"""


_GRAPH_OK = f"""WITH {_EL}, {_TEXT_CELLS}, {_SITES}, {_EDGES}, {_TEXT_STATUS},
g AS (SELECT k, 'id-' || k AS material_id, n AS n_nodes, (SELECT count(*) FROM edges WHERE id = k) AS n_edges, gap, energy/n AS e
  FROM texts WHERE status = 'ok'),
zs AS (SELECT id, string_agg(CAST(atomic_number AS VARCHAR), ',' ORDER BY i) AS atomic_numbers FROM sites JOIN el USING (element) GROUP BY id),
ps AS (SELECT id, string_agg(i || '-' || j, ',' ORDER BY i, j) AS pairs, sum(CAST(CAST(d AS FLOAT) AS DOUBLE)) AS total FROM edges GROUP BY id),
whole AS (SELECT k, material_id, CAST(n_nodes AS BIGINT) AS n_nodes, n_edges, atomic_numbers, coalesce(pairs, '') AS pairs, round(coalesce(total, 0), 3) AS total_length,
  round(CAST(CAST(gap AS FLOAT) AS DOUBLE), 4) AS band_gap, round(CAST(CAST(e AS FLOAT) AS DOUBLE), 4) AS energy_per_site
  FROM g JOIN zs ON zs.id = g.k LEFT JOIN ps ON ps.id = g.k),
"""


def oracle_sql() -> dict[str, str]:
    """SQL per query key; queries without a key here have no SQL equivalent."""
    from xtalframe.plans.queries import WEIGHTS as w

    sql: dict[str, str] = {}
    tc = f"WITH {_TC}"

    sql["scan_tsv_preamble"] = f"{tc} SELECT row_id, composition, nullif(tc_text, '') AS tc FROM tc"
    sql["scan_csv"] = f"{tc} SELECT row_id, composition, nullif(tc_text, '') AS tc_text FROM tc"
    sql["sink_table"] = f"{tc} SELECT composition, tc AS critical_temperature_tc FROM tn WHERE composition IS NOT NULL AND tc > 0"
    docs = """SELECT 'comp' || o_orderkey AS supercon_composition,
      CASE WHEN o_orderkey%6<>0 AND o_orderkey%5<>0 THEN 'mp-' || o_orderkey END AS material_id,
      CASE WHEN o_orderkey%6<>0 THEN o_totalprice END AS energy, o_orderkey%6=0 AS is_null FROM orders"""
    sql["scan_doc_map"] = docs
    sql["sink_doc_map"] = docs
    sql["sink_graph_dataset"] = (
        _GRAPH_OK + _split3("g", "material_id", 0.6, 0.2, 0.2)
        + " SELECT whole.* EXCLUDE (k), split FROM whole JOIN parts USING (material_id)"
    )
    sql["scan_graph_dataset"] = (
        _GRAPH_OK + _split3("g", "material_id", 0.6, 0.2, 0.2)
        + " SELECT whole.* EXCLUDE (k) FROM whole JOIN parts USING (material_id) WHERE split = 'test'"
    )
    number = "TRY_CAST(CASE WHEN {c} NOT IN ('bad', 'x1') THEN {c} END AS DOUBLE) AS {c}"
    sql["append_validated"] = f"""WITH {_MANUAL} SELECT CASE WHEN len(reasons)=0 THEN 'dataset' ELSE 'quarantine' END AS target, material_id,
      {number.format(c='band_gap_mp')}, {number.format(c='target_band_gap')}, {number.format(c='target_formation_energy')},
      target_is_metal = 'True' AS target_is_metal, array_to_string(reasons, '; ') AS reasons FROM judged"""

    sql["select_rename"] = f"{tc} SELECT composition, tc_text AS critical_temperature_tc FROM tc"
    sql["require_columns"] = f"{tc} SELECT count(*) AS n_rows FROM tc"
    sql["to_numeric_coerce"] = f"{tc} SELECT row_id, tc FROM tn"
    sql["drop_missing"] = f"{tc} SELECT row_id, composition, tc FROM tn WHERE tc IS NOT NULL AND composition IS NOT NULL"
    sql["filter_positive"] = f"{tc} SELECT row_id, tc FROM tn WHERE tc > 0"
    sql["clean_tc"] = f"{tc} SELECT composition, tc AS critical_temperature_tc, row_id FROM tn WHERE tc > 0 AND composition IS NOT NULL"
    sql["clean_tc_report"] = f"""{tc} SELECT count(*) AS rows_read,
      count(*) FILTER (tc IS NULL OR composition IS NULL) AS dropped_missing,
      count(*) FILTER (tc <= 0 AND composition IS NOT NULL) AS dropped_not_positive,
      count(*) FILTER (tc > 0 AND composition IS NOT NULL) AS rows_kept,
      count(DISTINCT composition) FILTER (tc > 0) AS distinct_compositions FROM tn"""
    sql["filter_deprecated"] = f"WITH {_ENTRIES} SELECT material_id, formula_pretty FROM ent WHERE NOT coalesce(deprecated, false)"
    sql["filter_valid_docs"] = """SELECT CASE WHEN o_orderkey%5=0 OR o_orderkey%7=0 THEN 'null'
      WHEN o_orderkey%11=0 OR o_orderkey%13=0 THEN 'other' ELSE 'object' END AS kind, count(*) AS n FROM orders GROUP BY 1"""
    sql["id_fallback"] = f"WITH {_DOCS} SELECT comp AS supercon_composition, mid AS material_id FROM docs"
    sql["conform_schema"] = """SELECT CASE WHEN event_id%14=0 THEN '  ' ELSE ' m-' || event_id || ' ' END AS material_id,
      CASE WHEN event_id%5<>0 AND event_id%7<>0 THEN value END AS band_gap_mp, CAST(NULL AS DOUBLE) AS absent,
      CAST(event_id%4 AS INTEGER) AS num_elements FROM events"""
    sql["alias_fields"] = f"WITH {_DOCS} SELECT comp AS supercon_composition, coalesce(gap_long, gap_short) AS gap FROM docs"
    sql["validate_structure"] = f"""WITH {_ENTRY_LISTS} SELECT comp AS supercon_composition,
      count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_invalid FROM lists GROUP BY comp"""
    sql["validate_manual_row"] = f"""WITH {_MANUAL} SELECT material_id, TRY_CAST(band_gap_mp AS DOUBLE) AS band_gap_mp,
      CASE WHEN is_metal='True' THEN true END AS is_metal, CAST(target_is_metal AS BOOLEAN) AS target_is_metal,
      CAST(len(reasons) AS BIGINT) AS n_reasons, coalesce(array_to_string(reasons, '; '), '') AS reasons FROM judged"""
    sql["rejection_counts"] = f"WITH {_MANUAL} SELECT reason, count(*) AS n_rows FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY reason"
    sql["skip_report"] = f"WITH {_TEXT_STATUS} SELECT status, count(*) AS n_rows FROM texts GROUP BY status"

    sql["join_candidates_chemsys"] = f"{_PAIRS} SELECT composition, material_id, formula_match FROM cand"
    sql["join_candidates_elements"] = f"WITH {_SETS} SELECT composition, entry_id FROM q LEFT JOIN e ON list_has_all(e.elements, q.elements)"
    sql["join_candidates_exact"] = f"WITH {_SETS} SELECT composition, entry_id FROM q LEFT JOIN e ON e.elements = q.elements"
    sql["join_candidates_subset"] = f"WITH {_SETS} SELECT e.entry_id AS composition, q.composition AS entry_id FROM e LEFT JOIN q ON list_has_all(e.elements, q.elements)"
    sql["best_by_element_set"] = f"""WITH {_SETS} SELECT composition, entry_id, delta_e FROM (
      SELECT composition, entry_id, delta_e, row_number() OVER (PARTITION BY composition ORDER BY coalesce(delta_e, 'inf'::DOUBLE), coalesce(stability, 'inf'::DOUBLE), entry_id) AS rn
      FROM q LEFT JOIN e ON list_has_all(e.elements, q.elements)) WHERE rn = 1"""
    sql["join_details"] = """SELECT 'mp-' || o_orderkey AS material_id, CASE WHEN o_orderkey%6<>0 THEN o_totalprice END AS band_gap,
      o_orderkey%6<>0 AS found FROM orders"""
    sql["join_structure_dos"] = """SELECT 'mp-' || o_orderkey AS material_id,
      CASE WHEN o_orderkey%4<>0 THEN CAST(o_orderkey%8 + 1 AS INTEGER) END AS n_sites,
      CASE WHEN o_orderkey%3<>0 AND o_orderkey%13<>0 AND o_orderkey%11<>0 THEN (o_orderkey%9)/2.0::DOUBLE - 2.5 END AS efermi FROM orders"""
    ranked = "SELECT composition, tc, row_id FROM (SELECT *, row_number() OVER (PARTITION BY composition ORDER BY row_id) AS rn FROM tn WHERE composition IS NOT NULL) WHERE rn = 1"
    sql["join_tc"] = f"{tc} SELECT composition, tc AS critical_temperature_tc FROM ({ranked})"
    sql["join_elements"] = f"""WITH {_EL} SELECT element, count(*) AS n, min(atomic_number) AS atomic_number, min(electronegativity) AS electronegativity
      FROM (SELECT {_sym('l_partkey')} AS element FROM lineitem) JOIN el USING (element) GROUP BY element"""
    rows = """rows AS (SELECT l_orderkey AS id, l_linenumber*1000000000000000 + l_partkey*10000000 + l_suppkey AS i,
      (l_partkey%97)/97.0::DOUBLE AS x, (l_suppkey%89)/89.0::DOUBLE AS y,
      l_quantity/51.0::DOUBLE - floor(l_quantity/51.0::DOUBLE) AS z FROM lineitem)"""
    sql["pair_join_within"] = f"""WITH {_CELLS}, {rows}, dup AS (SELECT id, i, count(*) AS n FROM rows GROUP BY id, i),
      {_edges('edges', '(SELECT row_number() OVER () AS rid, * FROM rows)').replace('GROUP BY id, i, j', 'GROUP BY id, i, j, pr, qr').replace('SELECT p.id,', 'SELECT p.rid AS pr, q.rid AS qr, p.id,')}
      SELECT id AS structure_id, count(*) AS n_pairs, round(sum(d), 5) AS sum_distance, round(min(d), 5) AS min_distance FROM edges GROUP BY id"""
    sql["join_baseline"] = f"WITH {_SCORES} SELECT material_id, y_true, round((SELECT avg(y_true) FROM s WHERE l_orderkey%5<>0), 6) AS y_baseline FROM s WHERE l_orderkey%5=0"
    sql["join_predictions"] = "SELECT o_orderkey AS material_id, o_totalprice AS y_true, CASE WHEN o_orderkey%4<>0 THEN o_orderkey*2.0::DOUBLE END AS y_pred FROM orders"

    sql["best_entry_mp"] = f"""{_PAIRS} SELECT composition, material_id, energy_above_hull, formation_energy_per_atom FROM (
      SELECT *, row_number() OVER (PARTITION BY composition ORDER BY {_BEST_ORDER}, (NOT formula_match), row_id) AS rn FROM cand) WHERE rn = 1"""
    sql["best_entry_mp_same_formula"] = f"""{_PAIRS} SELECT composition, CASE WHEN formula_match THEN material_id END AS material_id FROM (
      SELECT *, row_number() OVER (PARTITION BY composition ORDER BY (NOT formula_match), {_BEST_ORDER}, row_id) AS rn FROM cand) WHERE rn = 1"""
    of_best = ", ".join(
        f"CASE WHEN valid THEN {c} END AS oqmd_{n}"
        for c, n in (
            ("entry_id", "entry_id"), ("name", "formula"), ("spacegroup", "spacegroup"), ("delta_e", "delta_e"), ("stability", "stability"),
            ("band_gap", "band_gap"), ("prototype", "prototype"), ("'[5.0,5.0,5.0,90.0,90.0,90.0]'", "unit_cell_json"), ("sites", "sites_json"), ("icsd", "icsd_id"),
        )
    )
    sql["best_entry_oqmd"] = f"WITH {_ENTRY_LISTS} SELECT comp AS supercon_composition, {of_best} FROM best"
    sql["dedup_first"] = f"{tc} {ranked}"
    sql["distinct_compositions"] = f"{tc} SELECT DISTINCT composition FROM tc WHERE composition IS NOT NULL"
    sql["match_counts"] = f"""WITH {_ENTRY_LISTS} SELECT count(*) AS rows_total, count(*) FILTER (valid) AS oqmd_entry_id_present,
      count(*) FILTER (valid AND delta_e IS NOT NULL) AS oqmd_delta_e_present FROM best"""
    sql["coercion_counts"] = f"""{tc} SELECT count(*) AS rows_read, count(*) FILTER (tc IS NULL) AS became_missing,
      count(*) FILTER (tc IS NULL AND tc_text <> '') AS not_numeric, count(tc) AS rows_kept FROM tn"""
    sql["doc_profile"] = """SELECT count(*) AS keys_total, count(*) FILTER (o_orderkey%7=0) AS keys_null,
      count(*) FILTER (o_orderkey%7<>0 AND o_orderkey%5=0) AS keys_empty, count(*) FILTER (o_orderkey%7<>0 AND o_orderkey%5<>0) AS keys_with_data,
      CAST(sum(CASE WHEN o_orderkey%7<>0 THEN o_orderkey%5 ELSE 0 END) AS BIGINT) AS entries_total FROM orders"""
    sql["composition_stats"] = f"WITH {_EL}, {_SITES}, {_STATS} SELECT id AS structure_id, num_sites, num_elements, elements, round(mass, 4) AS mass FROM stats"
    geometry = f"WITH {_CELLS}, {_SITES}, {_EDGES}"
    sql["graph_counts"] = f"""{geometry} SELECT id AS structure_id, n.n AS num_nodes, coalesce(e.n, 0) AS num_edges
      FROM (SELECT id, count(*) AS n FROM sites GROUP BY id) n LEFT JOIN (SELECT id, count(*) AS n FROM edges GROUP BY id) e USING (id)"""
    sql["collect_graph"] = f"""WITH {_EL}, {_CELLS}, {_SITES}, {_EDGES} SELECT id AS structure_id, n_nodes, coalesce(n_edges, 0) AS n_edges, atomic_numbers, coalesce(pairs, '') AS pairs
      FROM (SELECT id, count(*) AS n_nodes, string_agg(CAST(atomic_number AS VARCHAR), ',' ORDER BY i) AS atomic_numbers FROM sites JOIN el USING (element) GROUP BY id)
      LEFT JOIN (SELECT id, count(*) AS n_edges, string_agg(i || '-' || j, ',' ORDER BY i, j) AS pairs FROM edges GROUP BY id) USING (id)"""
    sql["regression_metrics"] = f"""WITH {_SCORES}, a AS (SELECT avg(y_true) AS mu FROM s) SELECT count(*) AS n, round(avg(abs(y_true-y_pred)), 6) AS mae,
      round(avg((y_true-y_pred)*(y_true-y_pred)), 6) AS mse, round(sqrt(avg((y_true-y_pred)*(y_true-y_pred))), 6) AS rmse,
      round(1 - sum((y_true-y_pred)*(y_true-y_pred))/sum((y_true-mu)*(y_true-mu)), 6) AS r2 FROM s, a"""
    sql["classification_metrics"] = """WITH l AS (SELECT quality AS y, 1 - toxic AS p FROM labels), c AS (SELECT unnest([0, 1]) AS c),
      f AS (SELECT c, count(*) FILTER (y=c) AS sup, 2.0::DOUBLE*count(*) FILTER (y=c AND p=c)/nullif(count(*) FILTER (y=c) + count(*) FILTER (p=c), 0) AS f1 FROM l, c GROUP BY c)
      SELECT CAST(sum(sup) AS BIGINT) AS n, round((SELECT avg(CASE WHEN y=p THEN 1.0 ELSE 0.0 END) FROM l), 9) AS accuracy, round(sum(coalesce(f1,0)*sup)/sum(sup), 9) AS f1_weighted FROM f"""
    sql["mean_target"] = f"WITH {_SCORES} SELECT round(avg(y_true), 6) AS mean_target FROM s WHERE l_orderkey%5<>0"
    compare = f"""WITH {_SCORES}, t AS (SELECT *, (SELECT avg(y_true) FROM s WHERE l_orderkey%5<>0) AS b FROM s WHERE l_orderkey%5=0)"""
    sql["baseline_compare"] = f"""{compare} SELECT round(avg(abs(y_true-y_pred)), 6) AS model_mae, round(sqrt(avg(pow(y_true-y_pred, 2))), 6) AS model_rmse,
      round(avg(abs(y_true-b)), 6) AS baseline_mae, round(sqrt(avg(pow(y_true-b, 2))), 6) AS baseline_rmse FROM t"""
    sql["evaluate_model"] = f"""{compare} SELECT count(*) AS n, round(avg(abs(y_true-y_pred)), 6) AS mae, round(sqrt(avg(pow(y_true-y_pred, 2))), 6) AS rmse,
      round(1 - sum(pow(y_true-y_pred, 2))/sum(pow(y_true-(SELECT avg(y_true) FROM t), 2)), 6) AS r2,
      round(avg(abs(y_true-b)), 6) AS baseline_mae, round(sqrt(avg(pow(y_true-b, 2))), 6) AS baseline_rmse,
      (SELECT string_agg(material_id || ' ' || CAST(e AS VARCHAR), ', ' ORDER BY k) FROM (SELECT material_id, round(abs(y_true-y_pred), 4) AS e,
        row_number() OVER (ORDER BY abs(y_true-y_pred) DESC, material_id) AS k FROM t) WHERE k <= 5) AS top_errors FROM t"""
    mode = "(SELECT {c} FROM m WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}_mode"
    means = ", ".join(f"round(avg({c}), 6) AS {c}_mean" for c in _PREP)
    sql["impute_stats"] = f"WITH {_MODEL} SELECT {means}, {mode.format(c='elements')}, {mode.format(c='crystal_system_pg')} FROM m"
    stats = ", ".join([f"round(avg({c}), 6) AS {c}_mean" for c in _PREP] + [f"round((SELECT stddev_pop(coalesce({c}, mu)) FROM m, (SELECT avg({c}) AS mu FROM m)), 6) AS {c}_std" for c in _PREP])
    sql["scale_stats"] = f"WITH {_MODEL} SELECT {stats} FROM m"

    sql["row_ids"] = "SELECT event_id, row_number() OVER (ORDER BY event_id) AS row_number FROM events"
    sql["unknown_ids"] = "SELECT o_orderkey AS row_id, 'Unknown_ID_' || row_number() OVER (ORDER BY o_orderkey) AS material_id FROM orders QUALIFY o_orderkey%71<>0"
    sql["site_index"] = f"WITH {_SITES} SELECT id AS structure_id, CAST(i AS INTEGER) AS site_index, element FROM sites"
    sql["first_k_per_key"] = "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5"
    sql["split_three_way"] = f"WITH {_split3('orders', 'o_orderkey', 0.7, 0.2, 0.1)} SELECT o_orderkey, split FROM parts"
    sql["split_two_way"] = f"WITH {_split2('part', 'p_partkey')} SELECT p_partkey, split FROM parts"
    sql["top_n_by_value"] = f"{tc} SELECT row_id, composition, tc FROM tn WHERE tc IS NOT NULL ORDER BY tc DESC, row_id LIMIT 20"
    sql["top_errors"] = f"WITH {_SCORES} SELECT material_id, y_true AS true_value, y_pred AS predicted_value, round(abs(y_true-y_pred), 6) AS absolute_error FROM s ORDER BY abs(y_true-y_pred) DESC, material_id LIMIT 5"
    sql["limit_keys"] = f"{tc} SELECT composition, min(row_id) AS row_id FROM tc WHERE composition IS NOT NULL GROUP BY composition ORDER BY 2, 1 LIMIT 7"
    sql["sample_preview"] = """SELECT 'comp' || o_orderkey AS composition, CAST(o_orderkey%5 AS INTEGER) AS n_entries, o_orderkey*10 AS first_entry
      FROM orders WHERE o_orderkey%7<>0 AND o_orderkey%5<>0 ORDER BY o_orderkey LIMIT 2"""
    sql["union_ids"] = f"{_PAIRS} SELECT DISTINCT material_id FROM cand WHERE material_id IS NOT NULL"
    edge_columns = "id AS structure_id, CAST(i AS INTEGER) AS source_node_index, CAST(j AS INTEGER) AS target_node_index, round(d, 5) AS distance"
    sql["distinct_edges"] = f"{geometry} SELECT {edge_columns} FROM edges"
    sql["union_splits"] = "SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, CAST(0 AS BIGINT) AS n_shared FROM orders"

    sql["clean_formula"] = f"{tc}, {_DIRTY} SELECT row_id, trim(replace(replace(replace(regexp_replace(text, '\\(.*?\\)', '', 'g'), '-Y', ''), '-delta', ''), 'x=', '')) AS formula FROM dirty"
    sql["parse_formula"] = f"WITH {_TC}, {_keys('ck', 'tc', 'composition')} SELECT row_id, sym AS symbol, amt AS amount FROM tc JOIN ck_parts ON f = composition"
    elements = "array_to_string(list_sort(list_distinct(regexp_extract_all(composition, '[A-Z][a-z]?'))), '{sep}')"
    sql["formula_elements"] = f"{tc} SELECT row_id, {elements.format(sep=',')} AS elements FROM tc WHERE composition IS NOT NULL"
    sql["chemical_system"] = f"{tc} SELECT row_id, {elements.format(sep='-')} AS chemsys FROM tc"
    sql["join_elements_text"] = f"{tc} SELECT row_id, {elements.format(sep=',')} AS elements FROM tc"
    sql["reduced_formula"] = f"WITH {_EL}, {_ENTRIES}, {_keys('ek', 'ent', 'formula_pretty')}, {_display('ek_parts')} SELECT row_id, formula FROM ent LEFT JOIN shown ON f = formula_pretty"
    fm = f"f AS (SELECT o_orderkey AS row_id, {_formula('o_custkey', '(o_orderkey*3+1)')} AS a, {_formula('o_custkey', '(o_orderkey*3+1+4*(o_orderkey%3))')} AS b FROM orders)"
    sql["formula_match"] = f"WITH {fm}, both_ab AS (SELECT a AS t FROM f UNION ALL SELECT b FROM f), {_keys('k', 'both_ab', 't')} SELECT row_id, x.fkey = y.fkey AS same FROM f JOIN k x ON x.f = a JOIN k y ON y.f = b"
    sql["normalise_na"] = f"{tc} SELECT row_id, CASE WHEN tc_text NOT IN ('', 'N/A') THEN tc_text END AS tc_text FROM tc"
    bad_cell = "(o_orderkey%29=0 OR o_orderkey%37=0 OR o_orderkey%41=0 OR o_orderkey%43=0)"
    sql["parse_cell"] = f"WITH {_TEXT_CELLS} SELECT o_orderkey AS row_id, " + ", ".join(
        f"CASE WHEN NOT {bad_cell} THEN round({n}, 6) END AS cell_{n}" for n in ("a", "b", "c", "alpha", "beta", "gamma")
    ) + " FROM orders JOIN cells ON id = o_orderkey"
    raw_sites = _SITES.replace("x - floor(x) AS x, y - floor(y) AS y, z - floor(z) AS z", "x, y, z")
    sql["parse_sites"] = f"""WITH {raw_sites} SELECT id AS row_id, CAST(i AS INTEGER) AS idx, CASE WHEN id%67=0 THEN 'Qq' ELSE element END AS element,
      round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z
      FROM sites WHERE id%31<>0 AND id%47<>0 AND id%53<>0 AND id%59<>0 AND id%61<>0"""
    of_entry = "'part-' || l_partkey AS supercon_composition, l_orderkey*100 + l_linenumber AS entry_id"
    sql["cell_to_text"] = f"""SELECT {of_entry}, CASE l_orderkey%11 WHEN 0 THEN '[5.0,5.0,5.0,5.0,5.0]' WHEN 1 THEN '[5.0,5.0,5.0,5.0,5.0,null]'
      ELSE '[5.0,5.0,5.0,90.0,90.0,90.0]' END AS cell_text, true AS same FROM lineitem WHERE l_partkey%19<>0"""
    xyz = "'\"xyz\":[0.0,0.5' || CASE WHEN l_partkey%13=1 THEN '' ELSE ',' || CAST((l_partkey%10)/10.0::DOUBLE AS VARCHAR) END || ']}'"
    site = lambda e: f"""'{{"species":[{{' || {e} || '"occu":1.0}}],' || {xyz}"""
    named = lambda n: f"""'"element":"' || {_sym(n)} || '",'"""
    sql["sites_to_text"] = f"""SELECT {of_entry}, '[' || CASE l_partkey%13 WHEN 0 THEN '' WHEN 1 THEN {site(named('l_partkey'))}
      WHEN 2 THEN {site(named('l_partkey'))} || ',' || {site("''")} ELSE {site(named('l_partkey'))} || ',' || {site(named('l_suppkey'))} END || ']' AS sites_text,
      true AS same FROM lineitem WHERE l_partkey%19<>0"""
    spins = lambda *v: "concat_ws(',', " + ", ".join(f"CAST({x}::DOUBLE AS VARCHAR)" for x in v) + ")"
    k = "o_orderkey"
    sql["parse_dos"] = f"""SELECT {k} AS structure_id, CASE WHEN {k}%13<>0 AND {k}%11<>0 THEN ({k}%9)/2.0::DOUBLE - 2.5 END AS efermi,
      CASE WHEN {k}%13<>0 THEN {spins(f'(-1.0::DOUBLE - {k}%3)', '0.0', f'(1.0::DOUBLE + {k}%2)')} END AS energies,
      CASE WHEN {k}%13<>0 THEN {spins(f'(({k}%5)/10.0::DOUBLE)', f'(({k}%7)/5.0::DOUBLE)', f'(({k}%4)/2.0::DOUBLE)')} END AS up,
      CASE WHEN {k}%13<>0 AND {k}%2=0 THEN {spins(f'(({k}%3)/10.0::DOUBLE)', f'(({k}%2)/5.0::DOUBLE)', f'(({k}%6)/2.0::DOUBLE)')} END AS down FROM orders"""
    trig = "WITH " + _CELLS + ", t AS (SELECT *, cos(radians(alpha)) AS ca, cos(radians(beta)) AS cb, cos(radians(gamma)) AS cg, sin(radians(alpha)) AS sa, sin(radians(beta)) AS sb FROM cells), u AS (SELECT *, acos((ca*cb - cg)/(sa*sb)) AS gs FROM t)"
    sql["lattice_matrix"] = trig + """ SELECT id AS structure_id, round(a*sb, 6) AS m00, 0.0::DOUBLE AS m01, round(a*cb, 6) AS m02,
      round(-b*sa*cos(gs), 6) + 0.0 AS m10, round(b*sa*sin(gs), 6) AS m11, round(b*ca, 6) AS m12, 0.0::DOUBLE AS m20, 0.0::DOUBLE AS m21, c AS m22 FROM u"""
    sql["lattice_params"] = f"WITH {_CELLS} SELECT id AS structure_id, a AS cell_a, b AS cell_b, c AS cell_c, alpha AS cell_alpha, beta AS cell_beta, gamma AS cell_gamma FROM cells"
    sql["cell_volume"] = f"WITH {_CELLS} SELECT id AS structure_id, round(v, 6) AS volume, round(v/nullif(id%8, 0), 6) AS volume_per_atom, false AS skewed FROM vol"
    sql["density"] = f"WITH {_EL}, {_CELLS}, {_SITES}, {_STATS} SELECT id AS structure_id, round(mass*1.66053906660::DOUBLE/v, 6) AS density FROM stats JOIN vol USING (id)"
    sql["crystal_system"] = f"SELECT o_orderkey AS row_id, {_SYSTEM.format(n='(o_orderkey%240)')} AS crystal_system FROM orders"
    sql["min_image_distance"] = f"""WITH {_CELLS}, {_SITES}, {_EDGES.replace('HAVING d <= 3.0', '')}
      SELECT id AS structure_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(d, 5) AS distance FROM edges"""
    sql["is_metal"] = f"WITH {_DOCS} SELECT comp AS supercon_composition, gap_long = 0 AS is_metal FROM docs"
    sql["dos_at_fermi"] = f"WITH {_DOS} SELECT k AS structure_id, round(dos, 6) AS dos FROM dos"
    sql["energy_per_site"] = "SELECT o_orderkey AS row_id, round(CASE WHEN o_orderkey%4>0 THEN o_totalprice/(o_orderkey%4) ELSE o_totalprice END, 4) AS energy FROM orders"
    sql["derive_targets"] = f"""WITH {_DOCS}, {_DOS} SELECT comp AS supercon_composition, coalesce(gap_long, gap_short) AS target_band_gap,
      round(fe, 8) AS target_formation_energy, coalesce(gap_long, gap_short) = 0 AS target_is_metal, round(dos, 6) AS target_dos_at_fermi
      FROM docs JOIN dos USING (k)"""

    full = lambda e: f"CASE WHEN k%10<>0 THEN {e} END"
    sql["feature_table"] = f"""WITH {_EL}, {_CELLS}, {_SITES}, {_EDGES}, {_STATS}, {_DOCS}, {_DOS},
      ne AS (SELECT id, count(*) AS n, string_agg(i || '-' || j, ',' ORDER BY i, j) AS pairs, sum(d) AS total FROM edges GROUP BY id),
      gn AS (SELECT id, string_agg(i || ':' || atomic_number || ':' || CAST(electronegativity AS VARCHAR), ',' ORDER BY i) AS nodes FROM sites JOIN el USING (element) GROUP BY id),
      amounts AS (SELECT CAST(id AS VARCHAR) AS f, element AS sym, CAST(count(*) AS DOUBLE) AS amt FROM sites GROUP BY id, element), {_display('amounts')}
      SELECT mid AS material_id, comp AS supercon_composition, tc AS critical_temperature_tc, round(coalesce(gap_long, gap_short), 8) AS band_gap_mp,
      round(fe, 8) AS formation_energy_per_atom_mp, coalesce(gap_long, gap_short)=0 AS is_metal, round(dos, 8) AS dos_at_fermi,
      {full('num_elements')} AS num_elements, {full('elements')} AS elements, round({full('mass*1.66053906660::DOUBLE/v')}, 8) AS density_pg,
      round({full('v')}, 8) AS volume_pg, round({full('v/num_sites')}, 8) AS volume_per_atom_pg, {full('CAST(k%230 + 1 AS INTEGER)')} AS spacegroup_number_pg,
      {full(_SYSTEM.format(n='(k%230 + 1)'))} AS crystal_system_pg, {full('a')} AS lattice_a_pg, {full('b')} AS lattice_b_pg, {full('c')} AS lattice_c_pg,
      {full('alpha')} AS lattice_alpha_pg, {full('beta')} AS lattice_beta_pg, {full('gamma')} AS lattice_gamma_pg, {full('CAST(num_sites AS INTEGER)')} AS num_sites_pg,
      round(coalesce(gap_long, gap_short), 8) AS target_band_gap, round(fe, 8) AS target_formation_energy, coalesce(gap_long, gap_short)=0 AS target_is_metal,
      round(dos, 8) AS target_dos_at_fermi, {full('num_sites')} AS num_graph_nodes, {full('coalesce(ne.n, 0)')} AS num_graph_edges,
      {full('shown.formula')} AS formula_pretty, {full('gn.nodes')} AS graph_nodes, {full("coalesce(ne.pairs, '')")} AS graph_edges, round({full('coalesce(ne.total, 0)')}, 4) AS graph_length
      FROM docs JOIN dos USING (k) JOIN cells ON cells.id = k JOIN vol ON vol.id = k JOIN stats ON stats.id = k LEFT JOIN ne ON ne.id = k
      JOIN gn ON gn.id = k JOIN shown ON shown.f = CAST(k AS VARCHAR)"""
    prep = ", ".join(
        f"round((coalesce({c}, (SELECT avg({c}) FROM tr)) - (SELECT avg({c}) FROM tr)) / (SELECT CASE WHEN s>0 THEN s ELSE 1 END FROM (SELECT stddev_pop(coalesce({c}, mu)) AS s FROM tr, (SELECT avg({c}) AS mu FROM tr))), 5) AS {c}"
        for c in _PREP
    )
    sql["numeric_prep"] = f"WITH {_MODEL}, {_split2('m', 'material_id')}, tr AS (SELECT * FROM parts WHERE split='train') SELECT material_id, {prep} FROM parts"
    categories = lambda c, start: f"""{c}_f AS (SELECT material_id, split, coalesce({c}, (SELECT {c} FROM tr WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS v FROM parts),
      {c}_d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 + {start} AS at FROM (SELECT DISTINCT v FROM {c}_f WHERE split = 'train'))"""  # noqa: E731
    sql["categorical_prep"] = f"""WITH {_MODEL}, {_split2('m', 'material_id')}, tr AS (SELECT * FROM parts WHERE split='train'),
      {categories('elements', 0)}, {categories('crystal_system_pg', '(SELECT count(*) FROM elements_d)')}
      SELECT material_id, p.split, e.at AS elements_at, c.at AS crystal_system_pg_at,
        CAST((SELECT count(*) FROM elements_d) + (SELECT count(*) FROM crystal_system_pg_d) AS INTEGER) AS width,
        concat_ws(',', e.at, c.at) AS set
      FROM parts p JOIN elements_f ef USING (material_id) JOIN crystal_system_pg_f cf USING (material_id)
      LEFT JOIN elements_d e ON e.v = ef.v LEFT JOIN crystal_system_pg_d c ON c.v = cf.v"""
    held_out = "SELECT CAST(ceil(0.2::DOUBLE*count(*)) AS BIGINT) AS n, true AS learned FROM part WHERE {where}"
    for name in ("fit_gap_regressor", "fit_energy_regressor", "fit_metal_classifier"):
        sql[name] = held_out.format(where="p_partkey%21<>0")
    sql["fit_dos_regressor"] = held_out.format(where="p_partkey%3=0 AND p_partkey%6<>0")
    sql["score_properties"] = """SELECT 'part-' || p_partkey AS material_id, true AS has_class, true AS probable, true AS gap_inside,
      true AS energy_inside, true AS dos_for_metals FROM part"""
    sql["model_save_load"] = "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed, CAST(0 AS BIGINT) AS n_without_model FROM part"
    sql["structure_nodes"] = f"WITH {_EL}, {_SITES} SELECT id AS structure_id, CAST(i AS INTEGER) AS original_site_index, atomic_number, electronegativity FROM sites JOIN el USING (element)"
    sql["structure_edges"] = f"{geometry} SELECT {edge_columns} FROM edges"
    sql["graph_rows"] = _GRAPH_OK.rstrip().rstrip(",") + " SELECT * EXCLUDE (k) FROM whole"
    graph = f"WITH {_EL}, {_CELLS}, {_SITES}, {_EDGES}, {_GNODES}"
    sql["neighbor_aggregate"] = f"{graph}, {_layer('l1', 'nodes', ['x0', 'x1'])} SELECT id AS structure_id, CAST(i AS INTEGER) AS node, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM l1"
    sql["graph_mean_pool"] = f"{graph} SELECT id AS structure_id, round(avg(x0), 6) AS x0, round(avg(x1), 6) AS x1 FROM nodes GROUP BY id"
    out = " + ".join([f"{w['b_out']}::DOUBLE"] + [f"avg({k})*({v}::DOUBLE)" for k, v in zip(("k0", "k1"), w["w_out"])])
    sql["gcn_score"] = f"""{graph}, {_layer('l1', 'nodes', ['x0', 'x1'])}, {_dense('d1', 'l1', ['x0', 'x1'], w['w1'], w['b1'], ['h0', 'h1', 'h2'])},
      {_layer('l2', 'd1', ['h0', 'h1', 'h2'])}, {_dense('d2', 'l2', ['h0', 'h1', 'h2'], w['w2'], w['b2'], ['k0', 'k1'])}
      SELECT id AS structure_id, round({out}, 6) AS score FROM d2 GROUP BY id"""
    scored = sql["gcn_score"].replace(f"round({out}, 6) AS score", f"{out} AS score").rpartition("SELECT id AS structure_id")
    sql["gcn_fit"] = f"""{scored[0]}, scored AS (SELECT id AS structure_id{scored[2]})
      SELECT 0 AS epoch, round(avg(pow(score - (structure_id%9)/4.0::DOUBLE, 2)), 6) AS first_loss, CAST(NULL AS BOOLEAN) AS lower FROM scored
      UNION ALL SELECT 1, NULL, true"""
    sql["target_select"] = "SELECT o_orderkey AS structure_id, o_orderkey*0.5::DOUBLE AS target FROM orders WHERE o_orderkey%3<>0"
    sql["graph_validate"] = _GRAPH_OK.rstrip().rstrip(",") + " SELECT * EXCLUDE (k) FROM whole WHERE k%5<>0"
    moves = "(VALUES (0, x, y, z), (1, -x, -y, -z), (2, x + 0.5, 0.5 - y, z)) m(o, mx, my, mz)"
    of_cell = ", ".join(f"CASE WHEN status='ok' THEN {n} END AS cell_{n}" for n in ("a", "b", "c", "alpha", "beta", "gamma"))
    far = lambda n: f"abs(p.{n} - q.{n} - round_even(p.{n} - q.{n}, 0)) < 1e-4"
    sql["cif_to_structure"] = f"""WITH {_CELLS}, {raw_sites},
      st AS (SELECT *, CASE WHEN id%9=0 THEN 'parse_error' WHEN id%6=0 AND id%5<>0 THEN 'unsupported_symmetry' ELSE 'ok' END AS status FROM cells),
      moved AS (SELECT id, i, element, o, mx - floor(mx) AS x, my - floor(my) AS y, mz - floor(mz) AS z FROM sites, LATERAL (SELECT * FROM {moves}) WHERE id%5=0),
      every AS (SELECT id, i, 0 AS o, element, x, y, z FROM sites WHERE id%5<>0 UNION ALL
        SELECT id, i, o, element, x, y, z FROM moved p WHERE NOT EXISTS (SELECT 1 FROM moved q WHERE q.id = p.id AND q.i = p.i AND q.o < p.o
          AND {far('x')} AND {far('y')} AND {far('z')})),
      placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY i, o) - 1 AS INTEGER) AS site FROM every)
      SELECT st.id AS structure_id, status, {of_cell}, site, element, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z
      FROM st LEFT JOIN placed ON placed.id = st.id AND status = 'ok'"""
    sql["structure_report"] = f"""WITH {_EL}, {_CELLS}, {_SITES}, {_EDGES}, {_STATS},
      b AS (SELECT id, count(*) AS n, avg(d) AS m FROM edges GROUP BY id)
      SELECT id AS structure_id, round(v, 4) AS volume, round(mass*1.66053906660::DOUBLE/v, 4) AS density, num_sites AS n_nodes, coalesce(n, 0) AS n_edges, round(m, 5) AS mean_bond
      FROM stats JOIN vol USING (id) LEFT JOIN b USING (id) ORDER BY n_edges DESC, structure_id LIMIT 20"""
    return sql
