"""Lattice geometry as column arithmetic.

A cell is ``struct<a, b, c, alpha, beta, gamma>`` in angstrom and degrees.
Distances need only its metric tensor (six numbers), so no matrix is ever
built on the neighbour-search path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xtalframe.functions.once import compute_once

CELL = "struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>"

# u / A^3 to g / cm^3
_DENSITY_FACTOR = 1.66053906660

# Last space-group number of each crystal system.
CRYSTAL_SYSTEMS = [
    (2, "triclinic"),
    (15, "monoclinic"),
    (74, "orthorhombic"),
    (142, "tetragonal"),
    (167, "trigonal"),
    (194, "hexagonal"),
    (230, "cubic"),
]


def cell(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Pack six parameters into a cell."""
    names = ["a", "b", "c", "alpha", "beta", "gamma"]
    return F.struct(
        *[v.cast("double").alias(n) for n, v in zip(names, [a, b, c, alpha, beta, gamma])]
    )


def _cosines(cell: Column) -> tuple[Column, Column, Column]:
    return tuple(F.cos(F.radians(cell[k])) for k in ("alpha", "beta", "gamma"))


def metric(cell: Column) -> list[Column]:
    """Metric tensor of a cell as six named columns g11, g22, g33, g12, g13, g23."""
    cos_a, cos_b, cos_g = _cosines(cell)
    a, b, c = cell["a"], cell["b"], cell["c"]
    return [
        (a * a).alias("g11"),
        (b * b).alias("g22"),
        (c * c).alias("g33"),
        (a * b * cos_g).alias("g12"),
        (a * c * cos_b).alias("g13"),
        (b * c * cos_a).alias("g23"),
    ]


METRIC = ["g11", "g22", "g33", "g12", "g13", "g23"]


def lattice_matrix(cell: Column) -> list[list[Column]]:
    """Lattice vectors as three rows of three expressions (c along z)."""
    cos_a, cos_b, cos_g = _cosines(cell)
    sin_a, sin_b = F.sin(F.radians(cell["alpha"])), F.sin(F.radians(cell["beta"]))
    star = (cos_a * cos_b - cos_g) / (sin_a * sin_b)
    star = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), star))
    a, b, c = cell["a"], cell["b"], cell["c"]
    zero = F.lit(0.0)
    return [
        [a * sin_b, zero, a * cos_b],
        [-b * sin_a * star, b * sin_a * F.sqrt(1 - star * star), b * cos_a],
        [zero, zero, c],
    ]


def lattice_params(matrix: Column) -> Column:
    """3x3 matrix (array of three rows) to a cell; null unless it is 3x3."""
    rows = [[matrix[i][j] for j in range(3)] for i in range(3)]

    def dot(u: list[Column], v: list[Column]) -> Column:
        return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    lengths = [F.sqrt(dot(r, r)) for r in rows]

    def angle(i: int, j: int) -> Column:
        cosine = dot(rows[i], rows[j]) / (lengths[i] * lengths[j])
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))

    shaped = (F.size(matrix) == 3) & F.forall(matrix, lambda r: F.size(r) == 3)
    return F.when(shaped, cell(*lengths, angle(1, 2), angle(0, 2), angle(0, 1)))


def cell_volume(cell: Column) -> Column:
    """Volume in cubic angstrom."""
    cos_a, cos_b, cos_g = _cosines(cell)
    shape = 1 - cos_a * cos_a - cos_b * cos_b - cos_g * cos_g + 2 * cos_a * cos_b * cos_g
    return cell["a"] * cell["b"] * cell["c"] * F.sqrt(shape)


def volume_per_atom(cell: Column, num_sites: Column) -> Column:
    """Volume per site; null for a structure without sites."""
    return cell_volume(cell) / F.nullif(num_sites, F.lit(0))


def density(total_mass: Column, volume: Column) -> Column:
    """Density in g/cm3 from the mass of all sites in u and the volume in A3."""
    return total_mass * F.lit(_DENSITY_FACTOR) / volume


def crystal_system(number: Column) -> Column:
    """Crystal system of a space-group number; null outside 1-230."""
    result = F.when(number < 1, F.lit(None).cast("string"))
    for last, name in CRYSTAL_SYSTEMS:
        result = result.when(number <= last, F.lit(name))
    return result


def strongly_skewed(cell: Column) -> Column:
    """Cells with an angle outside 45-135 degrees: written in an unusual setting."""
    angles = [cell[k] for k in ("alpha", "beta", "gamma")]
    return F.least(*angles).__lt__(45.0) | F.greatest(*angles).__gt__(135.0)


def wrap(fraction: Column) -> Column:
    """Fractional coordinate moved into [0, 1)."""
    return fraction - F.floor(fraction)


def _square(y: str, z: str) -> str:
    """Least squared length over all x images, for given y and z differences.

    In x the square is a quadratic, so its least value over the whole numbers
    is at the one nearest to its minimum, however oblique the cell.
    """
    shift = f"(dx + (g12 * {y} + g13 * {z}) / g11)"
    return (
        f"g11 * pow({shift} - rint({shift}), 2) + {y} * {y} * (g22 - g12 * g12 / g11)"
        f" + 2D * {y} * {z} * (g23 - g12 * g13 / g11) + {z} * {z} * (g33 - g13 * g13 / g11)"
    )


_IMAGES = [(y, z) for y in (-1, 0, 1) for z in (-1, 0, 1)]


def image_constants(lattice: str) -> Column:
    """What the nine (y, z) images of a reduced lattice add to a pair's own
    terms, for ``pairs_within``: once per structure."""
    g = {n: f"{lattice}.{n}" for n in METRIC}
    ratio = lambda a, b: f"coalesce(try_divide({a}, {b}), double('NaN'))"
    parts = {
        "g": g["g11"],
        "cy": ratio(g["g12"], g["g11"]),
        "cz": ratio(g["g13"], g["g11"]),
        "yy": f"{g['g22']} - {ratio(f'{g['g12']} * {g['g12']}', g['g11'])}",
        "zz": f"{g['g33']} - {ratio(f'{g['g13']} * {g['g13']}', g['g11'])}",
        "yz": f"2D * ({g['g23']} - {ratio(f'{g['g12']} * {g['g13']}', g['g11'])})",
    }
    for k, (y, z) in enumerate(_IMAGES):
        parts[f"s{k}"] = f"{y} * ({parts['cy']}) + {z} * ({parts['cz']})"
        parts[f"q{k}"] = f"{y * y} * ({parts['yy']}) + {z * z} * ({parts['zz']}) + {y * z} * ({parts['yz']})"
    return F.expr("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in parts.items()) + ")")


def pairs_within(points: str, images: str, cutoff: float) -> Column:
    """The neighbour pairs of one structure as an array of (source_node_index,
    target_node_index, distance), in order. ``points`` names an array of
    (x, y, z), wrapped fractions of the reduced lattice; ``images`` its
    ``image_constants``.

    All pairs are built within the row: for structures of few sites.
    """
    c = images
    moved = lambda k, y, z: f"d.q + {c}.q{k}" + (f" + {y} * d.a" if y else "") + (f" + {z} * d.b" if z else "")
    squares = ", ".join(
        f"{c}.g * pow((d.s + {c}.s{k}) - rint(d.s + {c}.s{k}), 2) + {moved(k, y, z)}" for k, (y, z) in enumerate(_IMAGES)
    )
    own = (
        f"named_struct('s', w.x + w.y * {c}.cy + w.z * {c}.cz, 'q', w.y * (w.y * {c}.yy + w.z * {c}.yz) + w.z * w.z * {c}.zz,"
        f" 'a', 2D * w.y * {c}.yy + w.z * {c}.yz, 'b', 2D * w.z * {c}.zz + w.y * {c}.yz)"
    )
    between = "named_struct('x', q.x - p.x, 'y', q.y - p.y, 'z', q.z - p.z)"
    distance = f"transform(transform(array({between}), w -> {own}), d -> sqrt(greatest(least({squares}), 0D)))[0]"
    pair = f"named_struct('source_node_index', i, 'target_node_index', i + 1 + j, 'distance', {distance})"
    rest = f"slice({points}, i + 2, size({points}))"
    return F.expr(f"filter(flatten(transform({points}, (p, i) -> transform({rest}, (q, j) -> {pair}))), e -> e.distance <= {float(cutoff)!r}D)")


def min_image_squares() -> list[Column]:
    """Squared distance to the nearest x image, for each of nine (y, z) images.

    Works on columns ``dx``, ``dy``, ``dz`` (differences of wrapped
    coordinates) and the metric, both of the reduced lattice: there the nearest
    image of all is among these.
    """
    return [F.expr(_square(f"(dy + {ny}D)", f"(dz + {nz}D)")) for ny in (-1, 0, 1) for nz in (-1, 0, 1)]


def min_image_distance() -> Column:
    """Shortest distance over all periodic images, on the columns of
    :func:`min_image_squares`."""
    return F.sqrt(F.greatest(F.least(*min_image_squares()), F.lit(0.0)))


TURN = [f"t{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
_SWEEPS = 16  # of nine steps; two steps on a pair of vectors divide their ratio by three
_MORE, _LESS = "1.000000001D", "0.999999999D"  # what lengths may differ by and count as equal
#: The steps of a sweep: the vector v that changes, the one that is taken off it
#: and the third; then each vector against both others.
_MOVES = [(1, 0, 2), (0, 1, 2), (2, 0, 1), (0, 2, 1), (2, 1, 0), (1, 2, 0), (0, 1, 2), (1, 0, 2), (2, 0, 1)]
_SUMS_FROM = 6

# State s: metric g and turn t, nine numbers each, row by row.
_REDUCED = (
    f"2 * abs({{s}}.g[1]) <= least({{s}}.g[0], {{s}}.g[4]) * {_MORE} AND 2 * abs({{s}}.g[2]) <= least({{s}}.g[0], {{s}}.g[8]) * {_MORE}"
    f" AND 2 * abs({{s}}.g[5]) <= least({{s}}.g[4], {{s}}.g[8]) * {_MORE} AND {{s}}.g[0] + {{s}}.g[4] + {{s}}.g[8] + 2 * least("
    "{s}.g[1] + {s}.g[2] + {s}.g[5], {s}.g[1] - {s}.g[2] - {s}.g[5], {s}.g[2] - {s}.g[1] - {s}.g[5], {s}.g[5] - {s}.g[1] - {s}.g[2])"
    f" >= greatest({{s}}.g[0], {{s}}.g[4], {{s}}.g[8]) * {_LESS}"
)


def _step_sql(v: int, a: int, b: int, sums: bool) -> str:
    """One step as SQL over the state ``s``: vector v less as many of vector a as
    leave it shortest; or, if it is the longest, replaced by a shorter sum of all
    three. Only lengths fall. Written out for its three vectors, so that a row
    pays for the numbers that change and not for looking up which do."""
    f = lambda i, j: f"s.g[{3 * i + j}]"
    if sums:
        square = f"{f(v, v)} + {f(a, a)} + {f(b, b)}"
        four = ", ".join(
            f"named_struct('square', {square} + 2 * ({p} * {f(v, a)} + {q} * {f(v, b)} + {p * q} * {f(a, b)}), 'ka', {p}D, 'kb', {q}D)"
            for p in (1, -1)
            for q in (1, -1)
        )
        # the longest vector has something to win
        taken = f"{f(v, v)} >= {f(a, a)} AND {f(v, v)} >= {f(b, b)} AND c.square < {f(v, v)} * {_LESS}"
        ka, kb = "c.ka", "c.kb"
    else:
        ka, kb = "c", ""
    and_b = lambda value: f" + {kb} * {value}" if sums else ""

    def length(i: int, j: int) -> str:
        value = f(i, j)
        if i == v:
            value += f" + ({ka} * {f(a, j)}{and_b(f(b, j))})"
        if j == v:
            value += f" + ({ka} * {f(i, a)}{and_b(f(i, b))})"
        if i == j == v:
            value += f" + ({ka} * {ka} * {f(a, a)}" + (f" + {kb} * {kb} * {f(b, b)} + 2 * {ka} * {kb} * {f(a, b)})" if sums else ")")
        return value

    def turn(i: int, j: int) -> str:
        less = {a: ka, b: kb}.get(j)
        return f"s.t[{3 * i + j}]" + (f" - {less} * s.t[{3 * i + v}]" if less else "")

    nine = lambda of: "array(" + ", ".join(of(i, j) for i in range(3) for j in range(3)) + ")"
    moved = f"named_struct('g', {nine(length)}, 't', {nine(turn)})"
    if sums:
        return f"transform(array(array_min(array({four}))), c -> if({taken}, {moved}, s))[0]"
    count = f"-rint(coalesce(try_divide({f(a, v)}, {f(a, a)}), 0D))"
    return f"transform(array({count}), c -> if(c = 0D, s, {moved}))[0]"


def with_reduced_lattice(df: DataFrame, cell: str = "cell", name: str = "lattice") -> DataFrame:
    """Add the lattice of a cell by its shortest vectors (Minkowski reduction):
    six numbers of the metric, and nine that turn fractions of the cell into
    fractions of those vectors.

    However oblique or thin the setting a cell is written in, its nearest
    images are afterwards the nearest in every direction. A fold of a fixed
    number of steps, once for each row; cells that are reduced as they are take
    none, and after a first sweep the others are hardly ever looked at.
    """
    g = dict(zip(METRIC, metric(F.col(cell))))
    full = F.array(*[g[f"g{min(i, j)}{max(i, j)}"] for i in (1, 2, 3) for j in (1, 2, 3)])
    one = F.array(*[F.lit(float(i == j)) for i in range(3) for j in range(3)])
    steps = [_step_sql(*move, sums=k >= _SUMS_FROM) for k, move in enumerate(_MOVES)]
    step = f"CASE n % {len(_MOVES)} " + " ".join(f"WHEN {k} THEN {one}" for k, one in enumerate(steps)) + " ELSE s END"

    def go_on(first: int, last: int) -> Column:
        places = f"sequence({first * len(_MOVES)}, {last * len(_MOVES) - 1})"
        fold = f"aggregate({places}, _state, (s, n) -> if({_REDUCED.format(s='s')}, s, {step}))"
        return F.expr(f"if(_done, _state, {fold})")

    out = compute_once(df, {"_state": F.struct(full.alias("g"), one.alias("t"))})
    for first, last in ((0, 1), (1, _SWEEPS)):
        # folds are not compiled; a column beside them is, and most rows need no more
        done = out.withColumn("_done", F.expr(f"coalesce({_REDUCED.format(s='_state')}, true)"))  # null: no cell
        out = compute_once(done, {"_state": go_on(first, last)}).drop("_done")
    entries = [f"'g{i}{j}', _state.g[{3 * (i - 1) + j - 1}]" for i, j in ((1, 1), (2, 2), (3, 3), (1, 2), (1, 3), (2, 3))]
    entries += [f"'{n}', _state.t[{k}]" for k, n in enumerate(TURN)]
    return compute_once(out, {name: F.expr(f"named_struct({', '.join(entries)})")}).drop("_state")


def turned(lattice: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Fractions of the cell as fractions of its reduced lattice."""
    return tuple(x * lattice[f"t1{j}"] + y * lattice[f"t2{j}"] + z * lattice[f"t3{j}"] for j in (1, 2, 3))


def image_heights() -> tuple[Column, Column, Column]:
    """Distance between opposite faces of the cell, per axis, from the metric columns."""
    faces = ("g22 * g33 - g23 * g23", "g11 * g33 - g13 * g13", "g11 * g22 - g12 * g12")
    det = (
        "g11 * (g22 * g33 - g23 * g23) - g12 * (g12 * g33 - g13 * g23)"
        " + g13 * (g12 * g23 - g22 * g13)"
    )
    return tuple(F.expr(f"sqrt(greatest({det}, 0D) / ({face}))") for face in faces)
