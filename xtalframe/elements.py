"""Chemical elements as a small static table.

118 rows, fixed by nature, so it is the one table this package broadcasts
without a run-time size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELEMENT_SCHEMA = T.StructType(
    [
        T.StructField("element", T.StringType(), False),
        T.StructField("atomic_number", T.IntegerType(), False),
        T.StructField("electronegativity", T.DoubleType(), False),
        T.StructField("atomic_mass", T.DoubleType(), False),
    ]
)

# Symbol, Pauling electronegativity ("-" = undefined), standard
# atomic weight in u, in order of atomic number.
_FIXED_VALUES = """
H 2.20 1.00794
He - 4.002602
Li 0.98 6.941
Be 1.57 9.012182
B 2.04 10.811
C 2.55 12.0107
N 3.04 14.0067
O 3.44 15.9994
F 3.98 18.9984032
Ne - 20.1797
Na 0.93 22.98976928
Mg 1.31 24.3050
Al 1.61 26.9815386
Si 1.90 28.0855
P 2.19 30.973762
S 2.58 32.065
Cl 3.16 35.453
Ar - 39.948
K 0.82 39.0983
Ca 1.00 40.078
Sc 1.36 44.955912
Ti 1.54 47.867
V 1.63 50.9415
Cr 1.66 51.9961
Mn 1.55 54.938045
Fe 1.83 55.845
Co 1.88 58.933195
Ni 1.91 58.6934
Cu 1.90 63.546
Zn 1.65 65.409
Ga 1.81 69.723
Ge 2.01 72.64
As 2.18 74.92160
Se 2.55 78.96
Br 2.96 79.904
Kr 3.00 83.798
Rb 0.82 85.4678
Sr 0.95 87.62
Y 1.22 88.90585
Zr 1.33 91.224
Nb 1.6 92.90638
Mo 2.16 95.94
Tc 1.9 98.0
Ru 2.2 101.07
Rh 2.28 102.90550
Pd 2.20 106.42
Ag 1.93 107.8682
Cd 1.69 112.411
In 1.78 114.818
Sn 1.96 118.710
Sb 2.05 121.760
Te 2.1 127.60
I 2.66 126.90447
Xe 2.6 131.293
Cs 0.79 132.9054519
Ba 0.89 137.327
La 1.10 138.90547
Ce 1.12 140.116
Pr 1.13 140.90765
Nd 1.14 144.242
Pm 1.13 145.0
Sm 1.17 150.36
Eu 1.2 151.964
Gd 1.2 157.25
Tb 1.1 158.92535
Dy 1.22 162.500
Ho 1.23 164.93032
Er 1.24 167.259
Tm 1.25 168.93421
Yb 1.1 173.04
Lu 1.27 174.967
Hf 1.3 178.49
Ta 1.5 180.94788
W 2.36 183.84
Re 1.9 186.207
Os 2.2 190.23
Ir 2.20 192.217
Pt 2.28 195.084
Au 2.54 196.966569
Hg 2.00 200.59
Tl 1.62 204.3833
Pb 2.33 207.2
Bi 2.02 208.98040
Po 2.0 210.0
At 2.2 210.0
Rn 2.2 220.0
Fr 0.7 223.0
Ra 0.9 226.0
Ac 1.1 227.0
Th 1.3 232.03806
Pa 1.5 231.03588
U 1.38 238.02891
Np 1.36 237.0
Pu 1.28 244.0
Am 1.3 243.0
Cm 1.3 247.0
Bk 1.3 247.0
Cf 1.3 251.0
Es 1.3 252.0
Fm 1.3 257.0
Md 1.3 258.0
No 1.3 259.0
Lr 1.3 262.0
Rf - 267.0
Db - 268.0
Sg - 269.0
Bh - 270.0
Hs - 270.0
Mt - 278.0
Ds - 281.0
Rg - 282.0
Cn - 285.0
Nh - 286.0
Fl - 289.0
Mc - 290.0
Lv - 293.0
Ts - 294.0
Og - 294.0
"""


def _parse() -> list[tuple[str, int, float, float]]:
    rows = []
    for z, line in enumerate(_FIXED_VALUES.split("\n")[1:-1], start=1):
        symbol, en, mass = line.split()
        rows.append((symbol, z, float("nan") if en == "-" else float(en), float(mass)))
    return rows


ELEMENTS: list[tuple[str, int, float, float]] = _parse()
SYMBOLS: list[str] = [r[0] for r in ELEMENTS]

# One alternation matching exactly the known symbols, two-letter symbols first
# so that "Co" is never read as "C" followed by a stray "o".
SYMBOL_PATTERN: str = "|".join(sorted(SYMBOLS, key=lambda s: (-len(s), s)))


def elements_table(spark: SparkSession) -> DataFrame:
    """The element table as a local relation (118 rows)."""
    rows = ", ".join(
        f"('{symbol}', {z}, double('{en}'), {mass}D)" for symbol, z, en, mass in ELEMENTS
    )
    return spark.sql(
        "SELECT * FROM VALUES "
        f"{rows} AS t(element, atomic_number, electronegativity, atomic_mass)"
    )


def join_elements(df: DataFrame, symbol: str = "element") -> DataFrame:
    """Add ``atomic_number``, ``electronegativity`` and ``atomic_mass``.

    Left join: an unknown or null symbol keeps its row with nulls; a noble gas
    without a Pauling value gets NaN. The build side is the 118-row table, so
    broadcasting it never depends on the data.
    """
    elements = elements_table(df.sparkSession).withColumnRenamed("element", "_symbol")
    return df.join(
        F.broadcast(elements), F.col(symbol) == F.col("_symbol"), "left"
    ).drop("_symbol")


def electronegativity_rank(symbol: Column) -> Column:
    """Position of a symbol when symbols are ordered by (electronegativity, symbol).

    Undefined electronegativities come last. Works inside array lambdas, where
    a join is impossible: the answer is an offset into one constant string.
    """
    order = sorted(ELEMENTS, key=lambda r: (r[2] if r[2] == r[2] else 99.0, r[0]))
    text = " " + " ".join(r[0] for r in order) + " "
    return F.instr(F.lit(text), F.concat(F.lit(" "), symbol, F.lit(" ")))


def electronegativity_of(symbol: Column) -> Column:
    """Pauling value of a symbol as an expression; unknown symbols give null."""
    pairs = [F.lit(v) for r in ELEMENTS for v in (r[0], r[2])]
    return F.try_element_at(F.create_map(*pairs), symbol)


def symbol_array() -> Column:
    """All symbols in order of atomic number, as one constant."""
    return F.expr("array(" + ", ".join(f"'{e[0]}'" for e in ELEMENTS) + ")")


def element_values(symbol: Column) -> Column:
    """``struct<atomic_number, electronegativity, atomic_mass>`` of a symbol as an
    expression, for use within a row; unknown symbols give null."""
    number = lambda v: f"double('{v}')" if v != v else f"{v!r}D"
    rows = ", ".join(f"named_struct('atomic_number', {z}, 'electronegativity', {number(en)}, 'atomic_mass', {number(m)})" for _, z, en, m in ELEMENTS)
    return F.get(F.expr(f"array({rows})"), F.array_position(symbol_array(), symbol).cast("int") - 1)
