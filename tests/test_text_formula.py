"""Golden cases for numbers and formulas."""

import math

import pytest
from pyspark.sql import functions as F

from xtalframe.elements import element_values, join_elements
from xtalframe.functions import formula as FO
from xtalframe.functions.text import missing_if_na, to_number


def run(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_numbers(spark):
    texts = ["1.5", "bad", "", None, " 12 ", "1e3", "-inf", "1.0d", "1f", "NaN", ".5", "5.", "1_0"]
    got = [r[0] for r in run(spark, texts, to_number(F.col("t")))]
    assert got == [1.5, None, None, None, 12.0, 1000.0, float("-inf"), None, None, None, 0.5, 5.0, None]


def test_missing(spark):
    got = [r[0] for r in run(spark, [" a ", "N/A", "", "  "], missing_if_na(F.col("t")))]
    assert got == ["a", None, None, None]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Fe2O3", {"Fe": 2.0, "O": 3.0}),
        ("Ca3(PO4)2", {"Ca": 3.0, "O": 8.0, "P": 2.0}),
        ("K4(Fe(C1N1)6)1", {"C": 6.0, "Fe": 1.0, "K": 4.0, "N": 6.0}),
        ("Hg1Ba2Ca2Cu3O8.29", {"Ba": 2.0, "Ca": 2.0, "Cu": 3.0, "Hg": 1.0, "O": 8.29}),
        ("FeFe2", {"Fe": 3.0}),
        ("Fe)2(", None),
        ("Xx2", None),
        ("", None),
    ],
)
def test_parse_formula(spark, text, expected):
    (parts,) = run(spark, [text], FO.parse_formula(F.col("t")))[0]
    assert (None if parts is None else {p["symbol"]: p["amount"] for p in parts}) == expected


def test_clean_and_elements(spark):
    texts = ["YBa2Cu3O7-delta", "Fe(vac)2 ", "(abc)", "REBa2Cu3O7", "Qq2", "Fe+2", "X1Cu2", "M", "12"]
    got = run(spark, texts, FO.clean_formula(F.col("t")), FO.formula_elements(F.col("t")))
    assert got == [
        ("YBa2Cu3O7", ["Ba", "Cu", "O", "Y"]),
        ("Fe2", ["Fe"]),
        (None, None),
        ("REBa2Cu3O7", ["Ba", "Cu", "O"]),
        ("Qq2", None),
        ("Fe+2", ["Fe"]),
        ("X1Cu2", ["Cu"]),
        ("M", None),
        ("12", None),
    ]


def test_reduced_and_match(spark):
    parts = FO.parse_formula(F.col("t"))
    got = run(spark, ["Al4Si4", "O4", "Na2Cl2", "Ca3(PO4)2", "Fe1Te0.5Se0.5", "Li2O2"], FO.reduced_formula(parts))
    assert [r[0] for r in got] == ["AlSi", "O2", "NaCl", "Ca3(PO4)2", "FeTe0.5Se0.5", "Li2O2"]
    same = run(spark, ["Fe4O6", "FeO", "O3Fe2"], FO.formula_match(F.col("t"), F.lit("Fe2O3")))
    assert [r[0] for r in same] == [True, False, True]
    assert run(spark, ["O3Fe2"], FO.chemical_system(F.col("t"))) == [("Fe-O",)]


# Fixed values, from common tables: number, Pauling electronegativity, weight.
GOLDEN = """H 1 2.20 1.008; He 2 - 4.0026; Li 3 0.98 6.94; C 6 2.55 12.011; N 7 3.04 14.007; O 8 3.44 15.999; F 9 3.98 18.998; Na 11 0.93 22.990
Mg 12 1.31 24.305; Al 13 1.61 26.982; Si 14 1.90 28.086; S 16 2.58 32.06; Cl 17 3.16 35.45; K 19 0.82 39.098; Ca 20 1.00 40.078; Ti 22 1.54 47.867
Fe 26 1.83 55.845; Co 27 1.88 58.933; Ni 28 1.91 58.693; Cu 29 1.90 63.546; Zn 30 1.65 65.38; As 33 2.18 74.922; Y 39 1.22 88.906; Nb 41 1.6 92.906
Ag 47 1.93 107.868; Sn 50 1.96 118.710; Ba 56 0.89 137.327; La 57 1.10 138.905; Hg 80 2.00 200.592; Pb 82 2.33 207.2; Bi 83 2.02 208.980; U 92 1.38 238.029"""


def test_element_values(spark):
    """The element table against values that come from elsewhere, as rows and as
    an expression within a row."""
    want = [r.split() for line in GOLDEN.splitlines() for r in line.split(";")]
    df = spark.createDataFrame([(r[0],) for r in want] + [("Qq",)], "element string")
    joined = {r["element"]: r for r in join_elements(df).collect()}
    within = {r["element"]: r["v"] for r in df.select("element", element_values(F.col("element")).alias("v")).collect()}
    assert within["Qq"] is None
    for symbol, number, negativity, weight in want:
        for row in (joined[symbol], within[symbol]):
            assert row["atomic_number"] == int(number)
            assert row["atomic_mass"] == pytest.approx(float(weight), rel=1e-3)
            assert math.isnan(row["electronegativity"]) if negativity == "-" else row["electronegativity"] == float(negativity)
