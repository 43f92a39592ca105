"""Materials-shaped views over general business tables.

The registered queries run on these. Each view is a plain projection of one or
two whole tables; missing and malformed values are injected by arithmetic on
the keys, because the source columns hold none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xtalframe.functions import lattice
from xtalframe.operators.candidates import add_formula_keys
from xtalframe.functions.formula import formula_elements
from xtalframe.functions.once import compute_once

SYMBOLS = (
    "H Li C N O F Na Mg Al Si P S Cl K Ca Ti V Cr Mn Fe "
    "Co Ni Cu Zn Ga Ge As Se Sr Y Zr Nb Mo Ag Cd In Sn Ba La Bi"
).split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_key(df: DataFrame, key: str) -> DataFrame:
    """A table as a store partitioned by its key delivers it: in as many hash
    partitions as the session shuffles into, whatever its files look like. Plans
    are the same at every size, and what reads the view twice shuffles it once.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _as_file(df: DataFrame) -> DataFrame:
    """Derived columns as plain attributes, as a reader would deliver them."""
    return compute_once(df, {c: F.col(c) for c in df.columns})


def _symbol(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), (n % 40 + 1).cast("int"))


def _div(n: Column, by: int) -> Column:
    return F.floor(n / by)


def _triple(u: Column) -> list[Column]:
    return [_symbol(u), _symbol(u * 3 + _div(u, 40)), _symbol(u * 7 + 3)]


def _formula(u: Column, e: Column) -> Column:
    """Three symbols from ``u`` with amounts from ``e``."""
    e1, e2, e3 = _triple(u)
    return F.concat(
        e1,
        (e % 4 + 1).cast("string"),
        e2,
        (_div(e, 4) % 3 + 1).cast("string"),
        e3,
        F.when(e % 10 == 0, "0.5").otherwise(""),
    )


def tc_raw(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, composition, tc_text: a critical-temperature table as text."""
    e = F.col("event_id")
    text = (
        F.when(e % 17 == 0, "N/A")
        .when(e % 13 == 0, "")
        .when(e % 11 == 0, "-1.5")
        .when(e % 29 == 0, "NaN")
        .when(e % 31 == 0, "1.0d")
        .otherwise(F.col("value").cast("string"))
    )
    return _as_file(table(spark, sf, "events").select(
        e.alias("row_id"),
        F.when(e % 23 != 0, _formula(F.col("user_id"), e)).alias("composition"),
        text.alias("tc_text"),
    ))


def compositions(spark: SparkSession, sf: str, match: bool = True) -> DataFrame:
    """Distinct compositions of the Tc table with their formula keys."""
    names = tc_raw(spark, sf).where(F.col("composition").isNotNull()).select("composition").distinct()
    return add_formula_keys(names, "composition", match)


def entries(spark: SparkSession, sf: str, match: bool = True) -> DataFrame:
    """Candidate entries with formula keys; energies tie often."""
    k = F.col("o_orderkey")
    orders = by_key(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    base = orders.select(
        k.alias("row_id"),
        F.concat(F.lit("mp-"), k.cast("string")).alias("material_id"),
        _formula(F.col("o_custkey"), k * 3 + 1).alias("formula_pretty"),
        F.when(k % 9 != 0, (k % 5) / 10.0).alias("energy_above_hull"),
        F.when(k % 13 != 0, -(k % 7) / 2.0).alias("formation_energy_per_atom"),
        F.when(k % 50 != 0, F.col("o_orderstatus") == "P").alias("deprecated"),
    )
    return add_formula_keys(_as_file(base), "formula_pretty", match)


def details(spark: SparkSession, sf: str) -> DataFrame:
    """Detail rows for most entries."""
    k = F.col("o_orderkey")
    return (
        table(spark, sf, "orders")
        .where(k % 6 != 0)
        .select(
            F.concat(F.lit("mp-"), k.cast("string")).alias("material_id"),
            F.col("o_totalprice").alias("band_gap"),
        )
    )


def set_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Compositions with the element set they ask for."""
    s = F.col("s_suppkey")
    return _as_file(table(spark, sf, "supplier").select(
        F.concat(F.lit("c"), s.cast("string")).alias("composition"),
        formula_elements(_formula(s, s)).alias("elements"),
    ))


def set_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the element-set database."""
    k = F.col("o_orderkey")
    orders = by_key(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return _as_file(orders.select(
        k.alias("entry_id"),
        F.array_sort(F.array_distinct(F.array(*_triple(F.col("o_custkey")), _symbol(k)))).alias(
            "elements"
        ),
        F.when(k % 9 != 0, (k % 11) / 4.0).alias("delta_e"),
        F.when(k % 7 != 0, (k % 3) / 8.0).alias("stability"),
    ))


def entry_lists(spark: SparkSession, sf: str) -> DataFrame:
    """supercon_composition and one candidate ``entry`` struct per row, and the
    row's address: its file and its place there."""
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    number = lambda v: F.lit(v).cast("double")
    cell = (
        F.when(k % 11 == 0, F.array(*[number(5)] * 5))
        .when(k % 11 == 1, F.array(*[number(5)] * 5, number(None)))
        .otherwise(F.array(*[number(5)] * 3, *[number(90)] * 3))
    )
    site = lambda symbol, xyz: F.struct(
        F.array(F.struct(symbol.alias("element"), F.lit(1.0).alias("occu"))).alias("species"),
        xyz.alias("xyz"),
    )
    three = F.array(number(0), number(0.5), (p % 10) / 10.0)
    no_symbol = F.lit(None).cast("string")
    sites = (
        F.when(p % 13 == 0, F.slice(F.array(site(_symbol(p), three)), 2, 1))
        .when(p % 13 == 1, F.array(site(_symbol(p), F.slice(three, 1, 2))))
        .when(p % 13 == 2, F.array(site(_symbol(p), three), site(no_symbol, three)))
        .otherwise(F.array(site(_symbol(p), three), site(_symbol(s), three)))
    )
    entry = F.struct(
        F.concat(_symbol(p), _symbol(s)).alias("name"),
        (k * 100 + F.col("l_linenumber")).alias("entry_id"),
        F.col("l_returnflag").alias("spacegroup"),
        F.lit(2).alias("ntypes"),
        F.col("l_tax").alias("band_gap"),
        F.when(k % 9 != 0, F.col("l_extendedprice") / 10000 - 5).alias("delta_e"),
        F.when(s % 7 != 0, F.col("l_discount")).alias("stability"),
        F.col("l_linestatus").alias("prototype"),
        cell.alias("unit_cell"),
        sites.alias("sites"),
        p.alias("icsd_id"),
    )
    return _as_file(table(spark, sf, "lineitem").select(
        F.concat(F.lit("part-"), p.cast("string")).alias("supercon_composition"),
        F.when(p % 19 != 0, entry).alias("entry"),
        F.col("_metadata.file_path").alias("row_file"),
        F.col("_metadata.row_index").alias("row_index"),
    ))


def _angles(k: Column) -> tuple[Column, Column, Column]:
    return (
        F.when(k % 4 == 1, 80.0).otherwise(90.0),
        F.when(k % 6 == 2, 100.0).otherwise(90.0),
        F.when(k % 5 == 0, 120.0).otherwise(90.0),
    )


def _cell(k: Column) -> Column:
    return lattice.cell(4 + (k % 7) / 2, 4.5 + (k % 5) / 2, 5 + (k % 3) / 2, *_angles(k))


def structures(spark: SparkSession, sf: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Nested structures of 1 to 8 sites, one per order."""
    k = F.col("o_orderkey")
    fraction = lambda i, a, b, m: ((k * a + i * b) % m) / float(m) + (k % 3 - 1)
    site = lambda i: F.struct(
        i.alias("idx"),
        _symbol(k + i * 3).alias("element"),
        F.array(
            fraction(i, 7, 13, 97), fraction(i, 11, 29, 89), fraction(i, 5, 31, 101)
        ).alias("frac"),
    )
    # written out, as lambdas are not compiled; they are left for keys below zero
    n = (k % 8).cast("int")
    sites = F.when(n >= 0, F.slice(F.array(*[site(F.lit(i)) for i in range(8)]), 1, n + 1)).otherwise(
        F.transform(F.sequence(F.lit(0), n), site)
    )
    orders = by_key(table(spark, sf, "orders").select("o_orderkey", *columns), "o_orderkey")
    return _as_file(orders.select(k.alias("structure_id"), _cell(k).alias("cell"), sites.alias("sites"), *columns))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """One cell per order."""
    k = F.col("o_orderkey")
    orders = by_key(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return orders.select(k.alias("structure_id"), _cell(k).alias("cell"))


def site_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One site per line item. The index only has to be ordered, not dense."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("structure_id"),
        (F.col("l_linenumber") * 10**15 + p * 10**7 + s).alias("idx"),
        _symbol(p).alias("element"),
        ((p % 97) / 97.0).alias("x"),
        ((s % 89) / 89.0).alias("y"),
        (F.col("l_quantity") / 51.0).alias("z"),
    )


def _dos(k: Column) -> Column:
    """Three-point spectra of one or two spins; one in 13 is null."""
    up = F.array((k % 5) / 10.0, (k % 7) / 5.0, (k % 4) / 2.0)
    down = F.array((k % 3) / 10.0, (k % 2) / 5.0, (k % 6) / 2.0)
    dos = F.struct(
        F.when(k % 11 != 0, (k % 9) / 2.0 - 2.5).alias("efermi"),
        F.array(-1.0 - k % 3, F.lit(0.0), 1.0 + k % 2).alias("energies"),
        F.when(k % 2 == 0, F.create_map(F.lit("1"), up, F.lit("-1"), down))
        .otherwise(F.create_map(F.lit("1"), up))
        .alias("densities"),
    )
    return F.when(k % 13 != 0, dos)


def dos_docs(spark: SparkSession, sf: str) -> DataFrame:
    """structure_id, dos: one document per order."""
    k = F.col("o_orderkey")
    return _as_file(table(spark, sf, "orders").select(k.alias("structure_id"), _dos(k).alias("dos")))


def property_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed property documents with nested structure; one in 23 is null."""
    k = F.col("structure_id")
    nested = structures(spark, sf, ("o_totalprice",))
    have = k % 10 != 0
    doc = F.struct(
        F.when(k % 17 == 0, None)
        .when(k % 19 == 0, "")
        .otherwise(F.concat(F.lit("mp-"), k.cast("string")))
        .alias("material_id"),
        F.when(have, F.col("cell")).alias("cell"),
        F.when(have, F.col("sites")).alias("sites"),
        (k % 230 + 1).cast("int").alias("spacegroup_number"),
        F.when(k % 2 == 0, (k % 5) / 2.0).alias("band_gap_mp"),
        F.when(k % 3 != 0, (k % 4) / 4.0).alias("band_gap"),
        F.when(k % 2 == 1, -(k % 6) / 3.0).alias("formation_energy_per_atom_mp"),
        (F.col("o_totalprice") / -100000).alias("formation_energy_per_atom"),
        _dos(k).alias("dos_object_mp"),
        F.when(k % 7 != 0, (k % 300) / 2.0).alias("critical_temperature_tc"),
    )
    return _as_file(nested.select(
        F.concat(F.lit("comp"), k.cast("string")).alias("supercon_composition"),
        F.when(k % 23 != 0, doc).alias("doc"),
    ))


def structure_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Processed rows with JSON cells, broken in known ways by key."""
    k = F.col("structure_id")
    c = F.col("cell")
    six = F.array(*[c[n] for n in ("a", "b", "c", "alpha", "beta", "gamma")])
    zero = F.lit(0.0)
    cubic = F.array(
        F.array(c["a"], zero, zero), F.array(zero, c["b"], zero), F.array(zero, zero, c["c"])
    )
    as_sites = lambda symbol, xyz: F.transform(
        "sites",
        lambda s: F.struct(
            F.array(F.struct(symbol(s).alias("element"), F.lit(1.0).alias("occu"))).alias("species"),
            xyz(s).alias("xyz"),
        ),
    )
    element, frac = lambda s: s["element"], lambda s: s["frac"]
    cell_text = (
        F.when(k % 29 == 0, None)
        .when(k % 37 == 0, "[1, 2, 3")
        .when(k % 41 == 0, "[1, 2, 3, 90, 90]")
        .when(k % 43 == 0, '[1, 2, 3, 90, 90, "x"]')
        .when(k % 3 == 0, F.to_json(cubic))
        .otherwise(F.to_json(six))
    )
    sites_text = (
        F.when(k % 31 == 0, "")
        .when(k % 47 == 0, "[]")
        .when(k % 53 == 0, "{not json")
        .when(k % 59 == 0, F.to_json(as_sites(element, lambda s: F.slice(s["frac"], 1, 2))))
        .when(k % 61 == 0, F.to_json(as_sites(lambda s: F.lit(None).cast("string"), frac)))
        .when(k % 67 == 0, F.to_json(as_sites(lambda s: F.lit("Qq"), frac)))
        .otherwise(F.to_json(as_sites(element, frac)))
    )
    return _as_file(structures(spark, sf).select(
        k.alias("row_id"),
        F.concat(F.lit("id-"), k.cast("string")).alias("material_id"),
        cell_text.alias("oqmd_unit_cell_json"),
        sites_text.alias("oqmd_sites_json"),
        F.when(k % 71 != 0, F.when(k % 73 == 0, F.lit(float("nan"))).otherwise((k % 9) / 4.0)).alias(
            "oqmd_band_gap"
        ),
        F.when(k % 79 != 0, -(k % 13) / 2.0).alias("oqmd_delta_e"),
    ))


def manual_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Hand-entered text rows with blanks, N/A and bad numbers."""
    e = F.col("event_id")
    return _as_file(table(spark, sf, "events").select(
        F.when(e % 14 == 0, "  ").otherwise(F.concat(F.lit(" m-"), e.cast("string"), F.lit(" "))).alias("material_id"),
        F.when(e % 5 == 0, "N/A").when(e % 7 == 0, "bad").otherwise(F.col("value").cast("string")).alias("band_gap_mp"),
        F.when(e % 3 == 0, "True").when(e % 3 == 1, "N/A").otherwise("maybe").alias("is_metal"),
        (e % 4).cast("string").alias("num_elements"),
        F.when(e % 9 == 0, "").otherwise(F.col("value").cast("string")).alias("target_band_gap"),
        F.when(e % 16 == 0, "x1").otherwise("-1.25").alias("target_formation_energy"),
        F.when(e % 10 == 0, "N/A").when(e % 2 == 0, "True").otherwise("False").alias("target_is_metal"),
    ))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions: price against a multiple of quantity."""
    return table(spark, sf, "lineitem").select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("bigint")
        ).alias("material_id"),
        "l_orderkey",
        (F.col("l_extendedprice") / 1000).alias("y_true"),
        (F.col("l_quantity") * 1.5).alias("y_pred"),
    )


def class_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels: quality against not toxic."""
    return table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("label"), (1 - F.col("toxic")).alias("pred")
    )


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows for the models: parts with their sales figures."""
    p = F.col("p_partkey")
    sold = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.avg("l_quantity").alias("q"),
        F.avg("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"),
    )
    gap = F.when(p % 3 == 0, 0.0).otherwise(F.col("p_size") / 10.0)
    return (
        table(spark, sf, "part")
        .join(sold, "p_partkey", "left")
        .select(
            F.concat(F.lit("part-"), p.cast("string")).alias("material_id"),
            gap.alias("band_gap_mp"),
            (F.col("p_retailprice") / -1000).alias("formation_energy_per_atom_mp"),
            (p % 5 + 1).cast("int").alias("num_elements"),
            F.when(p % 11 != 0, F.col("q")).alias("density_pg"),
            F.when(p % 12 != 0, F.col("price") / 1000).alias("volume_pg"),
            (F.col("price") / (p % 5 + 1)).alias("volume_per_atom_pg"),
            (p % 230 + 1).cast("int").alias("spacegroup_number_pg"),
            (F.col("p_size") / 5.0).alias("lattice_a_pg"),
            (F.col("p_size") / 4.0 + 1).alias("lattice_b_pg"),
            (F.col("p_retailprice") / 500).alias("lattice_c_pg"),
            F.lit(90.0).alias("lattice_alpha_pg"),
            (90 + F.col("disc") * 100).alias("lattice_beta_pg"),
            F.lit(90.0).alias("lattice_gamma_pg"),
            (p % 8 + 1).cast("int").alias("num_sites_pg"),
            F.when(p % 14 != 0, F.col("p_brand")).alias("elements"),
            F.when(p % 15 != 0, F.lower("p_type")).alias("crystal_system_pg"),
            F.when(p % 21 != 0, gap).alias("target_band_gap"),
            (F.col("p_retailprice") / -1000).alias("target_formation_energy"),
            (gap == 0).alias("target_is_metal"),
            F.when((gap == 0) & (p % 6 != 0), F.col("p_size") / 25.0).alias("target_dos_at_fermi"),
        )
    )
