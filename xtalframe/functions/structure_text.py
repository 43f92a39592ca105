"""Cells, sites and density-of-states documents as text.

Typed ``from_json`` nulls a whole array when one element has the wrong type
and keeps a JSON null as a null element; both mean "invalid" here, so every
check asks for the array and for each of its elements.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from xtalframe.functions.lattice import cell, lattice_params
from xtalframe.functions.once import let
from xtalframe.functions.text import to_number
from xtalframe.schemas import DOS, SITES

SITE_LIST = "array<struct<idx:int,element:string,frac:array<double>>>"


def _all_present(values: Column, n: int) -> Column:
    return F.coalesce(
        (F.size(values) == n) & F.forall(values, lambda v: v.isNotNull()), F.lit(False)
    )


def parse_cell(text: Column) -> Column:
    """JSON text to a cell: six parameters or a 3x3 matrix, anything else null."""
    from_six = lambda six: F.when(
        _all_present(six, 6), cell(*[F.try_element_at(six, F.lit(i)) for i in range(1, 7)])
    )
    from_rows = lambda rows: F.when(
        F.coalesce(
            (F.size(rows) == 3) & F.forall(rows, lambda r: _all_present(r, 3)), F.lit(False)
        ),
        lattice_params(rows),
    )
    # lists in a list are no six numbers; finding out by reading costs an exception
    lists = text.rlike(r"^\s*\[\s*\[")
    return F.coalesce(
        F.when(~lists, let(F.from_json(text, "array<double>"), from_six)),
        let(F.from_json(text, "array<array<double>>"), from_rows),
    )


def _first_element(site: Column) -> Column:
    return F.try_element_at(site["species"], F.lit(1))["element"]


def parse_sites(text: Column) -> Column:
    """JSON text to sites (index, first species' element, three fractions).

    Null when the text is no list of sites, the list is empty, or any site has
    no species, no element or no three numbers. Occupancy is not used.
    """
    return let(F.from_json(text, SITES), checked_sites)


def checked_sites(raw: Column) -> Column:
    """The same from JSON that is read already."""
    good = (F.size(raw) > 0) & F.forall(raw, _valid_site)
    return F.when(
        F.coalesce(good, F.lit(False)),
        F.transform(
            raw,
            lambda s, i: F.struct(
                i.alias("idx"), _first_element(s).alias("element"), s["xyz"].alias("frac")
            ),
        ),
    )


def _valid_site(site: Column) -> Column:
    return (
        site.isNotNull() & _first_element(site).isNotNull() & _all_present(site["xyz"], 3)
    )


def validate_structure(unit_cell: Column, sites: Column) -> Column:
    """Whether a typed record has a six-number cell and a non-empty list of
    sites, each with an element and three numbers. Never null."""
    good = (F.size(sites) > 0) & F.forall(sites, _valid_site)
    return _all_present(unit_cell, 6) & F.coalesce(good, F.lit(False))


def cell_to_text(unit_cell: Column) -> Column:
    """Typed cell numbers back to JSON text."""
    return F.to_json(unit_cell)


def sites_to_text(sites: Column) -> Column:
    """Typed sites back to JSON text."""
    return F.to_json(sites)


def parse_dos(text: Column) -> Column:
    """JSON text to ``struct<efermi, energies, densities>``; bad text is null."""
    return let(
        F.from_json(text, DOS),
        lambda dos: F.when(dos["energies"].isNotNull() | dos["efermi"].isNotNull(), dos),
    )


_OPERATIONS = "array<array<struct<x:double,y:double,z:double,shift:double>>>"
_UNCERTAINTY = r"\(\d+\)"
_TERM = r"([+-]?)(\d*\.?\d*)\*?"
_SHIFT = r"^([+-]?\d*\.?\d+)(?:/(\d+))?$"
_SAME_PLACE = 1e-4  # of a cell: images that close are one site
_SPACE_GROUP_TAGS = r"(?im)^\s*_(?:symmetry_space_group_name_H-M|space_group_name_H-M_alt)\s+(.+?)\s*$"
_SPACE_GROUP_NUMBER = r"(?im)^\s*_(?:symmetry_Int_Tables_number|space_group_IT_number)\s+(\d+)"


def _without_uncertainty(word: Column) -> Column:
    return F.when(word.contains("("), F.regexp_replace(word, _UNCERTAINTY, "")).otherwise(word)


def _numbers(words: list[Column]) -> Column:
    """Words as an array of numbers, each word worked out once."""
    return F.transform(F.transform(F.array(*words), _without_uncertainty), to_number)


def _cif_scalar(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, rf"(?im)^\s*{tag}\s+(\S+)", 1)


def _first_place(values: Column, found: Callable[[Column], Column]) -> Column:
    """Place, from 1, of the first value that ``found`` holds for; null if none.
    ``array_position`` leaves its loop by an exception, which costs far more than
    looking at the rest of a short list."""
    return F.array_min(F.transform(values, lambda v, i: F.when(found(v), i + 1)))


def _blocks(text: Column) -> Column:
    """The parts of a text between its ``loop_`` lines, without blank lines,
    comments and blanks around lines."""
    lines = F.filter(
        F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda t: F.trim(t)),
        lambda t: (t != "") & ~t.startswith("#"),
    )
    return F.split(F.array_join(lines, "\n"), r"(?m)^loop_\s*\n?")


def _loop(blocks: Column, prefix: str) -> Column:
    """``struct<tags, rows>`` of the loop whose tags start with ``prefix``: its
    lower-case tags and its data lines up to the next tag or data block."""
    tagged = lambda r: r.startswith("_") & r.rlike(rf"(?i)^{prefix}")

    def parts(lines: Column) -> Column:
        tags = F.filter(lines, tagged)
        body = F.slice(lines, F.size(tags) + 1, F.size(lines))
        stop = lambda rows: _first_place(rows, lambda r: r.startswith("_") | r.startswith("data_"))
        cut = lambda rows: let(
            stop(rows), lambda at: F.when(at > 0, F.slice(rows, 1, at - 1)).otherwise(rows)
        )
        return F.struct(
            F.transform(tags, lambda t: F.lower(t)).alias("tags"), let(body, cut).alias("rows")
        )

    block = F.try_element_at(F.filter(blocks, tagged), F.lit(1))
    return let(F.filter(F.split(block, "\n"), lambda r: r != ""), parts)


def _one_axis() -> Column:
    """Rows of operations that are one axis, as most are, read already."""
    row = lambda axis, sign: F.struct(*[F.lit(sign if a == axis else 0.0).alias(a) for a in "xyz"], F.lit(0.0).alias("shift"))
    return F.create_map(*[c for a in "xyz" for mark, sign in (("", 1.0), ("+", 1.0), ("-", -1.0)) for c in (F.lit(mark + a), row(a, sign))])


def symmetry_operation(text: Column) -> Column:
    """``x,-y,z+1/2`` as three rows ``struct<x, y, z, shift>`` that make a
    fraction from the old ones; null if a row can't be read."""

    def row(part: Column) -> Column:
        def factor(axis: str) -> Column:
            term = lambda k: F.regexp_extract(part, _TERM + axis, k)
            number = let(term(2), lambda n: F.when(n != "", n).try_cast("double"))
            sign = F.when(term(1) == "-", -1.0).otherwise(1.0)
            return F.when(part.contains(axis), sign * F.coalesce(number, F.lit(1.0))).otherwise(0.0)

        def shift(rest: Column) -> Column:
            number = F.regexp_extract(rest, _SHIFT, 1).try_cast("double")
            under = let(F.regexp_extract(rest, _SHIFT, 2), lambda n: F.coalesce(F.when(n != "", n).try_cast("double"), F.lit(1.0)))
            return F.when(rest == "", 0.0).when(rest.rlike(_SHIFT), F.try_divide(number, under))

        rest = F.regexp_replace(part, r"[+-]?\d*\.?\d*\*?[xyz]", "")
        read = lambda v: F.when((part != "") & v.isNotNull(), F.struct(*[factor(a).alias(a) for a in "xyz"], v.alias("shift")))
        return F.coalesce(F.try_element_at(_one_axis(), part), let(let(rest, shift), read))

    bare = F.lower(F.regexp_replace(F.regexp_replace(text, r"^\d+\s+", ""), r"['\"\s]", ""))
    rows = lambda parts: F.transform(parts, row)
    whole = lambda r: F.when((F.size(r) == 3) & F.forall(r, lambda x: x.isNotNull()), r)
    return let(let(F.split(bare, ","), rows), whole)


def _is_identity(operation: Column) -> Column:
    """True or false; false for null."""
    same = [operation[k][n] == (1.0 if n == axis else 0.0) for k, axis in enumerate("xyz") for n in ("x", "y", "z", "shift")]
    return F.coalesce(reduce(and_, same), F.lit(False))


def orbit(frac: Column, operations: Column) -> Column:
    """The distinct places of a site under all operations, in [0, 1), in order;
    places that coincide, also across a face of the cell, are one."""
    moved = lambda r: r["x"] * frac[0] + r["y"] * frac[1] + r["z"] * frac[2] + r["shift"]
    inside = lambda v: v - F.floor(v)
    places = F.transform(operations, lambda o: F.transform(F.transform(o, moved), inside))
    apart = lambda p, q, k: F.abs(p[k] - q[k] - F.rint(p[k] - q[k]))
    same = lambda p, q: F.greatest(*[apart(p, q, k) for k in range(3)]) < _SAME_PLACE
    none = F.array().cast("array<array<double>>")
    return F.aggregate(places, none, lambda kept, p: F.when(F.exists(kept, lambda q: same(p, q)), kept).otherwise(F.concat(kept, F.array(p))))


def cif_to_structure(text: Column) -> Column:
    """CIF text as ``struct<status, cell, sites, spacegroup_number>``.

    Listed symmetry operations are applied: each site becomes its orbit, in
    order of sites and operations. Where the identity is the only one, sites
    stay as they are written.

    ``status``: ``ok``, ``missing`` (no text), ``unsupported_symmetry`` (a space
    group other than P1 by name or number without its operations) or
    ``parse_error``. Bracketed uncertainties are dropped; the element of a site
    is its type symbol without charge, or else the letters of its label.
    """
    tags = ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")
    six = _numbers([_cif_scalar(text, f"_cell_{tag}") for tag in tags])
    words = ("type_symbol", "label", "fract_x", "fract_y", "fract_z")

    def site(row: Column, i: Column, at: Column) -> Column:
        word = lambda name: F.try_element_at(row, at[name])
        symbol = F.regexp_extract(F.coalesce(word("type_symbol"), word("label")), r"^([A-Z][a-z]?)", 1)
        return F.struct(
            i.alias("idx"),
            let(symbol, lambda e: F.when(e != "", e)).alias("element"),
            _numbers([word(f"fract_{axis}") for axis in "xyz"]).alias("frac"),
        )

    def sites(loop: Column) -> Column:
        at = F.struct(*[_first_place(loop["tags"], lambda t, w=w: t == f"_atom_site_{w}").alias(w) for w in words])
        rows = F.transform(loop["rows"], lambda r: F.split(r, r"\s+"))
        return let(at, lambda at: F.transform(rows, lambda r, i: site(r, i, at)))

    def loops(blocks: Column) -> Column:
        listed = _loop(blocks, "_(?:symmetry_equiv_pos|space_group_symop)")["rows"]
        operations = F.coalesce(F.transform(listed, symmetry_operation), F.array().cast(_OPERATIONS))
        return F.struct(operations.alias("operations"), let(_loop(blocks, "_atom_site_"), sites).alias("sites"))

    raw = F.struct(
        (text.isNull() | (F.trim(text) == "")).alias("missing"),
        F.regexp_replace(F.regexp_extract(text, _SPACE_GROUP_TAGS, 1), r"['\"\s]", "").alias("group"),
        let(F.regexp_extract(text, _SPACE_GROUP_NUMBER, 1), lambda n: F.when(n != "", n).cast("int")).alias("number"),
        let(six, lambda n: cell(*[n[k] for k in range(6)])).alias("cell"),
        let(_blocks(text), loops).alias("loops"),
    )

    def all_places(sites: Column, operations: Column) -> Column:
        each = F.flatten(F.transform(sites, lambda s: F.transform(orbit(s["frac"], operations), lambda p: F.struct(s["element"].alias("element"), p.alias("frac")))))
        return F.transform(each, lambda s, i: F.struct(i.alias("idx"), s["element"].alias("element"), s["frac"].alias("frac")))

    def result(r: Column, operations: Column, sites: Column, plain: Column) -> Column:
        named = ~r["group"].isin("", "P1") | (F.coalesce(r["number"], F.lit(1)) != 1)
        numbers_given = F.lit(True)
        for name in ("a", "b", "c", "alpha", "beta", "gamma"):
            numbers_given = numbers_given & r["cell"][name].isNotNull()
        good = (
            numbers_given
            & (F.size(sites) > 0)
            & F.forall(sites, lambda s: s["element"].isNotNull() & _all_present(s["frac"], 3))
            & F.forall(operations, lambda o: o.isNotNull())
        )
        status = (
            F.when(r["missing"], "missing")
            .when(named & plain, "unsupported_symmetry")
            .when(F.coalesce(good, F.lit(False)), "ok")
            .otherwise("parse_error")
        )
        return let(
            status,
            lambda st: F.struct(
                st.alias("status"),
                F.when(st == "ok", r["cell"]).alias("cell"),
                F.when((st == "ok") & plain, sites).when(st == "ok", all_places(sites, operations)).alias("sites"),
                r["number"].alias("spacegroup_number"),
            ),
        )

    def read(r: Column) -> Column:
        operations, sites = r["loops"]["operations"], r["loops"]["sites"]
        return let(F.forall(operations, _is_identity), lambda plain: result(r, operations, sites, plain))

    return let(raw, read)
