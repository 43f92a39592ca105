"""Chemical formula expressions.

All of them are built-in expressions over one string column: no join, no
Python, so they run inside the scan stage of whatever query uses them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from xtalframe.elements import SYMBOL_PATTERN, electronegativity_of, electronegativity_rank
from xtalframe.functions.once import let

# Bracketed remarks, then literal suffixes, in the order in which
# they are removed; placeholder symbols that stand for "some element".
BRACKETED = r"\(.*?\)"
SUFFIXES = ["-Y", "-delta", "-X", "x=", "-x", "+x", "-d", "+d"]
PLACEHOLDERS = ["X", "M", "RE", "Ln", "A", "B"]

_AMOUNT = r"(?:\d+\.?\d*|\.\d+)?"
_SYMBOL = r"[A-Z][a-z]?"
# "B" is an element, so only the others need a pattern of their own.
_STAND_INS = "|".join(p for p in PLACEHOLDERS if p != "B")

_FLAT = rf"^(?:(?:{SYMBOL_PATTERN}){_AMOUNT})+$"
_FLAT_WITH_STAND_INS = rf"^(?:(?:{SYMBOL_PATTERN}|{_STAND_INS}){_AMOUNT})+$"
_SHAPED = rf"^(?:(?:RE|{_SYMBOL}){_AMOUNT})+$"
_BRACKETED_FORMULA = rf"^(?:(?:{SYMBOL_PATTERN}){_AMOUNT}|\(|\){_AMOUNT})+$"

_EDGE_SPACE = r"^\s+|\s+$"


def clean_formula(text: Column) -> Column:
    """Drop bracketed remarks and doping suffixes, trim; empty becomes null."""
    cleaned = F.regexp_replace(text, BRACKETED, "")
    for suffix in SUFFIXES:
        cleaned = F.replace(cleaned, F.lit(suffix), F.lit(""))
    cleaned = F.regexp_replace(cleaned, _EDGE_SPACE, "")
    return F.nullif(cleaned, F.lit(""))


def _amount(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("double"), F.lit(1.0))


def _sum_per_symbol(parts: Column) -> Column:
    """Entries (symbol, amount) with one entry per symbol, sorted by symbol."""

    def total(ps: Column, s: Column) -> Column:
        same = F.filter(ps, lambda p: p["symbol"] == s)
        return F.aggregate(same, F.lit(0.0), lambda acc, p: acc + p["amount"])

    def per_symbol(ps: Column) -> Column:
        symbols = F.array_sort(F.array_distinct(F.transform(ps, lambda p: p["symbol"])))
        return F.transform(
            symbols, lambda s: F.struct(s.alias("symbol"), total(ps, s).alias("amount"))
        )

    return let(parts, per_symbol)


def _flat_parts(formula: Column) -> Column:
    symbols = F.regexp_extract_all(formula, F.lit(rf"({_SYMBOL}){_AMOUNT}"), F.lit(1))
    amounts = F.regexp_extract_all(formula, F.lit(rf"{_SYMBOL}({_AMOUNT})"), F.lit(1))
    return F.zip_with(
        symbols,
        amounts,
        lambda s, a: F.struct(s.alias("symbol"), _amount(a).alias("amount")),
    )


def _bracketed_parts(formula: Column) -> Column:
    """Parts of a formula with brackets nested to any depth.

    Read right to left, a closing bracket multiplies everything up to its
    opening bracket: one fold over the tokens with a stack of multipliers.
    The stack has one level more than there are open brackets; running out of
    levels means the brackets do not match, and the result is null.
    """
    token = rf"({_SYMBOL}|\(|\))"
    heads = F.regexp_extract_all(formula, F.lit(rf"{token}{_AMOUNT}"), F.lit(1))
    amounts = F.regexp_extract_all(formula, F.lit(rf"(?:{_SYMBOL}|\(|\))({_AMOUNT})"), F.lit(1))
    tokens = F.reverse(
        F.zip_with(
            heads, amounts, lambda h, a: F.struct(h.alias("head"), _amount(a).alias("amount"))
        )
    )
    start = F.struct(
        F.array(F.lit(1.0)).alias("levels"),
        F.array().cast("array<struct<symbol:string,amount:double>>").alias("parts"),
        F.lit(True).alias("balanced"),
    )

    def step(state: Column, tok: Column) -> Column:
        levels, parts, balanced = state["levels"], state["parts"], state["balanced"]
        top = F.coalesce(F.try_element_at(levels, F.lit(1)), F.lit(1.0))
        is_close, is_open = tok["head"] == ")", tok["head"] == "("
        part = F.struct(tok["head"].alias("symbol"), (tok["amount"] * top).alias("amount"))
        return F.struct(
            F.when(is_close, F.concat(F.array(top * tok["amount"]), levels))
            .when(is_open & (F.size(levels) > 1), F.slice(levels, 2, F.size(levels) - 1))
            .otherwise(levels)
            .alias("levels"),
            F.when(is_close | is_open, parts).otherwise(F.concat(parts, F.array(part))).alias("parts"),
            (balanced & ~(is_open & (F.size(levels) < 2))).alias("balanced"),
        )

    done = F.aggregate(tokens, start, step)
    return F.when(done["balanced"] & (F.size(done["levels"]) == 1), done["parts"])


def parse_formula(formula: Column) -> Column:
    """``array<struct<symbol, amount>>`` sorted by symbol, amounts summed.

    Null when the text is not a formula of known elements. Brackets may nest.
    """
    parts = F.when(formula.rlike(_FLAT), _flat_parts(formula)).when(
        formula.contains("(") & formula.rlike(_BRACKETED_FORMULA), _bracketed_parts(formula)
    )
    return _sum_per_symbol(parts)


def symbols_of(parts: Column) -> Column:
    """Sorted symbols of a parsed formula."""
    return F.transform(parts, lambda p: p["symbol"])


def chemical_system(formula: Column) -> Column:
    """Sorted element symbols joined by "-"; null for text that is no formula."""
    flat = F.array_sort(
        F.array_distinct(F.regexp_extract_all(formula, F.lit(f"({_SYMBOL})"), F.lit(1)))
    )
    bracketed = formula.contains("(") & _bracketed_parts(formula).isNotNull()
    return F.when(
        formula.rlike(_FLAT) | (formula.rlike(_BRACKETED_FORMULA) & bracketed),
        F.nullif(F.array_join(flat, "-"), F.lit("")),
    )


def formula_elements(text: Column) -> Column:
    """Sorted distinct element symbols of free-text composition.

    Placeholders are ignored; an unknown symbol makes the result null; text
    that does not have the shape of a formula falls back to whatever looks
    like a symbol.
    """
    symbols = lambda t: F.array_sort(
        F.array_distinct(F.regexp_extract_all(t, F.lit(f"({_SYMBOL})"), F.lit(1)))
    )
    stand_ins = F.array(*[F.lit(p) for p in PLACEHOLDERS if p not in ("B", "RE")])

    def found(cleaned: Column) -> Column:
        without_re = F.replace(cleaned, F.lit("RE"), F.lit(""))
        return (
            F.when(
                cleaned.rlike(_FLAT_WITH_STAND_INS), F.array_except(symbols(without_re), stand_ins)
            )
            .when(cleaned.rlike(_SHAPED), F.lit(None).cast("array<string>"))
            .otherwise(symbols(cleaned))
        )

    return let(let(clean_formula(text), found), lambda s: F.when(F.size(s) > 0, s))


def elements_text(symbols: Column) -> Column:
    """Sorted symbols joined by a comma."""
    return F.array_join(F.array_sort(symbols), ",")


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a fold; the smaller number bounds the steps needed
    (at most 1.45 per bit, and two to settle)."""
    steps = F.floor(F.log2(F.greatest(F.least(a, b), F.lit(1).cast("bigint")) + 1) * 1.45) + 2
    done = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), steps),
        F.struct(a.alias("a"), b.alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(
            F.struct(
                s["b"].alias("a"),
                F.coalesce(F.try_mod(s["a"], s["b"]), F.lit(0).cast("bigint")).alias("b"),
            )
        ),
    )
    return done["a"]


def _common_factor(parts: Column) -> Column:
    """Greatest common divisor of the amounts; 1 unless all are whole numbers."""
    whole = F.forall(parts, lambda p: p["amount"] == F.floor(p["amount"]))
    divisor = F.aggregate(
        parts,
        F.lit(0).cast("bigint"),
        lambda g, p: _gcd(p["amount"].cast("bigint"), g),
    )
    return F.when(whole, F.greatest(divisor, F.lit(1).cast("bigint")).cast("double")).otherwise(
        F.lit(1.0)
    )


def _number_text(number: Column) -> Column:
    """"" for 1, digits for whole numbers, at most eight decimals otherwise."""
    return let(
        number,
        lambda v: F.when(v == 1, F.lit(""))
        .when(v == F.floor(v), F.floor(v).cast("string"))
        .otherwise(F.round(v, 8).cast("string")),
    )


def _scaled(parts: Column, factor: Column, separator: str) -> Column:
    return F.transform(
        parts,
        lambda p: F.concat(p["symbol"], F.lit(separator), _number_text(p["amount"] / factor)),
    )


def match_key(parts: Column) -> Column:
    """Text equal for two formulas exactly when they reduce to the same formula."""
    return let(
        parts,
        lambda ps: let(_common_factor(ps), lambda f: F.array_join(_scaled(ps, f, ":"), "|")),
    )


def formula_match(left: Column, right: Column) -> Column:
    """Whether two formula texts reduce to the same formula; null if either is none."""
    return match_key(parse_formula(left)) == match_key(parse_formula(right))


# Formulas that are always written as the molecule.
_MOLECULES = {
    "LiO": "Li2O2",
    "NaO": "Na2O2",
    "KO": "K2O2",
    "HO": "H2O2",
    "CsO": "Cs2O2",
    "RbO": "Rb2O2",
    "O": "O2",
    "N": "N2",
    "F": "F2",
    "Cl": "Cl2",
    "H": "H2",
}


def reduced_formula(parts: Column) -> Column:
    """Display formula: whole amounts divided by their common factor, symbols in
    order of electronegativity, and the last two symbols bracketed when they
    form a group with a common factor of their own, as in Ca3(PO4)2.
    """

    def rank(ps: Column) -> Column:
        return F.array_sort(
            F.transform(
                F.filter(ps, lambda p: F.abs(p["amount"]) > 1e-8),
                lambda p: F.struct(
                    electronegativity_rank(p["symbol"]).alias("rank"),
                    p["symbol"].alias("symbol"),
                    p["amount"].alias("amount"),
                ),
            )
        )

    def display(ordered: Column, factor: Column, group: Column) -> Column:
        n, tail = F.size(ordered), F.slice(ordered, -2, 2)
        gap = electronegativity_of(tail[1]["symbol"]) - electronegativity_of(tail[0]["symbol"])
        bracketed = F.concat(
            F.array_join(_scaled(F.slice(ordered, 1, n - 2), factor, ""), ""),
            F.lit("("),
            F.array_join(_scaled(tail, factor * group, ""), ""),
            F.lit(")"),
            _number_text(group),
        )
        plain = F.array_join(_scaled(ordered, factor, ""), "")
        return F.when((n >= 3) & (group != 1), F.when(gap < 1.65, bracketed)).otherwise(plain)

    def with_factor(ordered: Column, factor: Column) -> Column:
        tail = F.transform(
            F.slice(ordered, -2, 2),
            lambda p: F.struct((p["amount"] / factor).alias("amount")),
        )
        group = F.when(F.size(ordered) >= 3, _common_factor(tail)).otherwise(F.lit(1.0))
        return let(
            group,
            lambda g: F.coalesce(
                display(ordered, factor, g), F.array_join(_scaled(ordered, factor, ""), "")
            ),
        )

    molecules = F.create_map(*[F.lit(v) for kv in _MOLECULES.items() for v in kv])
    text = let(
        rank(parts),
        lambda ordered: let(_common_factor(ordered), lambda f: with_factor(ordered, f)),
    )
    return let(text, lambda t: F.coalesce(F.try_element_at(molecules, t), t))
