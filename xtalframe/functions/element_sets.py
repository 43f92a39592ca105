"""Sets of element symbols as bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from xtalframe.elements import ELEMENTS, symbol_array

#: Bits of the first word; the other elements are in the second.
_FIRST = 60
OTHER = "?"


def _bits(symbols: list[str], elements: Column) -> Column:
    table = F.expr("map(" + ", ".join(f"'{s}', {1 << k}L" for k, s in enumerate(symbols)) + ")")
    bit = lambda s: F.coalesce(F.try_element_at(table, s), F.lit(0).cast("bigint"))
    return F.aggregate(elements, F.lit(0).cast("bigint"), lambda a, s: a.bitwiseOR(bit(s)))


def _known() -> list[str]:
    return [e[0] for e in ELEMENTS]


def element_set(elements: Column) -> Column:
    """``low``, ``high``: one bit for each known element; ``other``: the distinct
    symbols that name none, in order (hardly ever any). Null gives null; order
    and repeats don't matter."""
    known = _known()
    here = F.filter(elements, lambda s: s.isNotNull())
    names = symbol_array()
    other = F.array_sort(F.array_distinct(F.filter(here, lambda s: ~F.array_contains(names, s))))
    bits = F.struct(_bits(known[:_FIRST], here).alias("low"), _bits(known[_FIRST:], here).alias("high"), other.alias("other"))
    return F.when(elements.isNotNull(), bits)


def tidy(elements: Column) -> Column:
    """Sorted distinct symbols; null stays null."""
    return F.array_sort(F.array_distinct(F.filter(elements, lambda s: s.isNotNull())))


def set_key(elements: Column) -> Column:
    """One text for each set, whatever the order and repeats of its symbols."""
    return F.array_join(tidy(elements), " ")


def contains(large: Column, small: Column) -> Column:
    """Whether one set has all elements of another: two bit tests, and names
    only where a symbol is unknown."""
    word = lambda n: large[n].bitwiseAND(small[n]) == small[n]
    return word("low") & word("high") & F.forall(small["other"], lambda s: F.array_contains(large["other"], s))


def index_symbols(elements: Column) -> Column:
    """Distinct symbols, all unknown ones as ``OTHER``: at most 119 names."""
    names = symbol_array()
    return F.array_distinct(F.transform(elements, lambda s: F.when(F.array_contains(names, s), s).otherwise(F.lit(OTHER))))
