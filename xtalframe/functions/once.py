"""Naming an intermediate value so that it is computed once.

Columns are trees: a value used in five places is written, optimised and
evaluated five times, and a filter on a derived column is pushed below it with
the whole tree copied into it. For values that are expensive or used often,
these two helpers keep one copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, with ``value`` bound as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df.withColumns``, with the new columns produced by a one-row generator.

    Later selects and filters see plain attributes, as if they had been read
    from a file; nothing is shuffled or materialised.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[v.alias(n) for n, v in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
