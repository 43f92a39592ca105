"""Rules for hand-entered rows, as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xtalframe.functions.text import missing_if_na, to_flag, to_number
from xtalframe.schemas import MANUAL_ENTRY, MANUAL_ENTRY_TEXT, conform_schema

REQUIRED = ["material_id", "target_band_gap", "target_formation_energy", "target_is_metal"]
_FLAGS = ["is_metal", "target_is_metal"]


def validate_manual_row(rows: DataFrame) -> DataFrame:
    """Typed rows with ``reasons``: why a row is rejected, empty when it is not.

    The id and three targets are required; numeric fields must parse or be
    blank; "N/A" counts as blank; flags must be True or False. Columns that
    are not supplied are null. All reasons of a row are reported.
    """
    extra = [c for c in rows.columns if c not in MANUAL_ENTRY_TEXT.names]
    fields = conform_schema(rows, MANUAL_ENTRY_TEXT).columns
    text = rows.select(
        *extra,
        *[
            (F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c)
            for c in fields
        ],
    )
    clean = {c: missing_if_na(F.col(c)) for c in fields}
    numeric = [
        f.name
        for f in MANUAL_ENTRY.fields
        if isinstance(f.dataType, (T.DoubleType, T.IntegerType, T.LongType))
    ]
    reasons = [
        F.when(clean[c].isNull(), F.lit(f"{c} is required")) for c in REQUIRED
    ]
    reasons += [
        F.when(clean[c].isNotNull() & to_number(clean[c]).isNull(), F.lit(f"{c} is not a number"))
        for c in numeric
    ]
    reasons += [
        F.when(clean[c].isNotNull() & to_flag(clean[c]).isNull(), F.lit(f"{c} is not True or False"))
        for c in _FLAGS
    ]
    typed = {}
    for f in MANUAL_ENTRY.fields:
        if f.name in numeric:
            typed[f.name] = to_number(clean[f.name]).try_cast(f.dataType)
        elif f.name in _FLAGS:
            typed[f.name] = to_flag(clean[f.name])
        else:
            typed[f.name] = clean[f.name]
    return text.select(
        *extra,
        F.array_compact(F.array(*reasons)).alias("reasons"),
        *[v.alias(n) for n, v in typed.items()],
    )


def accepted(validated: DataFrame, *more: str) -> DataFrame:
    """Valid rows in the column order of the manual-entry table, then the named
    further columns."""
    valid = validated.where(F.size("reasons") == 0)
    schema = T.StructType([*MANUAL_ENTRY.fields, *(valid.schema[c] for c in more)])
    return conform_schema(valid, schema)


def rejected(validated: DataFrame) -> DataFrame:
    """Rejected rows with their reasons."""
    return validated.where(F.size("reasons") > 0)


def rejection_counts(validated: DataFrame) -> DataFrame:
    """Rows per reason; a row with several reasons counts under each."""
    return (
        validated.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
