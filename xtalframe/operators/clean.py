"""Cleaning, counting and ranking the critical-temperature table, and the
row-level filters shared by the other pipelines.

Everything here is a projection, a filter or one aggregate: no join, at most
one shuffle of pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xtalframe.functions.text import missing_if_na, to_number
from xtalframe.schemas import require_columns

__all__ = [
    "alias_fields",
    "clean_tc",
    "clean_tc_report",
    "coercion_counts",
    "distinct_compositions",
    "doc_profile",
    "drop_missing",
    "filter_deprecated",
    "filter_positive",
    "filter_valid_docs",
    "id_fallback",
    "limit_keys",
    "match_counts",
    "normalise_na",
    "require_columns",
    "sample_preview",
    "select_rename",
    "to_numeric_coerce",
    "top_n_by_value",
]


def select_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep the columns named by the keys, under the names given as values."""
    require_columns(df, *names)
    return df.select([F.col(f"`{old}`").alias(new) for old, new in names.items()])


def to_numeric_coerce(df: DataFrame, column: str) -> DataFrame:
    """Replace a text column by its number; text that is no number is null."""
    return df.withColumn(column, to_number(F.col(column)))


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows in which any of the columns is null or NaN."""
    return df.dropna(subset=list(columns))


def filter_positive(df: DataFrame, column: str) -> DataFrame:
    """Keep rows with a number above zero; NaN (greater than all numbers in
    Spark) and null are dropped."""
    return df.where((F.col(column) > 0) & ~F.isnan(column))


def clean_tc(
    df: DataFrame,
    composition: str = "chemical formula",
    tc: str = "Tc (of this sample) recommended",
    keep: list[str] | None = None,
) -> DataFrame:
    """Text table to ``composition, critical_temperature_tc`` with valid rows only.

    ``keep`` names further columns to carry along, such as a row id.
    """
    names = {composition: "composition", tc: "critical_temperature_tc"}
    names.update({c: c for c in keep or []})
    selected = select_rename(df, names)
    number = to_numeric_coerce(selected, "critical_temperature_tc")
    present = drop_missing(number, "critical_temperature_tc", "composition")
    return filter_positive(present, "critical_temperature_tc")


def clean_tc_report(
    df: DataFrame,
    composition: str = "chemical formula",
    tc: str = "Tc (of this sample) recommended",
) -> DataFrame:
    """One row: rows read, dropped as missing, dropped as not positive, kept,
    and distinct compositions kept. A single scan."""
    require_columns(df, composition, tc)
    value = to_number(F.col(f"`{tc}`"))
    name = F.col(f"`{composition}`")
    present = value.isNotNull() & name.isNotNull()
    kept = present & (value > 0)
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(~present).alias("dropped_missing"),
        F.count_if(present & ~kept).alias("dropped_not_positive"),
        F.count_if(kept).alias("rows_kept"),
        F.count_distinct(F.when(kept, name)).alias("distinct_compositions"),
    )


def coercion_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: rows read, present texts that were no number, rows dropped, kept."""
    text = F.col(column)
    value = to_number(text)
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(value.isNull()).alias("became_missing"),
        F.count_if(value.isNull() & (F.trim(text) != "")).alias("not_numeric"),
        F.count_if(value.isNotNull()).alias("rows_kept"),
    )


def top_n_by_value(
    df: DataFrame, value: str, n: int = 20, ties: list[str] | None = None
) -> DataFrame:
    """The ``n`` rows with the largest value, duplicates kept.

    Text values are coerced, missing ones dropped. ``ties`` makes the order
    total. Plans as a top-k per task followed by a merge of k rows each.
    """
    require_columns(df, value)
    if dict(df.dtypes)[value] == "string":
        df = to_numeric_coerce(df, value)
    order = [F.col(value).desc()] + [F.col(c).asc() for c in ties or []]
    return drop_missing(df, value).orderBy(*order).limit(n)


def distinct_compositions(df: DataFrame, composition: str = "composition") -> DataFrame:
    """Distinct compositions; null is not a composition."""
    return df.select(composition).where(F.col(composition).isNotNull()).distinct()


def limit_keys(
    df: DataFrame, key: str, row_id: str, k: int | None = None
) -> DataFrame:
    """The first ``k`` distinct keys by first appearance; all keys without ``k``."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row_id).alias(row_id))
    return first if k is None else first.orderBy(row_id, key).limit(k)


def filter_deprecated(df: DataFrame, flag: str = "deprecated") -> DataFrame:
    """Drop entries flagged deprecated; a missing flag means not deprecated."""
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def doc_kind(raw: Column) -> Column:
    """What the JSON text of a document is: ``null``, ``object`` or ``other``."""
    text = F.trim(raw)
    return (
        F.when(raw.isNull() | (text == "null"), "null")
        .when(F.json_object_keys(text).isNotNull(), "object")
        .otherwise("other")
    )


def filter_valid_docs(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """Split on the raw JSON text: (objects, per-kind counts of the rest)."""
    kind = doc_kind(F.col(raw))
    objects = df.where(kind == "object")
    rest = df.select(kind.alias("kind")).where(F.col("kind") != "object")
    return objects, rest.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def id_fallback(df: DataFrame, material_id: str, composition: str) -> DataFrame:
    """Missing or empty ids become ``no_mpid_<composition>``."""
    own = F.nullif(F.col(material_id), F.lit(""))
    return df.withColumn(
        material_id, F.coalesce(own, F.concat(F.lit("no_mpid_"), F.col(composition)))
    )


def alias_fields(df: DataFrame, target: str, *sources: str) -> DataFrame:
    """``target`` is the first present of several columns; absent ones are skipped."""
    present = [F.col(s) for s in sources if s in df.columns]
    if not present:
        raise ValueError(f"none of {sources} is a column")
    return df.withColumn(target, F.coalesce(*present))


def normalise_na(df: DataFrame, *columns: str) -> DataFrame:
    """Trim text columns; blank and "N/A" become null."""
    return df.withColumns({c: missing_if_na(F.col(c)) for c in columns})


def match_counts(df: DataFrame, *columns: str) -> DataFrame:
    """One row: number of rows, and of non-null values per column."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_total"),
        *[F.count(F.col(c)).alias(f"{c}_present") for c in columns],
    )


def doc_profile(df: DataFrame, key: str, entries: str) -> DataFrame:
    """One row: keys; keys with null, empty and non-empty lists; entries in all."""
    size = F.size(entries)
    none = F.col(entries).isNull()
    return df.agg(
        F.count(F.col(key)).alias("keys_total"),
        F.count_if(none).alias("keys_null"),
        F.count_if(~none & (size == 0)).alias("keys_empty"),
        F.count_if(~none & (size > 0)).alias("keys_with_data"),
        F.coalesce(F.sum(F.when(~none, size.cast("bigint"))), F.lit(0)).alias("entries_total"),
    )


def sample_preview(
    df: DataFrame, key: str, entries: str, row_id: str, n: int = 2
) -> DataFrame:
    """Entry count and first entry of the first ``n`` keys that have entries."""
    return (
        df.where(F.size(entries) > 0)
        .orderBy(row_id)
        .limit(n)
        .select(key, F.size(entries).alias("n_entries"), F.col(entries)[0].alias("first_entry"))
    )
