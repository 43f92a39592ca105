"""Text to number and text to missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number: decimal or scientific notation, or an infinity.
# Narrower than Spark's cast, which would also accept "1.0d" and "1f".
NUMBER_PATTERN = (
    r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)\s*$"
)


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a number, "NaN" included, is null."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def missing_if_na(text: Column) -> Column:
    """Trimmed text; blank and "N/A" become null."""
    trimmed = F.trim(text)
    return F.when((trimmed != "") & (trimmed != "N/A"), trimmed)


def to_flag(text: Column) -> Column:
    """"True"/"False" to boolean, anything else to null."""
    value = F.lower(F.trim(text))
    return F.when(value == "true", F.lit(True)).when(value == "false", F.lit(False))


def no_nan(value: Column) -> Column:
    """A double with NaN read as missing."""
    return F.when(~F.isnan(value), value)


def null_to_inf(value: Column) -> Column:
    """Sort key that puts missing values after every finite one."""
    return F.coalesce(value, F.lit(float("inf")))
