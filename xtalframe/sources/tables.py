"""Readers and writers. Readers take explicit schemas and never infer."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xtalframe.schemas import conform_schema

CORRUPT = "_corrupt_record"


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def tsv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names on the second line of a TSV file with one metadata line."""
    lines = spark.read.text(path).head(2)
    if len(lines) < 2:
        raise ValueError(f"{path} has no header line")
    return lines[1][0].split("\t")


def scan_tsv_preamble(
    spark: SparkSession, path: str, columns: list[str] | None = None
) -> DataFrame:
    """Tab-separated text whose first line is metadata and second line the
    header. All columns are strings, as many as ``columns`` names.

    The reader skips line one at the start of a file wherever the file is
    split; the header line is dropped by content.
    """
    names = columns or tsv_columns(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    is_header = F.lit(True)
    for n in names:
        is_header = is_header & F.col(f"`{n}`").eqNullSafe(F.lit(n))
    return rows.where(~is_header)


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType, corrupt: bool = False
) -> DataFrame:
    """CSV with a header line. An absent path gives no rows and a warning.

    A line that does not fit becomes nulls; with ``corrupt`` its text is kept
    in ``_corrupt_record``.
    """
    full = schema
    if corrupt:
        full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = (
        spark.read.schema(full)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("escape", '"')
    )
    try:
        return reader.csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"cannot read {path}: {str(error)[:200]}", UserWarning, stacklevel=2)
        return _empty(spark, full)


def scan_doc_map(
    spark: SparkSession,
    path: str,
    value: T.DataType,
    key: str = "supercon_composition",
    one_per_file: bool = True,
) -> DataFrame:
    """Keyed documents from JSON objects ``{key: document}``. Columns: the key,
    ``raw`` (text of the value, null for JSON null) and ``doc``.

    A JSON object cannot be split. With ``one_per_file`` each file is one
    object and one task, which is meant for converting existing small files;
    otherwise every line is an object. Use :func:`scan_docs` for new data.
    """
    objects = spark.read.text(path, wholetext=one_per_file)
    pairs = objects.select(
        F.explode(F.from_json("value", "map<string,string>")).alias(key, "raw")
    )
    return pairs.withColumn("doc", F.from_json("raw", value))


def scan_docs(
    spark: SparkSession, path: str, value: T.DataType, key: str = "supercon_composition"
) -> DataFrame:
    """Keyed documents from JSON lines, ``{"<key>": …, "doc": …}`` per line."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("doc", value)])
    return spark.read.schema(schema).json(path)


def sink_doc_map(docs: DataFrame, path: str) -> None:
    """Keyed documents as JSON lines, null documents included."""
    docs.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def sink_table(
    df: DataFrame, path: str, schema: T.StructType | None = None, fmt: str = "csv"
) -> None:
    """A table with a fixed column list, as CSV (header always) or parquet.

    CSV cannot nest, so arrays and structs become JSON text there.
    """
    table = df if schema is None else conform_schema(df, schema)
    if fmt == "csv":
        nested = (T.ArrayType, T.StructType, T.MapType)
        texts = {
            f.name: F.to_json(f.name) for f in table.schema.fields if isinstance(f.dataType, nested)
        }
        table = table.withColumns(texts) if texts else table
        table.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        table.write.mode("overwrite").format(fmt).save(path)
