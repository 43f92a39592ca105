"""What the corpus operators share: inputs, keys and written intermediate tables."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import xtalframe
from xtalframe.session import shared_folder


@lru_cache
def _archive(application_id: str) -> str:
    root = Path(next(iter(xtalframe.__path__)))
    path = Path(tempfile.mkdtemp(prefix="xtalframe-code-")) / "xtalframe.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    return str(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    path = _archive(context.applicationId)
    if not any(f.endswith("/xtalframe.zip") for f in context.listFiles):
        context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text as an operator reads them: null text is empty. Columns
    are taken by exact name and place, so that other columns, whatever their
    names, stay outside."""
    return _shadow(docs).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _shadow(docs: DataFrame) -> DataFrame:
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    pick = lambda name: F.col(f"c{names.index(name)}").alias(name)
    return plain.select(pick("doc_id"), pick("text"), *plain.columns)


class Aside:
    """Rows with their columns set aside under names nothing can clash with,
    beside doc_id, text and text_key; ``restore`` puts them back."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.columns = [f"c{k}" for k in range(len(self.names))]
        shadow = _shadow(docs)
        self.rows = shadow.withColumn("text_key", text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))))

    def column(self, name: str) -> str:
        return self.columns[self.names.index(name)]

    def restore(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns).toDF(*self.names)

    def without(self, keys: DataFrame) -> DataFrame:
        """Rows whose doc_id and text_key aren't among ``keys``, restored."""
        other = keys.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
        same = self.rows["doc_id"].eqNullSafe(other["_id"]) & (self.rows["text_key"] == other["_key"])
        return self.restore(self.rows.join(other, same, "left_anti"))


def text_key(text: str | Column = "text") -> Column:
    """Tells apart rows that repeat a doc_id with another text."""
    return F.xxhash64(text)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: later steps do not recompute
    ``df``, also after executors are lost."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
