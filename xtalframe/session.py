"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    Clusters bring their own session; nothing in the library calls this.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("xtalframe")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@lru_cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="xtalframe-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the folder all executors can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Where the
    setting is absent a temporary folder is used, but only on a local master:
    on a cluster a machine-local folder would lose data with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{_application(spark)}/{purpose}-{uuid.uuid4().hex}"


def _application(spark: SparkSession) -> str:
    return f"xtalframe-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back, so that what several jobs need
    is computed once and survives the executors that computed it."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_by(df: DataFrame, purpose: str, *keys: str, buckets: int = 0, placed: bool = False) -> DataFrame:
    """Like ``stored``, in ``buckets`` by ``keys`` (none given: as many as there
    are shuffle partitions), one file each: joins and aggregates on these keys
    read it as it lies, without a shuffle. ``placed``: the rows come out of such
    buckets, as many, and are written where they are. It has a name in the
    catalog only while it is written."""
    spark = df.sparkSession
    buckets, name = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), f"{purpose}_{uuid.uuid4().hex}"
    writer = (df if placed else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", shared_folder(spark, purpose)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return out


@contextmanager
def joined_in_buckets(spark: SparkSession) -> Iterator[None]:
    """For jobs that run within: a join takes sides that lie in equal buckets as
    they are where the buckets go by some of its keys only. Elsewhere Spark
    shuffles such sides anew by all keys, as large groups may need."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove_shared(spark: SparkSession) -> None:
    """Remove all that this application put into the shared folder. For the
    owner of the application, when its results are stored elsewhere: tables
    that were read from there can't be read any more."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark.sparkContext.applicationId)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{_application(spark)}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
