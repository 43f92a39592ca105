"""Hand-entered rows arriving as files, validated and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from xtalframe.operators.manual import accepted, rejected, validate_manual_row
from xtalframe.schemas import MANUAL_ENTRY_TEXT
from xtalframe.streaming.manifest import Manifest


def read_manual_rows(
    spark: SparkSession,
    folder: str,
    schema: T.StructType = MANUAL_ENTRY_TEXT,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Stream of text rows from JSON-lines files dropped into ``folder``."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def store_batch(batch: DataFrame, dataset: str, quarantine: str, query_id: str, batch_id: int) -> None:
    """Judge one batch once, rewrite its folder in either table, then commit its
    files to the manifest. ``source_file`` names a row's file; a batch has as
    many as the stream takes at a time, and their names come to the driver."""
    spark = batch.sparkSession
    files = [r[0] for r in batch.select("source_file").distinct().collect()]
    manifest = Manifest(spark, dataset)
    taken = manifest.stored_by_others(files, query_id)
    own = [f for f in files if f not in taken]
    manifest.undo_unfinished((dataset, quarantine), set(own), query_id)
    if taken:
        batch = batch.where(~F.col("source_file").isin(sorted(taken)))
    validated = validate_manual_row(batch).persist()
    own_folder = f"query_id={query_id}/batch_id={batch_id}"
    try:
        accepted(validated, "source_file").write.mode("overwrite").parquet(f"{dataset}/{own_folder}")
        rejected(validated).write.mode("overwrite").parquet(f"{quarantine}/{own_folder}")
    finally:
        validated.unpersist()
    manifest.commit(own, query_id, batch_id)


def append_validated(
    stream: DataFrame, dataset: str, quarantine: str, checkpoint: str
) -> StreamingQuery:
    """Append valid rows to ``dataset`` and the rest, with reasons, to ``quarantine``.

    Rows are judged one by one, so the query keeps no state. Each micro-batch
    owns one folder in either table, named by the id that its checkpoint gives
    the query and by the batch, and rewrites it as a whole: a batch repeated
    after a failure replaces its rows, also where none are left. A manifest has
    one row for each stored file, committed after both folders: a query that
    starts anew, because its checkpoint was lost, leaves out files that another
    one has committed, and takes back what another one had begun to store of
    its files. What a batch costs does not grow with what is stored. Two
    queries must not read the same files at the same time. Stops when all files
    present at the start have been read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store_batch(batch, dataset, quarantine, query_id, batch_id)

    return (
        stream.withColumn("source_file", F.input_file_name())
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
