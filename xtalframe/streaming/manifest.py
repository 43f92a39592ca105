"""Which files' rows are stored: one small row a file, looked up by name."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xtalframe.schemas import fields

#: Runs of one level that are merged into one run of the next.
FAN = 64
ROWS_A_FILE = 1_000_000
SCHEMA = fields("source_file string, query_id string, batch_id bigint")


class Manifest:
    """Rows (source_file, query_id, batch_id) beside a dataset, in runs sorted by
    file name. A batch adds a run; ``FAN`` runs of a level are merged into one of
    the next, so there are few runs whatever the number of files, each row is
    rewritten a few times only, and a lookup by names reads the row groups
    whose range of names they fall into. A run is removed after the one that
    replaces it is complete: a crash between leaves rows twice, which changes
    nothing.
    """

    def __init__(self, spark: SparkSession, dataset: str):
        self.spark = spark
        self.path = f"{dataset.rstrip('/')}_manifest"

    def _folder(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        folder, system = self._folder(path)
        if not system.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in system.listStatus(folder) if s.isDirectory())

    def _remove(self, path: str) -> None:
        folder, system = self._folder(path)
        system.delete(folder, True)

    def _read(self, *paths: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(*paths)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def rows(self) -> DataFrame | None:
        """All rows; a file may be there more than once."""
        return self._read(self.path)

    def stored_by_others(self, files: list[str], query_id: str) -> set[str]:
        """Those of ``files``, at most a batch, that another query has committed."""
        rows = self.rows()
        if rows is None or not files:
            return set()
        found = rows.where(F.col("source_file").isin(files) & (F.col("query_id") != query_id))
        return {r[0] for r in found.select("source_file").distinct().collect()}

    def commit(self, files: list[str], query_id: str, batch_id: int) -> None:
        """Make the batch count, then merge runs where a level is full."""
        rows = [(f, query_id, batch_id) for f in sorted(files)]
        run = self.spark.createDataFrame(rows, SCHEMA).coalesce(1)
        run.write.mode("overwrite").parquet(f"{self.path}/0/{query_id}-{batch_id}")
        for level in range(len(self._children(self.path))):
            runs = [f"{self.path}/{level}/{r}" for r in self._children(f"{self.path}/{level}")]
            if len(runs) >= FAN:
                self._merge(runs, level + 1)

    def _merge(self, runs: list[str], level: int) -> None:
        rows = self._read(*runs).distinct()
        files = max(1, rows.count() // ROWS_A_FILE)
        sorted_rows = rows.repartitionByRange(files, "source_file").sortWithinPartitions("source_file")
        sorted_rows.write.parquet(f"{self.path}/{level}/{uuid.uuid4().hex}")
        for r in runs:
            self._remove(r)

    def undo_unfinished(self, tables: tuple[str, ...], files: set[str], query_id: str) -> None:
        """Remove what other queries stored of these files without committing it.

        Only the last batch of a query can be without a commit, so one folder of
        each other query is looked at, and its rows only if it has none.
        """
        for table in tables:
            for query in self._children(table):
                name, _, other = query.partition("=")
                if name != "query_id" or other == query_id:
                    continue
                last = max((int(b.partition("=")[2]) for b in self._children(f"{table}/{query}")), default=None)
                if last is None or self._committed(other, last):
                    continue
                folder = f"{table}/{query}/batch_id={last}"
                held = self.spark.read.schema("source_file string").parquet(folder)
                if held.where(F.col("source_file").isin(sorted(files))).limit(1).count():
                    self._remove(folder)

    def _committed(self, query_id: str, batch_id: int) -> bool:
        folder, system = self._folder(f"{self.path}/0/{query_id}-{batch_id}/_SUCCESS")
        if system.exists(folder):
            return True
        rows = self.rows()
        return rows is not None and rows.where((F.col("query_id") == query_id) & (F.col("batch_id") == batch_id)).limit(1).count() > 0
