"""Graph datasets as three tables: graphs, nodes and edges.

``graphs`` is the index, one small row a graph: its split, the part its rows
lie in, its counts and targets. Nodes and edges are rows, stored by split and
part and in order of graph and node, so that a split, or one graph, is read from
its own folders, and a graph of any size is many rows in many files, never one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xtalframe.operators.skew import SHARE, left_join
from xtalframe.schemas import fields, require_columns

PARTS = 16
#: Nodes of one graph whose rows, and whose edges, go to one file.
CHUNK = 100_000

_PLACE = [T.StructField("split", T.StringType()), T.StructField("part", T.IntegerType())]
NODES = fields("material_id string, node bigint, atomic_number int, electronegativity double")
EDGES = fields("material_id string, source_node_index bigint, target_node_index bigint, distance double")
INDEX = T.StructType(
    [*fields("material_id string, num_nodes bigint, num_edges bigint").fields, T.StructField("y", T.ArrayType(T.FloatType()))]
)


class GraphTables(NamedTuple):
    """graphs: material_id, y (num_nodes, num_edges, split where stored); nodes:
    material_id, node, atomic_number, electronegativity; edges: material_id,
    source_node_index, target_node_index, distance."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame


def _part(material_id: Column) -> Column:
    return F.pmod(F.xxhash64(material_id), F.lit(PARTS)).cast("int")


def sink_graph_dataset(tables: GraphTables, splits: DataFrame, path: str, share: int = SHARE) -> None:
    """Store graphs with the split that ``splits`` (material_id, split) gives
    them; graphs without one are left out. Replaces what lies at ``path``.

    Rows meet their split by joins that spread a graph of very many rows, and
    are counted with partial sums.
    """
    require_columns(splits, "material_id", "split")
    require_columns(tables.graphs, "material_id", "y")
    count = lambda df, name: df.groupBy("material_id").agg(F.count(F.lit(1)).alias(name))
    none = F.lit(0).cast("bigint")
    index = (
        tables.graphs.select("material_id", "y")
        .join(splits.select("material_id", "split"), "material_id")
        .join(count(tables.nodes, "num_nodes"), "material_id", "left")
        .join(count(tables.edges, "num_edges"), "material_id", "left")
        .withColumns({"num_nodes": F.coalesce("num_nodes", none), "num_edges": F.coalesce("num_edges", none), "part": _part(F.col("material_id"))})
    )
    _write(index.select(*INDEX.names, "split", "part"), F.lit(0), ["material_id"], f"{path}/graphs")
    for df, schema, name, at in ((tables.nodes, NODES, "nodes", "node"), (tables.edges, EDGES, "edges", "source_node_index")):
        typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        placed = left_join(typed, splits.select("material_id", "split"), ["material_id"], "inner", share)
        order = ["material_id", *schema.names[1:3]]
        _write(placed.withColumn("part", _part(F.col("material_id"))), F.floor(F.col(at) / CHUNK), order, f"{path}/{name}")


def _write(rows: DataFrame, chunk: Column, order: list[str], path: str) -> None:
    """By split and part; the nodes of a chunk stay together, chunks spread."""
    dealt = rows.withColumn("_chunk", chunk).repartition("split", "part", "_chunk").sortWithinPartitions("split", "part", *order)
    dealt.drop("_chunk").write.mode("overwrite").partitionBy("split", "part").parquet(path)


def scan_graph_dataset(spark: SparkSession, path: str, split: str | None = None) -> GraphTables:
    """The tables of one split (only its folders are read), or of all splits.
    Starts no job. Raises ``ValueError`` when there is nothing to read."""
    asked = f"{path}/graphs" if split is None else f"{path}/graphs/split={split}"
    try:
        spark.read.schema(INDEX).parquet(asked)  # looks for the folder
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"no graphs in {path} for split {split!r}") from error

    def table(name: str, schema: T.StructType) -> DataFrame:
        try:
            rows = spark.read.schema(T.StructType([*schema.fields, *_PLACE])).parquet(f"{path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], T.StructType([*schema.fields, *_PLACE]))
        return rows if split is None else rows.where(F.col("split") == split)

    return GraphTables(table("graphs", INDEX), table("nodes", NODES), table("edges", EDGES))


def scan_graph(spark: SparkSession, path: str, material_id: str) -> GraphTables:
    """The tables of one graph: of each only its part is read, in any split."""
    own = (F.col("part") == _part(F.lit(material_id))) & (F.col("material_id") == material_id)
    return GraphTables(*[t.where(own) for t in scan_graph_dataset(spark, path)])
