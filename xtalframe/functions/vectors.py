"""MLlib vectors from columns, without Python on the rows."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPARSE = 0  # what MLlib's vector type calls a sparse vector
_HOLDER = T.StructType([T.StructField("v", VectorUDT())])


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """A sparse vector of ``size``; ``indices`` ascending, as many as ``values``.

    MLlib offers no column function for it: the vector's parts pass through
    JSON, whose reader knows the vector type. No list of names is made, so the
    size may be in the millions.
    """
    parts = F.struct(
        F.lit(_SPARSE).cast("tinyint").alias("type"),
        F.lit(size).cast("int").alias("size"),
        F.transform(indices, lambda i: i.cast("int")).alias("indices"),
        F.transform(values, lambda v: v.cast("double")).alias("values"),
    )
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), _HOLDER)["v"]
