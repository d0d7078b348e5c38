"""The vector table and its rules: ``vec_id`` (long) and ``embedding`` (array of float)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
NEIGHBOURS = T.StructType([T.StructField("qid", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("dist", T.DoubleType())])


class VectorError(ValueError):
    """A vector table breaks its rules."""


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The one length of all vectors, from a single aggregation; 0 for an empty table.

    Raises on null vectors, null or non-finite components, null ids and mixed lengths.
    """
    v = F.col(column)
    bad = v.isNull() | F.col("vec_id").isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    row = vectors.agg(F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi"), F.count_if(bad).alias("bad")).first()
    if row["bad"]:
        raise VectorError(f"{row['bad']} rows have no id, no vector, or a component that is null or not finite")
    if row["lo"] != row["hi"]:
        raise VectorError(f"vectors have between {row['lo']} and {row['hi']} components")
    return int(row["hi"] or 0)


def require_unique_ids(vectors: DataFrame) -> None:
    """Raises if a ``vec_id`` occurs twice."""
    again = vectors.groupBy("vec_id").count().filter("count > 1").limit(1).collect()
    if again:
        raise VectorError(f"vec_id {again[0]['vec_id']} occurs {again[0]['count']} times")


def as_double(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, F.col(column).cast("array<double>"))
