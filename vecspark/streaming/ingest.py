"""Vectors that arrive as a stream: appended to a table, searched at once, compacted later.

Each micro-batch is written under its number, so a batch that is replayed after a failure
replaces itself. Of vectors with one id the latest batch counts, and a null embedding
deletes the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vecspark.operators.knn import knn


def ingest(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts writing the stream's ``vec_id, embedding`` to ``path/batch=<n>``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select("vec_id", "embedding").write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The live vectors: the latest version of each id, deleted ones left out."""
    rows = spark.read.parquet(path).select("vec_id", "embedding", F.col("batch").cast("long").alias("batch"))
    latest = rows.groupBy("vec_id").agg(F.max_by(F.struct("embedding"), "batch").alias("v"))
    return latest.select("vec_id", F.col("v.embedding").alias("embedding")).filter("embedding is not null")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, index_search=None) -> DataFrame:
    """The k nearest live vectors: exact over the stream's table, merged with ``index_search(queries, k)`` if given."""
    fresh = knn(current(spark, path), queries, k)
    if index_search is None:
        return fresh
    from vecspark.operators.knn import nearest

    replaced = spark.read.parquet(path).select("vec_id").distinct()
    old = index_search(queries, k).join(replaced, "vec_id", "left_anti")
    cols = ["qid", "vec_id", "dist"]
    return nearest(fresh.select(*cols).unionByName(old.select(*cols)), k).select("qid", "rank", "vec_id", "dist")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Writes the live vectors as one batch of a new table."""
    current(spark, path).write.mode("overwrite").parquet(f"{to}/batch=0")
