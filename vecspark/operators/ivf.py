"""Inverted-list index: vectors filed under their nearest centroid, searched in the lists nearest to a query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions.dco import Estimator
from vecspark.functions.distance import l2sq
from vecspark.functions.transforms import MOST_CELLS, matrix_of
from vecspark.operators.blocks import through_shards
from vecspark.operators.knn import BLOCK, SHARD, _best_of, held_parts, nearest
from vecspark.operators.linear import _closest

_FOUND = "qid long, vec_id long, dist double"


def centroid_frame(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>")


def centroids_of(frame: DataFrame) -> np.ndarray:
    """The centroid table as a matrix, after a check of its size; cells must be numbered from 0."""
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("centroid")), F.lit(0)).alias("cells")).first()
    if row["cells"] > MOST_CELLS:
        raise ValueError(f"{row['cells']} centroid components are too many to send to executors")
    rows = sorted(frame.select("cell", F.col("centroid").cast("array<double>").alias("c")).collect(), key=lambda r: r["cell"])
    if [r["cell"] for r in rows] != list(range(len(rows))):
        raise ValueError("cells must be numbered from 0 without gaps")
    return np.array([r["c"] for r in rows])


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cell, vec_id, embedding``: the nearest centroid of each vector, ties to the lowest cell."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell = _closest(matrix_of(batch.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), batch.column(1)], ["cell", "vec_id", "embedding"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"cell int, vec_id long, embedding {kind}")


def list_sizes(filed: DataFrame, cells: int) -> DataFrame:
    """``cell, n`` of all cells, empty ones included."""
    every = filed.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell"))
    return every.join(filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))


def list_offsets(filed: DataFrame, cells: int) -> DataFrame:
    """``cell, start, n``: where each list begins if lists are laid end to end. One row per cell is windowed."""
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return list_sizes(filed, cells).select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """``qid, q, cell``: the ``nprobe`` nearest cells of each query, ties to the lowest."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix_of(batch.column(1))
            d = np.stack([((shared.value - row) ** 2).sum(1) for row in q])
            cells = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
            at = np.repeat(np.arange(len(q)), cells.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cells.ravel(), pa.int32())], ["qid", "q", "cell"])

    return queries.select("qid", "q").mapInArrow(run, "qid long, q array<double>, cell int")


def _pieces(filed: DataFrame) -> DataFrame:
    """``cell, pieces``: in how many pieces of about ``SHARD`` vectors a list is searched."""
    return filed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("pieces"))


def _probed(filed: DataFrame, asked: DataFrame, cells: int) -> DataFrame:
    """The lists that are asked for; of lists stored by cell no others are read."""
    wanted = sorted(r["cell"] for r in asked.select("cell").distinct().collect())
    return filed if len(wanted) == cells else filed.filter(F.col("cell").isin(wanted))


def search_sql(filed: DataFrame, queries: DataFrame, centroids: np.ndarray, nprobe: int, k: int, dims: int | None) -> DataFrame:
    """``qid, rank, vec_id, dist`` over the probed lists, as an equi-join on the cell and the piece of a long list."""
    asked = probes(queries, centroids, nprobe)
    filed = _probed(filed, asked, len(centroids))
    pieces = F.broadcast(_pieces(filed))
    left = filed.join(pieces, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).alias("piece"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    right = asked.join(pieces, "cell").withColumn("piece", F.explode(F.expr("sequence(0L, pieces - 1L)"))).drop("pieces")
    met = left.join(right, ["cell", "piece"])
    return nearest(met.select("qid", "vec_id", l2sq(F.col("q"), F.col("x"), dims).alias("dist")), k).select("qid", "rank", "vec_id", "dist")


def search(filed: DataFrame, queries: DataFrame, centroids: np.ndarray, nprobe: int, k: int, estimator: Estimator | None = None) -> DataFrame:
    """The same with a running k-th distance in every list, which an estimator is held against.

    Lists longer than ``SHARD`` vectors are split, their probes repeated for each piece;
    only lists that are asked for are read, each exchanged once, and queries pass them in
    blocks.
    """
    asked = probes(queries, centroids, nprobe)
    filed = _probed(filed, asked, len(centroids))
    # One row per cell: pieces are numbered through.
    sizes = _pieces(filed).withColumn("first", F.coalesce(F.sum("pieces").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    sizes = sizes.sparkSession.createDataFrame(sizes.collect(), sizes.schema)
    shards = max(1, int(sizes.agg(F.sum("pieces")).first()[0] or 0))
    near = F.broadcast(sizes)
    left = filed.join(near, "cell").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces"))).cast("int").alias("shard"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    right = asked.join(near, "cell").select(F.explode(F.expr("sequence(first, first + pieces - 1)")).alias("shard"), F.col("qid").alias("id"), F.col("q").alias("v"))
    answer = lambda parts, block: _best_of(parts, block.ids, block.matrix, k, None, estimator)
    found = through_shards(left, queries, shards, BLOCK, lambda rows: held_parts(rows, estimator), answer, _FOUND, asks=right)
    return nearest(found, k).select("qid", F.col("rank").cast("int").alias("rank"), "vec_id", "dist")
