"""Stored indexes and results, as Parquet."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.functions.transforms import lists_of, matrix_of

from vecspark.operators import hnsw
from vecspark.operators.ivf import centroid_frame, centroids_of
from vecspark.sources.vectors import FormatError, write_bytes


class IndexError_(ValueError):
    """A stored index is incomplete or inconsistent."""


def save_ivf(filed: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Vectors in one folder per cell, so that a search reads the cells it probes; centroids and counts beside them."""
    spark = filed.sparkSession
    filed.repartition("cell").sortWithinPartitions("cell", "vec_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
    centroid_frame(spark, centroids).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    filed.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/counts")


def load_ivf(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    filed = spark.read.parquet(f"{path}/lists").select(F.col("cell").cast("int").alias("cell"), "vec_id", "embedding")
    _same_rows(spark, filed, path)
    return filed, centroids_of(spark.read.parquet(f"{path}/centroids"))


def _same_rows(spark: SparkSession, rows: DataFrame, path: str) -> None:
    want, have = spark.read.parquet(f"{path}/counts").first()["rows"], rows.count()
    if want != have:
        raise IndexError_(f"{path} should hold {want} rows and holds {have}")


def save_hnsw(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/graph")
    spark = index.sparkSession
    spark.read.parquet(f"{path}/graph").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/counts")


def load_hnsw(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    index = spark.read.parquet(f"{path}/graph").select(F.col("shard").cast("int").alias("shard"), "vec_id", "embedding", "links")
    _same_rows(spark, index, path)
    if check:
        wrong = hnsw.integrity(index).limit(1).collect()
        if wrong:
            raise IndexError_(f"{wrong[0]['problem']} at node {wrong[0]['node']}")
    return index


def save_vectors(vectors: DataFrame, path: str) -> None:
    """The exact index is the table itself."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/counts")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.parquet(f"{path}/vectors")
    _same_rows(spark, out, path)
    return out


def append_results(metrics: DataFrame, path: str) -> None:
    """Adds rows (``method, setting, recall, ...``) to a table of results."""
    metrics.write.mode("append").parquet(path)


#: Header of a graph file in the layout of the hnswlib library: six sizes, top level, entry, three link numbers, level factor, build width.
_HEADER = struct.Struct("<6QiI3QdQ")


def decode_graph(data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, list[list[list[int]]]]:
    """Labels, vectors and links (by label, for each level) of a graph file."""
    if len(data) < _HEADER.size:
        raise FormatError("the file is shorter than its header")
    _, _, n, size, label_at, data_at, _, _, most, most0, _, _, _ = _HEADER.unpack_from(data)
    if data_at + 4 * dims > label_at or label_at + 8 > size or _HEADER.size + n * size > len(data):
        raise FormatError(f"the header does not fit vectors of {dims} components")
    block = np.frombuffer(data, np.uint8, n * size, _HEADER.size).reshape(n, size)
    labels = np.ascontiguousarray(block[:, label_at : label_at + 8]).view("<u8").ravel().astype(np.int64)
    vectors = np.ascontiguousarray(block[:, data_at : data_at + 4 * dims]).view("<f4")
    near = np.ascontiguousarray(block[:, : 4 * (most0 + 1)]).view("<u4")
    links, at = [], _HEADER.size + n * size
    for i in range(n):
        own = [labels[near[i, 1 : 1 + (near[i, 0] & 0xFFFF)]].tolist()]
        length = int.from_bytes(data[at : at + 4], "little")
        upper = np.frombuffer(data, "<u4", length // 4, at + 4).reshape(-1, most + 1)
        own += [labels[row[1 : 1 + (row[0] & 0xFFFF)]].tolist() for row in upper]
        at += 4 + length
        links.append(own)
    return labels, vectors, links


def encode_graph(labels: np.ndarray, vectors: np.ndarray, links: list[list[list[int]]], m: int, width: int) -> bytes:
    """The same as a file; ``m`` links a node (twice that on level 0)."""
    n, dims = vectors.shape
    place = {int(v): i for i, v in enumerate(labels)}
    data_at = 4 * (2 * m + 1)
    label_at = data_at + 4 * dims
    block = np.zeros((n, label_at + 8), np.uint8)
    near = np.zeros((n, 2 * m + 1), "<u4")
    upper = []
    for i, levels in enumerate(links):
        rows = [[place[v] for v in own] for own in levels]
        near[i, 0] = len(rows[0])
        near[i, 1 : 1 + len(rows[0])] = rows[0]
        more = np.zeros((len(rows) - 1, m + 1), "<u4")
        for level, own in enumerate(rows[1:]):
            more[level, 0] = len(own)
            more[level, 1 : 1 + len(own)] = own
        upper.append(more.nbytes.to_bytes(4, "little") + more.tobytes())
    block[:, :data_at] = near.view(np.uint8)
    block[:, data_at:label_at] = np.ascontiguousarray(vectors.astype("<f4")).view(np.uint8)
    block[:, label_at:] = np.ascontiguousarray(labels.astype("<u8")).view(np.uint8).reshape(n, 8)
    heights = [len(x) for x in links]
    top = max(heights, default=0) - 1
    header = _HEADER.pack(0, n, n, label_at + 8, label_at, data_at, top, heights.index(top + 1) if n else 0, m, 2 * m, m, 1 / np.log(max(2, m)), width)
    return header + block.tobytes() + b"".join(upper)


def read_graph_file(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """The index of one graph file, or of a folder of them: a shard each, in order of their names (at most 2 GB a file)."""

    def decode(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                labels, vectors, links = decode_graph(content.as_py(), dims)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(labels), pa.int32()), pa.array(labels), lists_of(vectors, pa.float32()), pa.array(links, pa.list_(pa.list_(pa.int64())))], ["shard", "vec_id", "embedding", "links"])

    files = spark.read.format("binaryFile").load(path)
    numbers = files.select("path").withColumn("shard", (F.row_number().over(Window.orderBy("path")) - 1).cast("int"))
    return files.select("path", "content").join(numbers, "path").select("shard", "content").mapInArrow(decode, "shard int, vec_id long, embedding array<float>, links array<array<bigint>>")


def write_graph_files(index: DataFrame, path: str, m: int, width: int) -> int:
    """One graph file for each shard; returns their number."""

    def encode(key, table):
        table = table.sort_by("vec_id")
        body = encode_graph(table.column("vec_id").to_numpy(), matrix_of(table.column("embedding")), table.column("links").to_pylist(), m, width)
        return pa.table({"file": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([body], pa.binary())})

    return write_bytes(index.groupBy("shard").applyInArrow(encode, "file long, content binary"), path)


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """``path, pos, setting, recall, ms``: points of recall and time in text logs, one curve a file.

    A line has a setting, recall in percent and microseconds a query; lines that start with
    ``|||`` are notes, and a line of less than 30 characters starts the curve again.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line <> '' and not startswith(line, '|||')")
    again = lines.filter(F.length("line") < 30).groupBy("path").agg(F.max("pos").alias("from"))
    word = lambda i: F.split("line", " ")[i]
    kept = lines.join(again, "path", "left").filter(F.col("from").isNull() | (F.col("pos") > F.col("from")))
    return kept.select("path", "pos", word(0).alias("setting"), word(1).cast("double").alias("recall"), (word(2).cast("double") / 1000).alias("ms"))


def read_hdf5(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``dataset``, ``query`` (``vec_id, embedding``) and ``groundtruth`` of an HDF5 bundle on the driver; needs h5py."""
    import h5py

    with h5py.File(path, "r") as f:
        found = {name: np.asarray(f[name]) for name in ("dataset", "query", "groundtruth") if name in f}
    frame = lambda m: spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(m))), "embedding": lists_of(m, pa.float32() if m.dtype.kind == "f" else pa.int32())}))
    return {name: frame(m) for name, m in found.items()}
