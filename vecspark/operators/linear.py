"""Corpus-wide linear algebra: Gram matrices, principal axes, k-means, product codes.

Every pass sums fixed-size partial results in the executors; only matrices whose size
depends on the dimension or the number of codes reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.transforms import MOST_CELLS, lists_of, matrix_of

_PARTIAL = "part int, n long, total array<double>"


def _sum_partials(frame: DataFrame) -> list:
    def add(key, table):
        total = matrix_of(table.column("total")).sum(axis=0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": [int(sum(table.column("n").to_pylist()))], "total": lists_of(total[None])})

    return frame.groupBy("part").applyInArrow(add, _PARTIAL).collect()


def _partials(vectors: DataFrame, column: str, make) -> list:
    """Sums over all rows of the arrays that ``make(matrix)`` gives as ``{part: (count, array)}``."""

    def run(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                for part, (n, x) in make(matrix_of(batch.column(0))).items():
                    have = total.get(part)
                    total[part] = (n, x) if have is None else (have[0] + n, have[1] + x)
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "n": [n for n, _ in total.values()], "total": pa.array([x for _, x in total.values()], pa.list_(pa.float64()))})

    return _sum_partials(vectors.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, _PARTIAL))


def gram(vectors: DataFrame, column: str = "embedding", other=None) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sum of the vectors, and the sum of outer products (with ``other(matrix)``, if given)."""

    def make(x):
        y = x if other is None else other(x)
        product = x.T @ y
        return {-1: (len(x), x.sum(axis=0)), **{i: (0, row) for i, row in enumerate(product)}}

    rows = {r["part"]: r for r in _partials(vectors, column, make)}
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    product = np.stack([np.array(rows[i]["total"]) for i in range(len(rows) - 1)])
    if product.size > MOST_CELLS:
        raise ValueError("the dimension is too high for a dense Gram matrix")
    return rows[-1]["n"], np.array(rows[-1]["total"]), product


def principal_axes(vectors: DataFrame, column: str = "embedding", centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and an orthonormal basis (columns): of the covariance, or uncentred (the SVD basis).

    The component of largest size in each axis is positive.
    """
    n, total, product = gram(vectors, column)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    if centred:
        product = product - np.outer(total, total) / n
    values, axes = np.linalg.eigh(product / n)
    values, axes = values[::-1], axes[:, ::-1]
    flip = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return np.maximum(values, 0), axes * np.where(flip == 0, 1, flip)


def spectrum(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``pos``, ``value``: singular values of the centred data over their sum, falling."""
    values = np.sqrt(principal_axes(vectors, column)[0])
    share = values / (values.sum() or 1)
    return vectors.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(share)], "pos int, value double")


def codebook(vectors: DataFrame, parts: int, codes: int, iterations: int = 20, seed: int = 123, column: str = "embedding", rotation: np.ndarray | None = None, first: np.ndarray | None = None) -> np.ndarray:
    """A product codebook (parts x codes x width) by Lloyd's iterations over all vectors.

    The first centroids are the vectors of least hashed id, or ``first`` (one a row). Components beyond a multiple of
    ``parts`` are filled with zeros. A code that loses all its vectors stays where it is.
    With fewer vectors than codes, the last ones repeat.
    """
    turn = lambda x: x if rotation is None else x @ rotation
    if first is None:
        rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("x")).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(codes).collect()
        first = np.array([r["x"] for r in rows])
    if not len(first):
        raise ValueError("no vectors to learn from")
    start = turn(first)
    start = start[np.minimum(np.arange(codes), len(start) - 1)]
    book = _split(start, parts).transpose(1, 0, 2).copy()
    spark = vectors.sparkSession
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(book)

        def make(x, shared=shared):
            own, out = _split(turn(x), parts), {}
            for m, centres in enumerate(shared.value):
                code = _closest(own[:, m], centres)
                n = np.bincount(code, minlength=len(centres))
                total = np.stack([np.bincount(code, own[:, m, d], len(centres)) for d in range(own.shape[2])], axis=1)
                out.update({m * len(centres) + int(c): (int(n[c]), total[c]) for c in np.flatnonzero(n)})
            return out

        moved = book.copy()
        for r in _partials(vectors, column, make):
            moved[r["part"] // codes, r["part"] % codes] = np.array(r["total"]) / r["n"]
        if np.array_equal(moved, book):
            break
        book = moved
    return book


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row; ties go to the first."""
    return np.concatenate([((x[lo : lo + 1024, None, :] - centres[None]) ** 2).sum(-1).argmin(1) for lo in range(0, len(x), 1024)]) if len(x) else np.zeros(0, int)


def kmeans(vectors: DataFrame, cells: int, iterations: int = 10, seed: int = 123, column: str = "embedding", first: np.ndarray | None = None) -> np.ndarray:
    """Centroids (cells x dimension), from ``first`` if given."""
    return codebook(vectors, 1, cells, iterations, seed, column, first=first)[0]


def optimised_codebook(vectors: DataFrame, parts: int, codes: int, rounds: int = 5, iterations: int = 5, seed: int = 123, column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """A rotation and a product codebook fitted in turn: codes for the rotated vectors, then the
    orthogonal Procrustes rotation onto their reconstructions. Starts from the principal axes,
    dealt to the parts so that their variances balance."""
    values, axes = principal_axes(vectors, column)
    room = -(-len(values) // parts)
    bins: list[list[int]] = [[] for _ in range(parts)]
    weight = np.zeros(parts)
    for i, v in enumerate(np.log(np.maximum(values, 1e-12))):
        at = min((p for p in range(parts) if len(bins[p]) < room), key=lambda p: (weight[p], p))
        bins[at].append(i)
        weight[at] += v - np.log(1e-13)
    rotation = axes[:, [i for b in bins for i in b]]
    book = codebook(vectors, parts, codes, iterations, seed, column, rotation)
    for _ in range(rounds):
        now, turned = book, rotation

        def rebuilt(x, now=now, turned=turned):
            own = _split(x @ turned, parts)
            return np.concatenate([c[_closest(own[:, m], c)] for m, c in enumerate(now)], axis=1)[:, : x.shape[1]]

        _, _, cross = gram(vectors, column, rebuilt)
        u, _, vt = np.linalg.svd(cross)
        rotation = u @ vt
        book = codebook(vectors, parts, codes, iterations, seed, column, rotation)
    return rotation, book


def codebook_frame(spark, book: np.ndarray) -> DataFrame:
    """``m, code, centroid`` rows of a codebook."""
    return spark.createDataFrame([(m, c, [float(v) for v in row]) for m, part in enumerate(book) for c, row in enumerate(part)], "m int, code int, centroid array<double>")


def encode(vectors: DataFrame, book: np.ndarray, rotation: np.ndarray | None = None, column: str = "embedding") -> DataFrame:
    """``vec_id, codes``: the nearest code of each part (ties: the first)."""
    shared = vectors.sparkSession.sparkContext.broadcast((book, rotation))

    def run(batches):
        own, turn = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column(1))
            parts = _split(x if turn is None else x @ turn, len(own))
            codes = np.stack([_closest(parts[:, m], own[m]) for m in range(len(own))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of(codes.astype(np.int32), pa.int32())], ["vec_id", "codes"])

    return vectors.select("vec_id", F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, codes array<int>")


def lookup_tables(queries: DataFrame, book: np.ndarray, rotation: np.ndarray | None = None) -> DataFrame:
    """``qid, lut``: squared distances of each part of a query to each code."""
    shared = queries.sparkSession.sparkContext.broadcast((book, rotation))

    def run(batches):
        own, turn = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix_of(batch.column(1))
            parts = _split(q if turn is None else q @ turn, len(own))
            lut = ((parts[:, :, None, :] - own[None]) ** 2).sum(-1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lut.tolist(), pa.list_(pa.list_(pa.float64())))], ["qid", "lut"])

    return queries.select("qid", "q").mapInArrow(run, "qid long, lut array<array<double>>")


def column_stats(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``pos, mean, stdev`` (population) of every component."""
    each = vectors.select(F.posexplode(F.col(column).cast("array<double>")).alias("pos", "x"))
    return each.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("stdev"))
