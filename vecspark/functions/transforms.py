"""Vector transforms: piecewise means, Haar wavelets, rotations, projections and element-wise helpers.

Linear transforms are matrices made in closed form or from a seed on the driver; applied
as expressions they inline the matrix, applied in batches they are one product per Arrow batch.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest matrix that is sent to the executors.
MOST_CELLS = 4096 * 4096


def next_power(dims: int) -> int:
    return 1 << max(0, (dims - 1).bit_length())


def haar_matrix(dims: int) -> np.ndarray:
    """Orthonormal Haar transform of ``dims`` components padded with zeros to a power of two.

    Rows are components, columns coefficients from coarse to fine. Columns that only the
    padding touches are left out: they are zero for every vector.
    """
    n = next_power(dims)
    columns = [np.full(n, 1 / math.sqrt(n))]
    width = n
    while width > 1:
        for start in range(0, n, width):
            c = np.zeros(n)
            c[start : start + width // 2] = 1 / math.sqrt(width)
            c[start + width // 2 : start + width] = -1 / math.sqrt(width)
            columns.append(c)
        width //= 2
    full = np.stack(columns, axis=1)[:dims]
    return full[:, np.abs(full).sum(axis=0) > 0]


def hadamard_matrix(dims: int, seed: int = 0) -> np.ndarray:
    """Walsh-Hadamard rotation of components with signs from their parity hash; ``dims`` padded to a power of two."""
    n = next_power(dims)
    i = np.arange(n)
    signs = np.where(popcount(i * 2654435761 + seed * 40503 + 12345) % 2, -1.0, 1.0)
    h = np.where(popcount(i[:, None] & i[None, :]) % 2, -1.0, 1.0) / math.sqrt(n)
    return (signs[:, None] * h)[:dims]


def popcount(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    total = np.zeros(x.shape, np.int64)
    while x.any():
        total += (x & np.uint64(1)).astype(np.int64)
        x = x >> np.uint64(1)
    return total


def random_rotation(dims: int, seed: int = 0) -> np.ndarray:
    """A uniformly random orthonormal matrix: QR of a Gaussian one, signs fixed."""
    q, r = np.linalg.qr(np.random.Generator(np.random.Philox(seed)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def gaussian_projection(dims: int, low: int, seed: int = 0) -> np.ndarray:
    """Independent N(0, 1) entries, unscaled: squared projected distances over squared ones are chi-squared."""
    return np.random.Generator(np.random.Philox(seed)).standard_normal((dims, low))


def sign_projection(dims: int, low: int) -> np.ndarray:
    """Entries +1 and -1 by the parity of ``i & (2 j + 1)``: a projection with a closed form."""
    i, j = np.arange(dims)[:, None], np.arange(low)[None, :]
    return np.where(popcount((i + 1) * 31 & (2 * j + 1) * 7) % 2, -1.0, 1.0)


def piece_bounds(dims: int, pieces: int) -> list[tuple[int, int]]:
    """Bounds of ``pieces`` stretches that cover all components, cut at ``floor(i * dims / pieces)``."""
    cuts = [i * dims // pieces for i in range(pieces + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def paa(v: Column, dims: int, pieces: int) -> Column:
    """Means of the stretches of ``piece_bounds``."""
    return F.array(*(_sum(v, a, b) / F.lit(float(b - a)) for a, b in piece_bounds(dims, pieces)))


def paa_equal(v: Column, dims: int, pieces: int, order: list[int] | None = None) -> Column:
    """Means of ``dims // pieces`` consecutive components, those left over dropped; optionally of reordered components."""
    n = dims // pieces
    at = order or list(range(dims))
    mean = lambda own: sum((v[i] for i in own[1:]), start=v[own[0]]) / F.lit(float(n))
    return F.array(*(mean(at[p * n : (p + 1) * n]) for p in range(pieces)))


def _sum(v: Column, a: int, b: int) -> Column:
    total = v[a]
    for i in range(a + 1, b):
        total = total + v[i]
    return total


def apply_matrix(v: Column, matrix: np.ndarray) -> Column:
    """``v`` times a matrix, as an unrolled expression; zero entries cost nothing."""
    out = []
    for j in range(matrix.shape[1]):
        terms = [v[int(i)] * F.lit(float(matrix[i, j])) for i in np.flatnonzero(matrix[:, j])]
        total = terms[0] if terms else F.lit(0.0)
        for t in terms[1:]:
            total = total + t
        out.append(total)
    return F.array(*out)


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of one length as a matrix of double."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists_of(matrix: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    rows, width = matrix.shape
    values = pa.array(np.ascontiguousarray(matrix).ravel(), kind or pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), values)


def transform(vectors: DataFrame, matrix: np.ndarray, column: str = "embedding", to: str | None = None) -> DataFrame:
    """All columns, with ``to`` (or ``column`` itself) holding the vectors times ``matrix``, in double."""
    if matrix.size > MOST_CELLS:
        raise ValueError(f"a matrix of {matrix.size} cells is not sent to executors")
    to = to or column
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)
    wide = vectors.withColumn(to, F.col(column).cast("array<double>"))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(to)
            x = matrix_of(batch.column(at))
            done = lists_of(x @ shared.value if len(x) else np.zeros((0, shared.value.shape[1])))
            yield pa.RecordBatch.from_arrays([done if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return wide.mapInArrow(run, wide.schema)


def pad(v: Column, by: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), by)) if by > 0 else v


def pick(v: Column, keep: list[int]) -> Column:
    return F.array(*(v[i] for i in keep))


def sorted_with_positions(v: Column) -> Column:
    """The components in rising order with their positions."""
    return F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("value"), i.alias("pos"))))


def sign_bits(v: Column, dims: int) -> Column:
    """Up to 64 signs (positive: 1) packed into a long, the first in the highest place."""
    if dims > 64:
        raise ValueError("at most 64 signs fit into a long")
    return F.aggregate(v, F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def hamming_share(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) / F.lit(float(bits))


def min_max(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id``, ``pos``, ``value``: components scaled to [0, 1] by the range of their position."""
    each = vectors.select("vec_id", F.posexplode(F.col(column).cast("array<double>")).alias("pos", "x"))
    range_ = each.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return each.join(range_, "pos").select("vec_id", "pos", F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("value"))
