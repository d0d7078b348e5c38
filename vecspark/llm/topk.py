"""Exact top-k inner products by columnar branch and bound.

Vectors are held dimension by dimension in blocks. For a block of queries, scores are
accumulated over one block of dimensions at a time; what the other dimensions can still add
is at most the product of the remaining norms, and candidates that cannot reach the query's
k-th best score any more are dropped, the survivors being compacted once few are left.

Each shard of the base is held by one task, which its queries pass in blocks: the base is
exchanged once, and a query once for each shard. A shard starts from a few full scores and
tightens its thresholds block by block. Where sums of products may leave the whole numbers
that doubles hold (``EXACT``), those pairs are scored with integers of any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.chunks import bounded
from vecspark.operators.blocks import Block, through_shards

K = 5
DIMENSIONS = 16
#: Queries of one block and base vectors of one shard, about; base vectors scored at once.
QUERY_BLOCK, SHARD, STRIP = 1024, 65_536, 2048
#: Sums of products under this size are exact in doubles; scores are kept within a long.
EXACT, MOST = 2.0**52, (1 << 63) - 1
#: Share of survivors under which candidates are compacted.
SPARSE = 0.25

_FOUND = "query_id long, vec_id long, score long"


def _matrix(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (columns: vectors, shorter ones filled with zeros), by id."""
    ids, column = block.ids, block.vectors
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((int(sizes.max(initial=0)), len(ids)))
    row = np.repeat(np.arange(len(ids)), sizes)
    out[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = column.flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], out[:, order]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, by score falling, then id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (a column), ids and scores of its k best base vectors under other ids."""
    dims = max(len(queries), len(base))
    queries = np.vstack([queries, np.zeros((dims - len(queries), queries.shape[1]))])
    base = np.vstack([base, np.zeros((dims - len(base), base.shape[1]))])
    # The dimensions with most weight in the queries first: bounds tighten sooner.
    order = np.argsort(-(queries**2).sum(axis=1), kind="stable")
    queries, base = np.ascontiguousarray(queries[order]), base[order]
    steps = list(range(0, dims, DIMENSIONS)) or [0]
    rest_q = [np.sqrt((queries[s + DIMENSIONS :] ** 2).sum(axis=0)) for s in steps]
    top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)
    least = np.full(len(query_ids), -np.inf)

    def take(q: int, new_ids: np.ndarray, scores: np.ndarray) -> None:
        other = new_ids != query_ids[q]
        all_ids, all_scores = np.concatenate([top[q][0], new_ids[other]]), np.concatenate([top[q][1], scores[other]])
        at = _best(all_ids, all_scores, k)
        top[q] = (all_ids[at], all_scores[at])
        if len(at) == k:
            least[q] = all_scores[at[-1]]

    bounds = [0, *range(min(64, len(ids)), len(ids), STRIP), len(ids)]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if lo == hi:
            continue
        strip, own = np.ascontiguousarray(base[:, lo:hi]), ids[lo:hi]
        rest = [np.sqrt((strip[s + DIMENSIONS :] ** 2).sum(axis=0)) for s in steps]
        total, alive, at = np.zeros((len(query_ids), hi - lo)), None, 0
        for at, s in enumerate(steps):
            total += queries[s : s + DIMENSIONS].T @ strip[s : s + DIMENSIONS]
            reach = total + np.outer(rest_q[at], rest[at]) * (1 + 1e-9) + 1e-6
            alive = reach >= least[:, None]
            if alive.mean() < SPARSE:
                break
        for q in np.flatnonzero(alive.any(axis=1)).tolist():
            left = np.flatnonzero(alive[q])
            part = total[q, left]
            for later in range(at + 1, len(steps)):
                s = steps[later]
                part = part + queries[s : s + DIMENSIONS, q] @ strip[s : s + DIMENSIONS, left]
                keep = part + rest_q[later][q] * rest[later][left] * (1 + 1e-9) + 1e-6 >= least[q]
                left, part = left[keep], part[keep]
            if len(left):
                take(q, own[left], part)
    return top


def _whole(x: np.ndarray) -> list[list[int]]:
    return [[int(v) for v in column] for column in x.T]


def _large(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int) -> list[tuple[list, list]]:
    """The same in integers of any size, scores held within a long."""
    q, x, out = _whole(queries), _whole(base), []
    for i, own in enumerate(query_ids.tolist()):
        scored = [(-max(-MOST, min(MOST, sum(a * b for a, b in zip(q[i], x[j], strict=False)))), int(ids[j])) for j in range(len(x)) if ids[j] != own]
        best = sorted(scored)[:k]
        out.append(([v for _, v in best], [-s for s, _ in best]))
    return out


def _answer(k: int, base: tuple[np.ndarray, np.ndarray], block: Block) -> pa.RecordBatch:
    (ids, x), (query_ids, q) = base, _matrix(block)
    size_q, size_x = np.sqrt((q**2).sum(axis=0)), np.sqrt((x**2).sum(axis=0))
    large_x = size_x * size_q.max(initial=0) >= EXACT
    rows: dict[str, list] = {c: [] for c in ("query_id", "vec_id", "score")}

    def put(own, of, scores) -> None:
        rows["query_id"] += [int(own)] * len(of)
        rows["vec_id"] += [int(v) for v in of]
        rows["score"] += [int(s) for s in scores]

    for own, (of, scores) in zip(query_ids, search(query_ids, q, ids[~large_x], x[:, ~large_x], k), strict=True):
        put(own, of, np.rint(scores))
    if large_x.any():
        for own, (of, scores) in zip(query_ids, _large(query_ids, q, ids[large_x], x[:, large_x], k), strict=True):
            put(own, of, scores)
    return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in rows.items()})


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id`` and ``x``, the floors of ``scale`` times each component; unusable vectors go."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: c * scale)
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # A double beyond 2**53 is whole; its floor would not fit a long.
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def top_products(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k highest inner products.

    ``vectors``: ``vec_id`` (long), ``x`` (array of whole doubles); ``is_query`` picks the
    queries by ``vec_id``. Candidates are all rows with another ``vec_id``; repeated rows
    are candidates of their own, while queries that share a ``vec_id`` count once (their
    least vector). Ties go to the smaller ``vec_id``. Scores are exact whatever their size,
    and those beyond a long count as its ends. Missing trailing dimensions count as 0; an
    empty table gives an empty result.
    """
    queries = bounded(vectors).filter(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    shards = max(1, -(-vectors.count() // SHARD))
    # Rows with one id are spread by the partition they are in.
    base = vectors.select(F.pmod(F.xxhash64("vec_id", "x", F.spark_partition_id()), F.lit(shards)).cast("int").alias("shard"), F.col("vec_id").alias("id"), F.col("x").alias("v"))
    asked = queries.select(F.col("vec_id").alias("id"), F.col("x").alias("v"))
    found = through_shards(base, asked, shards, QUERY_BLOCK, _matrix, lambda held, block: _answer(k, held, block), _FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
