"""Exact quantiles of values that are made in the tasks and never stored: counts by bins, then the values of few bins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.dco import Estimator
from vecspark.functions.transforms import matrix_of
from vecspark.operators.knn import _collect
from vecspark.operators.linear import _partials

#: First bins between 0 and 1, parts of a bin that holds more than ``GATHER`` values, and values of a bin that are gathered.
BINS, PARTS, GATHER = 1 << 16, 1 << 12, 1 << 17


def keys_of(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; adding zero makes one of both zeros."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def values_of(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _split(lo: int, hi: int) -> list[int]:
    """Inner edges of about ``PARTS`` parts of a bin."""
    n = min(PARTS, hi - lo)
    return [lo + (hi - lo) * i // n for i in range(1, n)]


def ratio_quantiles(vectors: DataFrame, queries: DataFrame, estimator: Estimator, points: tuple[float, ...]) -> list[float | None]:
    """Interpolated quantiles of ``metrics.approximation_ratio`` over all pairs; nulls where there are no ratios.

    ``queries`` must be few enough to broadcast. Each pass counts the ratios in bins; bins that
    hold a wanted rank are split until few values are left, which are gathered.
    """
    asked = _collect(queries)[1]
    shared = vectors.sparkSession.sparkContext.broadcast((asked, estimator.table(asked) if len(asked) else asked))

    def keys(x):
        (q, side), judge = shared.value, estimator
        seen = judge.project(x)
        for i in range(len(q)):
            d = x - q[i]
            true, est = np.einsum("ij,ij->i", d, d), judge.judge(side[i : i + 1], seen, np.zeros(1))[1][0]
            some = true > 0
            yield keys_of(np.concatenate([est[some] / true[some], np.ones(np.count_nonzero(~some & (est == 0)))]))

    def counts_of(edges: np.ndarray) -> np.ndarray:
        def make(x):
            total = np.zeros(len(edges) - 1)
            for own in keys(x):
                total += np.bincount(np.searchsorted(edges, own, "right") - 1, minlength=len(total))
            return {0: (len(x), total)}

        rows = _partials(vectors, "embedding", make)
        return np.array(rows[0]["total"]).astype(np.int64) if rows else np.zeros(len(edges) - 1, np.int64)

    ends = keys_of(np.array([-np.inf, np.inf]))
    edges = np.unique(np.concatenate([ends[:1], keys_of(np.linspace(0, 1, BINS + 1)), ends[1:] + 1]))
    while True:
        counts = counts_of(edges)
        upto = np.cumsum(counts)
        if not upto[-1]:
            return [None] * len(points)
        at = [p * (int(upto[-1]) - 1) for p in points]
        ranks = sorted({r for a in at for r in (int(np.floor(a)), int(np.ceil(a)))})
        bins = sorted({int(np.searchsorted(upto, r, "right")) for r in ranks})
        wide = [b for b in bins if counts[b] > GATHER and edges[b + 1] - edges[b] > 1]
        if not wide:
            break
        edges = np.unique(np.concatenate([edges, *(np.array(_split(int(edges[b]), int(edges[b + 1])), np.int64) for b in wide)]))
    gathered = [b for b in bins if edges[b + 1] - edges[b] > 1]

    def gather(batches):
        for batch in batches:
            if batch.num_rows:
                for own in keys(matrix_of(batch.column(0))):
                    own = own[np.isin(np.searchsorted(edges, own, "right") - 1, gathered)]
                    value, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], ["key", "n"])

    known = {b: (edges[b : b + 1], counts[b : b + 1]) for b in bins if b not in gathered}
    if gathered:
        base = vectors.select(F.col("embedding").cast("array<double>").alias("x"))
        found = base.mapInArrow(gather, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
        key, n = found.column("key").to_numpy(), found.column("n").to_numpy()
        place = np.searchsorted(edges, key, "right") - 1
        known |= {b: (key[place == b], n[place == b]) for b in gathered}

    def value(rank: int) -> float:
        b = int(np.searchsorted(upto, rank, "right"))
        key, n = known[b]
        own = np.searchsorted(np.cumsum(n), rank - (int(upto[b]) - int(counts[b])), "right")
        return float(values_of(key[own : own + 1])[0])

    low, high = ([value(int(f(a))) for a in at] for f in (np.floor, np.ceil))
    return [float(x + (a - np.floor(a)) * (y - x)) for x, y, a in zip(low, high, at, strict=True)]
