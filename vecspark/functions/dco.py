"""Distance-comparison operators: is the distance of a pair below a threshold, and if not, what hints at it?

Each takes a frame of pairs with the columns it names and ``tau``, and adds ``pruned``
(boolean), ``est`` (a distance or an estimate of it) and ``dims`` (components consumed).
Lossless operators prune only what lies strictly above ``tau``, so equal distances stay.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions.chi2 import chi2_quantile
from vecspark.functions.distance import l2sq
from vecspark.functions.transforms import piece_bounds

#: Relative room above a threshold, so that rounding never prunes an equal distance.
SLACK = 1e-12
ADS_EPSILON, ADS_STEP = 2.1, 16
PAA_PIECES, LSH_DIMS, LSH_P = 96, 16, 0.95
PQ_PARTS, PQ_CODES, PQ_EPSILON = 6, 256, 1.0
FINGER_BITS, FINGER_RATIO, SEANET_RATIO = 64, 1.5, 1.5


def ads_ratio(dims: int, at: int, epsilon: float = ADS_EPSILON) -> float:
    """How far the share of the distance in ``at`` of ``dims`` rotated components may lie above its expectation."""
    return 1.0 if at >= dims else at / dims * (1 + epsilon / math.sqrt(at)) ** 2


def full_scan(pairs: DataFrame, dims: int, a: str = "q", b: str = "x") -> DataFrame:
    return pairs.withColumn("est", l2sq(F.col(a), F.col(b), dims)).withColumns({"pruned": F.lit(False), "dims": F.lit(dims)})


def incremental(pairs: DataFrame, dims: int, every: int, ratio=lambda at: 1.0, scale=lambda at: 1.0, a: str = "q", b: str = "x") -> DataFrame:
    """Prunes at the first checkpoint whose partial distance exceeds ``tau * ratio(at)``.

    ``scale`` turns the partial distance there into the estimate. With ratio 1 this is
    lossless for any orthonormal transform of both sides.
    """
    names = pairs.columns
    points = [*range(every, dims, every), dims]
    done, x, y, last = pairs, F.col(a), F.col(b), 0
    for at in points:
        piece = (x[last] - y[last]) * (x[last] - y[last])
        for i in range(last + 1, at):
            piece = piece + (x[i] - y[i]) * (x[i] - y[i])
        done = done.withColumn(f"__d{at}", piece if not last else F.col(f"__d{last}") + piece)
        last = at
    stop: Column | None = None
    for at in points[:-1]:
        hit = F.col(f"__d{at}") > F.col("tau") * F.lit(float(ratio(at)) * (1 + SLACK))
        stop = F.when(hit, F.lit(at)) if stop is None else stop.when(hit, F.lit(at))
    done = done.withColumn("dims", stop.otherwise(F.lit(dims)) if stop is not None else F.lit(dims))
    est = F.col(f"__d{dims}")
    for at in points[:-1]:
        est = F.when(F.col("dims") == at, F.col(f"__d{at}") * F.lit(float(scale(at)))).otherwise(est)
    return done.withColumns({"est": est, "pruned": F.col("dims") < dims}).select(*names, "pruned", "est", "dims")


def adsampling(pairs: DataFrame, dims: int, every: int = ADS_STEP, epsilon: float = ADS_EPSILON) -> DataFrame:
    """For randomly rotated vectors: partial distances are tested against their confidence bound."""
    return incremental(pairs, dims, every, lambda at: ads_ratio(dims, at, epsilon), lambda at: dims / at)


def sketch(pairs: DataFrame, est: Column, limit: Column, dims: int) -> DataFrame:
    """A one-step operator: pruned if the estimate lies strictly above ``limit``."""
    return pairs.withColumn("est", est).withColumns({"pruned": F.col("est") > limit * F.lit(1 + SLACK), "dims": F.lit(dims)})


def paa(pairs: DataFrame, dims: int, pieces: int) -> DataFrame:
    """For piecewise means: the Cauchy-Schwarz lower bound, each piece weighted by its length."""
    total: Column | None = None
    for i, (lo, hi) in enumerate(piece_bounds(dims, pieces)):
        d = F.col("q")[i] - F.col("x")[i]
        term = F.lit(float(hi - lo)) * d * d
        total = term if total is None else total + term
    return sketch(pairs, total, F.col("tau"), pieces)


def lsh(pairs: DataFrame, low: int = LSH_DIMS, p: float = LSH_P) -> DataFrame:
    """For Gaussian projections: the projected distance over its chi-squared quantile."""
    return sketch(pairs, l2sq(F.col("q"), F.col("x"), low) / F.lit(chi2_quantile(p, low)), F.col("tau"), low)


def scaled_sketch(pairs: DataFrame, dims: int, low: int, ratio: float = SEANET_RATIO) -> DataFrame:
    """For learned sketches that keep the mean squared difference: scaled by dims / low."""
    return sketch(pairs, l2sq(F.col("q"), F.col("x"), low) * F.lit(dims / low), F.col("tau") * F.lit(ratio), low)


def quantised(pairs: DataFrame, parts: int, epsilon: float = PQ_EPSILON) -> DataFrame:
    """For product codes: ``q`` is the query's lookup table, ``x`` the codes; epsilon 1 is the plain rule."""
    total: Column | None = None
    for m in range(parts):
        term = F.col("q")[m][F.col("x")[m]]
        total = term if total is None else total + term
    return sketch(pairs, total, F.col("tau") * F.lit(epsilon), parts)


#: Vectors judged all at once instead of step by step.
FEW = 128


class Estimator:
    """A distance-comparison operator as a numpy kernel over blocks of queries and base vectors."""

    lossless = False

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """The representation compared; row for row."""
        return vectors

    def table(self, queries: np.ndarray) -> np.ndarray:
        """The queries' side, where it differs."""
        return self.project(queries)

    def judge(self, q: np.ndarray, x: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and base row: pruned, estimate, components consumed."""
        raise NotImplementedError

    def judge_rows(self, q: np.ndarray, x: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the query, base row and threshold of each row."""
        own = [self.judge(q[i : i + 1], x[i : i + 1], tau[i : i + 1]) for i in range(len(x))]
        return tuple(np.array([o[i][0, 0] for o in own]) for i in range(3))


class Incremental(Estimator):
    """Partial distances after an orthonormal transform, in steps of ``every`` components."""

    def __init__(self, matrix: np.ndarray | None, every: int = ADS_STEP, epsilon: float | None = None, amplify: np.ndarray | None = None):
        self.matrix, self.every, self.epsilon, self.amplify = matrix, every, epsilon, amplify
        self.lossless = epsilon is None
        self._known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors if self.matrix is None else vectors @ self.matrix

    def _steps(self, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where steps end; of all but the last, the limit's ratio to the threshold and the scale of the estimate."""
        if dims not in self._known:
            ends = np.array([*range(self.every, dims, self.every), dims])
            ratio = np.array([(1.0 if self.epsilon is None else ads_ratio(dims, int(e), self.epsilon)) * (1 + SLACK) for e in ends[:-1]])
            scale = np.array([dims / e if self.epsilon is not None else 1.0 if self.amplify is None else self.amplify[e - 1] for e in ends[:-1]])
            self._known[dims] = ends, ratio, scale
        return self._known[dims]

    def judge_rows(self, q, x, tau):
        """All partial distances at once, as the rows are few; one query and threshold may stand for all."""
        dims = x.shape[1]
        ends, ratio, scale = self._steps(dims)
        part = x - q
        part *= part
        if self.every > 1:
            part = np.add.reduceat(part, ends - np.diff(ends, prepend=0), axis=1)
        np.cumsum(part, axis=1, out=part)
        if len(ends) == 1:
            return np.zeros(len(x), bool), part[:, 0], np.full(len(x), dims)
        hit = part[:, :-1] > np.reshape(tau, (-1, 1)) * ratio
        first = hit.argmax(axis=1)
        pruned = hit[np.arange(len(x)), first]
        return pruned, np.where(pruned, part[np.arange(len(x)), first] * scale[first], part[:, -1]), np.where(pruned, ends[first], dims)

    def judge(self, q, x, tau):
        if 0 < len(x) <= FEW and len(q):
            own = [self.judge_rows(row, x, t) for row, t in zip(q, tau, strict=True)]
            return tuple(np.stack([o[i] for o in own]) for i in range(3))
        dims = x.shape[1]
        total = np.zeros((len(q), len(x)))
        est = np.zeros_like(total)
        used = np.full(total.shape, dims)
        open_ = np.ones(total.shape, bool)
        for lo in range(0, dims, self.every):
            hi = min(dims, lo + self.every)
            for i in range(len(q)):
                own = np.flatnonzero(open_[i])
                if len(own):
                    d = x[own, lo:hi] - q[i, lo:hi]
                    total[i, own] += np.einsum("ij,ij->i", d, d)
            if hi == dims:
                break
            ratio = (1.0 if self.epsilon is None else ads_ratio(dims, hi, self.epsilon)) * (1 + SLACK)
            hit = open_ & (total > tau[:, None] * ratio)
            scale = dims / hi if self.epsilon is not None else 1.0 if self.amplify is None else self.amplify[hi - 1]
            est[hit], used[hit] = total[hit] * scale, hi
            open_ &= ~hit
        return ~open_, np.where(open_, total, est), used


class Sketch(Estimator):
    """A fixed-size sketch whose scaled distance is compared with ``tau * limit``."""

    def __init__(self, project, weights: np.ndarray, limit: float = 1.0, lossless: bool = False):
        self._project, self.weights, self.limit, self.lossless = project, weights, limit, lossless

    def project(self, vectors):
        return self._project(vectors)

    def judge(self, q, x, tau):
        est = np.stack([((x - row) ** 2) @ self.weights for row in q]) if len(q) else np.zeros((0, len(x)))
        return est > tau[:, None] * self.limit * (1 + SLACK), est, np.full(est.shape, x.shape[1])

    def judge_rows(self, q, x, tau):
        est = ((x - q) ** 2) @ self.weights
        return est > tau * self.limit * (1 + SLACK), est, np.full(len(x), x.shape[1])


class Codes(Estimator):
    """Product codes: queries become lookup tables, base vectors codes."""

    def __init__(self, codebook: np.ndarray, rotation: np.ndarray | None = None, epsilon: float = PQ_EPSILON):
        self.codebook, self.rotation, self.epsilon = codebook, rotation, epsilon

    def _parts(self, vectors: np.ndarray) -> np.ndarray:
        parts, _, width = self.codebook.shape
        v = vectors if self.rotation is None else vectors @ self.rotation
        v = np.pad(v, ((0, 0), (0, parts * width - v.shape[1])))
        return v.reshape(len(v), parts, width)

    def project(self, vectors):
        v = self._parts(vectors)
        return np.stack([((v[:, m, None, :] - self.codebook[m][None]) ** 2).sum(-1).argmin(1) for m in range(v.shape[1])], axis=1)

    def table(self, queries):
        v = self._parts(queries)
        return ((v[:, :, None, :] - self.codebook[None]) ** 2).sum(-1)

    def judge(self, q, x, tau):
        est = np.stack([t[np.arange(x.shape[1])[None, :], x].sum(1) for t in q]) if len(q) else np.zeros((0, len(x)))
        return est > tau[:, None] * self.epsilon * (1 + SLACK), est, np.full(est.shape, x.shape[1])

    def judge_rows(self, q, x, tau):
        est = np.take_along_axis(q, x[:, :, None], axis=2)[:, :, 0].sum(1)
        return est > tau * self.epsilon * (1 + SLACK), est, np.full(len(x), x.shape[1])


def paa_kernel(dims: int, pieces: int) -> Sketch:
    bounds = piece_bounds(dims, pieces)
    means = np.zeros((dims, pieces))
    for p, (lo, hi) in enumerate(bounds):
        means[lo:hi, p] = 1 / (hi - lo)
    return Sketch(lambda v: v @ means, np.array([hi - lo for lo, hi in bounds], float), lossless=True)


def lsh_kernel(projection: np.ndarray, p: float = LSH_P) -> Sketch:
    low = projection.shape[1]
    return Sketch(lambda v: v @ projection, np.full(low, 1 / chi2_quantile(p, low)))
