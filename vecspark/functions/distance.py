"""Distances between vectors as column expressions and as numpy kernels.

Sums run over components from left to right in double. For a known dimension the
expression is unrolled, which keeps it inside whole-stage code generation; otherwise it is
a higher-order function, interpreted and much slower, for any length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest dimension that is unrolled; beyond it generated code may pass the JVM's method limit.
UNROLL = 256


def _fold(terms: Callable[[Column, Column], Column], a: Column, b: Column, dims: int | None) -> Column:
    if dims is not None and 0 < dims <= UNROLL:
        total = terms(a[0], b[0])
        for i in range(1, dims):
            total = total + terms(a[i], b[i])
        return total
    return F.aggregate(F.zip_with(a, b, terms), F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column, dims: int | None = None) -> Column:
    """Squared Euclidean distance of two arrays of double."""
    return _fold(lambda x, y: (x - y) * (x - y), a, b, dims)


def inner_product(a: Column, b: Column, dims: int | None = None) -> Column:
    return _fold(lambda x, y: x * y, a, b, dims)


def inner_product_distance(a: Column, b: Column, dims: int | None = None) -> Column:
    return F.lit(1.0) - inner_product(a, b, dims)


def norm2(a: Column, dims: int | None = None) -> Column:
    """Squared norm."""
    return _fold(lambda x, y: x * y, a, a, dims)


def l2sq_via_ip(a: Column, b: Column, a_norm2: Column, b_norm2: Column, dims: int | None = None) -> Column:
    """Squared distance from stored squared norms; rounds differently from ``l2sq``."""
    return a_norm2 + b_norm2 - F.lit(2.0) * inner_product(a, b, dims)


def l2sq_bytes(a: Column, b: Column, dims: int | None = None) -> Column:
    """Squared distance of two arrays of small integers, as a long."""
    term = lambda x, y: ((x - y) * (x - y)).cast("bigint")
    if dims is not None and 0 < dims <= UNROLL:
        return _fold(lambda x, y: term(x.cast("int"), y.cast("int")), a, b, dims)
    return F.aggregate(F.zip_with(a.cast("array<int>"), b.cast("array<int>"), term), F.lit(0).cast("bigint"), lambda s, x: s + x)


def euclidean(a: Column, b: Column, dims: int | None = None) -> Column:
    return F.sqrt(l2sq(a, b, dims))


def prefix_l2sq(a: Column, b: Column) -> Column:
    """Running squared distance after 1, 2, ... components."""
    step = lambda s, x: F.concat(s, F.array(F.coalesce(F.element_at(s, -1), F.lit(0.0)) + x))
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.slice(F.aggregate(terms, F.array(F.lit(0.0)), step), F.lit(2), F.size(a))


def partial_l2sq(a: Column, b: Column, dims: int, every: int) -> list[tuple[int, Column]]:
    """Partial squared distances at each checkpoint: after every ``every`` components, and all."""
    out, total = [], None
    for i in range(dims):
        term = (a[i] - b[i]) * (a[i] - b[i])
        total = term if total is None else total + term
        if (i + 1) % every == 0 or i + 1 == dims:
            out.append((i + 1, total))
    return out


def l2sq_block(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """All squared distances of two row matrices, by differences (no cancellation), strip by strip."""
    out = np.empty((len(queries), len(base)))
    for i, q in enumerate(queries):
        d = base - q
        out[i] = np.einsum("ij,ij->i", d, d)
    return out


def l2sq_screen(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """All squared distances by one matrix product: fast, to be refined where the order matters."""
    return np.maximum((queries**2).sum(axis=1)[:, None] + (base**2).sum(axis=1)[None, :] - 2 * queries @ base.T, 0)
