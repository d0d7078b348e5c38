import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.util import frame, vectors
from vecspark.functions import dco, transforms
from vecspark.functions.chi2 import chi2_cdf, chi2_quantile
from vecspark.functions.distance import euclidean, inner_product, inner_product_distance, l2sq, l2sq_block, l2sq_bytes, l2sq_screen, l2sq_via_ip, norm2, partial_l2sq, prefix_l2sq
from vecspark.schema import VectorError, dimension, require_unique_ids

FLOATS = st.floats(-100, 100, width=32)


@pytest.mark.parametrize("dims", [60, 63, 64])
def test_distances_unrolled_and_folded(spark, dims):
    x = vectors(6, dims).astype(np.float64)
    pairs = spark.createDataFrame([(x[i].tolist(), x[j].tolist()) for i in range(3) for j in range(3)], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = pairs.select(
        l2sq(a, b, dims), l2sq(a, b), inner_product(a, b, dims), inner_product(a, b), norm2(a, dims), l2sq_via_ip(a, b, norm2(a), norm2(b), dims), euclidean(a, b, dims), inner_product_distance(a, b, dims), prefix_l2sq(a, b), F.array(*(c for _, c in partial_l2sq(a, b, dims, 16)))
    ).collect()
    for r, (i, j) in zip(got, [(i, j) for i in range(3) for j in range(3)], strict=True):
        d, ip = ((x[i] - x[j]) ** 2).sum(), x[i] @ x[j]
        assert r[0] == r[1] and math.isclose(r[0], d, rel_tol=1e-12, abs_tol=1e-12)
        assert r[2] == r[3] and math.isclose(r[2], ip, rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r[4], x[i] @ x[i], rel_tol=1e-12) and abs(r[5] - d) < 1e-9 and math.isclose(r[6], math.sqrt(d), abs_tol=1e-12)
        assert math.isclose(r[7], 1 - ip, rel_tol=1e-9, abs_tol=1e-12)
        assert np.allclose(r[8], np.cumsum((x[i] - x[j]) ** 2)) and r[9] == [r[8][k - 1] for k in [*range(16, dims, 16), dims]]


def test_byte_distance_and_kernels(spark):
    got = spark.sql("select array(1Y, -128Y, 127Y, 5Y) a, array(-3Y, 127Y, -128Y, 5Y) b").select(l2sq_bytes(F.col("a"), F.col("b"))).first()[0]
    assert got == 16 + 2 * 255 * 255
    x = vectors(50, 33).astype(np.float64)
    exact = ((x[:7, None] - x[None]) ** 2).sum(-1)
    assert np.allclose(l2sq_block(x[:7], x), exact) and np.allclose(l2sq_screen(x[:7], x), exact, atol=1e-9)


@pytest.mark.parametrize("dims", [60, 63, 64, 1])
def test_orthonormal_transforms_keep_distances(dims):
    x = vectors(40, dims).astype(np.float64) if dims > 1 else np.arange(5.0)[:, None]
    true = l2sq_block(x, x)
    for m in (transforms.haar_matrix(dims), transforms.hadamard_matrix(dims), transforms.random_rotation(dims, 3)):
        assert np.allclose(m @ m.T, np.eye(dims), atol=1e-12)
        assert np.abs(l2sq_block(x @ m, x @ m) - true).max() < 1e-9


def test_projections_are_seeded_and_signed():
    a, b = transforms.gaussian_projection(64, 16, 5), transforms.gaussian_projection(64, 16, 5)
    assert (a == b).all() and not (a == transforms.gaussian_projection(64, 16, 6)).all()
    s = transforms.sign_projection(64, 32)
    assert set(np.unique(s)) == {-1.0, 1.0} and abs(s.mean()) < 0.3


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40).flatmap(lambda d: st.tuples(st.lists(FLOATS, min_size=d, max_size=d), st.lists(FLOATS, min_size=d, max_size=d), st.integers(1, d))))
def test_paa_is_a_lower_bound(case):
    a, b, pieces = np.array(case[0]), np.array(case[1]), case[2]
    kernel = dco.paa_kernel(len(a), pieces)
    _, est, _ = kernel.judge(kernel.project(a[None]), kernel.project(b[None]), np.array([0.0]))
    assert est[0, 0] <= ((a - b) ** 2).sum() * (1 + 1e-9) + 1e-9
    assert sum(hi - lo for lo, hi in transforms.piece_bounds(len(a), pieces)) == len(a)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 2000), st.integers(1, 2000), st.floats(0.0, 4.0))
def test_ads_ratio(dims, at, epsilon):
    assert dco.ads_ratio(dims, dims, epsilon) == 1.0
    if at < dims:
        assert math.isclose(dco.ads_ratio(dims, at, epsilon), at / dims * (1 + epsilon / math.sqrt(at)) ** 2)


def test_chi2():
    assert abs(chi2_quantile(0.95, 16) - 26.296) < 1e-3 and abs(chi2_quantile(0.95, 64) - 83.675) < 1e-3
    for p in (0.01, 0.5, 0.99):
        for k in (1, 2, 7, 300):
            assert abs(chi2_cdf(chi2_quantile(p, k), k) - p) < 1e-10
    with pytest.raises(ValueError):
        chi2_quantile(1.0, 3)


def test_expressions_for_transforms(spark):
    x = vectors(5, 10).astype(np.float64)
    df = frame(spark, x).withColumn("v", F.col("embedding").cast("array<double>"))
    m = transforms.hadamard_matrix(10)
    got = df.select("v", transforms.paa(F.col("v"), 10, 4), transforms.paa_equal(F.col("v"), 10, 3), transforms.paa_equal(F.col("v"), 10, 2, list(range(9, -1, -1))), transforms.apply_matrix(F.col("v"), m), transforms.pad(F.col("v"), 2), transforms.pick(F.col("v"), [1, 3]), transforms.sorted_with_positions(F.col("v")), transforms.sign_bits(F.col("v"), 10)).collect()
    for r in got:
        v = np.array(r["v"])
        assert np.allclose(r[1], [v[0:2].mean(), v[2:5].mean(), v[5:7].mean(), v[7:10].mean()])
        assert np.allclose(r[2], [v[0:3].mean(), v[3:6].mean(), v[6:9].mean()]) and np.allclose(r[3], [v[5:].mean(), v[:5].mean()])
        assert np.allclose(r[4], v @ m) and r[5] == [*v, 0.0, 0.0] and r[6] == [v[1], v[3]]
        assert [s["pos"] for s in r[7]] == np.argsort(v, kind="stable").tolist()
        assert r[8] == int("".join("1" if c > 0 else "0" for c in v), 2)
    with pytest.raises(ValueError):
        transforms.sign_bits(F.col("v"), 65)


def test_table_rules(spark):
    good = frame(spark, vectors(9, 4))
    assert dimension(good) == 4 and dimension(good.limit(0)) == 0
    require_unique_ids(good)
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [float("nan")])], [(None, [1.0])], [(1, [None])]):
        with pytest.raises(VectorError):
            dimension(spark.createDataFrame(bad, good.schema))
    with pytest.raises(VectorError):
        require_unique_ids(good.unionByName(good.limit(1)))


def test_lossless_operators_never_prune_below_the_threshold(spark):
    x = vectors(80, 24).astype(np.float64)
    true = l2sq_block(x[:5], x)
    tau = np.sort(true, axis=1)[:, 9]
    for kernel in (dco.Incremental(None, 5), dco.Incremental(transforms.haar_matrix(24), 7), dco.Incremental(transforms.random_rotation(24), 16), dco.paa_kernel(24, 5)):
        assert kernel.lossless
        pruned, est, used = kernel.judge(kernel.table(x[:5]), kernel.project(x), tau)
        assert not (pruned & (true <= tau[:, None])).any() and pruned.any() and (est <= true * (1 + 1e-9) + 1e-9).all() and (used > 0).all()


def test_column_operators_agree_with_kernels(spark):
    x = vectors(60, 24).astype(np.float64)
    tau = np.sort(l2sq_block(x[:4], x), axis=1)[:, 9]
    rows = [(q, i, x[q].tolist(), x[i].tolist(), float(tau[q])) for q in range(4) for i in range(60)]
    pairs = spark.createDataFrame(rows, "qid int, vec_id int, q array<double>, x array<double>, tau double")
    for frame_, kernel in ((dco.incremental(pairs, 24, 7), dco.Incremental(None, 7)), (dco.adsampling(pairs, 24, 7, 1.0), dco.Incremental(None, 7, 1.0))):
        pruned, est, used = kernel.judge(x[:4], x, tau)
        for r in frame_.collect():
            i = (r["qid"], r["vec_id"])
            assert r["pruned"] == pruned[i] and r["dims"] == used[i] and math.isclose(r["est"], est[i], rel_tol=1e-9, abs_tol=1e-12)
