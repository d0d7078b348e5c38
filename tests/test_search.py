import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.util import SCHEMA, exact, frame, rows, vectors
from vecspark.functions import dco, transforms
from vecspark.operators import ivf, knn as K, linear, metrics
from vecspark.operators.blocks import through_shards
from vecspark.plans import planner

X = vectors()
QUERIES = [(i, X[i]) for i in (0, 3, 66, 150)]


@pytest.fixture(scope="module")
def base(spark):
    return frame(spark, X).cache()


@pytest.fixture(scope="module")
def asked(base):
    return K.as_queries(base.filter(F.col("vec_id").isin(*[q[0] for q in QUERIES]))).cache()


def test_exact_search_with_ties(spark, base, asked):
    want = exact(X, QUERIES, 12)
    assert rows(K.knn(base, asked, 12)) == want
    assert rows(K.knn_sql(base, asked, 12, 24)) == want and rows(K.knn_sql(base, asked, 12, None)) == want
    assert {r["vec_id"] for r in K.knn(base, asked, 3).filter("qid = 3").collect()} == {3, 100, 101}


def test_more_neighbours_than_rows_and_none(spark, base, asked):
    few = base.filter("vec_id < 3")
    assert rows(K.knn(few, asked, 10)) == exact(X[:3], QUERIES, 10)
    assert K.knn(base.limit(0), asked, 5).count() == 0 and K.knn(base, asked.limit(0), 5).count() == 0


def test_large_query_sets_go_in_blocks(spark, base, asked, monkeypatch):
    monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(K, "BLOCK", 3)
    monkeypatch.setattr(K, "SHARD", 64)
    assert rows(K.knn(base, asked, 9)) == exact(X, QUERIES, 9)
    assert rows(K.knn_sql(base, asked, 9, 24)) == exact(X, QUERIES, 9)
    assert K.pairs(base, asked).count() == len(X) * len(QUERIES)
    for metric, best in (("l2_via_ip", 0), ("ip", 1), ("ip_distance", 1)):
        got = rows(K.knn_products(base, asked, 9, metric))
        if best:
            order = lambda q: np.lexsort((np.arange(len(X)), np.round(-(X.astype(float) @ np.asarray(q, float)), 9)))[:9]
            assert got == sorted((q[0], r + 1, int(i)) for q in QUERIES for r, i in enumerate(order(q[1])))
        else:
            assert got == exact(X, QUERIES, 9)
    tau = K.seed_tau(base, asked, 9, F.col("vec_id") % 3 == 0)
    assert rows(K.knn(base, asked, 9, dco.paa_kernel(24, 6), tau)) == exact(X, QUERIES, 9)


def test_lossless_pruning_is_exact(spark, base, asked):
    tau = K.seed_tau(base, asked, 10, F.col("vec_id") % 4 == 0)
    axes = linear.principal_axes(base)[1]
    for kernel in (dco.paa_kernel(24, 6), dco.Incremental(transforms.haar_matrix(24), 5), dco.Incremental(axes, 8)):
        assert rows(K.knn(base, asked, 10, kernel, tau)) == exact(X, QUERIES, 10)
        assert rows(K.knn(base, asked, 10, kernel)) == exact(X, QUERIES, 10)


def test_few_vectors_are_judged_alike(monkeypatch):
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(5, 24)), rng.normal(size=(60, 24))
    tau = np.quantile(((x[None] - q[:, None]) ** 2).sum(axis=2), 0.3, axis=1)
    for operator in (dco.Incremental(None, 5), dco.Incremental(transforms.random_rotation(24), 8, 1.0), dco.Incremental(None, 24), dco.Incremental(None, 7, amplify=np.linspace(3, 1, 24))):
        few = operator.judge(q, operator.project(x), tau)
        monkeypatch.setattr(dco, "FEW", 0)
        many = operator.judge(q, operator.project(x), tau)
        monkeypatch.undo()
        assert (few[0] == many[0]).all() and np.allclose(few[1], many[1]) and (few[2] == many[2]).all()


def test_lossy_pruning_has_recall(spark, base, asked):
    truth = K.knn(base, asked, 10)
    for kernel in (dco.Incremental(transforms.random_rotation(24), 8, 2.1), dco.lsh_kernel(transforms.gaussian_projection(24, 12)), dco.Codes(linear.codebook(base, 6, 16, 5), epsilon=1.2)):
        got = metrics.recall(K.knn(base, asked, 10, kernel), truth, 10).agg(F.avg("recall")).first()[0]
        assert got >= 0.9


def test_range_truth_and_store(spark, base, asked):
    d = {(q, i): float(((X[i].astype(float) - v.astype(float)) ** 2).sum()) for q, v in QUERIES for i in range(len(X))}
    assert {(r["qid"], r["vec_id"]) for r in K.within(base, asked, 5.0, 24).collect()} == {k for k, v in d.items() if v < 5.0}
    truth = {r["qid"]: r["neighbours"] for r in K.ground_truth(base, asked, 7).collect()}
    assert sorted((q, r + 1, i) for q, n in truth.items() for r, i in enumerate(n)) == exact(X, QUERIES, 7)
    store = K.VectorStore(base)
    ids = spark.createDataFrame([(3,), (100,)], "vec_id long")
    hidden = store.mark_deleted(ids)
    left = [i for i in range(len(X)) if i not in (3, 100)]
    assert rows(hidden.search(asked, 5)) == exact(X[left], QUERIES, 5, left)
    assert rows(hidden.unmark_deleted(ids).search(asked, 5)) == exact(X, QUERIES, 5)
    assert rows(store.remove(ids).search(asked, 5)) == exact(X[left], QUERIES, 5, left)
    changed = X.copy()
    changed[5] = X[0]
    assert rows(store.add(frame(spark, X[:1], [5])).search(asked, 5)) == exact(changed, QUERIES, 5)
    assert np.allclose(store.get(9), X[9])
    for wrong in (lambda: hidden.mark_deleted(ids), lambda: store.unmark_deleted(ids)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        store.mark_deleted(spark.createDataFrame([(9999,)], "vec_id long"))
    with pytest.raises(KeyError):
        hidden.get(3)


def test_inverted_lists(spark, base, asked, monkeypatch):
    centres = linear.kmeans(base, 7, 6)
    centres = np.vstack([centres, np.full((1, 24), 1e6)])
    filed = ivf.assign(base, centres).cache()
    cell = {r["vec_id"]: r["cell"] for r in filed.collect()}
    assert all(cell[i] == ((centres - X[i]) ** 2).sum(1).argmin() for i in range(len(X)))
    sizes = {r["cell"]: r["n"] for r in ivf.list_sizes(filed, 8).collect()}
    assert sizes[7] == 0 and sum(sizes.values()) == len(X)
    assert [r["start"] for r in ivf.list_offsets(filed, 8).orderBy("cell").collect()] == np.cumsum([0, *[sizes[c] for c in range(7)]]).tolist()
    assert rows(ivf.search(filed, asked, centres, 8, 9)) == exact(X, QUERIES, 9) == rows(ivf.search_sql(filed, asked, centres, 8, 9, 24))
    some = rows(ivf.search_sql(filed, asked, centres, 2, 9, 24))
    assert rows(ivf.search(filed, asked, centres, 2, 9)) == some == rows(ivf.search(filed, asked, centres, 2, 9, dco.Incremental(transforms.haar_matrix(24), 5)))
    monkeypatch.setattr(ivf, "SHARD", 10)
    assert rows(ivf.search(filed, asked, centres, 2, 9)) == some
    assert (ivf.centroids_of(ivf.centroid_frame(spark, centres)) == centres).all()
    with pytest.raises(ValueError):
        ivf.centroids_of(ivf.centroid_frame(spark, centres).filter("cell <> 2"))


def test_principal_axes_and_codes(spark, base):
    x = X.astype(np.float64)
    values, axes = linear.principal_axes(base)
    assert np.allclose(values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]) and np.allclose(axes.T @ axes, np.eye(24), atol=1e-9)
    _, plain = linear.principal_axes(base, centred=False)
    assert np.allclose(np.abs(plain.T @ np.linalg.svd(x)[2].T), np.eye(24), atol=1e-5)
    assert abs(linear.spectrum(base).agg(F.sum("value")).first()[0] - 1) < 1e-9
    book = linear.codebook(base, 5, 8, 4)
    assert book.shape == (5, 8, 5) and (book == linear.codebook(base, 5, 8, 4)).all()
    error = lambda b, r=None: sum(np.min(((linear._split(x if r is None else x @ r, 5)[:, m, None] - b[m][None]) ** 2).sum(-1), 1).sum() for m in range(5))
    assert error(book) < error(linear.codebook(base, 5, 8, 0))
    rotation, turned = linear.optimised_codebook(base, 5, 8, 2, 4)
    assert np.allclose(rotation.T @ rotation, np.eye(24), atol=1e-9) and error(turned, rotation) < error(book)
    codes = {r["vec_id"]: r["codes"] for r in linear.encode(base, book).collect()}
    parts = linear._split(x, 5)
    assert all(codes[i] == [int(((book[m] - parts[i, m]) ** 2).sum(1).argmin()) for m in range(5)] for i in range(0, len(X), 17))
    assert linear.codebook(base.filter("vec_id < 3"), 2, 6, 2).shape == (2, 6, 12)


def test_metrics(spark, base, asked, monkeypatch):
    found = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 9)], "qid long, rank int, vec_id long")
    truth = spark.createDataFrame([(1, 1, 6), (1, 2, 7), (2, 1, 9), (2, 2, 8), (3, 1, 1)], "qid long, rank int, vec_id long")
    assert {r["qid"]: (r["hits"], r["recall"]) for r in metrics.recall(found, truth, 2).collect()} == {1: (1, 0.5), 2: (1, 0.5), 3: (0, 0.0)}
    judged = spark.createDataFrame([("m", True, 4, 3.0, 2.0), ("m", True, 4, 1.0, 2.0), ("m", False, 8, 1.0, 2.0), ("m", False, 8, 5.0, 2.0)], "method string, pruned boolean, dims int, dist double, tau double")
    r = metrics.prune_summary(judged, 8).first()
    assert (r["pairs"], r["vector_pruned_pct"], r["dims_pruned_pct"], r["false_negative_pct"]) == (4, 50.0, 25.0, 25.0)
    ratios = spark.createDataFrame([("m", float(i)) for i in range(10)] + [("m", None)], "method string, ratio double")
    assert tuple(metrics.ratio_at(ratios, ["method"]).first())[1:] == (8.0, 9.0)
    assert metrics.ratio_quantiles(ratios, ["method"]).first()["p50"] == 4.5
    e = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)], "est double, true double")
    assert [x[0] for x in e.select(metrics.approximation_ratio(F.col("est"), F.col("true"))).collect()] == [1.0, None, 0.5]
    rng = np.random.default_rng(0)
    plane = np.hstack([rng.uniform(size=(1500, 3)), np.zeros((1500, 5))])
    v = frame(spark, plane)
    near = K.nearest(K.knn(v, K.as_queries(v.filter("vec_id % 10 = 0")), 51).filter("qid <> vec_id").drop("rank"), 50)
    lid = metrics.intrinsic_dimension(near, 50).first()["lid"]
    assert 2.3 < lid < 3.5 and abs(metrics.intrinsic_dimension(near, 50, squared=True).first()["lid"] - lid / 2) < 1e-9
    share = metrics.prefix_ratios(spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],), ([0.0, 0.0],)], "prefix array<double>"))
    assert {r["dims"]: r["mean_ratio"] for r in share.collect()} == {1: 0.625, 2: 1.0}
    d = np.cumsum((X[[q[0] for q in QUERIES]].astype(float)[:, None] - X[None].astype(float)) ** 2, axis=2).reshape(-1, 24)
    d = d[d[:, -1] > 0]
    want = (d / d[:, -1:]).mean(axis=0)
    for most in (1 << 20, 0):
        monkeypatch.setattr(metrics, "BROADCAST_BYTES", most)
        assert np.allclose([r["mean_ratio"] for r in metrics.mean_prefix_ratio(base, asked).orderBy("dims").collect()], want)
    runs = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.25)], "method string, setting int, recall double")
    assert {r["method"]: r["relative"] for r in metrics.relative_accuracy(runs, "a").collect()} == {"a": 1.0, "b": 0.5}


def test_planner_raises_the_effort_until_the_recall_is_met(spark, base, asked):
    truth = K.knn(base, asked, 5)
    for plan in (planner.Plan("ivf", cells=12, nprobe=1), planner.Plan("hnsw", ef=1)):
        found, used = planner.search(plan, base, asked, 5, 0.95)
        assert metrics.recall(found, truth, 5).agg(F.avg("recall")).first()[0] >= 0.95 and (used.nprobe, used.ef) >= (plan.nprobe, plan.ef)


def test_shards_stream_their_queries(spark):
    """Every shard meets every query once, in blocks; shards without rows or queries are passed over."""
    base = spark.range(50).selectExpr("cast(id % 5 * 2 as int) as shard", "id", "array(double(id)) as v")
    asked = spark.range(100, 123).selectExpr("id", "array(1.0D) as v", "cast(id as string) as note")

    def answer(held, block):
        assert len(block.ids) <= 4 and block.column("note").to_pylist() == [str(i) for i in block.ids]
        return pa.RecordBatch.from_pydict({"q": block.ids, "n": [len(held.ids)] * len(block.ids), "s": [float(held.matrix.sum())] * len(block.ids)})

    got = through_shards(base, asked, 11, 4, lambda rows: rows, answer, "q long, n long, s double").collect()
    assert len(got) == 23 * 5 and {r["n"] for r in got} == {10}
    assert sum(r["s"] for r in got) == 23 * sum(range(50))


def test_planner(spark, base, asked):
    assert planner.choose(10**9, 1000).method == "exact" and planner.choose(100, 5, 0.9).method == "exact"
    assert planner.choose(10**9, 1000, 0.95).method == "ivf" and planner.choose(10**7, 10**7, 0.9).method == "hnsw"
    want = exact(X, QUERIES, 5)
    assert rows(planner.run(planner.Plan("exact"), base, asked, 5)) == want
    assert rows(planner.run(planner.Plan("ivf", cells=6, nprobe=6), base, asked, 5)) == want
    assert rows(planner.run(planner.Plan("hnsw", ef=400), base, asked, 5)) == want
    with pytest.raises(ValueError):
        planner.run(planner.Plan("other"), base, asked, 5)
