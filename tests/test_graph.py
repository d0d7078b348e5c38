import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.util import SCHEMA, exact, frame, rows, vectors
from vecspark.functions import dco, transforms
from vecspark.operators import finger, hnsw, linear, metrics
from vecspark.operators.knn import as_queries, knn

X = vectors(300)
QUERIES = [(i, X[i]) for i in (0, 3, 101, 250)]
HOW = hnsw.Build(m=8, width=50)


@pytest.fixture(scope="module")
def base(spark):
    return frame(spark, X).cache()


@pytest.fixture(scope="module")
def asked(base):
    return as_queries(base.filter(F.col("vec_id").isin(*[q[0] for q in QUERIES]))).cache()


@pytest.fixture(scope="module")
def index(base):
    return hnsw.build(base, HOW, 3).cache()


def test_full_width_is_exact(spark, index, asked):
    assert rows(hnsw.search(index, asked, 10, hnsw.Search(ef=400))) == exact(X, QUERIES, 10)
    assert hnsw.search(index, asked.limit(0), 5).count() == 0


def test_builds_agree_and_are_sound(spark, base, index):
    again = {r["vec_id"]: r["links"] for r in hnsw.build(base.repartition(5), HOW, 3).collect()}
    assert again == {r["vec_id"]: r["links"] for r in index.collect()}
    assert hnsw.integrity(index).count() == 0
    degree = hnsw.links(index).groupBy("node", "level").count().groupBy("level").agg(F.max("count")).collect()
    assert all(n <= (16 if level == 0 else 8) for level, n in degree)
    broken = index.withColumn("links", F.when(F.col("vec_id") == 5, F.array(F.array(F.lit(5), F.lit(5), F.lit(10**9)).cast("array<bigint>"))).otherwise(F.col("links")))
    assert {r["problem"] for r in hnsw.integrity(broken).filter("node = 5").collect()} >= {"self link", "repeated link", "unknown node"}


def test_strategies_reach_recall(spark, base, index, asked):
    truth = knn(base, asked, 10)
    axes = linear.principal_axes(base)[1]
    book = linear.codebook(base, 6, 16, 5)
    edges = hnsw.links(index).filter("level = 0").select(F.col("node").alias("src"), F.col("neighbour").alias("dst"))
    cases = {
        "plain": {},
        "plain wide": {"how": hnsw.Search(ef=48)},
        "ads": {"estimator": dco.Incremental(transforms.random_rotation(24), 8, 2.1)},
        "pca": {"estimator": dco.Incremental(axes, 8)},
        "paa": {"estimator": dco.paa_kernel(24, 6)},
        "lsh": {"estimator": dco.lsh_kernel(transforms.gaussian_projection(24, 12))},
        "pq": {"estimator": dco.Codes(book, epsilon=1.2)},
        "ads two": {"estimator": dco.Incremental(transforms.random_rotation(24), 8, 2.1), "how": hnsw.Search(ef=24, two_thresholds=True)},
        "pca two": {"estimator": dco.Incremental(axes, 8, amplify=np.full(24, 1.5)), "how": hnsw.Search(ef=24, two_thresholds=True)},
        "pq few": {"estimator": dco.Codes(book, epsilon=1.2), "how": hnsw.Search(ef=48, expand=4)},
        "finger": {"finger": finger.Residuals(finger.residual_basis(base, edges, 24, 16))},
    }
    plain: dict[int, int] = {}
    for name, more in cases.items():
        how = more.pop("how", hnsw.Search(ef=24))
        found = hnsw.search(index, asked, 10, how, **more).cache()
        recall = metrics.recall(found, truth, 10).agg(F.avg("recall")).first()[0]
        full = found.groupBy("qid", "vec_id").agg(F.max("full").alias("f")).agg(F.sum("f")).first()[0]
        plain.setdefault(how.ef, full)
        assert recall >= 0.9, (name, recall)
        if name not in ("plain", "plain wide", "ads", "ads two", "paa"):
            assert full < plain[how.ef], name
        assert found.filter("qid = vec_id and rank <= 3").count() == len(QUERIES)


def test_tombstones(spark, base, index, asked):
    entry = index.filter("shard = 0").orderBy(F.size("links").desc(), "vec_id").first()["vec_id"]
    gone = {entry, 3, 100, 250}
    left = [i for i in range(len(X)) if i not in gone]
    found = hnsw.search(index, asked, 6, hnsw.Search(ef=400), deleted=spark.createDataFrame([(i,) for i in gone], "vec_id long"))
    assert rows(found) == exact(X[left], QUERIES, 6, left)


def test_inserts_and_small_shards(spark, base, asked):
    some = hnsw.build(base.filter("vec_id < 200"), HOW, 3)
    changed = X.copy()
    changed[7] = X[0]
    more = frame(spark, np.vstack([X[200:], X[:1]]), [*range(200, 300), 7])
    assert rows(hnsw.search(hnsw.insert(some, more, HOW), asked, 8, hnsw.Search(ef=400))) == exact(changed, QUERIES, 8)
    one = hnsw.build(base.filter("vec_id = 0"), HOW, 1)
    assert rows(hnsw.search(one, asked, 4)) == exact(X[:1], QUERIES, 4)
    none = hnsw.build(base.limit(0), HOW, 1)
    assert hnsw.search(none, asked, 4).count() == 0
    assert rows(hnsw.search(hnsw.insert(none, base, HOW), asked, 3, hnsw.Search(ef=400))) == exact(X, QUERIES, 3)


def test_two_hops(spark, index):
    near: dict[int, set[int]] = {}
    for r in hnsw.links(index).filter("level = 0").collect():
        near.setdefault(r["node"], set()).add(r["neighbour"])
    want = {n: (near[n] | set().union(*(near.get(m, set()) for m in near[n]))) - {n} for n in near}
    got: dict[int, set[int]] = {}
    for r in hnsw.two_hops(index).collect():
        got.setdefault(r["node"], set()).add(r["other"])
    assert got == want


def test_residual_estimates(spark, base):
    """With the projection an orthonormal basis and the true angle, the estimate is the distance."""
    x = X.astype(np.float64)
    zero = int(np.flatnonzero((x == 0).all(axis=1))[0])
    edges = spark.createDataFrame([(1, 2), (5, 9), (zero, 4)], "src long, dst long")
    m = transforms.sign_projection(24, 20)
    got = {(r["src"], r["dst"]): r for r in finger.edge_table(base, edges, m).collect()}
    assert got[zero, 4]["b"] == got[zero, 4]["d_res"] == 0.0
    for c, d in ((1, 2), (5, 9)):
        r = got[c, d]
        b = x[c] @ x[d] / (x[c] @ x[c])
        res = x[d] - b * x[c]
        assert np.isclose(r["b"], b) and np.isclose(r["d_res"], np.linalg.norm(res)) and np.isclose(r["c2"], x[c] @ x[c])
        assert r["bits"] == int("".join("1" if v > 0 else "0" for v in res @ m), 2)
        q = x[7]
        t = q @ x[c] / (x[c] @ x[c])
        qres = q - t * x[c]
        angle = np.arccos(np.clip(qres @ res / np.linalg.norm(qres) / np.linalg.norm(res), -1, 1)) / np.pi
        one = spark.range(1).select(finger.estimate(F.lit(float(q @ q)), F.lit(r["c2"]), F.lit(float(((q - x[c]) ** 2).sum())), F.lit(r["b"]), F.lit(r["d_res"]), F.lit(float(angle)))).first()[0]
        assert np.isclose(one, ((q - x[d]) ** 2).sum())
    nodes = {r["node"]: r for r in finger.node_table(base, m, 24).collect()}
    assert np.allclose(nodes[5]["c_p"], x[5] @ m) and np.isclose(nodes[5]["c2"], x[5] @ x[5])


def test_many_copies_of_a_vector_all_have_an_inbound_link(spark):
    x = np.concatenate([X[:60], np.repeat(X[7:8], 120, axis=0), X[60:120]])
    index = hnsw.build(frame(spark, x), HOW, 2).cache()
    assert hnsw.integrity(index).count() == 0
    assert hnsw.links(index).filter("level = 0").groupBy("node").count().agg(F.max("count")).first()[0] <= 2 * HOW.m
    asked = [(7, x[7])]
    assert rows(hnsw.search(index, as_queries(frame(spark, x[7:8], [7])), 121, hnsw.Search(ef=400))) == exact(x, asked, 121)


ESTIMATORS = {
    "none": None,
    "ads_every_component": dco.Incremental(transforms.random_rotation(24), 1, dco.ADS_EPSILON),
    "lossless": dco.Incremental(None, 5),
    "lsh": dco.lsh_kernel(transforms.gaussian_projection(24, 8)),
    "codes": dco.Codes(np.random.default_rng(2).normal(size=(4, 8, 6)), epsilon=1.2),
}


def judge_of(estimator, tables, sketched, i):
    return (lambda near, tau: tuple(v[0] for v in estimator.judge(tables[i : i + 1], sketched[near], np.array([tau])))) if estimator else None


@pytest.mark.parametrize("ef", [10, 40, 2000])
@pytest.mark.parametrize("name", ESTIMATORS)
def test_queries_walk_side_by_side_as_one_by_one(name, ef):
    """The same answers and counters, tombstones included."""
    g, e, dead = hnsw.Graph(np.arange(len(X)), X).build(hnsw.Build(m=6, width=30)), ESTIMATORS[name], np.arange(len(X)) % 7 == 3
    asked = vectors(60, seed=5)
    tables, sketched = (e.table(asked), e.project(g.x)) if e else (None, None)
    dist, node, counts = hnsw.walk_all(g, asked, 10, ef, e, tables, sketched, dead)
    for i, q in enumerate(asked):
        hits, c = hnsw.walk(g, q, 10, hnsw.Search(ef=ef), judge_of(e, tables, sketched, i), None, dead)
        assert [n for _, n in hits] == node[i].tolist()
        assert np.allclose([d for d, _ in hits], dist[i], rtol=1e-12)
        assert (c.full, c.approx, c.total, c.dims) == tuple(counts[i].tolist())


def test_side_by_side_with_few_nodes_and_copies():
    one = hnsw.Graph(np.array([4]), X[:1]).build(hnsw.Build(m=6, width=30))
    dist, node, _ = hnsw.walk_all(one, X[:3], 10, 64)
    assert node[:, 0].tolist() == [0, 0, 0] and np.isinf(dist[:, 1:]).all() and dist[0, 0] == 0
    copies = hnsw.Graph(np.arange(80), np.repeat(X[:2], 40, axis=0)).build(hnsw.Build(m=6, width=30))
    dist, node, _ = hnsw.walk_all(copies, X[:2], 10, 2000)
    assert (dist == 0).all() and node.tolist() == [list(range(10)), list(range(40, 50))]


def test_side_by_side_is_faster_than_one_by_one():
    """``hnsw_ads_keep`` took its time in calls for each node of each query."""
    g, e, asked = hnsw.Graph(np.arange(250), X[:250]).build(hnsw.Build(m=12, width=60)), ESTIMATORS["ads_every_component"], vectors(400, seed=6)
    tables, sketched = e.table(asked), e.project(g.x)
    began = time.process_time()
    hnsw.walk_all(g, asked, 10, 64, e, tables, sketched)
    together, began = time.process_time() - began, time.process_time()
    for i in range(40):
        hnsw.walk(g, asked[i], 10, hnsw.Search(ef=64), judge_of(e, tables, sketched, i))
    assert together / 400 < (time.process_time() - began) / 40 / 3


@pytest.mark.parametrize("n", [20, 64, 90])
def test_links_are_chosen_by_the_plain_rule(n):
    """Distances between candidates come all at once, or a row for each chosen one; the choice is that of single comparisons."""
    x = np.concatenate([X, X[:20]])
    g = hnsw.Graph(np.arange(len(x)), x)
    apart = lambda i, j: float(g.distances(x[i], np.array([j]))[0])
    near = sorted((apart(7, i), i) for i in [*range(n - 10), *range(len(X), len(X) + 10)])
    chosen, rest = [], []
    for d, i in near:
        (chosen if all(apart(i, c) > d for c in chosen) and len(chosen) < 12 else rest).append(i)
    assert g.spread(near, 12) == (chosen + rest)[:12]
