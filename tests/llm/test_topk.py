import math
import random

import numpy as np
from pyspark.sql import functions as F

from vecspark.llm import topk
from vecspark.llm.topk import integer_vectors, search, top_products

VECTORS = "vec_id long, embedding array<float>, label int"


def data(seed=1, n=300, d=20):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 0.3) for _ in range(d)], 0) for i in range(n)]
    out += [(n + i, out[7][1], 0) for i in range(40)]
    return out + [(1000, None, 0), (1050, [float("nan")] * d, 0), (1100, [1.0, None] + [0.0] * (d - 2), 0), (1150, [float("inf")] * d, 0), (1200, [0.0] * d, 0), (None, [1.0] * d, 0), (1250, [0.5, -0.5], 0)]


def brute(rows, k=5, step=50):
    own = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, _ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in own:
        if i % step == 0:
            s = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in own if j != i)[:k]
            out += [(i, r + 1, j, -p) for r, (p, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows):
    v = integer_vectors(spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit(1)).withColumn("score", F.lit("s")))
    return sorted(map(tuple, top_products(v, F.col("vec_id") % 50 == 0).collect()))


def test_matches_brute_force(spark, monkeypatch):
    assert run(spark, data()) == brute(data())
    for name, value in (("SHARD", 40), ("QUERY_BLOCK", 3), ("STRIP", 16), ("DIMENSIONS", 3)):
        monkeypatch.setattr(topk, name, value)
    assert run(spark, data(2)) == brute(data(2))


def test_few_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 0)]) == []
    assert run(spark, [(0, [1.0], 0), (5, [0.5], 0), (4, [0.5], 0)]) == [(0, 1, 4, 32768), (0, 2, 5, 32768)]
    assert run(spark, [(0, [1.0], 0), (0, [1.0], 0), (3, [0.5], 0), (3, [0.5], 0)]) == [(0, 1, 3, 32768), (0, 2, 3, 32768)]


def test_pruning_keeps_every_answer():
    rng = np.random.default_rng(4)
    base = rng.integers(-40, 40, (64, 5000)).astype(float)
    base[:40] *= 4
    q = rng.integers(-40, 40, (64, 30)).astype(float)
    q[:40] *= 4
    found = search(np.full(30, -1), q, np.arange(5000), base, 7)
    exact = q.T @ base
    for i in range(30):
        want = np.lexsort((np.arange(5000), -exact[i]))[:7]
        assert found[i][0].tolist() == want.tolist() and found[i][1].tolist() == exact[i][want].tolist()


def test_large_components_are_exact(spark):
    """Scores beyond what doubles hold are whole numbers, beyond a long its ends."""
    data = [(0, [1e17, 1.0]), (50, [1e17, -3.0]), (1, [2.0, 5.0]), (2, [-1e17, 4.0]), (3, [2.0**40, 2.0**20]), (4, [2.0**41, 3.0])]
    x = {i: [int(c * 256) if abs(c * 256) < 2**53 else int(c * 256.0) for c in v] for i, v in data}
    want = []
    for q in (0, 50):
        scored = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(x[q], x[i], strict=True)))), i) for i in x if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = top_products(integer_vectors(vectors), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(want)
