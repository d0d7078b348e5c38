"""Small vector tables and plain reference computations."""

import numpy as np

SCHEMA = "vec_id long, embedding array<float>"


def vectors(n=200, dims=24, seed=0):
    """Clustered vectors with duplicates and one zero vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    x = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dims))
    x[n // 2] = x[3]
    x[n // 2 + 1] = x[3]
    x[n // 3] = 0
    return x.astype(np.float32)


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], SCHEMA)


def exact(x, queries, k, ids=None):
    """``(qid, rank, vec_id)`` by definition."""
    x = np.asarray(x, np.float64)
    ids = np.arange(len(x)) if ids is None else np.asarray(ids)
    out = []
    for q in queries:
        d = ((x - np.asarray(q[1], np.float64)) ** 2).sum(axis=1)
        out += [(q[0], r + 1, int(ids[i])) for r, i in enumerate(np.lexsort((ids, d))[:k])]
    return sorted(out)


def rows(found):
    return sorted((r["qid"], r["rank"], r["vec_id"]) for r in found.select("qid", "rank", "vec_id").collect())
