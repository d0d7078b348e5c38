"""Quality and cost of searches: recall, pruning, false negatives, approximation ratios, intrinsic dimension."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions.dco import Estimator
from vecspark.functions.distance import l2sq_block, prefix_l2sq
from vecspark.functions.transforms import matrix_of
from vecspark.operators.knn import BROADCAST_BYTES, _collect, _limits, knn, pairs, query_bytes
from vecspark.operators.linear import _partials


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``qid, hits, recall`` of every query in ``truth``, over its first k neighbours."""
    want = truth.filter(F.col("rank") <= k).select("qid", "vec_id")
    got = found.filter(F.col("rank") <= k).select("qid", "vec_id", F.lit(1).alias("hit")).distinct()
    return want.join(got, ["qid", "vec_id"], "left").groupBy("qid").agg(F.count("hit").alias("hits"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def prune_summary(judged: DataFrame, dims: int) -> DataFrame:
    """Per ``method``: share of vectors pruned, of components saved, and of pruned pairs that were below the threshold.

    ``judged``: ``method, pruned, dims, dist, tau``, ``dist`` being the true distance.
    """
    n = F.count(F.lit(1))
    wrong = F.count_if(F.col("pruned") & (F.col("dist") < F.col("tau")))
    return judged.groupBy("method").agg(
        n.alias("pairs"),
        (100.0 * F.count_if("pruned") / n).alias("vector_pruned_pct"),
        (100.0 * (1 - F.sum("dims") / (n * dims))).alias("dims_pruned_pct"),
        (100.0 * wrong / n).alias("false_negative_pct"),
    )


def kernel_prune_summary(method: str, vectors: DataFrame, queries: DataFrame, k: int, estimator: Estimator) -> DataFrame:
    """``prune_summary`` of one operator over all pairs, judged and added up in the tasks that read the vectors.

    Thresholds are the true k-th distances, found first.
    """
    if query_bytes(queries)[1] > BROADCAST_BYTES:
        raise ValueError("the queries are too many to send to all tasks")
    tau = knn(vectors, queries, k).filter(F.col("rank") == k).select("qid", F.col("dist").alias("tau"))
    table = queries.join(tau, "qid", "left").toArrow()
    q, limit = matrix_of(table.column("q")), _limits(table.column("tau").to_numpy())
    shared = vectors.sparkSession.sparkContext.broadcast((q, estimator.table(q) if len(q) else q, limit, estimator))

    def make(x):
        points, side, tau, judge = shared.value
        if not len(points):
            return {}
        pruned, _, dims = judge.judge(side, judge.project(x), tau)
        near = l2sq_block(points, x) < tau[:, None]
        return {0: (pruned.size, np.array([pruned.sum(), dims.sum(), (pruned & near).sum(), pruned.size * x.shape[1]], float))}

    rows = [(method, int(r["n"]), *(float(v) for v in r["total"])) for r in _partials(vectors, "embedding", make)]
    done = vectors.sparkSession.createDataFrame(rows, "method string, pairs long, pruned double, dims double, wrong double, every double")
    n = F.col("pairs")
    return done.select("method", "pairs", (100.0 * F.col("pruned") / n).alias("vector_pruned_pct"), (100.0 * (1 - F.col("dims") / F.col("every"))).alias("dims_pruned_pct"), (100.0 * F.col("wrong") / n).alias("false_negative_pct"))


def approximation_ratio(est: Column, true: Column) -> Column:
    """Estimate over distance; 1 if both are 0, null if only the distance is."""
    return F.when(true > 0, est / true).when(est == 0, F.lit(1.0))


def ratio_quantiles(ratios: DataFrame, by: list[str], points: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Interpolated quantiles of ``ratio`` in each group, nulls left out."""
    return ratios.groupBy(*by).agg(*(F.percentile("ratio", F.lit(p)).alias(f"p{round(100 * p)}") for p in points))


def ratio_at(ratios: DataFrame, by: list[str], points: tuple[float, ...] = (0.8, 0.9)) -> DataFrame:
    """Quantiles without interpolation: the element at index ``floor(n * p)`` of the sorted ratios.

    The element follows from counts of distinct values, so no group is sorted in one task.
    """
    from pyspark.sql import Window

    counts = ratios.groupBy(*by, "ratio").agg(F.count("ratio").alias("n"))
    run = Window.partitionBy(*by).orderBy("ratio").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return placed.groupBy(*by).agg(*(F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * p), F.col("all") - 1), F.col("ratio"))).alias(f"p{round(100 * p)}") for p in points))


def prefix_ratios(prefixes: DataFrame) -> DataFrame:
    """``dims, mean_ratio``: mean share of the whole distance that the first ``dims`` components hold.

    ``prefixes``: ``prefix``, arrays of running distances; pairs at distance 0 are left out.
    """
    whole = F.element_at("prefix", -1)
    each = prefixes.filter(whole > 0).select(F.posexplode(F.transform("prefix", lambda x: x / whole)).alias("pos", "ratio"))
    return each.groupBy((F.col("pos") + 1).alias("dims")).agg(F.avg("ratio").alias("mean_ratio"))


def mean_prefix_ratio(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``prefix_ratios`` over all pairs of queries and vectors, summed in the tasks that read the vectors."""
    if query_bytes(queries)[1] > BROADCAST_BYTES:
        return prefix_ratios(pairs(vectors, queries).select(prefix_l2sq(F.col("q"), F.col("x")).alias("prefix")))
    asked = _collect(queries)[1]

    def make(x):
        n, total = 0, np.zeros(x.shape[1])
        for q in asked:
            d = np.cumsum((x - q) ** 2, axis=1)
            d = d[d[:, -1] > 0]
            n, total = n + len(d), total + (d / d[:, -1:]).sum(axis=0)
        return {0: (n, total)}

    rows = [(i + 1, float(v / r["n"])) for r in _partials(vectors, "embedding", make) if r["n"] for i, v in enumerate(r["total"])]
    return vectors.sparkSession.createDataFrame(rows, "dims int, mean_ratio double")


def intrinsic_dimension(neighbours: DataFrame, k: int, squared: bool = False) -> DataFrame:
    """``lid``: the maximum-likelihood estimate averaged over queries, from k neighbours each.

    ``neighbours``: ``qid, rank, dist`` (squared distances, the query itself left out). True
    distances enter unless ``squared``, which halves the estimate. Neighbours at distance 0 are skipped.
    """
    d = F.col("dist") if squared else F.sqrt("dist")
    own = neighbours.filter((F.col("rank") <= k) & (F.col("dist") > 0)).withColumn("d", d)
    far = own.groupBy("qid").agg(F.max("d").alias("far"))
    each = own.join(far, "qid").filter("d < far").groupBy("qid").agg((1 / F.avg(F.log(F.col("far") / F.col("d")))).alias("lid"))
    return each.agg(F.avg("lid").alias("lid"), F.count(F.lit(1)).alias("points"))


def relative_accuracy(runs: DataFrame, baseline: str) -> DataFrame:
    """``method, setting, relative``: recall over that of the baseline method at the same setting."""
    base = runs.filter(F.col("method") == baseline).select("setting", F.col("recall").alias("base"))
    return runs.join(base, "setting").select("method", "setting", (F.col("recall") / F.col("base")).alias("relative"))


def run_metrics(counters: DataFrame, dims: int) -> DataFrame:
    """Totals of a search's counters (``full, approx, total, dims`` per query) as pruning percentages."""
    return counters.agg(
        F.count(F.lit(1)).alias("queries"),
        (100.0 * (1 - F.sum("full") / F.sum("total"))).alias("vector_pruned_pct"),
        (100.0 * (1 - F.sum("dims") / (F.sum("total") * dims))).alias("dims_pruned_pct"),
    )
