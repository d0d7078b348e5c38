"""Choice of a search method by the size of the base, and of its effort by the recall that is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators import hnsw, ivf, metrics
from vecspark.operators.knn import knn
from vecspark.operators.linear import kmeans

#: Queries whose recall is measured to set the effort.
SAMPLE = 100


@dataclass(frozen=True)
class Plan:
    method: str
    cells: int = 0
    nprobe: int = 0
    ef: int = 0


def choose(rows: int, queries: int, recall: float = 1.0) -> Plan:
    """Exact for full recall or few comparisons; lists for one-off batches; graphs where queries outnumber a build's cost.

    The effort (``nprobe``, ``ef``) is where ``search`` starts from.
    """
    if recall >= 1.0 or rows * max(1, queries) <= 10**8:
        return Plan("exact")
    cells = max(16, int(rows**0.5))
    if queries * 20 < rows:
        return Plan("ivf", cells=cells, nprobe=max(1, cells // 64))
    return Plan("hnsw", ef=32)


def _searcher(plan: Plan, vectors: DataFrame, k: int) -> tuple[Callable[[DataFrame, Plan], DataFrame], Iterator[Plan]]:
    """The search on an index made once, and plans of growing effort, the last of which is exact or nearly."""
    if plan.method == "ivf":
        centroids = kmeans(vectors, plan.cells)
        filed = ivf.assign(vectors, centroids).cache()

        def more() -> Iterator[Plan]:
            n = plan.nprobe
            while n < plan.cells:
                yield replace(plan, nprobe=n)
                n *= 2
            yield replace(plan, nprobe=plan.cells)

        return lambda q, p: ivf.search(filed, q, centroids, p.nprobe, k), more()
    if plan.method == "hnsw":
        index = hnsw.build(vectors).cache()
        efforts = (replace(plan, ef=max(k, plan.ef) << i) for i in range(8))
        return lambda q, p: hnsw.search(index, q, k, hnsw.Search(ef=p.ef)).select("qid", "rank", "vec_id", "dist"), efforts
    raise ValueError(plan.method)


def search(plan: Plan, vectors: DataFrame, queries: DataFrame, k: int, recall: float = 1.0) -> tuple[DataFrame, Plan]:
    """``qid, rank, vec_id, dist`` by the planned method, and the plan with the effort that was used.

    The effort grows until the recall, measured against exact answers of ``SAMPLE``
    queries (by a hash of their ids), is reached.
    """
    if plan.method == "exact":
        return knn(vectors, queries, k), plan
    ask, efforts = _searcher(plan, vectors, k)
    some = queries.orderBy(F.xxhash64("qid"), "qid").limit(SAMPLE).cache()
    truth = knn(vectors, some, k).cache()
    for effort in efforts:
        got = metrics.recall(ask(some, effort), truth, k).agg(F.avg("recall")).first()[0]
        if got is None or got >= recall:
            break
    return ask(queries, effort), effort


def run(plan: Plan, vectors: DataFrame, queries: DataFrame, k: int, recall: float = 1.0) -> DataFrame:
    """The rows of ``search``."""
    return search(plan, vectors, queries, k, recall)[0]
