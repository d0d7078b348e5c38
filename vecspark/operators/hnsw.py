"""Sharded navigable small-world graphs.

Vectors are dealt to shards by a hash of their id; each shard is an independent graph, built
and searched by one task, and shard results are merged. The index is a DataFrame with one
row per vector: ``shard, vec_id, embedding, links`` (``links[l]``: neighbours on level l).
Levels come from a hash of the id and vectors enter in id order, so a build is a pure
function of its input, whatever is recomputed.

One search kernel serves every strategy. It is parameterised by an estimator (which
rejects neighbours before their distance is known), by two thresholds (rejected neighbours
still steer the walk by their estimates), and by expanding only the best few neighbours
of a poor node.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions.dco import Estimator
from vecspark.functions.transforms import lists_of, matrix_of
from vecspark.operators.blocks import Block, through_shards
from vecspark.operators.knn import BLOCK, nearest

SHARD_SIZE = 100_000
#: Nodes of a shard up to which queries walk it side by side, and cells (queries x nodes) of one such group.
SIDE_BY_SIDE, CELLS = 8192, 1 << 21
_INDEX = "shard int, vec_id long, embedding array<{}>, links array<array<bigint>>"
_FOUND = "qid long, vec_id long, dist double, full long, approx long, total long, dims long"


@dataclass(frozen=True)
class Build:
    """``m`` links a node (twice that on level 0), ``width`` of the beam while building."""

    m: int = 16
    width: int = 200
    seed: int = 100


@dataclass(frozen=True)
class Search:
    """Beam width, and the optional strategies."""

    ef: int = 64
    two_thresholds: bool = False
    expand: int | None = None
    poor: float = 0.95


def _level(vec_id: int, build: Build) -> int:
    """Geometric level of a node, from its id."""
    x = (vec_id * 0x9E3779B97F4A7C15 + build.seed * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & 0xFFFFFFFFFFFFFFFF
    u = ((x ^ (x >> 31)) + 1) / 2.0**64
    return int(-math.log(u) / math.log(max(2, build.m)))


class Graph:
    """One shard's graph over vectors in id order; nodes are positions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, vectors
        self.links: list[list[np.ndarray]] = []
        #: While building: links of level 0 that stay, one to every node, forming a tree from the first.
        self.kept: list[list[int]] = []
        self.entry, self.top = -1, -1
        self._padded: dict[int, np.ndarray] = {}

    def distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = self.x[nodes] - q
        return np.einsum("ij,ij->i", d, d)

    def descend(self, q: np.ndarray, down_to: int) -> tuple[float, int]:
        """The locally nearest node above level ``down_to``."""
        at = self.entry
        best = float(self.distances(q, np.array([at]))[0])
        for level in range(self.top, down_to, -1):
            while len(near := self.links[at][level]):
                d = self.distances(q, near)
                i = int(np.lexsort((near, d))[0])
                if (float(d[i]), int(near[i])) >= (best, at):
                    break
                best, at = float(d[i]), int(near[i])
        return best, at

    def padded(self, level: int) -> np.ndarray:
        """The links of one level as a matrix; places without a link hold the number of nodes."""
        if level not in self._padded:
            near = [own[level] if len(own) > level else own[0][:0] for own in self.links]
            sizes = np.array([len(x) for x in near], np.int64)
            out = np.full((len(near), max(1, int(sizes.max(initial=0)))), len(near), np.int64)
            out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(near) if len(near) else 0
            self._padded[level] = out
        return self._padded[level]

    def descend_all(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``descend`` to level 0 for many queries at once."""
        n, at = len(self.ids), np.full(len(points), self.entry)
        best = self.distances(points, at)
        for level in range(self.top, 0, -1):
            links, go = self.padded(level), np.arange(len(points))
            while len(go):
                near = links[at[go]]
                i, j = np.nonzero(near < n)
                d = np.full(near.shape, np.inf)
                d[i, j] = self.distances(points[go[i]], near[i, j])
                least = d.min(axis=1)
                node = np.where(d == least[:, None], near, n).min(axis=1)
                moves = (least < best[go]) | (least == best[go]) & (node < at[go])
                go = go[moves]
                best[go], at[go] = least[moves], node[moves]
        return best, at

    def beam(self, q: np.ndarray, start: tuple[float, int], width: int, level: int, seen: np.ndarray, epoch: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes met on one level, nearest first."""
        open_, kept = [start], [(-start[0], -start[1])]
        seen[start[1]] = epoch
        while open_:
            d, at = heapq.heappop(open_)
            if d > -kept[0][0] and len(kept) >= width:
                break
            near = self.links[at][level]
            near = near[seen[near] != epoch]
            if not len(near):
                continue
            seen[near] = epoch
            for dn, n in zip(self.distances(q, near).tolist(), near.tolist(), strict=True):
                if len(kept) < width or dn < -kept[0][0]:
                    heapq.heappush(open_, (dn, n))
                    heapq.heappush(kept, (-dn, -n))
                    if len(kept) > width:
                        heapq.heappop(kept)
        return sorted((-d, -n) for d, n in kept)

    def spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates, nearest first, those closer to the centre than to any one chosen before.

        Free places go to the nearest of the rest, so that copies of a vector stay linked.
        """
        if len(near) < most:
            return [n for _, n in near]
        nodes = np.array([n for _, n in near])
        between = None
        if len(nodes) <= 64:
            apart = self.x[nodes] - self.x[nodes][:, None]
            between = np.einsum("ijk,ijk->ij", apart, apart)
        chosen: list[int] = []
        rest: list[int] = []
        least = np.full(len(nodes), np.inf)
        for i, (d, n) in enumerate(near):
            if not chosen or least[i] > d:
                chosen.append(n)
                if len(chosen) == most:
                    break
                least = np.minimum(least, between[i] if between is not None else self.distances(self.x[n], nodes))
            else:
                rest.append(n)
        return chosen + rest[: most - len(chosen)]

    def build(self, build: Build) -> Graph:
        self._enter(0, build)
        return self

    def extend(self, ids: np.ndarray, vectors: np.ndarray, build: Build) -> None:
        """Adds nodes, in the order given, to a graph whose kept links are known."""
        first = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.x = np.concatenate([self.x, vectors]) if first else np.array(vectors)
        self._enter(first, build)

    def move(self, node: int, vector: np.ndarray, build: Build) -> None:
        """Gives a node another vector: its neighbours choose their links again among theirs and its own, then it is linked anew."""
        self.x[node] = vector
        if len(self.ids) < 2:
            return
        for level, near in enumerate(self.links[node]):
            most = 2 * build.m if level == 0 else build.m
            for other in near.tolist():
                pool = np.unique(np.concatenate([self.links[other][level], near]))
                self._choose(other, pool[pool != other], level, most)
        top = len(self.links[node]) - 1
        for level in range(top, -1, -1):
            seen = np.zeros(len(self.ids), np.int64)
            start = self.descend(vector, level)
            found = [x for x in self.beam(vector, start, max(build.width, build.m) + 1, level, seen, 1) if x[1] != node]
            old, self.links[node][level] = self.links[node][level], np.zeros(0, np.int64)
            own = self.kept[node] if level == 0 else []
            chosen = list(dict.fromkeys([*own, *self.spread(found, build.m)]))[: 2 * build.m if level == 0 else build.m]
            self.links[node][level] = np.array(chosen, np.int64) if chosen else old
            for other in chosen:
                if node not in self.links[other][level]:
                    self._choose(other, np.append(self.links[other][level], node), level, 2 * build.m if level == 0 else build.m)

    def _enter(self, first: int, build: Build) -> None:
        seen, epoch = np.zeros(len(self.ids), np.int64), 0
        for node in range(first, len(self.ids)):
            level = _level(int(self.ids[node]), build)
            self.links.append([np.zeros(0, np.int64) for _ in range(level + 1)])
            self.kept.append([])
            if node:
                q = self.x[node]
                start = self.descend(q, min(level, self.top))
                for at in range(min(level, self.top), -1, -1):
                    epoch += 1
                    near = self.beam(q, start, max(build.width, build.m), at, seen, epoch)
                    start = near[0]
                    self._connect(node, self.spread(near, build.m), at, build)
            if level > self.top:
                self.entry, self.top = node, level

    def _choose(self, node: int, near: np.ndarray, level: int, most: int) -> None:
        """Sets a node's links to the best of some; on level 0 kept ones stay."""
        if len(near) > most:
            d = self.distances(self.x[node], near)
            have = self.spread(sorted(zip(d.tolist(), near.tolist(), strict=True)), most)
            if level == 0 and (lost := [n for n in self.kept[node] if n not in have]):
                give = [n for n in have if n not in self.kept[node]][-len(lost) :]
                have = [n for n in have if n not in give] + lost
            near = np.array(have, np.int64)
        self.links[node][level] = near

    def _connect(self, node: int, chosen: list[int], level: int, build: Build) -> None:
        most = 2 * build.m if level == 0 else build.m
        self.links[node][level] = np.array(chosen, np.int64)
        parent = self._adopt(node, chosen, most) if level == 0 else node
        for other in [*chosen, *([parent] if parent != node and parent not in chosen else [])]:
            self._choose(other, np.append(self.links[other][level], node), level, most)

    def _adopt(self, node: int, chosen: list[int], most: int) -> int:
        """A node whose link to this one stays: the first chosen with room, or else the next below them."""
        queue = list(chosen)
        for parent in queue:
            if len(self.kept[parent]) < most:
                break
            queue += self.kept[parent]
        self.kept[parent].append(node)
        if node == 1:
            self.kept[1].append(0)
        return parent

    @staticmethod
    def of(ids: np.ndarray, vectors: np.ndarray, links: pa.ChunkedArray) -> Graph:
        """A stored graph, ids rising; links to ids that are gone are dropped."""
        g = Graph(ids, vectors)
        levels = links.combine_chunks()
        near = levels.flatten()
        of_node, of_level = (x.offsets.to_numpy() - x.offsets[0].as_py() if len(x) else np.zeros(1, np.int64) for x in (levels, near))
        wanted = near.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        known = ids[at] == wanted if len(wanted) else np.zeros(0, bool)
        pieces = np.split(at[known], np.concatenate(([0], np.cumsum(known)))[of_level[1:-1]]) if len(near) else []
        g.links = [pieces[a:b] for a, b in zip(of_node[:-1].tolist(), of_node[1:].tolist(), strict=True)]
        heights = np.array([len(n) for n in g.links])
        if len(heights):
            g.entry, g.top = int(heights.argmax()), int(heights.max()) - 1
        return g

    def protect(self) -> Graph:
        """Finds the kept links of a stored graph: a tree over level 0 from a node that reaches all, or nearly."""
        n = len(self.ids)
        best, parent = 0, np.full(n, -1)
        for root in range(min(n, 8)):
            up, queue = np.full(n, -1), [root]
            up[root] = root
            for at in queue:
                near = self.links[at][0]
                new = near[up[near] < 0]
                up[new] = at
                queue += new.tolist()
            if len(queue) > best:
                best, parent = len(queue), np.where(up == np.arange(n), -1, up)
            if best == n:
                break
        inbound = {}
        lone = {int(x) for x in np.flatnonzero(parent < 0)}
        for at in range(n):
            for other in self.links[at][0].tolist():
                if other in lone:
                    inbound.setdefault(other, at)
        self.kept = [[] for _ in range(n)]
        for node in range(n):
            up = int(parent[node]) if parent[node] >= 0 else inbound.get(node)
            if up is not None:
                self.kept[up].append(node)
        return self


class _Counters:
    def __init__(self) -> None:
        self.full = self.approx = self.total = self.dims = 0


def walk(g: Graph, q: np.ndarray, k: int, how: Search, judge=None, edges=None, deleted: np.ndarray | None = None) -> tuple[list[tuple[float, int]], _Counters]:
    """The k nearest live nodes that the beam meets.

    ``judge(nodes, tau)`` gives (pruned, estimate, dims) of base vectors; ``edges(node, near,
    dist, tau)`` the same of one node's neighbours. A tombstoned node is walked through and
    never returned. A query's own duplicate at distance 0 is an answer like any other.
    """
    ef, count, width = max(how.ef, k), _Counters(), g.x.shape[1]
    dead = deleted if deleted is not None else np.zeros(len(g.ids), bool)
    start = g.descend(q, 0)
    seen = np.zeros(len(g.ids), bool)
    seen[start[1]] = True
    open_: list[tuple[float, int, bool]] = [(*start, True)]
    result: list[tuple[float, int]] = []
    answers: list[tuple[float, int]] = []
    count.full = count.total = 1
    count.dims = width

    def keep(heap: list, most: int, d: float, n: int) -> None:
        heapq.heappush(heap, (-d, -n))
        if len(heap) > most:
            heapq.heappop(heap)

    if not dead[start[1]]:
        keep(result, ef, *start)
        keep(answers, k, *start)
    while open_:
        key, at, exact = heapq.heappop(open_)
        if len(result) >= ef and key > -result[0][0]:
            break
        near = g.links[at][0]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        governing, most = (answers, k) if how.two_thresholds else (result, ef)
        tau = -governing[0][0] if len(governing) >= most else math.inf
        count.total += len(near)
        hints: list[tuple[float, int]] = []
        judged = None
        if tau < math.inf:
            if edges is not None and exact:
                judged = edges(at, near, key, tau)
            elif judge is not None:
                judged = judge(near, tau)
        if judged is not None:
            pruned, est, used = judged
            count.approx += len(near)
            count.dims += int(used[pruned].sum())
            if how.two_thresholds:
                hints = list(zip(est[pruned].tolist(), near[pruned].tolist(), strict=True))
            kept, est = near[~pruned], est[~pruned]
            if how.expand is not None and key >= how.poor * tau:
                kept = kept[np.argsort(est, kind="stable")[: how.expand]]
            near = kept
        count.full += len(near)
        count.dims += len(near) * width
        for d, n in zip(g.distances(q, near).tolist(), near.tolist(), strict=True):
            if len(result) < ef or d < -result[0][0] or (len(governing) < most or d < -governing[0][0]):
                heapq.heappush(open_, (d, n, True))
                if not dead[n]:
                    keep(result, ef, d, n)
                    keep(answers, k, d, n)
        for d, n in hints:
            if len(result) < ef or d < -result[0][0]:
                heapq.heappush(open_, (d, n, False))
                if not dead[n]:
                    keep(result, ef, d, n)
    pool = answers if how.two_thresholds else result
    return sorted((-d, -n) for d, n in pool)[:k], count


def walk_all(g: Graph, points: np.ndarray, k: int, ef: int, estimator: Estimator | None = None, tables: np.ndarray | None = None, sketched: np.ndarray | None = None, deleted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``walk`` by a plain beam for many queries at once: in each step every open one expands its nearest node.

    Returns distances and nodes (queries x k; infinite where there are fewer) and the counters
    ``full, approx, total, dims`` of each query. The same nodes are met, judged against the
    same thresholds and counted; only nodes as far as the beam's last may differ.
    """
    n, width, ef, m = len(g.ids), g.x.shape[1], max(ef, k), len(points)
    links, far = g.padded(0), np.inf
    out_d, out_n, out_c = np.full((m, k), far), np.zeros((m, k), np.int64), np.zeros((m, 4), np.int64)
    rows, counts = np.arange(m), np.zeros((m, 4), np.int64)
    start, at = g.descend_all(points)
    counts[:] = (1, 0, 1, width)
    seen = np.zeros((m, n + 1), bool)
    seen[rows, at] = seen[:, n] = True
    open_, found = np.full((m, n), far), np.full((m, n), far)
    open_[rows, at] = start
    live = np.ones(n, bool) if deleted is None else ~deleted
    found[rows, at] = np.where(live[at], start, far)
    # The beam's distances, of which the largest is the threshold; none while it has room for all nodes.
    beam, worst = (np.full((m, ef), far) if ef < n else None), np.full(m, far)
    if beam is not None:
        beam[:, 0] = found[rows, at]
        worst = beam.max(axis=1)

    def add(r: np.ndarray, column: int, amount: np.ndarray | None = None) -> None:
        counts[:, column] += np.bincount(r, amount, len(counts)).astype(np.int64)

    def settle(done: np.ndarray) -> None:
        order = np.argsort(found[done], axis=1, kind="stable")[:, :k]
        out_n[rows[done], : order.shape[1]] = order
        out_d[rows[done], : order.shape[1]] = np.take_along_axis(found[done], order, axis=1)
        out_c[rows[done]] = counts[done]

    while len(rows):
        at = open_.argmin(axis=1)
        key = open_[np.arange(len(rows)), at]
        going = (key < far) & (key <= worst)
        go = np.flatnonzero(going)
        if 2 * len(go) < len(rows) or not len(go):
            settle(~going)
            rows, at, points, counts, seen, open_, found, worst = (x[go] for x in (rows, at, points, counts, seen, open_, found, worst))
            beam, tables = (x if x is None else x[go] for x in (beam, tables))
            go = np.arange(len(rows))
        open_[go, at[go]] = far
        near = links[at[go]]
        i, j = np.nonzero(~seen[go[:, None], near])
        if not len(i):
            continue
        r, node = go[i], near[i, j]
        seen[r, node] = True
        add(r, 2)
        if estimator is not None and (judged := worst[r] < far).any():
            own, there = r[judged], node[judged]
            pruned, _, used = estimator.judge_rows(tables[own], sketched[there], worst[own])
            add(own, 1)
            add(own[pruned], 3, used[pruned])
            stay = ~judged
            stay[judged] = ~pruned
            r, node = r[stay], node[stay]
        add(r, 0)
        add(r, 3, np.full(len(r), width))
        d = g.distances(points[r], node)
        closer = d < worst[r]
        r, node, d = r[closer], node[closer], d[closer]
        open_[r, node] = d
        r, node, d = (x[live[node]] for x in (r, node, d))
        found[r, node] = d
        if beam is not None and len(r):
            own, first, size = np.unique(r, return_index=True, return_counts=True)
            both = np.full((len(own), ef + size.max()), far)
            both[:, :ef] = beam[own]
            both[np.repeat(np.arange(len(own)), size), ef + np.arange(len(r)) - np.repeat(first, size)] = d
            both.partition(ef - 1, axis=1)
            beam[own], worst[own] = both[:, :ef], both[:, ef - 1]
    return out_d, out_n, out_c


def build(vectors: DataFrame, how: Build = Build(), shards: int | None = None) -> DataFrame:
    """The index of all vectors, in shards of about ``SHARD_SIZE``."""
    shards = shards or max(1, -(-vectors.count() // SHARD_SIZE))
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()

    def run(key, table):
        table = table.sort_by("vec_id")
        ids = table.column("vec_id").to_numpy()
        g = Graph(ids, matrix_of(table.column("embedding"))).build(how)
        links = [[ids[near].tolist() for near in levels] for levels in g.links]
        return pa.table({"shard": table.column("shard"), "vec_id": table.column("vec_id"), "embedding": table.column("embedding"), "links": pa.array(links, pa.list_(pa.list_(pa.int64())))})

    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "embedding")
    # A stated number of partitions, as small shards would otherwise be coalesced into one long task.
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(run, _INDEX.format(kind))


def shard_count(index: DataFrame) -> int:
    """Shards of an index (the number of the highest, and one)."""
    return int(index.agg(F.max("shard")).first()[0] or 0) + 1


def insert(index: DataFrame, more: DataFrame, how: Build = Build(), shards: int | None = None) -> DataFrame:
    """The index with vectors added or replaced, each by walks through its shard's graph; other shards are not touched.

    Of ids in ``more``, each once, known ones get their new vectors and their links are
    repaired; new ones enter in order of their ids. ``shards``: their number where known,
    which saves a pass over the index.
    """
    shards = shards or shard_count(index)
    kind = index.schema["embedding"].dataType
    news = more.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", F.col("embedding").cast(kind).alias("embedding"))
    touched = news.select("shard").distinct()
    old = index.select("shard", "vec_id", "embedding", "links").join(touched, "shard", "left_semi")

    def run(key, have, new):
        have, new = have.sort_by("vec_id"), new.sort_by("vec_id")
        x = np.array(matrix_of(new.column("embedding")))
        ids = new.column("vec_id").to_numpy()
        g = Graph(np.zeros(0, np.int64), np.zeros((0, x.shape[1])))
        if have.num_rows:
            g = Graph.of(have.column("vec_id").to_numpy(), np.array(matrix_of(have.column("embedding"))), have.column("links")).protect()
        known = np.isin(ids, g.ids)
        for i in np.flatnonzero(known).tolist():
            g.move(int(np.searchsorted(g.ids, ids[i])), x[i], how)
        if not known.all():
            g.extend(ids[~known], x[~known], how)
        n = len(g.ids)
        links = [[g.ids[near].tolist() for near in levels] for levels in g.links]
        vectors = lists_of(g.x, new.schema.field("embedding").type.value_type)
        shard = (new if new.num_rows else have).column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard] * n, pa.int32()), "vec_id": pa.array(g.ids, pa.int64()), "embedding": vectors, "links": pa.array(links, pa.list_(pa.list_(pa.int64())))})

    both = (frame.repartition(shards, "shard").groupBy("shard") for frame in (old, news))
    done = next(both).cogroup(next(both)).applyInArrow(run, _INDEX.format(kind.elementType.simpleString()))
    return index.select("shard", "vec_id", "embedding", "links").join(touched, "shard", "left_anti").unionByName(done)


def links(index: DataFrame) -> DataFrame:
    """``shard, node, level, neighbour``: the graph as edges."""
    each = index.select("shard", F.col("vec_id").alias("node"), F.posexplode("links").alias("level", "near"))
    return each.select("shard", "node", "level", F.explode("near").alias("neighbour"))


def two_hops(index: DataFrame) -> DataFrame:
    """``node, other``: nodes within two links on level 0, the node itself left out."""
    one = links(index).filter("level = 0").select("node", "neighbour")
    two = one.join(one.select(F.col("node").alias("neighbour"), F.col("neighbour").alias("other")), "neighbour").select("node", "other")
    return one.select("node", F.col("neighbour").alias("other")).unionByName(two).filter("node <> other").distinct()


def integrity(index: DataFrame) -> DataFrame:
    """``problem, node`` rows: links to oneself, to the same node twice, to unknown nodes, and nodes none links to."""
    edge = links(index)
    sizes = index.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    own = edge.filter("node = neighbour").select(F.lit("self link").alias("problem"), "node")
    twice = edge.groupBy("node", "level", "neighbour").count().filter("count > 1").select(F.lit("repeated link").alias("problem"), "node")
    lost = edge.join(index.select(F.col("vec_id").alias("neighbour")), "neighbour", "left_anti").select(F.lit("unknown node").alias("problem"), "node")
    alone = index.join(sizes.filter("n > 1"), "shard").join(edge.filter("level = 0").select(F.col("neighbour").alias("vec_id")), "vec_id", "left_anti").select(F.lit("no inbound link").alias("problem"), F.col("vec_id").alias("node"))
    return own.unionByName(twice).unionByName(lost).unionByName(alone)


def search(index: DataFrame, queries: DataFrame, k: int, how: Search = Search(), estimator: Estimator | None = None, deleted: DataFrame | None = None, finger=None, shards: int | None = None) -> DataFrame:
    """``qid, rank, vec_id, dist`` and the counters ``full, approx, total, dims`` of each query, over all its shards.

    ``deleted``: ids (``vec_id``) that are walked through but not returned. ``finger``: a
    ``Residuals`` basis; its per-edge values are made where the shard is searched. The index
    is exchanged once, whatever the number of queries; these pass each shard in blocks.
    ``shards``: their number where known, which saves a pass over the index.
    """
    names = ("qid", "vec_id", "dist", "full", "approx", "total", "dims")
    side_by_side = finger is None and not how.two_thresholds and how.expand is None
    side = index.select("shard", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "links")
    gone = deleted.select(F.col("vec_id").alias("id")).distinct().withColumn("dead", F.lit(True)) if deleted is not None else None
    side = side.join(gone, "id", "left").withColumn("dead", F.coalesce("dead", F.lit(False))) if gone is not None else side.withColumn("dead", F.lit(False))

    def load(rows: Block):
        rows = Block(rows.table.sort_by("id"))
        g = Graph.of(rows.ids, rows.matrix, rows.column("links"))
        dead = rows.column("dead").to_numpy()
        return g, dead, estimator.project(g.x) if estimator is not None else None, finger.prepare(g) if finger is not None else None

    def answer(held, asked: Block) -> pa.RecordBatch:
        g, dead, sketched, prepared = held
        points = asked.matrix
        tables = estimator.table(points) if estimator is not None else None
        if side_by_side and len(g.ids) <= SIDE_BY_SIDE:
            step = max(1, CELLS // len(g.ids))
            parts = [walk_all(g, points[lo : lo + step], k, how.ef, estimator, tables[lo : lo + step] if tables is not None else None, sketched, dead) for lo in range(0, len(points), step)]
            dist, node, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            counts = np.concatenate([counts[:, None], np.zeros((len(counts), k - 1, 4), np.int64)], axis=1)
            hit = np.isfinite(dist)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(asked.ids, hit.sum(axis=1))), pa.array(g.ids[node[hit]]), pa.array(dist[hit]), *(pa.array(counts[hit][:, i]) for i in range(4))], list(names))
        out: dict[str, list] = {c: [] for c in names}
        for i, qid in enumerate(asked.ids.tolist()):
            judge = (lambda near, tau, i=i: tuple(v[0] for v in estimator.judge(tables[i : i + 1], sketched[near], np.array([tau])))) if estimator is not None else None
            on_edges = finger.judge_for(prepared, points[i]) if finger is not None else None
            hits, c = walk(g, points[i], k, how, judge, on_edges, dead)
            for nth, (d, node) in enumerate(hits):
                counts = (0, 0, 0, 0) if nth else (c.full, c.approx, c.total, c.dims)
                for name, value in zip(out, (qid, int(g.ids[node]), d, *counts), strict=True):
                    out[name].append(value)
        kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    asked = queries.select(F.col("qid").alias("id"), F.col("q").alias("v"))
    found = through_shards(side, asked, shards or shard_count(index), BLOCK, load, answer, _FOUND)
    over = Window.partitionBy("qid")
    found = found.withColumns({c: F.sum(c).over(over) for c in ("full", "approx", "total", "dims")})
    return nearest(found, k).select("qid", F.col("rank").cast("int").alias("rank"), "vec_id", "dist", "full", "approx", "total", "dims")
