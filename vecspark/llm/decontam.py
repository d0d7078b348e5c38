"""Benchmark decontamination by greedy string tiling.

Benchmark items are indexed by the hashes of their ``SEED`` consecutive words. A document
sharing a seed with an item is tiled against it: all shared seeds are found by rolling
Karp-Rabin hashes, runs of seeds on one diagonal are matches, and the longest match that
covers no marked word is marked again and again until none of ``SEED`` words is left. The
share of the item's words under tiles is its coverage, whatever the order of the tiles.

Items are taken in blocks of a bounded number of words, each broadcast; documents are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm import textkit as tk
from vecspark.llm.chunks import bounded, on_batches, slim

SEED = 5
COVERAGE = 0.5
#: Benchmark text held (and broadcast) at once.
BLOCK_BYTES = 8 << 20

_PAIRS = "doc_id long, item_id long, n_words long, n_covered long, n_tiles long, coverage double, tiles array<struct<doc_start:int,item_start:int,length:int>>"
_TILE = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
_PAIRS_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int64()), ("n_covered", pa.int64()), ("n_tiles", pa.int64()), ("coverage", pa.float64()), ("tiles", _TILE)])

#: ASCII letters, digits and all bytes beyond ASCII make up words; the rest separates.
_WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _word_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (case and punctuation ignored), and the first word of each text."""
    buf, offs = tk.text_buffer(pc.utf8_lower(column.cast(pa.large_string())))
    buf = np.where(_WORD_BYTE[buf], buf, np.uint8(32))
    starts, ends, first = tk.words(buf, offs)
    return tk.word_hashes(buf, starts, ends), first


def tile(pairs: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, length) from all pairs of equal seeds (a, b).

    Longest first; ties by the earlier start in a, then in b.
    """
    out: list[tuple[int, int, int]] = []
    pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 0] - pairs[:, 1]))]
    while len(pairs):
        a, b = pairs[:, 0], pairs[:, 1]
        new = np.concatenate(([True], (np.diff(a - b) != 0) | (np.diff(a) != 1)))
        heads = np.flatnonzero(new)
        length = np.diff(np.append(heads, len(a))) + seed - 1
        best = np.lexsort((b[heads], a[heads], -length))[0]
        x, y, n = int(a[heads[best]]), int(b[heads[best]]), int(length[best])
        out.append((x, y, n))
        pairs = pairs[((a + seed <= x) | (a >= x + n)) & ((b + seed <= y) | (b >= y + n))]
    return out


#: Pairs of equal seeds of a document and an item that are held at once.
MOST_PAIRS = 1 << 20


def tile_by_length(a: np.ndarray, b: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """The tiles of ``tile`` from the word hashes themselves, for texts whose equal seeds are too many to list.

    The length of the next tile is found by bisection: the windows of a length in one
    sequence, unmarked, are looked up among those in the other by their rolling hashes.
    """
    out: list[tuple[int, int, int]] = []
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)

    def common(n: int) -> tuple[int, int] | None:
        """The first window of n words that both have."""
        starts = [np.flatnonzero(np.convolve(f, np.ones(n, np.int64), "valid") == n) if len(f) >= n else np.zeros(0, np.int64) for f in (free_a, free_b)]
        if not len(starts[0]) or not len(starts[1]):
            return None
        x, y = (tk.windows(h, n, tk.WINDOW_BASES[0])[s] for h, s in zip((a, b), starts, strict=True))
        known, first = np.unique(y, return_index=True)
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        hit = np.flatnonzero(known[at] == x)
        return (int(starts[0][hit[0]]), int(starts[1][first[at[hit[0]]]])) if len(hit) else None

    top = len(b)
    while (found := common(seed)) is not None:
        lo, hi = seed, top
        while lo < hi:
            n = (lo + hi + 1) // 2
            if (at := common(n)) is not None:
                found, lo = at, n
            else:
                hi = n - 1
        x, y = found
        out.append((x, y, lo))
        free_a[x : x + lo], free_b[y : y + lo], top = False, False, lo
    return out


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None], seed: int):
        self.ids, self.seed = ids, seed
        self.hashes, self.first = _word_hashes(pa.array(texts, pa.large_string()))
        self.sizes = np.diff(self.first)
        seeds, item, at, length = [], [], [], []
        for n in range(1, seed + 1):
            of = np.flatnonzero((self.sizes >= seed) if n == seed else (self.sizes == n))
            rolled = tk.windows(self.hashes, n, tk.WINDOW_BASES[0])
            for i in of.tolist():
                starts = np.arange(self.sizes[i] - n + 1)
                seeds.append(rolled[self.first[i] + starts])
                item.append(np.full(len(starts), i))
                at.append(starts)
                length.append(np.full(len(starts), n))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        seeds_, order = join(seeds, np.uint64), None
        length_ = join(length, np.int64)
        self.by_length = {}
        for n in np.unique(length_).tolist():
            own = np.flatnonzero(length_ == n)
            order = own[np.argsort(seeds_[own], kind="stable")]
            table = np.zeros(1 << 20, bool)
            table[(seeds_[order] >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[n] = (seeds_[order], join(item, np.int64)[order], join(at, np.int64)[order], table)

    def matches(self, column: pa.Array | pa.ChunkedArray, coverage: float) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(row, item, covered words, tiles) wherever an item is covered enough."""
        hashes, first = _word_hashes(column)
        for n, (seeds, item, at, table) in self.by_length.items():
            rolled = tk.windows(hashes, n, tk.WINDOW_BASES[0])
            inside = tk.inside_rows(first, n)
            inside = inside[table[(rolled[inside] >> np.uint64(44)).astype(np.int64)]]
            near = np.minimum(np.searchsorted(seeds, rolled[inside]), len(seeds) - 1)
            inside = inside[seeds[near] == rolled[inside]]
            if not len(inside):
                continue
            # Different seeds of each document first: a seed repeated in a document is looked up once.
            row = np.searchsorted(first, inside, "right") - 1
            order = np.lexsort((inside, rolled[inside], row))
            inside, row = inside[order], row[order]
            key = rolled[inside]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
            heads, times = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(inside)))
            lo, hi = np.searchsorted(seeds, key[heads], "left"), np.searchsorted(seeds, key[heads], "right")
            many = hi - lo
            head = np.repeat(np.arange(len(heads)), many)
            of = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            pos = inside[heads[head]]
            same = np.ones(len(pos), bool)
            for k in range(n):
                same &= hashes[pos + k] == self.hashes[self.first[item[of]] + at[of] + k]
            head, of = head[same], of[same]
            which, in_row = item[of], row[heads[head]]
            order = np.lexsort((head, which, in_row))
            head, of, which, in_row = head[order], of[order], which[order], in_row[order]
            edges = np.flatnonzero(np.concatenate(([True], (np.diff(in_row) != 0) | (np.diff(which) != 0)))) if len(of) else np.zeros(0, np.int64)
            for s, e in zip(edges.tolist(), np.append(edges[1:], len(of)).tolist(), strict=True):
                i, r = int(which[s]), int(in_row[s])
                if self._reach(at[of[s:e]], n) < coverage * self.sizes[i]:
                    continue
                own = times[head[s:e]]
                if own.sum() <= MOST_PAIRS:
                    k = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
                    places = inside[np.repeat(heads[head[s:e]], own) + k]
                    tiles = tile(np.stack([places - first[r], np.repeat(at[of[s:e]], own)], axis=1), n)
                else:
                    tiles = tile_by_length(hashes[first[r] : first[r + 1]], self.hashes[self.first[i] : self.first[i + 1]], n)
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * self.sizes[i]:
                    yield r, i, covered, tiles

    @staticmethod
    def _reach(at: np.ndarray, n: int) -> int:
        """Words of the item under any shared seed, which no tiling can exceed."""
        at = np.unique(at)
        return int(np.minimum(np.diff(at, append=at[-1] + n), n).sum())


def _blocks(benchmark: DataFrame, seed: int) -> Iterator[Index]:
    """The benchmark in indexed blocks of bounded size, read one partition at a time."""
    rows, size = [], 0
    items = bounded(benchmark).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for r in items.toLocalIterator():
        n = len((r["text"] or "").encode())
        if rows and size + n > BLOCK_BYTES:
            yield Index([x["item_id"] for x in rows], [x["text"] for x in rows], seed)
            rows, size = [], 0
        rows.append(r)
        size += n
    if rows:
        yield Index([x["item_id"] for x in rows], [x["text"] for x in rows], seed)


def _tilings(index, coverage: float, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in tk.slices(batch, "text"):
        ids = part.column(0).to_pylist()
        out: dict[str, list] = {n: [] for n in _PAIRS_ARROW.names}
        for r, i, covered, tiles in index.value.matches(part.column(1), coverage):
            size = int(index.value.sizes[i])
            row = (ids[r], index.value.ids[i], size, covered, len(tiles), covered / size, [dict(zip(("doc_start", "item_start", "length"), t, strict=True)) for t in sorted(tiles)])
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, _PAIRS_ARROW)


def _clean(index, coverage: float, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in tk.slices(batch, "text"):
        keep = np.ones(part.num_rows, bool)
        for r, *_ in index.value.matches(part.column(part.schema.get_field_index("text")), coverage):
            keep[r] = False
        yield part.filter(pa.array(keep))


def _shared(spark: SparkSession, benchmark: DataFrame, seed: int) -> Iterator:
    for index in _blocks(benchmark, seed):
        yield spark.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """Every pair of a document and a benchmark item whose tiles cover ``coverage`` of the item.

    ``docs``: ``doc_id``, ``text``; ``benchmark``: ``item_id``, ``text``; other columns are
    ignored. Returns ``doc_id``, ``item_id``, ``n_words`` (of the item), ``n_covered``,
    ``n_tiles``, ``coverage`` and ``tiles`` (word positions). Words ignore case and ASCII
    punctuation. An item of fewer than ``seed`` words has one seed, its whole sequence.
    Null or empty texts and items match nothing; null ids are returned as null; repeated
    rows give repeated pairs; an empty table gives an empty result.
    """
    docs = slim(docs)
    done = docs.sparkSession.createDataFrame([], _PAIRS)
    for index in _shared(docs.sparkSession, benchmark, seed):
        done = done.unionByName(docs.mapInArrow(on_batches(_tilings, index, coverage), _PAIRS))
    return done


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The documents, all columns, without those that cover a benchmark item."""
    schema = T.StructType(bounded(docs).schema.fields)
    for index in _shared(docs.sparkSession, benchmark, seed):
        docs = docs.mapInArrow(on_batches(_clean, index, coverage), schema)
    return docs
