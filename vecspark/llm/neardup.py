"""Near-duplicate groups by MinHash: fast similarity sketching, banding, exact verification.

Sketch (Dahlgaard, Knudsen, Thorup 2017): in round i < t every shingle is thrown into one
of t bins with a value in [i, i+1); in round t + j all shingles are thrown into bin j; a
bin keeps its least value, and a set stops once every bin is full, so each coordinate is
always filled and the estimate keeps Chernoff-style concentration.

Texts with equal shingle sets collapse first. Each band bucket then links its members to
its least member; those links are verified on full sets and joined into components. A
bucket that still holds more than one component is settled in blocks of bounded size: an
inverted index of the block's shingles counts the exact intersections of each member
outside the largest component with all others, and one link for each pair of components
comes out. Members of the largest component never meet each other. So no bucket is
expanded into pairs of rows, and none is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import textkit as tk
from vecspark.llm.chunks import cut, on_batches, on_group, shuffle_partitions, slim
from vecspark.llm.graph import components
from vecspark.llm.idfilter import likely_rows

SHINGLE = 5
SIMILARITY = 0.75
#: 40 bands of 4: a pair at 0.75 shares no band with probability 2.5e-7.
BANDS, ROWS = 40, 4
#: Members and shingles in a block of a bucket.
BLOCK, BLOCK_SHINGLES = 600, 200_000

_FEATURES = "doc_id long, n_shingles long, digest binary, bands array<long>"
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, concatenated, and the bounds of each text.

    A text of fewer than k words has one shingle, its whole sequence; one without words has none.
    """
    buf, offs = tk.text_buffer(column)
    buf = tk.lower_ascii(buf)
    starts, ends, first = tk.words(buf, offs)
    hashes = tk.word_hashes(buf, starts, ends)
    at = tk.inside_rows(first, k)
    rolled = tk.windows(hashes, k, tk.WINDOW_BASES[0])[at]
    bounds = np.searchsorted(at, first)
    counts = np.diff(first)
    sets = []
    for d, n in enumerate(counts.tolist()):
        if n >= k:
            sets.append(np.unique(rolled[bounds[d] : bounds[d + 1]]))
        elif n:
            x = np.uint64(n)
            for h in hashes[first[d] : first[d + 1]]:
                x = tk.mix64(np.array([x], np.uint64) * np.uint64(tk.WINDOW_BASES[1]) + h)[0]
            sets.append(np.array([x], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    ends_at = np.cumsum([0] + [len(s) for s in sets])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), ends_at


def fast_sketches(values: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches (rows: sets, none empty; columns: t coordinates)."""
    n = len(bounds) - 1
    sketch = np.full((n, t), _EMPTY, np.uint64)
    flat = sketch.ravel()
    row = np.repeat(np.arange(n), np.diff(bounds))
    for i in range(2 * t):
        if not len(row):
            break
        x = tk.mix64(values + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        if i < t:
            to = (((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64)
        else:
            to = np.full(len(x), i - t)
        v = (tk.mix64(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(10)) | np.uint64(i << 54)
        np.minimum.at(flat, row * t + to, v)
        if i % 4 == 3 or i < 4 or i >= t:
            now = np.unique(row)
            left = np.zeros(n, bool)
            left[now] = (sketch[now] == _EMPTY).any(axis=1)
            keep = left[row]
            values, row = values[keep], row[keep]
    return sketch


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    parts = sketch.reshape(len(sketch), bands, rows)
    for r in range(rows):
        x = tk.mix64(x * np.uint64(tk.WINDOW_BASES[1]) + parts[:, :, r])
    return x.view(np.int64)


def _features(bands: int, rows: int, k: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in tk.slices(batch, "text", 2 << 20):
        values, bounds = shingle_sets(part.column(1), k)
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        sketch = fast_sketches(values, np.concatenate(([0], np.cumsum(sizes[full]))), bands * rows)
        keys = band_keys(sketch, bands, rows)
        at = dict(zip(full.tolist(), range(len(full)), strict=True))
        digests = [hashlib.blake2b(values[bounds[d] : bounds[d + 1]].tobytes(), digest_size=16).digest() for d in range(part.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(sizes), pa.array(digests, pa.binary()), pa.array([keys[at[d]] if d in at else None for d in range(part.num_rows)], pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "digest", "bands"],
        )


def _verify(k: int, similarity: float, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in tk.slices(batch, "text_a", 2 << 20):
        va, ba = shingle_sets(part.column(2), k)
        vb, bb = shingle_sets(part.column(3), k)
        keep = []
        for i in range(part.num_rows):
            x, y = va[ba[i] : ba[i + 1]], vb[bb[i] : bb[i + 1]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and 100 * both >= round(100 * similarity) * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; a may be in very many pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    text = likely_rows(docs.select("doc_id", "text"), ends, "doc_id")
    met = pairs.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    met = met.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return met.select("a", "b", "text_a", "text_b").mapInArrow(on_batches(_verify, k, similarity), "a long, b long")


def _settle(k: int, similarity: float, key: tuple, table: pa.Table) -> pa.Table:
    """Links between the components of each bucket block, one for each member and other component."""
    table = table.sort_by([(c, "ascending") for c in ("key", "i", "j", "node")])
    key_, i, j, own, node, comp = (table.column(c).to_numpy() for c in ("key", "i", "j", "own", "node", "comp"))
    new = np.flatnonzero(np.concatenate(([True], (key_[1:] != key_[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    a, b = [], []
    for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(key_)], strict=True):
        c, n, o = comp[lo:hi], node[lo:hi], own[lo:hi]
        kinds, kind = np.unique(c, return_inverse=True)
        if len(kinds) < 2:
            continue
        values, bounds = shingle_sets(table.column("text").slice(lo, hi - lo), k)
        sizes = np.diff(bounds)
        _, of = np.unique(values, return_inverse=True)
        order = np.argsort(of, kind="stable")
        holder = np.repeat(np.arange(hi - lo), sizes)[order]
        ends = np.cumsum(np.bincount(of))
        starts = np.concatenate(([0], ends[:-1]))
        for x in np.flatnonzero(kind != np.bincount(kind).argmax()).tolist():
            own_of = of[bounds[x] : bounds[x + 1]]
            stop = ends[own_of]
            many = stop - starts[own_of]
            at = np.repeat(stop - np.cumsum(many), many) + np.arange(int(many.sum()))
            both = np.bincount(holder[at], minlength=hi - lo)
            link = (100 * both >= round(100 * similarity) * (sizes + sizes[x] - both)) & (both > 0) & (kind != kind[x])
            if i[lo] != j[lo]:
                link &= o != o[x]
            hits = np.flatnonzero(link)
            for y in hits[np.unique(kind[hits], return_index=True)[1]].tolist():
                a.append(int(min(n[x], n[y])))
                b.append(int(max(n[x], n[y])))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _met(known: DataFrame) -> DataFrame:
    """Members (key, node, n, comp) of the buckets that hold several components, once for each block pair they go to.

    A bucket of more than one block is split into the members of its largest component and
    the others: these are in blocks ``0`` to ``outer - 1`` and meet everyone, those in the
    ``inner`` blocks after them meet the others only. So the members of one component,
    however many, are copied once for each ``BLOCK`` of the rest.
    """
    blocks = lambda c, n: F.greatest(F.ceil(c / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    sums = (F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    open_ = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), *sums).filter("x < y and c > 2")
    wide = open_.filter(blocks(F.col("c"), F.col("n")) > 1).select("key")
    shares = known.join(wide, "key", "left_semi").groupBy("key", "comp").agg(*sums)
    split = shares.groupBy("key").agg(F.max(F.struct("c", "comp", "n")).alias("m"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    split = split.select("key", F.col("m.comp").alias("main"), blocks(F.col("m.c"), F.col("m.n")).alias("inner"), blocks(F.col("c") - F.col("m.c"), F.col("n") - F.col("m.n")).alias("outer"))
    held = known.join(open_.select("key"), "key", "left_semi").join(split, "key", "left")
    held = held.withColumns({"within": F.coalesce(F.col("comp") == F.col("main"), F.lit(False)), "inner": F.coalesce("inner", F.lit(0)), "outer": F.coalesce("outer", F.lit(1))})
    at = F.pmod(F.xxhash64("node"), F.when(F.col("within"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    held = held.withColumn("own", at + F.when(F.col("within"), F.col("outer")).otherwise(0))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outer") - 1 + F.when(F.col("within"), 0).otherwise(F.col("inner")))))
    alone = F.col("outer") + F.col("inner") == 1
    return held.select("key", "node", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), alone.alias("alone"))


def _settled(members: DataFrame, labels: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Verified links between the components that meet in a bucket."""
    parts = shuffle_partitions(members.sparkSession)
    known = members.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    held = cut(_met(cut(known)))
    text = likely_rows(docs.select("doc_id", "text"), held.select("node"), "doc_id").withColumnRenamed("doc_id", "node")
    task = F.when(F.col("alone"), F.pmod(F.xxhash64("key"), F.lit(8 * parts))).otherwise(F.xxhash64("key", "i", "j"))
    held = held.join(text, "node").select(task.alias("task"), "key", "i", "j", "own", "node", "comp", "text")
    return held.groupBy("task").applyInArrow(on_group(_settle, k, similarity), "a long, b long").distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of the components that come of joining labelled ones by further links, which are few."""
    at = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_"))
    met = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    joined = components(met.select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b")).distinct())
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(joined)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents connected by shingle-set similarity of ``similarity`` or more.

    ``docs``: ``doc_id`` (long) and ``text``; other columns are ignored. Letters A-Z are
    lowered. Returns one row per input row: ``doc_id``, ``n_shingles`` (size of its set),
    ``component_id`` (smallest ``doc_id`` reachable) and ``kept`` (``doc_id`` equals it).

    A text without words, or null, has an empty set and is linked with nothing. Rows that
    share a ``doc_id`` count as one document. A null ``doc_id`` cannot be linked: its
    ``component_id`` is null and it is kept. An empty table gives an empty result.
    """
    docs = slim(docs)
    features = cut(docs.mapInArrow(on_batches(_features, bands, rows, shingle), _FEATURES))
    ready = features.filter("n_shingles > 0 and doc_id is not null")
    # Written out, so that the join on it below is a plain shuffle join, which Spark splits where copies abound.
    classes = cut(ready.groupBy("digest").agg(F.min("doc_id").alias("node")))
    heads = ready.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    each = heads.select(F.col("doc_id").alias("node"), F.col("n_shingles").cast("int").alias("n"), F.explode("bands").alias("key"))
    lead = each.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("top")).filter("lead < top").select("key", "lead")
    members = cut(each.join(lead, "key").select("key", "node", "n", "lead"))
    pairs = cut(members.filter("lead < node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    twice = ready.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("doc_id")
    same = ready.join(twice, "doc_id").join(classes, "digest").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = cut(_verified(pairs, docs, shingle, similarity).unionByName(same))
    labels = components(links)
    more = _settled(members.select("key", "node", "n").distinct(), labels, docs, shingle, similarity)
    labels = _joined(labels, more)
    own = features.join(classes, "digest", "left").withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")))
    done = own.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    done = done.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")))
    return done.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
