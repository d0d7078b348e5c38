"""Substring deduplication: removal of word windows that occur more than once in a corpus.

Every window of ``window`` consecutive words gets a Rabin-Karp hash. Chunks of documents
send each hash bucket their distinct hashes (packed, one row per chunk and bucket), the
bucket counts them over the whole corpus and answers with one bit for each, and the chunk
merges its repeated windows into maximal removal intervals.

The hash has 96 bits: 64 from one polynomial over hashes of words, 32 from another over other
hashes, so that words that agree in one do not agree in both. Of n different windows about
``n**2 / 2**97`` pairs agree: at 100 TB of text 0.002 are expected.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import textkit as tk
from vecspark.llm.chunks import dealt, in_chunks, measure, on_group, on_pair, slim

WINDOW = 35
_REQUEST = "bucket int, chunk int, n int, keys binary"
_ANSWER = "chunk int, bucket int, n int, flags binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _ordered(table: pa.Table) -> pa.Table:
    """Rows of a chunk in an order that depends on their content only; equal rows are interchangeable."""
    if table.num_rows < 2:
        return table
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class _Chunk:
    """The words of a chunk and its window hashes, sorted, with equal hashes merged."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        self.buf, offs = tk.text_buffer(table.column("text"))
        self.starts, self.ends, self.first = tk.words(self.buf, offs)
        hashes = tk.word_hashes(self.buf, self.starts, self.ends)
        self.at = tk.inside_rows(self.first, window)
        h1 = tk.windows(hashes, window, tk.WINDOW_BASES[0])[self.at]
        del hashes
        other = tk.word_hashes(self.buf, self.starts, self.ends, tk.OTHER_BYTE_BASE)
        h2 = (tk.windows(other, window, tk.WINDOW_BASES[1])[self.at] >> np.uint64(32)).astype(np.uint32)
        del other
        self.order = np.argsort(h1, kind="stable")
        h1, h2 = h1[self.order], h2[self.order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        heads = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.h1, self.h2 = h1[heads], h2[heads]
        self.again = np.diff(np.append(heads, len(h1))) > 1
        bucket = (((self.h1 >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        self.bounds = np.searchsorted(bucket, np.arange(buckets + 1))


def _request(window: int, buckets: int, key: tuple, table: pa.Table) -> pa.Table:
    c = _Chunk(_ordered(table), window, buckets)
    out: dict[str, list] = {"bucket": [], "chunk": [], "n": [], "keys": []}
    for b in np.flatnonzero(np.diff(c.bounds)):
        lo, hi = c.bounds[b], c.bounds[b + 1]
        keys = tk.pack_sorted(c.h1[lo:hi]) + c.h2[lo:hi].tobytes() + np.packbits(c.again[lo:hi]).tobytes()
        for k, v in zip(out, (int(b), key[0].as_py(), int(hi - lo), tk.squeeze(keys)), strict=True):
            out[k].append(v)
    return pa.table(out, pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("keys", pa.binary())]))


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """Which hashes of a bucket occur twice or more, over all chunks."""
    sizes = table.column("n").to_numpy()
    h1, h2, again = [], [], []
    for n, keys in zip(sizes, table.column("keys"), strict=True):
        data = tk.expand(keys.as_py())
        h1.append(tk.unpack_sorted(data, n))
        h2.append(np.frombuffer(data, np.uint32, n, 8 * n))
        again.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=12 * n), count=n))
    h1, h2, again = np.concatenate(h1), np.concatenate(h2), np.concatenate(again)
    order = np.lexsort((h2, h1))
    h1, h2, again = h1[order], h2[order], again[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    heads = np.flatnonzero(new)
    twice = np.add.reduceat(1 + again.astype(np.int64), heads) > 1
    flags = np.empty(len(h1), bool)
    flags[order] = twice[np.cumsum(new) - 1]
    ends = np.cumsum(sizes)
    answers = [np.packbits(flags[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": table.column("n"), "flags": pa.array(answers, pa.binary())})


def _remove(window: int, buckets: int, key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
    docs = _ordered(docs)
    c = _Chunk(docs, window, buckets)
    flags = np.zeros(len(c.h1), bool)
    seen = 0
    for b, n, bits in zip(answers.column("bucket").to_pylist(), answers.column("n").to_pylist(), answers.column("flags"), strict=True):
        if c.bounds[b + 1] - c.bounds[b] != n:
            raise RuntimeError("a chunk changed between its request and its answer")
        flags[c.bounds[b] : c.bounds[b + 1]] = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=n)
        seen += n
    if seen != len(c.h1):
        raise RuntimeError("a chunk lacks answers of some buckets")
    edge = np.zeros(len(c.starts) + 1, np.int32)
    hit = c.at[c.order[flags[c.group]]]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    removed = np.concatenate(([0], np.cumsum(gone)))
    raw, first = c.buf.tobytes(), c.first
    kept, spans = [], []
    for d in range(docs.num_rows):
        lo, hi = int(first[d]), int(first[d + 1])
        if lo == hi:
            kept.append(b"")
            spans.append([])
            continue
        own = raw[c.starts[lo] : c.ends[hi - 1]].split()
        if removed[hi] == removed[lo]:
            kept.append(b" ".join(own))
            spans.append([])
            continue
        mask = gone[lo:hi]
        kept.append(b" ".join([w for w, m in zip(own, mask.tolist(), strict=True) if not m]))
        turns = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
        spans.append([{"start": int(s), "end": int(e)} for s, e in turns.reshape(-1, 2)])
    out = [docs.column("doc_id").combine_chunks(), pa.array(np.diff(first)), pa.array(removed[first[1:]] - removed[first[:-1]]), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, _RESULT_ARROW.field("removed").type)]
    return pa.table([pa.array(x) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x for x in out], schema=_RESULT_ARROW)


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removes each word that lies in a window of ``window`` words which also starts elsewhere.

    ``docs``: ``doc_id`` (long) and ``text`` (string); other columns are ignored. Returns
    one row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words
    joined by one space) and ``removed`` (maximal intervals of word positions, end
    exclusive). Windows are judged on the input: of two copies, both go.

    Null text counts as empty; a null ``doc_id`` is returned as null. Repeated rows are
    separate occurrences. An empty table gives an empty result. Texts under ``window``
    words stay whole. The work is linear in the text; a text is held whole by one task.
    """
    docs = slim(docs)
    sizes = measure(docs)
    buckets = sizes.buckets(1 / 6, 1_000_000)
    own = dealt(in_chunks(docs, sizes.chunks), "__chunk", sizes.partitions)
    asked = own.applyInArrow(on_group(_request, window, buckets), _REQUEST)
    answers = dealt(asked, "bucket", sizes.partitions).applyInArrow(on_group(_count), _ANSWER)
    return own.cogroup(dealt(answers, "chunk", sizes.partitions)).applyInArrow(on_pair(_remove, window, buckets), _RESULT)
