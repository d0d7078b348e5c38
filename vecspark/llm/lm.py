"""Language-model scores from a hierarchical Pitman-Yor model over words.

Every context (the previous word, by its 64-bit hash) is a restaurant; all share one parent
over words, whose own base is uniform over the learned words and one unknown word. Seating
is sampled by Gibbs sweeps: all customers of a dish leave their restaurant and are seated
again by the Chinese-restaurant rule, and the new seating is accepted by the Metropolis
ratio of its weights. Customers come singly until 64 are seated, then in groups of a 32nd
of those seated, in which each opens a table with the group's middle probability; a
seating's weight is that of the one-by-one rule over the chance of having drawn it, so
groups do not change what is sampled from. Every table sends one customer to the parent.
Predictive probabilities are averaged over the sweeps after burn-in; perplexity is
``10 ** (-score / n_tokens)``.

Counts of (context, word) pairs are merged in word buckets. A bucket holds all restaurants'
tables for its words, so the parent's share of these is exact there; a restaurant's size is
summed by the host of its context's hash and sent back to the word buckets after each
sweep, and so are the parent's totals. Within a sweep sizes are those of the sweep before,
as in approximate distributed Gibbs sampling (a seating's weight is kept from its own
sweep). Scoring takes documents in chunks of what one task reads, each of which asks the
buckets for its distinct pairs and words; texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import textkit as tk
from vecspark.llm.chunks import Steps, bounded, cut, cut_alone, dealt, measure, on_batches, on_group, on_pair, slim

SWEEPS, BURN_IN = 6, 2
CONCENTRATION = 1.0
#: Customers seated at once, as a share of those seated.
_GROUP = 32
#: Word buckets for each host, which sums the sizes of as many contexts (there are fewer of these than pairs).
HOSTED = 8
#: Parts that documents are scored in; the exchanges of one part are on disk at a time.
PARTS = 2

#: Classes that ``LanguageModel.start`` and ``sampled`` add contexts up in; the model has none.
_CLASS_BITS = 18
_CONTEXTS = 1 << _CLASS_BITS
_END, _START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
_REQUEST = "bucket int, slot int, chunk long, n_words int, n_pairs int, body binary"
_MERGED = "bucket int, n_words int, n_pairs long, tokens long, once long, twice long, alone long, pairs_of_two long, body binary"
_ANSWER = "slot int, chunk long, bucket int, n_words int, n_pairs int, body binary"
#: What buckets send each other: ``peer`` is the sender, or -1 for what a bucket keeps.
_NOTE = "bucket int, peer int, sweep int, guests double, roots double, body binary"
_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


class _Tokens:
    """Tokens of all texts of a table (words, then one end each) and their (word, context) pairs.

    ``words`` also has the mark before a text's first word, the context there.
    """

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        token, sizes = _hashes(column)
        order = np.argsort(token)
        token = token[order]
        new = np.concatenate(([True], token[1:] != token[:-1]))
        self.words = token[new]
        of = token.view(np.int64)  # its bytes are used again
        of[order] = np.cumsum(new, dtype=np.int32) - 1
        self._pair(of[:-1], sizes, int(of[-1]))

    def _pair(self, word_of: np.ndarray, sizes: np.ndarray, start: int) -> None:
        self.word_of, self.sizes, self.start = word_of, sizes, start
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        before = np.empty_like(word_of)
        before[1:] = word_of[:-1]
        before[self.bounds[:-1]] = start
        self.pair_key = word_of * len(self.words) + before

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and how often they occur; the tokens' own order is given up for it."""
        key = self.pair_key
        del self.pair_key, self.word_of
        key.sort()
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        return key[heads], np.diff(heads, append=len(key))

    def blob(self, *more: np.ndarray) -> bytes:
        return _blob(self.word_of.astype(np.uint32), self.sizes, np.array([self.start, len(self.words)]), *more)

    @staticmethod
    def of(blob: bytes) -> tuple[_Tokens, list[np.ndarray]]:
        """The tokens again, words being known by number only, and what was packed with them."""
        word_of, sizes, (start, n), *more = _arrays(blob)
        t = _Tokens.__new__(_Tokens)
        t.words = np.arange(n)
        t._pair(word_of.astype(np.int64), sizes, int(start))
        return t, more

    def requests(self, buckets: int, pairs: np.ndarray, counts: np.ndarray | None, chunk: int) -> dict[str, list]:
        """One packed row per word bucket."""
        bounds = _bucket_bounds(self.words, buckets)
        word, context = np.divmod(pairs, len(self.words))
        at = np.searchsorted(word, bounds)
        out: dict[str, list] = {name: [] for name in _REQUEST_ARROW.names}
        for b in np.flatnonzero(np.diff(bounds)):
            own = slice(at[b], at[b + 1])
            body = _pack(self.words[bounds[b] : bounds[b + 1]], word[own] - bounds[b], self.words[context[own]], None if counts is None else counts[own])
            for k, v in zip(out, (int(b), chunk % _SLOTS, chunk, int(bounds[b + 1] - bounds[b]), int(at[b + 1] - at[b]), body), strict=True):
                out[k].append(v)
        return out


def _hashes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, with the mark before a first word at the end, and the number of tokens of each text."""
    buf, offs = tk.text_buffer(column)
    buf = tk.lower_ascii(buf)
    starts, ends, first = tk.words(buf, offs)
    rows = len(offs) - 1
    token = np.full(len(starts) + rows + 1, _END, np.uint64)
    own = np.ones(len(token), bool)
    own[first[1:] + np.arange(rows)] = own[-1] = False
    token[own] = tk.word_hashes(buf, starts, ends)
    token[-1] = _START
    return token, np.diff(first) + 1


def _bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return (((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _bucket_bounds(words: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(_bucket_of(words, buckets), np.arange(buckets + 1))


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    parts = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        parts += [x.dtype.str.encode(), len(x).to_bytes(8, "little"), _planes(x)]
    return tk.squeeze(b"".join(parts))


def _arrays(blob: bytes) -> list[np.ndarray]:
    data, at, out = tk.expand(blob), 0, []
    while at < len(data):
        dtype, n = np.dtype(data[at : at + 3].decode()), int.from_bytes(data[at + 3 : at + 11], "little")
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at + 11).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += 11 + n * dtype.itemsize
    return out


def _gaps(values: np.ndarray) -> np.ndarray:
    """Differences of sorted hashes (``np.cumsum`` undoes it)."""
    return np.diff(values, prepend=np.uint64(0))


def _pack(words: np.ndarray, word: np.ndarray, context: np.ndarray, counts: np.ndarray | None) -> bytes:
    """Sorted words, pairs of each word, sorted contexts, the context of each pair and, for training, their counts."""
    contexts, at = np.unique(context, return_inverse=True)
    parts = [_gaps(words), np.bincount(word, minlength=len(words)).astype(np.uint32), _gaps(contexts), at.astype(np.uint32)]
    return _blob(*parts, *([] if counts is None else [counts.astype(np.int64)]))


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Words, the word of each pair, contexts, the context of each pair, counts."""
    words, each, contexts, at, *counts = _arrays(body)
    return np.cumsum(words, dtype=np.uint64), np.repeat(np.arange(len(words)), each), np.cumsum(contexts, dtype=np.uint64), at.astype(np.int64), counts[0] if counts else None


_REQUEST_ARROW = pa.schema([("bucket", pa.int32()), ("slot", pa.int32()), ("chunk", pa.int64()), ("n_words", pa.int32()), ("n_pairs", pa.int32()), ("body", pa.binary())])


def _count(buckets: int):
    def counted(column: pa.ChunkedArray) -> pa.RecordBatch:
        t = _Tokens(column)
        return pa.RecordBatch.from_pydict(t.requests(buckets, *t.counted(), 0), _REQUEST_ARROW)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.filled(batches, "text"):
            yield counted(part.column(0))

    return call


def _rows(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """All counts of a word bucket."""
    bodies = [x.as_py() for x in table.column("body")]
    known_, contexts_, size = [], [], 0
    for body in bodies:
        words, each, near, at, _ = _arrays(body)
        # A word without pairs is the mark before the first word, which is a context only.
        known_.append(np.cumsum(words, dtype=np.uint64)[each > 0])
        contexts_.append(np.cumsum(near, dtype=np.uint64))
        size += len(at)
    known, contexts = np.unique(np.concatenate(known_)), np.unique(np.concatenate(contexts_))
    del known_, contexts_
    if not len(known):
        return pa.table([pa.array([], t) for t in _MERGED_TYPES], names=_MERGED_NAMES)
    key_, count, seen = np.empty(size, np.int64), np.empty(size, np.int64), 0
    for body in bodies:
        words, word, near, context, n = _unpack(body)
        key_[seen : seen + len(n)] = np.searchsorted(known, words)[word] * len(contexts) + np.searchsorted(contexts, near)[context]
        count[seen : seen + len(n)] = n
        seen += len(n)
    order = np.argsort(key_)
    key_, count = key_[order], count[order]
    del order
    heads = np.flatnonzero(np.concatenate(([True], key_[1:] != key_[:-1])))
    count, key_ = np.add.reduceat(count, heads), key_[heads]
    word, context = np.divmod(key_, len(contexts))
    fan = np.bincount(word, minlength=len(known))
    row = [key[0].as_py(), len(known), len(key_), int(count.sum()), int((count == 1).sum()), int((count == 2).sum()), int((fan == 1).sum()), int((fan == 2).sum()), _pack(known, word, contexts[context], count)]
    return pa.table([pa.array([v], t) for v, t in zip(row, _MERGED_TYPES, strict=True)], names=_MERGED_NAMES)


_MERGED_NAMES = ["bucket", "n_words", "n_pairs", "tokens", "once", "twice", "alone", "pairs_of_two", "body"]
_MERGED_TYPES = [pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.binary()]


@dataclass
class Settings:
    """Corpus-wide sizes of the model."""

    tokens: int
    words: int
    pairs: float  # customers of the parent
    tables: float  # tables of the parent
    discount: float
    parent_discount: float
    buckets: int


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function, for x > 0."""
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - shift


def _subsets(rng: np.random.Generator, size: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A uniform subset of ``take`` of the first ``size`` numbers for each row: rows and numbers, in order."""
    # Of a set and the rest the smaller is drawn, by drawing until all are distinct.
    small = np.where(2 * take > size, size - take, take)
    key = np.zeros(0, np.int64)
    width = int(size.max(initial=0)) + 1
    missing = np.repeat(np.arange(len(size)), small)
    while len(missing):
        key = np.unique(np.concatenate([key, missing * width + (rng.random(len(missing)) * size[missing]).astype(np.int64)]))
        missing = np.repeat(np.arange(len(size)), small - np.bincount(key // width, minlength=len(size)))
    rest = np.flatnonzero(2 * take > size)
    if len(rest):
        every = np.concatenate([r * width + np.arange(size[r]) for r in rest])
        key = np.sort(np.concatenate([key[~np.isin(key // width, rest)], np.setdiff1d(every, key, assume_unique=True)]))
    return key // width, key % width


def _group_weight(rng: np.random.Generator, discount: float, seated: np.ndarray, tables: np.ndarray, size: np.ndarray, opened: np.ndarray, p: np.ndarray, first: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For groups of customers: log of the one-by-one weight of a seating over the chance of having drawn it.

    ``opened`` of ``size`` customers open tables, each with probability ``p``; which of them
    is drawn here. ``first``: weight of a new table when the group comes, over ``base``.
    """
    row, at = _subsets(rng, size, opened)
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.bincount(row, np.log((first[row] + discount * nth) * base[row]), len(size)).astype(float)
    # Between two new tables all customers sit down at known ones, of which there is a constant number.
    lo, hi = [np.zeros(len(size), np.int64)], [size.copy()]
    last = np.concatenate((row[1:] != row[:-1], [True])) if len(row) else np.zeros(0, bool)
    hi[0][row[nth == 0]] = at[nth == 0]
    lo.append(at + 1)
    hi.append(np.where(last, size[row], np.append(at[1:], 0)))
    row_, have = np.concatenate([np.arange(len(size)), row]), np.concatenate([tables, tables[row] + nth + 1])
    lo_, hi_ = np.concatenate(lo), np.concatenate(hi)
    full = hi_ > lo_
    start = seated[row_] - discount * have
    gain = _log_gamma(start[full] + hi_[full]) - _log_gamma(start[full] + lo_[full])
    out += np.bincount(row_[full], gain, len(size))
    return out - opened * np.log(p) - (size - opened) * np.log1p(-p)


def _seat(rng: np.random.Generator, n: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Tables that n customers of one dish take, and the log weight of the seating.

    ``n`` falls; ``others``: tables of other dishes in the restaurant; ``base``: the
    parent's probability of the dish.
    """
    tables, weight = np.ones(len(n)), np.zeros(len(n))
    seated, top, falling = 1, int(n[0]) if len(n) else 0, -n
    groups: list[tuple] = []
    while seated < top:
        block = max(1, seated // _GROUP)
        live = int(np.searchsorted(falling, -seated, "left"))
        first = CONCENTRATION + discount * (others[:live] + tables[:live])
        if block == 1:
            new = first * base[:live]
            total = new + (seated - discount * tables[:live])
            weight[:live] += np.log(total)
            tables[:live] += rng.random(live) * total < new
        else:
            size = np.minimum(block, n[:live] - seated)
            new = first * base[:live]
            p = np.clip(new / (new + seated + (size - 1) / 2 - discount * tables[:live]), 1e-15, 1 - 1e-9)
            opened = rng.binomial(size, p)
            groups.append((np.arange(live), np.full(live, seated), tables[:live].copy(), size, opened, p, first, base[:live]))
            tables[:live] += opened
        seated += block
    if groups:
        of, *parts = (np.concatenate(x) for x in zip(*groups, strict=True))
        weight += np.bincount(of, _group_weight(rng, discount, *parts), len(n))
    return tables, weight


class _Bucket:
    """The restaurants' tables for the words of one bucket, averaged over the kept sweeps.

    ``row``: the merged counts (``body``) and what the sweeps drew (``drawn``).
    """

    def __init__(self, row: dict, *_):
        self.words, word, contexts, context, self.count = _unpack(row["body"])
        self.contexts, self.keys = contexts, word * len(contexts) + context
        self.word_count = np.bincount(word, self.count, len(self.words)).astype(np.int64)
        state = _State(row["drawn"])
        self.summed = np.full(len(self.count), SWEEPS - BURN_IN, np.int64)
        self.summed[_many(self.count)] = state.seats
        self.seats = self.summed / (SWEEPS - BURN_IN)
        self.drawn = np.stack([state.kept[0::2], state.kept[1::2]])
        self.guests, self.roots = self.drawn.mean(axis=1)
        self.context = (contexts >> np.uint64(64 - _CLASS_BITS)).astype(np.int64)[context]


def _many(count: np.ndarray) -> np.ndarray:
    """Pairs with a choice of tables, most customers first."""
    many = np.flatnonzero(count > 1)
    return many[np.argsort(-count[many], kind="stable")]


class _State:
    """What a word bucket keeps between sweeps.

    Of the pairs seen more than once: customers, word, context (its place among the bucket's
    contexts of such pairs), tables, log normalisers and tables summed over the kept sweeps;
    of these contexts the buckets that sum them; of words their pairs, tables of the parent
    and its log normalisers; ``kept``: guests and tables of the parent of every kept sweep.
    """

    NAMES = ("n", "w", "u", "now", "weight", "seats", "to", "fan", "root", "root_weight")

    def __init__(self, blob: bytes):
        arrays = _arrays(blob)
        for name, x in zip(self.NAMES, arrays, strict=False):
            setattr(self, name, x)
        self.kept = arrays[len(self.NAMES) :]

    def blob(self) -> bytes:
        return _blob(*(getattr(self, name) for name in self.NAMES), *self.kept)


def _notes(rows: list[tuple]) -> dict[str, list]:
    return {name: [r[i] for r in rows] for i, name in enumerate(_NOTE_ARROW.names)}


_NOTE_ARROW = pa.schema([("bucket", pa.int32()), ("peer", pa.int32()), ("sweep", pa.int32()), ("guests", pa.float64()), ("roots", pa.float64()), ("body", pa.binary())])


def _open(hosts: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The first state of a word bucket, and its contexts for the hosts that sum their sizes."""
    for row in _rows(pa.Table.from_batches([batch])):
        words, word, contexts, context, count = _unpack(row["body"])
        many = _many(count)
        tables = np.bincount(context[many], minlength=len(contexts))
        live = np.flatnonzero(tables)
        target, fan = _bucket_of(contexts, hosts), np.bincount(word, minlength=len(words))
        ones, none = np.ones(len(many), np.int32), np.zeros(len(many), np.float32)
        state = _blob(count[many], word[many].astype(np.int32), np.searchsorted(live, context[many]).astype(np.int32), ones, none, np.zeros(len(many), np.int64), target[live].astype(np.int32), fan, np.ones(len(words), np.int64), np.zeros(len(words), np.float32))
        customers, pairs = np.bincount(context, count, len(contexts)).astype(np.int64), np.bincount(context, minlength=len(contexts))
        out = [(row["bucket"], -1, -1, 0.0, 0.0, state)]
        bounds = np.searchsorted(target, np.arange(hosts + 1))
        for c in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[c], bounds[c + 1])
            out.append((int(c), row["bucket"], -1, 0.0, 0.0, _blob(_gaps(contexts[own]), customers[own], (pairs - tables)[own], tables[own])))
        yield pa.RecordBatch.from_pydict(_notes(out), _NOTE_ARROW)


def _host(key: tuple, table: pa.Table) -> pa.Table:
    """Sizes of all restaurants of a host; those of a table a pair are sent back as the first."""
    c = key[0].as_py()
    parts = []
    for r in sorted(_rows(table), key=lambda r: r["peer"]):
        gaps, customers, fixed, tables = _arrays(r["body"])
        parts.append((r["peer"], np.cumsum(gaps, dtype=np.uint64), customers, fixed, tables))
    contexts = np.unique(np.concatenate([p[1] for p in parts]))
    customers, fixed, tables = (np.zeros(len(contexts), np.int64) for _ in range(3))
    live = []
    for _, own, *sums in parts:
        at = np.searchsorted(contexts, own)
        for total, x in zip((customers, fixed, tables), sums, strict=True):
            total[at] += x
        live.append(at[sums[2] > 0])
    peers = np.array([p[0] for p in parts])
    out = [(c, -1, -1, 0.0, 0.0, _blob(_gaps(contexts), customers, fixed, fixed + tables, peers, np.array([len(x) for x in live]), np.concatenate(live).astype(np.int32)))]
    out += [(int(p), c, -1, 0.0, 0.0, _blob((fixed + tables)[x])) for p, x in zip(peers, live, strict=True) if len(x)]
    return pa.table(_notes(out), _NOTE_ARROW)


def _sweep(s: Settings, sweep: int, key: tuple, table: pa.Table) -> pa.Table:
    """Seats all customers of a word bucket once, under sizes as they were after the last sweep."""
    b, notes = key[0].as_py(), sorted(_rows(table), key=lambda r: r["peer"])
    x = _State(notes[0]["body"])
    tables = np.concatenate([np.zeros(0, np.int64), *(_arrays(r["body"])[0] for r in notes[1:])])
    if len(tables) != len(x.to):
        raise RuntimeError("a word bucket has not heard from all its contexts")
    rng = np.random.default_rng([b, sweep])
    words = len(x.fan)
    guests = x.fan + np.bincount(x.w, x.now - 1, words).astype(np.int64)
    new, fresh = _seat(rng, x.n, tables[x.u] - x.now, _parent(guests, x.root, s)[x.w], s.discount)
    take = np.ones(len(new), bool) if not sweep else np.log(rng.random(len(new))) < fresh - x.weight
    x.now, x.weight = np.where(take, new, x.now).astype(np.int32), np.where(take, fresh, x.weight).astype(np.float32)
    guests = x.fan + np.bincount(x.w, x.now - 1, words).astype(np.int64)
    order = np.argsort(-guests, kind="stable")
    new, fresh = np.empty(words), np.empty(words)
    new[order], fresh[order] = _seat(rng, guests[order], np.maximum(s.tables - x.root[order], 0), np.full(words, 1.0 / (s.words + 1)), s.parent_discount)
    take = np.ones(words, bool) if not sweep else np.log(rng.random(words)) < fresh - x.root_weight
    x.root = np.minimum(np.where(take, new, x.root), guests).astype(np.int64)
    x.root_weight = np.where(take, fresh, x.root_weight).astype(np.float32)
    if sweep >= BURN_IN:
        x.seats = x.seats + x.now
        x.kept += [guests, x.root]
    sums = np.bincount(x.u, x.now, len(x.to)).astype(np.int64)
    out = [(b, -1, sweep, float(guests.sum()), float(x.root.sum()), x.blob())]
    heads = np.flatnonzero(np.concatenate(([True], x.to[1:] != x.to[:-1]))) if len(x.to) else []
    out += [(int(x.to[lo]), b, sweep, 0.0, 0.0, _blob(part)) for lo, part in zip(heads, np.split(sums, heads[1:]), strict=True)] if len(heads) else []
    return pa.table(_notes(out), _NOTE_ARROW)


def _summed(table: pa.Table) -> tuple[list[np.ndarray], dict[int, np.ndarray], list[tuple[int, np.ndarray]]]:
    """A host's arrays, its restaurants' tables after each sweep heard of, and the contexts of each peer."""
    host = next(_arrays(r["body"]) for r in _rows(table) if r["peer"] < 0)
    peers = list(zip(host[4].tolist(), np.split(host[6], np.cumsum(host[5])[:-1]), strict=True))
    at, tables = dict(peers), {}
    for r in _rows(table):
        if r["peer"] >= 0:
            own = tables.setdefault(r["sweep"], host[2].copy())
            own[at[r["peer"]]] += _arrays(r["body"])[0]
    return host, tables, peers


def _resum(sweep: int, key: tuple, table: pa.Table) -> pa.Table:
    """Tables of the restaurants after a sweep, for the word buckets that asked."""
    host, tables, peers = _summed(table)
    now = tables.get(sweep, host[2])
    return pa.table(_notes([(p, key[0].as_py(), sweep, 0.0, 0.0, _blob(now[x])) for p, x in peers if len(x)]), _NOTE_ARROW)


def _settle(buckets: int, key: tuple, table: pa.Table) -> pa.Table:
    """Contexts, customers, first tables and the tables after every kept sweep, by the bucket of the context as a word."""
    host, tables, _ = _summed(table)
    contexts = np.cumsum(host[0], dtype=np.uint64)
    kept = [tables.get(k, host[2]) for k in range(BURN_IN, SWEEPS)]
    bounds = _bucket_bounds(contexts, buckets)
    full = np.flatnonzero(np.diff(bounds))
    part = lambda b: slice(bounds[b], bounds[b + 1])
    bodies = [_blob(_gaps(contexts[part(b)]), *(x[part(b)] for x in (host[1], host[3], *kept))) for b in full]
    return pa.table({"bucket": pa.array(full, pa.int32()), "sizes": pa.array(bodies, pa.binary())})


def _parent(guests: np.ndarray, roots: np.ndarray, s: Settings) -> np.ndarray:
    return (guests - s.parent_discount * roots + _unknown(s) * (CONCENTRATION + s.pairs)) / (CONCENTRATION + s.pairs)


def _unknown(s: Settings) -> float:
    """The parent's probability of a word that was never learned."""
    return (CONCENTRATION + s.parent_discount * s.tables) / (s.words + 1) / (CONCENTRATION + s.pairs)


def _ask(buckets: int):
    """For each chunk its requests, and under a negative bucket its tokens, which go on to its answers."""

    def asked(part: pa.Table, chunk: int) -> pa.RecordBatch:
        t = _Tokens(part.column("text"))
        out = t.requests(buckets, np.unique(t.pair_key), None, chunk)
        ids = part.column("doc_id")
        own = t.blob(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy().astype(np.int8))
        for k, v in zip(out, (-1 - chunk % _SLOTS, chunk % _SLOTS, chunk, len(t.words), 0, own), strict=True):
            out[k].append(v)
        return pa.RecordBatch.from_pydict(out, _REQUEST_ARROW)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, part in enumerate(tk.filled(batches, "text")):
            yield asked(part, task + i * _STRIDE)

    return call


_ANSWER_ARROW = pa.schema([("slot", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("n_words", pa.int32()), ("n_pairs", pa.int32()), ("body", pa.binary())])
#: Chunks of a task are numbered this far apart, so that each has a number of its own; groups go by the number's lower part.
_STRIDE, _SLOTS = 10_000_019, 1 << 30


def _reply(key: tuple, asked: pa.Table, model: pa.Table) -> pa.Table:
    """For each request, what the model knows of its words, as words and as contexts, and of its pairs: whole numbers."""
    if not asked.num_rows:
        return _ANSWER_ARROW.empty_table()
    if key[0].as_py() < 0:
        return asked.select(_ANSWER_ARROW.names).cast(_ANSWER_ARROW)
    row: dict = {}
    for r in _rows(model):
        row |= {k: v for k, v in r.items() if v is not None}
    own = _Bucket(row) if "body" in row else None
    contexts, customers, _, *tables = _arrays(row["sizes"]) if "sizes" in row else [np.zeros(0, np.uint64)] * (3 + SWEEPS - BURN_IN)
    contexts = np.cumsum(contexts, dtype=np.uint64)
    out: dict[str, list] = {name: [] for name in _ANSWER_ARROW.names}
    for r in _rows(asked):
        words, word, near, context, _ = _unpack(r["body"])
        of_words = np.zeros((2 + 3 * (SWEEPS - BURN_IN), len(words)), np.int64)
        of_pairs = np.zeros((2, len(word)), np.int64)
        if own is not None:
            at, known = _find(own.words, words)
            of_words[0, known] = own.word_count[at[known]]
            for k, x in enumerate((*own.drawn[0], *own.drawn[1])):
                of_words[2 + k, known] = x[at[known]]
            there, met = _find(own.contexts, near)
            pos, hit = _find(own.keys, at[word] * len(own.contexts) + there[context])
            hit &= known[word] & met[context]
            of_pairs[:, hit] = own.count[pos[hit]], own.summed[pos[hit]]
        if len(contexts):
            at, known = _find(contexts, words)
            for k, x in zip((1, *range(2 + 2 * len(tables), len(of_words))), (customers, *tables), strict=True):
                of_words[k, known] = x[at[known]]
        for k, v in zip(out, (r["slot"], r["chunk"], r["bucket"], len(words), len(word), _blob(of_words.ravel(), of_pairs.ravel())), strict=True):
            out[k].append(v)
    return pa.table(out, _ANSWER_ARROW)


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted values, and whether they are hits."""
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def _probability(sweeps: tuple[Settings, ...], words: np.ndarray, pairs: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Predictive probabilities of pairs, averaged over the kept sweeps.

    Each sweep has the parent's probabilities, the tables of the restaurants and those of
    the dish of its own; the number of customers is the same in all.
    """
    kept, d = len(sweeps), sweeps[0].discount
    p = pairs[0] - d * pairs[1] / kept
    for k, s in enumerate(sweeps):
        parent, tables = _parent(words[2 + k], words[2 + kept + k], s), words[2 + 2 * kept + k]
        p += (CONCENTRATION + d * tables[context]) * parent[word] / kept
    return p / (CONCENTRATION + words[1][context])


def _score(s: Settings, sweeps: tuple[Settings, ...], key: tuple, table: pa.Table) -> pa.Table:
    chunks = pc.unique(table.column("chunk"))
    return pa.concat_tables([_score_chunk(s, sweeps, table.filter(pc.equal(table.column("chunk"), c))) for c in chunks])


def _score_chunk(s: Settings, sweeps: tuple[Settings, ...], table: pa.Table) -> pa.Table:
    rows = sorted(_rows(table), key=lambda r: r["bucket"])
    if rows[0]["bucket"] >= 0:
        raise RuntimeError("a chunk changed between its request and its answer")
    t, (ids, null) = _Tokens.of(rows[0]["body"])
    pairs, pair_of = np.unique(t.pair_key, return_inverse=True)
    del t.pair_key
    n_words, n_pairs = (np.cumsum([0, *(r[name] for r in rows[1:])]) for name in ("n_words", "n_pairs"))
    if n_words[-1] != len(t.words) or n_pairs[-1] != len(pairs):
        raise RuntimeError("a chunk changed between its request and its answer")
    of_words, of_pairs = np.empty((2 + 3 * len(sweeps), len(t.words)), np.int64), np.empty((2, len(pairs)), np.int64)
    for i, r in enumerate(rows[1:]):
        a, b = _arrays(r["body"])
        of_words[:, n_words[i] : n_words[i + 1]] = a.reshape(len(of_words), -1)
        of_pairs[:, n_pairs[i] : n_pairs[i + 1]] = b.reshape(2, -1)
    count = of_words[0]
    word, context = np.divmod(pairs, len(t.words))
    del pairs
    p = np.log10(_probability(sweeps, of_words, of_pairs, word, context))
    base = np.log10((count + 0.5) / (s.tokens + 0.5 * (s.words + 1)))[t.word_of]
    heads = t.bounds[:-1]
    cols = [
        pa.array(ids, mask=null.astype(bool)),
        pa.array(t.sizes),
        pa.array(np.add.reduceat((count > 0)[t.word_of].astype(np.int64), heads)),
        pa.array(np.add.reduceat(base, heads)),
        pa.array(np.add.reduceat(p[pair_of], heads)),
    ]
    return pa.table(cols, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _classes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for blob in batch.column(0):
        gaps, customers, first, *kept = _arrays(blob.as_py())
        at = (np.cumsum(gaps, dtype=np.uint64) >> np.uint64(64 - _CLASS_BITS)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"class": at, "customers": customers.astype(float), "first": first.astype(float), "mean": np.mean(kept, axis=0)})


@dataclass
class LanguageModel:
    """A fitted model, in checkpointed tables of one row a bucket: counts, what was drawn for words, sizes of contexts."""

    counts: DataFrame
    drawn: DataFrame
    sizes: DataFrame
    first: Settings
    settings: Settings
    sweeps: tuple[Settings, ...]

    @property
    def merged(self) -> DataFrame:
        return self.counts.join(self.drawn, "bucket")

    def _by_class(self, tables: str) -> np.ndarray:
        sums = self.sizes.select("sizes").mapInArrow(on_batches(_classes), "class long, customers double, first double, mean double").groupBy("class").agg(F.sum("customers"), F.sum(tables)).collect()
        out = np.zeros((2, _CONTEXTS))
        for at, customers, n in sums:
            out[:, at] = customers, n
        return out

    @property
    def start(self) -> np.ndarray:
        """Customers and first tables of all contexts, added up by class; for looking at."""
        return self._by_class("first")

    @property
    def sampled(self) -> np.ndarray:
        """The same with the mean tables of the kept sweeps."""
        return self._by_class("mean")

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every text.

        Scores are log10 probabilities; ``base_score`` is the add-half unigram model.
        Null text counts as empty (one end token); a null ``doc_id`` is returned as null;
        repeated rows are scored alike; an empty table gives an empty result.
        """
        docs = slim(docs)
        parts, done = measure(docs).partitions, None
        model = self.counts.unionByName(self.drawn, True).unionByName(self.sizes, True)
        of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS))
        for i in range(PARTS):
            asked = docs.filter(of == i).mapInArrow(_ask(self.settings.buckets), _REQUEST)
            answers = dealt(asked, "bucket", parts).cogroup(dealt(model, "bucket", parts)).applyInArrow(on_pair(_reply), _ANSWER)
            own = cut_alone(dealt(answers, "slot", parts).applyInArrow(on_group(_score, self.settings, self.sweeps), _SCORES))
            done = own if done is None else done.unionByName(own)
        return done


def _discount(once: int | None, twice: int | None) -> float:
    """The Kneser-Ney estimate from the numbers of things seen once and twice."""
    return min(0.95, max(0.1, (once or 0) / max(1, (once or 0) + 2 * (twice or 0))))


def _apart(notes: DataFrame) -> DataFrame:
    """Notes with what buckets keep and what they send in columns of their own, so that only one of these is read."""
    keeps = F.col("peer") < 0
    return notes.withColumns({"kept": F.when(keeps, F.col("body")), "sent": F.when(~keeps, F.col("body"))}).drop("body")


def _kept(notes: DataFrame) -> DataFrame:
    return notes.filter("peer < 0").withColumnRenamed("kept", "body").drop("sent")


def _sent(notes: DataFrame) -> DataFrame:
    return notes.filter("peer >= 0").withColumnRenamed("sent", "body").drop("kept")


def fit(docs: DataFrame) -> LanguageModel:
    """Learns from all texts of ``docs`` (null: empty); only column ``text`` is read."""
    docs = bounded(docs).select(F.col("text").cast("string").alias("text"))
    n = measure(docs)
    buckets = n.buckets(1 / 12, 1_000_000)
    hosts = -(-buckets // HOSTED)
    buckets = buckets if hosts == 1 else hosts * HOSTED
    grouped = lambda frame: dealt(frame, "bucket", n.partitions)
    merged = cut_alone(grouped(docs.mapInArrow(_count(buckets), _REQUEST)).applyInArrow(on_group(_merge), _MERGED))
    names = ("n_words", "n_pairs", "tokens", "once", "twice", "alone", "pairs_of_two")
    total = merged.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names)).first()
    s = first = Settings(total["tokens"], total["n_words"], float(total["n_pairs"]), float(total["n_words"]), _discount(total["once"], total["twice"]), _discount(total["alone"], total["pairs_of_two"]), buckets)
    counts, sweeps = merged.select("bucket", "body"), []
    with Steps(docs.sparkSession) as steps:
        done = steps.write(_apart(counts.mapInArrow(on_batches(_open, hosts), _NOTE)))
        hosts = steps.write(_apart(grouped(_sent(done)).applyInArrow(on_group(_host), _NOTE)))
        own, sizes, heard = _kept(hosts), _sent(hosts), []
        for sweep in range(SWEEPS):
            last, done = done, steps.write(_apart(grouped(_kept(done).unionByName(sizes)).applyInArrow(on_group(_sweep, s, sweep), _NOTE)))
            steps.drop(*(t for t in [last] if not any(t is h for h in heard)))
            sizes = grouped(own.unionByName(_sent(done))).applyInArrow(on_group(_resum, sweep), _NOTE)
            after = _kept(done).agg(F.coalesce(F.sum("guests"), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("roots"), F.lit(0.0)).alias("tables")).first()
            s = replace(s, pairs=after["pairs"], tables=after["tables"])
            if sweep >= BURN_IN:
                sweeps.append(s)
                heard.append(done)
        kept = own
        for t in heard:
            kept = kept.unionByName(_sent(t))
        drawn = cut(_kept(done).select("bucket", F.col("body").alias("drawn")))
        settled = cut_alone(grouped(kept).applyInArrow(on_group(_settle, buckets), "bucket int, sizes binary"))
    mean = replace(s, pairs=sum(k.pairs for k in sweeps) / len(sweeps), tables=sum(k.tables for k in sweeps) / len(sweeps))
    return LanguageModel(counts, drawn, settled, first, mean, tuple(sweeps))


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents under a model of those whose crc32(doc_id as text) mod 5 is not 1.

    Adds ``held_out`` and ``train_tokens`` to the columns of ``LanguageModel.score``. A
    null ``doc_id`` counts as the empty text there, and so is learned from.
    """
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    model = fit(docs.filter(~out))
    done = model.score(docs)
    return done.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.settings.tokens).cast("long").alias("train_tokens"), "base_score", "score")
