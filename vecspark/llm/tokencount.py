"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a slice of text, sorted, are a trie: words that share a prefix
stand together. Forward scores are computed level by level, once for each trie node, so
once for each shared prefix; the node where a pre-token ends stores its token count. The
few pre-tokens of more than ``LONG`` bytes are a trie of their own, walked depth first: each
goes on from the scores of the prefix that it shares with the one before.

A unigram model's file gives the log-probabilities of its pieces. A rank file has none; a
piece of rank r gets one proportional to ``1 / (r + 1)`` (Zipf's law, ranks being in order
of frequency). The best-scoring segmentation counts (ties: the longer last piece).
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import textkit as tk
from vecspark.llm.chunks import on_batches, slim

#: Fixed value: the pattern that splits text for the byte-level rank files.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Largest vocabulary file that is broadcast.
MOST_BYTES = 64 << 20
#: Pre-tokens whose counts a worker remembers, and text counted at once.
REMEMBERED, SLICE = 400_000, 1 << 20
#: Bytes beyond which pre-tokens are walked depth first, and positions whose pieces are looked up at once.
LONG, STRETCH = 64, 1 << 16

#: What a byte without a piece of its own scores below the least piece of a unigram model.
UNKNOWN_PENALTY = 10.0
#: How unigram files write a blank and a single byte.
_BLANK, _BYTE = "\u2581", re.compile("<0x([0-9A-F]{2})>")

_BASE = 0x9E3779B97F4A7C15


class Vocabulary:
    """Different pieces, by length and hash, with their log-probabilities (by default, those of ranks)."""

    def __init__(self, pieces: list[bytes], scores: list[float] | None = None):
        known = set(pieces)
        if not all(bytes([b]) in known for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        if scores is None:
            score = -np.log(np.arange(1, len(pieces) + 1)) - np.log((1 / np.arange(1, len(pieces) + 1)).sum())
        else:
            score = np.asarray(scores, np.float64)
            if len(score) != len(pieces) or not np.isfinite(score).all():
                raise ValueError("every piece needs one finite score")
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        #: Names the vocabulary by its content.
        self.key = hashlib.blake2b(b"".join(len(p).to_bytes(4, "little") + p for p in pieces) + score.tobytes(), digest_size=16).hexdigest()
        sizes = np.array([len(p) for p in pieces])
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            flat = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8)
            hashes = _spans(_sums(flat), np.arange(len(own)) * n, n)
            order = np.argsort(hashes)
            table = np.zeros(1 << 18, bool)
            table[(hashes >> np.uint64(46)).astype(np.int64)] = True
            self.by_length.append((n, hashes[order], score[own][order], table))

    @staticmethod
    def load(path: str) -> Vocabulary:
        """A file of lines ``base64(piece) rank``, or (``.json``) a unigram model of the ``tokenizers`` library."""
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"{path} is over {MOST_BYTES} bytes")
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                return Vocabulary.of_unigram(json.load(f)["model"])
        with open(path, "rb") as f:
            ranks = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f))
        return Vocabulary([piece for _, piece in ranks])

    @staticmethod
    def of_unigram(model: dict) -> Vocabulary:
        """The pieces of a unigram model with their log-probabilities; its unknown piece is left out.

        Bytes without a piece score ``UNKNOWN_PENALTY`` below the least; of equal pieces the likelier counts.
        """
        if model.get("type") != "Unigram":
            raise ValueError("the file holds no unigram model")
        scores: dict[bytes, float] = {}
        for i, (text, score) in enumerate(model["vocab"]):
            if i != model.get("unk_id") and text:
                piece = bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(text)) else text.replace(_BLANK, " ").encode()
                scores[piece] = max(score, scores.get(piece, score))
        least = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        scores = {bytes([b]): least for b in range(256)} | scores
        return Vocabulary(list(scores), list(scores.values()))


def _sums(flat: np.ndarray) -> np.ndarray:
    up, _ = tk.powers(_BASE, len(flat) + 1)
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def _spans(sums: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    _, down = tk.powers(_BASE, len(sums))
    return tk.mix64((sums[start + n] - sums[start]) * down[start] ^ np.uint64(n * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))


def count_tokens(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each of the distinct words, which are sorted."""
    long = np.array([len(w) > LONG for w in words], bool)
    out = np.zeros(len(words), np.int64)
    out[~long] = _by_level([w for w in words if len(w) <= LONG], vocabulary)
    out[long] = _depth_first([w for w in words if len(w) > LONG], vocabulary)
    return out


def _depth_first(words: list[bytes], vocabulary: Vocabulary) -> list[int]:
    """The same, word after word; forward scores and token counts of the last word's prefixes are kept."""
    out: list[int] = []
    score, tokens, last = [0.0], [0], np.zeros(0, np.uint8)
    for word in words:
        flat = np.frombuffer(word, np.uint8)
        differ = np.flatnonzero(flat[: len(last)] != last[: len(flat)])
        shared = int(differ[0]) if len(differ) else min(len(flat), len(last))
        del score[shared + 1 :], tokens[shared + 1 :]
        sums = _sums(flat)
        for lo in range(shared, len(flat), STRETCH):
            hi = min(len(flat), lo + STRETCH)
            ends, sizes, gains = [], [], []
            for n, hashes, scores, table in reversed(vocabulary.by_length):
                start = np.arange(max(0, lo + 1 - n), hi + 1 - n)
                h = _spans(sums, start, n)
                may = np.flatnonzero(table[(h >> np.uint64(46)).astype(np.int64)])
                at = np.minimum(np.searchsorted(hashes, h[may]), len(hashes) - 1)
                hit = hashes[at] == h[may]
                ends.append(start[may[hit]] + n)
                sizes.append(np.full(len(ends[-1]), n))
                gains.append(scores[at[hit]])
            end = np.concatenate(ends)
            order = np.argsort(end, kind="stable")  # of one end, the longest piece first
            for e, n, gain in zip(end[order].tolist(), np.concatenate(sizes)[order].tolist(), np.concatenate(gains)[order].tolist(), strict=True):
                total = score[e - n] + gain
                if e == len(score):
                    score.append(total)
                    tokens.append(tokens[e - n] + 1)
                elif total > score[e]:
                    score[e], tokens[e] = total, tokens[e - n] + 1
        out.append(tokens[len(flat)])
        last = flat
    return out


def _by_level(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    if not len(words):
        return out
    flat = np.frombuffer(b"".join(words), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    sums = _sums(flat)
    deepest = vocabulary.by_length[-1][0]
    live = np.arange(len(words))
    #: By depth: the node of each word, and of each node its forward score and token count.
    node_of = {0: np.zeros(len(words), np.int64)}
    score, tokens = {0: np.zeros(1)}, {0: np.zeros(1, np.int64)}
    depth = 0
    while len(live):
        depth += 1
        live = live[sizes[live] >= depth]
        if not len(live):
            break
        letter, parent = flat[begin[live] + depth - 1], node_of[depth - 1][live]
        new = np.concatenate(([True], (letter[1:] != letter[:-1]) | (parent[1:] != parent[:-1])))
        node_of[depth] = np.zeros(len(words), np.int64)
        node_of[depth][live] = np.cumsum(new) - 1
        head = live[new]
        best, best_n = np.full(len(head), -np.inf), np.zeros(len(head), np.int64)
        for n, hashes, scores, table in reversed(vocabulary.by_length):
            if n > depth:
                continue
            h = _spans(sums, begin[head] + depth - n, n)
            may = np.flatnonzero(table[(h >> np.uint64(46)).astype(np.int64)])
            at = np.minimum(np.searchsorted(hashes, h[may]), len(hashes) - 1)
            hit = hashes[at] == h[may]
            may, at = may[hit], at[hit]
            before = node_of[depth - n][head[may]]
            total = score[depth - n][before] + scores[at]
            better = total > best[may]
            may = may[better]
            best[may], best_n[may] = total[better], tokens[depth - n][before[better]] + 1
        score[depth], tokens[depth] = best, best_n
        ended = live[sizes[live] == depth]
        out[ended] = best_n[node_of[depth][ended]]
        for kept in (node_of, score, tokens):
            kept.pop(depth - deepest, None)
    return out


_known: dict[str, int] = {}
_known_by: str | None = None
_pattern = None


def _counts(shared, pattern: str, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    global _pattern, _known_by
    import regex

    if _pattern is None or _pattern.pattern != pattern:
        _pattern = regex.compile(pattern)
    if _known_by != shared.key:
        _known.clear()
        _known_by = shared.key
    for part in tk.slices(batch, "text", SLICE):
        found = [_pattern.findall(t) if t else [] for t in part.column(1).to_pylist()]
        distinct = set().union(*found)
        if len(_known) + len(distinct) > REMEMBERED:
            _known.clear()
        fresh = sorted(w.encode() for w in distinct - _known.keys())
        _known.update(zip((w.decode() for w in fresh), count_tokens(fresh, shared.value).tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([sum(map(_known.__getitem__, x)) for x in found], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])


class _Shared:
    """A broadcast vocabulary with the key that workers keep counts by."""

    def __init__(self, broadcast, key: str):
        self._broadcast, self.key = broadcast, key

    @property
    def value(self) -> Vocabulary:
        return self._broadcast.value


def token_counts(docs: DataFrame, vocabulary: Vocabulary, pattern: str = PRETOKENS) -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens`` of every whole text, with no shuffle.

    Null and empty texts have no tokens; a null ``doc_id`` is returned as null; repeated
    rows count alike; columns other than ``doc_id`` and ``text`` are ignored; an empty
    table gives an empty result. The vocabulary is of checked size.
    """
    docs = slim(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.mapInArrow(on_batches(_counts, _Shared(sent, vocabulary.key), pattern), "doc_id long, n_pretokens long, n_tokens long")
