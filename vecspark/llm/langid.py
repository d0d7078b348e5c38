"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character n-grams of length 1 to 3 over lowered letters (everything else is a
blank), hashed into ``2**FEATURE_BITS`` slots; a slot weighs its share of the text's n-grams
times its inverse document frequency. Document frequencies cover all training documents.
The weights are learned on a bounded sample (``SAMPLE`` documents a language) by the
follow-the-regularised-leader proximal method with elastic-net penalties, and a temperature
fitted on every fifth sampled document calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm import textkit as tk
from vecspark.llm.chunks import bounded, on_batches, on_group, slim

FEATURE_BITS, LONGEST = 16, 3
#: Bound of the fitted sample: different texts of each language.
SAMPLE = 400
#: Languages that a model may have; each is a row of weights sent to all tasks (64 MB at most).
MOST_LANGUAGES = 128
UNKNOWN = "und"
EPOCHS, RATE, SMOOTH, L1, L2 = 4, 0.5, 1.0, 1e-4, 1e-4
_SLOTS = 1 << FEATURE_BITS
_SCALE = 50.0
_RANGES = 16
_SLICE = 1 << 20

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_slots(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length, the slots of all texts in order and the bounds of each text; first, letters per text."""
    buf, offs = tk.text_buffer(pc.utf8_lower(column.cast(pa.large_string())))
    starts = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offs]
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    letter = _is_letter()[points]
    total = np.concatenate(([0], np.cumsum(letter)))
    yield total[starts[1:]] - total[starts[:-1]], starts
    clean = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    inner = starts[:-1][starts[:-1] < len(points)]
    keep[inner] = letter[inner]
    kept = np.concatenate(([0], np.cumsum(keep)))
    clean, bounds = clean[keep], kept[starts]
    rolled = np.zeros(len(clean), np.uint64)
    for n in range(1, LONGEST + 1):
        rolled = (rolled[: len(clean) - n + 1] * np.uint64(0x100000001B3) + clean[n - 1 :]) if n > 1 else clean.copy()
        slots = ((rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        ends = np.minimum(np.maximum(bounds[1:] - n + 1, bounds[:-1]), len(slots))
        yield slots, np.stack([np.minimum(bounds[:-1], len(slots)), ends])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of one partition, in ranges of slots."""
    df, any_row = np.zeros(_SLOTS), False
    for batch in batches:
        for part in tk.slices(batch, "text", _SLICE):
            any_row = True
            grams = ngram_slots(part.column(0))
            next(grams)
            grams = list(grams)
            for d in range(part.num_rows):
                seen = np.zeros(_SLOTS, bool)
                for slots, at in grams:
                    seen[slots[at[0, d] : at[1, d]]] = True
                df[np.flatnonzero(seen)] += 1
    if any_row:
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(_RANGES), pa.int32()), "df": [x.tobytes() for x in df.reshape(_RANGES, -1)]})


def _add(key: tuple, table: pa.Table) -> pa.Table:
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "df": pa.array([sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("df")).tobytes()], pa.binary())})


def _features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in tk.slices(batch, "text", _SLICE):
        grams = ngram_slots(part.column(0))
        next(grams)
        grams = list(grams)
        slots, counts = [], []
        for d in range(part.num_rows):
            s, n = np.unique(np.concatenate([x[at[0, d] : at[1, d]] for x, at in grams]), return_counts=True)
            slots.append(s.astype(np.int32))
            counts.append(n.astype(np.int32))
        yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["lang", "spot", "slots", "counts"])


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, slots: int = _SLOTS, epochs: int = EPOCHS, rate: float = RATE, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights (classes x slots + 1, the last a bias) of a softmax regression, by FTRL-proximal steps.

    Each example is its slots, their values, and its class. A coordinate whose gathered
    gradient stays within ``l1`` has weight zero.
    """
    z, n = np.zeros((classes, slots + 1)), np.zeros((classes, slots + 1))

    def weights(at):
        return np.where(np.abs(z[:, at]) <= l1, 0.0, -(z[:, at] - np.sign(z[:, at]) * l1) / ((SMOOTH + np.sqrt(n[:, at])) / rate + l2))

    for _ in range(epochs):
        for at, x, y in examples:
            at, x = np.append(at, slots), np.append(x, 1.0)
            w = weights(at)
            p = w @ x
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            z[:, at] += g - (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / rate * w
            n[:, at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log-loss, on a fine grid.

    A share of ``1 / (n + 2)`` of each target goes to the other classes, so that a sample
    without errors doesn't claim certainty.
    """
    best, out = np.inf, 1.0
    if not len(logits) or logits.shape[1] < 2:
        return out
    rows, k = logits.shape
    target = np.full((rows, k), 1 / (rows + 2) / (k - 1))
    target[np.arange(rows), classes] = 1 - 1 / (rows + 2)
    for t in np.geomspace(0.05, 20, 200):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        loss = (np.log(np.exp(x).sum(axis=1)) - (target * x).sum(axis=1)).mean()
        if loss < best - 1e-12:
            best, out = loss, float(t)
    return out


@dataclass
class LanguageModel:
    """Learned languages and, for each, the weight of one n-gram (already times idf, over temperature) and a bias."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray


def _examples(rows: list, weight: np.ndarray, languages: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    out = []
    for r in rows:
        at = np.array(r["slots"], np.int64)
        n = np.array(r["counts"], np.float64)
        out.append((at, _SCALE * n / max(1.0, n.sum()) * weight[at], languages.index(r["lang"])))
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learns from ``text`` and ``lang`` of all rows where both are given.

    ``lang`` values other than null are the languages; more than ``MOST_LANGUAGES`` raise.
    The sample is the ``sample`` different texts of each language with the least hashes, so
    it is the same at every run, and a text repeated at will counts once.
    """
    known = bounded(docs).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    spot = F.xxhash64("text", F.lit(1))
    totals = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(spot).alias("texts")).limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"there are more than {MOST_LANGUAGES} languages")
    counts = {r["lang"]: r["n"] for r in totals}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((0, _SLOTS)), np.zeros(0))
    parts = known.select("text").mapInArrow(_frequencies, "part int, df binary").groupBy("part").applyInArrow(on_group(_add), "part int, df binary")
    df = np.zeros((_RANGES, _SLOTS // _RANGES))
    for r in parts.collect():
        df[r["part"]] = np.frombuffer(r["df"], np.float64)
    weight = np.log((1 + sum(counts.values())) / (1 + df.ravel())) + 1
    # Twice the share that is wanted surely holds the least hashes; of these each text is taken once, then the first.
    share = {r["lang"]: min(1.0, 2 * (sample + 50) / max(1, r["texts"])) for r in totals}
    top = F.create_map(*(F.lit(x) for k in languages for x in (k, share[k])))
    near = known.withColumn("spot", spot).filter((F.col("spot").cast("double") / 2.0**64 + 0.5) < top[F.col("lang")])
    once = near.groupBy("lang", "spot").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("spot"))
    picked = once.withColumn("nth", first).filter(F.col("nth") <= sample).select("text", "lang", "spot")
    rows = picked.mapInArrow(on_batches(_features), "lang string, spot long, slots array<int>, counts array<int>").collect()
    rows = sorted(rows, key=lambda r: ((r["spot"] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, r["lang"]))
    made = _examples(rows, weight, languages)
    held = [e for i, e in enumerate(made) if i % 5 == 0] if len(made) >= 20 else made
    w = ftrl([e for i, e in enumerate(made) if i % 5] if len(made) >= 20 else made, len(languages))
    logits = np.array([w[:, at] @ x + w[:, -1] for at, x, _ in held])
    t = temperature(logits, np.array([y for *_, y in held]))
    return LanguageModel(languages, w[:, :-1] * weight * _SCALE / t, w[:, -1] / t)


def _predicted(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text."""
    rows, k = len(column), len(model.languages)
    grams = ngram_slots(column)
    letters, _ = next(grams)
    logits, total = np.zeros((k, rows)), np.zeros(rows)
    for slots, at in grams:
        size = at[1] - at[0]
        full = np.flatnonzero(size > 0)
        if not len(full):
            continue
        total[full] += size[full]
        cuts = np.stack([at[0, full], at[1, full]], axis=1).ravel()
        if cuts[-1] == len(slots):
            cuts = cuts[:-1]
        for j in range(k):
            logits[j, full] += np.add.reduceat(model.table[j][slots], cuts)[::2]
    logits = logits / np.maximum(total, 1) + model.bias[:, None]
    if not k:
        return [UNKNOWN] * rows, np.zeros(rows)
    p = np.exp(logits - logits.max(axis=0))
    p /= p.sum(axis=0)
    best = p.argmax(axis=0)
    known = letters > 0
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, p.max(axis=0), 0.0)


def _predict(model, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in tk.slices(batch, "text", _SLICE):
        lang, p = _predicted(model.value, part.column(1))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])


def predict(model: LanguageModel, docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (calibrated, 0 to 1) of every whole text; only ``text`` is looked at.

    A null text or one without letters is ``und`` with score 0, as is every text if no
    language was learned. Ties go to the first language by name. A null ``doc_id`` is
    returned as null; repeated rows are predicted alike; an empty table gives an empty result.
    """
    docs = slim(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(on_batches(_predict, shared), "doc_id long, lang_pred string, score double")


def _accepted(model, least: float, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in tk.slices(batch, "text", _SLICE):
        lang, p = _predicted(model.value, part.column(part.schema.get_field_index("text")))
        yield part.filter(pa.array((np.array(lang) != UNKNOWN) & (p >= least)))


def keep_identified(model: LanguageModel, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose language is known with a probability of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(on_batches(_accepted, shared, least), T.StructType(docs.schema.fields))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2 (null: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2
