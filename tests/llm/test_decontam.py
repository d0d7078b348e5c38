import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, frame, rows
from vecspark.llm import decontam
from vecspark.llm.decontam import contaminated, remove_contaminated, tile

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def brute_tiles(a, b, k):
    """Greedy string tiling by definition: mark the longest unmarked match until none of k is left."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return out
        out.append((i, j, n))
        ma[i : i + n], mb[j : j + n] = [True] * n, [True] * n


def brute(docs, items, k=5, least=0.5):
    out = []
    for d, text, *_ in docs:
        for i, t in items:
            a, b = words(text), words(t)
            n = min(k, len(b))
            if n and (found := brute_tiles(a, b, n)) and sum(x[2] for x in found) >= least * len(b):
                out.append((d, i, len(b), sum(x[2] for x in found), len(found)))
    return sorted(out, key=str)


def case(seed=2):
    rng = random.Random(seed)
    word = ["v%d" % i for i in range(60)]
    prose = lambda n: [rng.choice(word) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(15, 40)))) for i in range(12)] + [(50, "two words"), (51, ""), (52, None), (None, "é! Été, où?")]
    docs = []
    for i in range(40):
        own = items[rng.randrange(12)][1].split()
        cut = rng.randint(3, len(own) - 3)
        body = [own, own[cut:] + prose(4) + own[:cut], own[: len(own) // 3], own[cut:] + own[cut:], []][i % 5]
        text = " ".join(prose(rng.randint(0, 30)) + body + prose(rng.randint(0, 30)))
        docs.append((i, text.upper() + "." if i % 3 else text, None, None, None))
    return [*docs, (100, "here are Two, words.", "", "", 0), (101, "and é ÉTÉ où", "", "", 0)], items


def test_matches_brute_force(spark):
    docs, items = case()
    got = contaminated(frame(spark, docs).withColumn("item_id", F.lit(1)), spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit("x")))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(docs, items)
    flagged = {r[0] for r in brute(docs, items)}
    kept = remove_contaminated(frame(spark, docs), spark.createDataFrame(items, ITEMS))
    assert kept.columns == DOCS.names and {r["doc_id"] for r in kept.collect()} == {d[0] for d in docs} - flagged


def test_blocks_agree(spark, monkeypatch):
    docs, items = case(4)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    got = contaminated(frame(spark, docs), spark.createDataFrame(items, ITEMS))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(docs, items)


def test_tiles_match_definition():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, 25).tolist(), rng.integers(0, 4, 15).tolist()
        pairs = [(i, j) for i in range(23) for j in range(13) if a[i : i + 3] == b[j : j + 3]]
        assert tile(np.array(pairs).reshape(-1, 2), 3) == brute_tiles(a, b, 3)


def test_awkward_and_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    assert contaminated(frame(spark), none).collect() == []
    assert remove_contaminated(frame(spark), none).count() == len(rows())
    some = spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    assert contaminated(spark.createDataFrame([], DOCS), some).collect() == []
    assert remove_contaminated(frame(spark), some).count() == len(rows())


def test_repeated_words_and_blocks(spark, monkeypatch):
    """A text of one word against an item of the same, and both ways of tiling."""
    import time

    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(150):
        a, b = (rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        pairs = np.array([(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if (a[i : i + 3] == b[j : j + 3]).all()], np.int64).reshape(-1, 2)
        assert decontam.tile(pairs, 3) == decontam.tile_by_length(a, b, 3)
    began = time.time()
    docs = frame(spark, [(1, "spam " * 200_000, None, None, None), (2, "spam " * 300 + "egg", None, None, None), (3, "egg", None, None, None)])
    bench = spark.createDataFrame([(7, "spam " * 400)] * 3, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_covered"], r["n_tiles"]) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(1, 7, 400, 1)] * 3 + [(2, 7, 300, 1)] * 3 and time.time() - began < 60
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    assert sorted((r["doc_id"], r["item_id"], r["n_covered"], r["n_tiles"]) for r in decontam.contaminated(docs, bench).collect()) == got
