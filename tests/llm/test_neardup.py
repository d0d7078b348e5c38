import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, frame, rows
from vecspark.llm import neardup
from vecspark.llm.graph import components
from vecspark.llm.neardup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(data):
    own = [sets(r[1]) for r in data]
    parent = {r[0]: r[0] for r in data if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(own):
        for j in range(i):
            both = len(x & own[j])
            if x and data[i][0] is not None and data[j][0] is not None and 100 * both >= 75 * len(x | own[j]) and both:
                a, b = sorted((find(data[i][0]), find(data[j][0])))
                parent[b] = a
    return sorted(((r[0], len(s), None if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0]) for r, s in zip(data, own, strict=True)), key=str)


def near(seed=3):
    """A chain of drifting versions, a hub with spokes that are unlike each other, and upper-case copies."""
    rng = random.Random(seed)
    word = ["w%d" % i for i in range(5000)]
    base = [rng.choice(word) for _ in range(120)]
    texts, chain = [], list(base)
    for _ in range(12):
        texts.append(" ".join(chain))
        at = rng.randrange(100)
        chain[at : at + 6] = [rng.choice(word) for _ in range(6)]
    hub = [rng.choice(word) for _ in range(200)]
    texts.append(" ".join(hub))
    for i in range(30):
        own = list(hub)
        at = 6 * i
        own[at : at + 18] = [rng.choice(word) for _ in range(18)]
        texts.append(" ".join(own))
    texts += [texts[0].upper(), texts[-1].upper()]
    return [(500 + i, x, None, None, None) for i, x in enumerate(texts)]


@pytest.mark.parametrize("data", [rows(), near(), near(9) + rows(2), [(1, "a b c d e f", "", "", 0), (1, "q r s t u v", "", "", 0), (0, "q r s t u v", "", "", 0)]])
def test_matches_brute_force(spark, data):
    got = near_duplicates(frame(spark, data).withColumn("node", F.lit(1)).withColumn("key", F.lit("x"))).collect()
    assert sorted(map(tuple, got), key=str) == brute(data)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    data = near(5)
    for name, value in (("BLOCK", 3), ("BLOCK_SHINGLES", 700)):
        monkeypatch.setattr(neardup, name, value)
        got = near_duplicates(frame(spark, data)).collect()
        assert sorted(map(tuple, got), key=str) == brute(data)


def test_members_of_one_component_are_copied_once_for_a_block_of_others(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 20)
    hot = [(1, i, 10, 0 if i >= 15 else i) for i in range(2000)]
    known = spark.createDataFrame([*hot, (2, 5000, 3, 1), (2, 5001, 3, 2), (2, 5002, 3, 1), (3, 1, 3, 1), (3, 2, 3, 1), (3, 3, 3, 1)], "key long, node long, n int, comp long")
    got = neardup._met(known).collect()
    assert sorted(r["node"] for r in got if r["key"] == 2 and r["alone"]) == [5000, 5001, 5002]
    assert not [r for r in got if r["key"] == 3]
    copies, pairs = {}, {}
    for r in got:
        if r["key"] == 1:
            copies[r["node"]] = copies.get(r["node"], 0) + 1
            pairs.setdefault((r["i"], r["j"]), []).append(r)
    assert all(copies[i] == 1 for i in (0, *range(15, 2000)))
    assert all(copies[i] <= 102 for i in range(1, 15)) and len(pairs) <= 102
    met = {(a["node"], b["node"]) for rows_ in pairs.values() for a in rows_ if a["comp"] for b in rows_ if a["comp"] != b["comp"]}
    assert met == {(a, b) for a in range(1, 15) for b in range(2000) if hot[a][3] != hot[b][3]}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    for share in (0.2, 0.6, 0.9):
        both = int(1000 * 2 * share / (1 + share))
        b = np.concatenate([a[:both], rng.integers(0, 1 << 63, 1000 - both).astype(np.uint64)])
        s = neardup.fast_sketches(np.concatenate([a, b]), np.array([0, 1000, 2000]), 1024)
        assert (s != neardup._EMPTY).all()
        assert abs((s[0] == s[1]).mean() - both / (2000 - both)) < 0.06
    few = neardup.fast_sketches(a[:3], np.array([0, 1, 3]), 160)
    assert (few != neardup._EMPTY).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3), (900, 901)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 150)} | {901: 900}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_id_filter_keeps_every_wanted_row(spark, monkeypatch):
    from vecspark.llm import idfilter

    rows_ = spark.range(5000).withColumn("text", F.lit("x")).unionByName(spark.createDataFrame([(None, "n")], "id long, text string"))
    wanted = spark.createDataFrame([(i * 37 - 5000,) for i in range(200)], "id long")
    for most in (1 << 28, 1 << 19):
        monkeypatch.setattr(idfilter, "MOST_BITS", most)
        got = {r["id"] for r in idfilter.likely_rows(rows_, wanted, "id").collect()}
        assert {i * 37 - 5000 for i in range(200)} & set(range(5000)) <= got and None not in got and len(got) < 400
    assert idfilter.likely_rows(rows_, wanted.limit(0), "id").count() == 0
