import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, frame, rows
from vecspark.llm.mixing import allocate, mix, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights=(3, 1, 2)):
    """Targets by repeated sharing of the excess, in exact arithmetic."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        out = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if out[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **out}
        fixed |= {s: Fraction(2 * sizes[s]) for s in over}


def check(got, data):
    size = {}
    for r in data:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = water(size)
    taken, n = Counter(), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        n[r["source"]] = max(n[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= n[s] + 1
    assert len(got) == len(data)


def test_targets_are_met_within_one_document(spark):
    data = [r for r in rows() if r[0] is not None]
    check(allocate(frame(spark, data).withColumn("size", F.lit("x")).withColumn("copies", F.lit(1))).collect(), data)
    many = [(i, "w " * (1 + i * 37 % 211), "", f"s{i % 13}" if i % 3 else "hot", 0) for i in range(600)]
    check(allocate(frame(spark, many)).collect(), many)


def test_nulls_and_repeated_rows(spark):
    data = rows() + [(None, f"x {i} " * 5, "", "nulls", 0) for i in range(200)] + [(7777, "same words here", "", "dup", 0)] * 9
    got = allocate(frame(spark, data)).collect()
    assert len(got) == len(data) and all(0 <= r["copies"] <= 2 for r in got)
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r["source"]][0] += r["copies"] * r["size"]
        by[r["source"]][1] = r["target"]
    assert abs(by["nulls"][0] - by["nulls"][1]) < 0.15 * by["nulls"][1]


def test_mix_emits_the_copies_and_reruns_agree(spark):
    data = [r for r in rows() if r[0] is not None][:60]
    docs = frame(spark, data)
    copies = {r["doc_id"]: r["copies"] for r in allocate(docs).collect()}
    a = mix(docs)
    assert a.columns == [*docs.columns, "copy"]
    first = sorted(map(str, a.collect()))
    assert Counter(r["doc_id"] for r in a.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert first == sorted(map(str, mix(docs).collect()))
    clash = mix(docs.withColumns({c: F.lit("mine") for c in ("copy", "copies", "size", "target", "id", "src", "same")}))
    assert clash.columns[-1] == "copy_" and clash.filter("copy = 'mine' and copies = 'mine' and size = 'mine' and target = 'mine'").count() == len(first)


def test_targets_of_no_words_and_empty_table(spark):
    sizes = spark.createDataFrame([("a", 0), ("b", 0), (None, 0)], "source string, source_size long")
    assert {r["target"] for r in source_targets(sizes).collect()} == {0.0}
    assert allocate(spark.createDataFrame([], DOCS)).collect() == []
    assert mix(spark.createDataFrame([], DOCS)).collect() == []
    assert all(r["copies"] == 0 for r in allocate(frame(spark, [(1, None, "", "a", 0), (2, " ", "", None, 0)])).collect())


def test_a_thousand_equal_rows_keep_to_the_target(spark):
    """Copies of rows alike differ by one at most and add up to the target."""
    for text in ("one two", "three four", "five six"):
        data = [(None, text, None, "a", 1)] * 1000 + [(i, "seven eight", None, "b", 1) for i in range(2000)]
        got = allocate(frame(spark, data)).filter("source = 'a'").collect()
        target = got[0]["target"]
        taken = [r["copies"] for r in got]
        assert len(got) == 1000 and max(taken) - min(taken) <= 1 and abs(sum(taken) * 2 - target) <= 2
        mixed = mix(frame(spark, data)).filter("source = 'a'").count()
        assert mixed == sum(taken)
