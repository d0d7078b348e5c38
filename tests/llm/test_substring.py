import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, frame, rows
from vecspark.llm.substring import remove_repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(data, k):
    words = [WORD.findall(r[1] or "") for r in data]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for r, w in zip(data, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone |= set(range(i, i + k))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    data = rows()
    for k in (35, 5, 1):
        got = remove_repeated_windows(frame(spark, data), k).select("doc_id", "n_words", "n_removed", "kept_text").collect()
        assert sorted(map(tuple, got), key=str) == brute(data, k)


def test_spans_are_maximal_and_extra_columns_are_ignored(spark):
    data = [(1, "x a b c d y", "", "", 0), (2, "a b c d", "", "", 0), (3, "q", "", "", 0)]
    docs = frame(spark, data).withColumn("n_words", F.lit("x")).withColumn("__chunk", F.lit(1)).withColumn("bucket", F.lit(2))
    got = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in remove_repeated_windows(docs, 2).collect()}
    assert got == {1: [(1, 5)], 2: [(0, 4)], 3: []}


def test_empty_table(spark):
    assert remove_repeated_windows(spark.createDataFrame([], DOCS)).collect() == []


def test_equal_rows_are_spread_over_chunks(spark):
    """A row that is repeated throughout the table is in as many chunks as the table has partitions, or nearly."""
    from vecspark.llm.chunks import in_chunks

    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.range(0, 20_000, 1, 16).selectExpr("cast(null as long) as doc_id", f"'{text}' as text")
    sizes = [r["count"] for r in in_chunks(docs, 64).groupBy("__chunk").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 4 * 20_000 // 16
    got = remove_repeated_windows(docs).groupBy("n_words", "n_removed").count().collect()
    assert [tuple(r) for r in got] == [(40, 40, 20_000)]
