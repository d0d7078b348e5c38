import random

import pytest

import corpus_pipeline
from tests.llm.fixtures import DOCS, frame
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_langid import prose
from tests.llm.test_mixing import WORD, water
from tests.llm.test_neardup import brute as groups

SECRET = 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"'


def corpus():
    rng = random.Random(3)
    data = [(i, t, lang, f"s{i % 4}", n) for i, t, lang, _, n in prose(5, 260)]
    long = [r for r in data if len(r[1].split()) > 30]
    out = list(data)
    for k, r in enumerate(long[:12]):
        out.append((1000 + k, r[1], r[2], "s1", r[4]))
        w = r[1].split()
        w[rng.randrange(len(w))] = "other"
        out.append((1100 + k, " ".join([*w, *w[:1]]), r[2], "s2", None))
    items = [(k, " ".join(r[1].split()[:20])) for k, r in enumerate(long[40:43])]
    out += [(1200 + k, long[50 + k][1] + " " + t, "aa", "s0", 0) for k, t in items]
    out += [(1300, "  ".join(long[20][1].split()[::-1]) + " " + SECRET, "aa", "s0", 0), (1400, "?! 12", "aa", "s0", 5), (1401, None, None, None, None), (None, long[25][1] + " more", "bb", None, 1), out[5], out[5]]
    return out, items


def test_stages_match_brute_force(spark, tmp_path):
    data, items = corpus()
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = [tuple(r) for r in docs.collect()]
        if k < 4:
            assert docs.columns == DOCS.names
    rows = seen["language_id"]
    assert {r[0] for r in data} - {r[0] for r in rows} == {1400, 1401}
    kept = {r[0] for r in groups(rows) if r[3]}
    after = seen["near_dedup"]
    assert sorted((r[0] for r in after), key=str) == sorted(kept, key=str) and not kept & set(range(1000, 1012))
    assert len(kept & set(range(1100, 1112))) < 12
    rows, after = after, seen["decontaminate"]
    bad = {r[0] for r in leaks(rows, items)}
    assert {1200, 1201, 1202} <= bad and {r[0] for r in after} == {r[0] for r in rows} - bad
    rows, after = after, seen["secrets"]
    assert len(after) == len(rows) and "token" not in next(r[1] for r in after if r[0] == 1300)
    assert all(r in after for r in rows if r[0] != 1300)
    size = {}
    for r in after:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = water(size)
    for s in size:
        taken = sum(len(WORD.findall(r[1])) for r in seen["mix_sources"] if r[3] == s)
        assert abs(taken - want[s]) <= 1 + max(len(WORD.findall(r[1])) for r in after if r[3] == s)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, again.collect()))) == sorted(map(str, seen["mix_sources"]))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_names_are_distinct(name):
    assert [n for n, _ in corpus_pipeline.STAGES].count(name) == 1
