import math
import random

import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, frame, rows
from vecspark.llm.tokencount import PRETOKENS, Vocabulary, count_tokens, token_counts


def pieces(seed=1):
    rng = random.Random(seed)
    made = [bytes([b]) for b in range(256)]
    more = {"".join(rng.choice("abcdeéf ß") for _ in range(rng.randint(2, 6))).encode() for _ in range(400)}
    return made + sorted(more - set(made))


def brute(word, ranks, total):
    """Best segmentation of one word by the plain forward pass."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if word[start:end] in ranks:
                s = best[start][0] - math.log(ranks[word[start:end]] + 1) - total
                if s > best[end][0] + 1e-9:
                    best[end] = (s, best[start][1] + 1)
    return best[-1][1]


@pytest.fixture(scope="module")
def vocabulary():
    p = pieces()
    return Vocabulary(p), {x: i for i, x in enumerate(p)}, math.log(sum(1 / (i + 1) for i in range(len(p))))


def test_words_match_the_plain_forward_pass(vocabulary):
    v, ranks, total = vocabulary
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdeéf ßz") for _ in range(rng.randint(1, 14))).encode() for _ in range(800)} | {b"a" * 300, b"a" * 299})
    assert count_tokens(words, v).tolist() == [brute(w, ranks, total) for w in words]
    assert count_tokens([], v).tolist() == []


def test_documents(spark, vocabulary):
    v, ranks, total = vocabulary
    data = rows()
    want = []
    for r in data:
        found = regex.findall(PRETOKENS, r[1] or "")
        want.append((r[0], len(found), sum(brute(w.encode(), ranks, total) for w in found)))
    got = token_counts(frame(spark, data).withColumn("n_tokens", F.lit("x")), v).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(spark.createDataFrame([], DOCS), v).collect() == []


def test_vocabulary_must_be_complete(tmp_path, monkeypatch):
    from vecspark.llm import tokencount

    with pytest.raises(ValueError):
        Vocabulary([b"a"])
    f = tmp_path / "v"
    f.write_bytes(b"YQ== 0\n")
    monkeypatch.setattr(tokencount, "MOST_BYTES", 3)
    with pytest.raises(ValueError):
        Vocabulary.load(str(f))


def test_long_pretokens_share_prefixes_and_are_quick(monkeypatch):
    import random
    import time

    import numpy as np

    from vecspark.llm import tokencount

    rng = random.Random(6)
    pieces = [bytes([b]) for b in range(256)] + sorted({bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(60)})
    own = tokencount.Vocabulary(pieces)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 30))) for _ in range(200)} | {b"abcab" * n for n in range(1, 9)})
    want = tokencount._by_level(words, own)
    assert np.array_equal(tokencount._depth_first(words, own), want)
    monkeypatch.setattr(tokencount, "STRETCH", 5)
    assert np.array_equal(tokencount._depth_first(words, own), want)
    monkeypatch.undo()
    began = time.time()
    long = bytes(rng.choices(b"abcdefgh", k=1_000_000))
    assert tokencount.count_tokens(sorted([long, long[:-1], b"ab"]), own)[-1] > 0 and time.time() - began < 30
    assert tokencount.Vocabulary(pieces).key == own.key != tokencount.Vocabulary(pieces[:256]).key


def test_unigram_files_agree_with_the_library(tmp_path):
    """Against the Viterbi search of another implementation, whose scores are given, not trained."""
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    rng = random.Random(8)
    texts = sorted({"".join(rng.choices("abcd\u2581é", k=rng.randint(2, 6))) for _ in range(200)})
    vocab = [("<unk>", 0.0), *((c, -12 - rng.random()) for c in "abcd\u2581é"), *((t, -6 * rng.random() - len(t)) for t in texts)]
    other = Tokenizer(Unigram(vocab, unk_id=0))
    path = str(tmp_path / "unigram.json")
    other.save(path)
    own = Vocabulary.load(path)
    words = {"".join(rng.choices("abcd é", k=rng.randint(1, n))) for n in (8, 40, 150) for _ in range(200)}
    words = sorted(words, key=str.encode)
    got = count_tokens([w.encode() for w in words], own)
    assert got.tolist() == [len(other.encode(w.replace(" ", "\u2581")).ids) for w in words]
    # Unknown bytes count one by one.
    assert count_tokens([b"xy"], own).tolist() == [2]
    assert own.key != Vocabulary([bytes([b]) for b in range(256)]).key
    with pytest.raises(ValueError):
        Vocabulary.of_unigram({"type": "BPE"})
    with pytest.raises(ValueError):
        Vocabulary([bytes([b]) for b in range(256)], [0.0])
