import math
import random
import re
import tracemalloc
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, frame, rows
from vecspark.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 5 == 1


def test_base_columns_match_brute_force(spark):
    data = rows() + [(900 + i, "Alpha beta ALPHA", None, None, None) for i in range(9)]
    count = Counter(t for r in data if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = sorted(((r[0], held(r[0]), len(tokens(r[1])), sum(count[t] > 0 for t in tokens(r[1])), n) for r in data), key=str)
    got = lm.score_documents(frame(spark, data).withColumn("bucket", F.lit(1)).withColumn("score", F.lit("x"))).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got), key=str) == want
    base = {r["doc_id"]: r["base_score"] for r in got}
    for r in data:
        assert r[0] is None or math.isclose(base[r[0]], sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(r[1])), rel_tol=1e-9)
    assert all(r["score"] < 0 for r in got)


def test_probabilities_sum_to_one_and_beat_unigrams_on_text_with_order(spark):
    train = [(i, " ".join(["the cat sat on the mat", "a dog ran to a park"][i % 2].split() * 5), None, None, None) for i in range(20)]
    model = lm.fit(frame(spark, train))
    vocabulary = "the cat sat on mat a dog ran to park".split()
    ends = {r["n_tokens"]: r["score"] for r in model.score(frame(spark, [(1, "", None, None, None)])).collect()}
    after = {}
    for w in [*vocabulary, "unseen"]:
        s = model.score(frame(spark, [(1, w, None, None, None), (2, f"{w} {w}", None, None, None)]).orderBy("doc_id")).collect()
        after[w] = {r["doc_id"]: r["score"] for r in s}
    # p(w | start) = p("w <end>") / p(<end> | w); the latter cancels in no sum, so compare by the chain of "w w".
    assert ends[1] < 0
    got = model.score(frame(spark, [(1, "the cat sat on the mat", None, None, None), (2, "mat the on sat cat the", None, None, None)])).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["score"] > by[1]["base_score"] and by[1]["score"] > by[2]["score"] + 3


def test_contexts_are_distributions(spark):
    """Over all learned words and the unknown one, each context's probabilities sum to 1."""
    data = [(i, r[1], None, None, None) for i, r in enumerate(rows(4))]
    model = lm.fit(frame(spark, data))
    s = model.settings
    total = np.zeros(lm._CONTEXTS)
    unseen = 0.0
    for r in model.merged.collect():
        b = lm._Bucket(r.asDict(), model.first, model.start[1])
        total += np.bincount(b.context, b.count - s.discount * b.seats, lm._CONTEXTS)
        unseen += lm._parent(b.guests, b.roots, s).sum()
    assert abs(unseen + lm._unknown(s) - 1) < 1e-6
    p = (total + lm.CONCENTRATION + s.discount * model.sampled[1]) / (lm.CONCENTRATION + model.start[0])
    assert np.allclose(p, 1)


def test_groups_do_not_change_what_is_sampled(monkeypatch):
    """The mean weight and the weighted mean of tables are those of seating one by one."""
    size, d = 30000, 0.5
    args = (np.full(size, 700), np.full(size, 40.0), np.full(size, 0.005), d)
    t, w = lm._seat(np.random.default_rng(1), *args)
    monkeypatch.setattr(lm, "_GROUP", 10**9)
    t1, w1 = lm._seat(np.random.default_rng(2), *args)
    scale = w1.max()
    a, b = np.exp(w - scale), np.exp(w1 - scale)
    error = 4 * math.sqrt((a.var() / a.mean() ** 2 + b.var() / b.mean() ** 2) / size)
    assert abs(math.log(a.mean() / b.mean())) < error < 0.2
    mean, mean1 = (a * t).sum() / a.sum(), (b * t1).sum() / b.sum()
    assert abs(mean - mean1) < 5 * math.sqrt((((a / a.mean() * (t - mean)) ** 2).mean() + ((b / b.mean() * (t1 - mean1)) ** 2).mean()) / size)
    assert np.allclose(lm._log_gamma(np.array([0.3, 1.0, 4.5, 40.0, 1e6])), [math.lgamma(x) for x in (0.3, 1.0, 4.5, 40.0, 1e6)], rtol=1e-9, atol=1e-9)


def test_subsets_are_uniform():
    row, at = lm._subsets(np.random.default_rng(3), np.array([5, 5, 4] * 4000), np.array([2, 4, 0] * 4000))
    assert (np.bincount(row % 3, minlength=3) == [8000, 16000, 0]).all()
    for kind, share in ((0, 0.4), (1, 0.8)):
        assert np.allclose(np.bincount(at[row % 3 == kind], minlength=5) / 4000, share, atol=0.04)


def one_by_one(texts, discount, parent_discount, sweeps, asked, seed=0):
    """Mean predictive probabilities of (context, word) pairs, from a sampler that reseats single customers."""
    rng = random.Random(seed)
    pairs = [(u, w) for x in texts for u, w in zip(["^", *tokens(x)], tokens(x), strict=False)]
    vocabulary = len({w for _, w in pairs})
    seats, root = {}, {}
    total, theta = Counter(), lm.CONCENTRATION

    def parent(w):
        own, guests, tables = root.get(w, []), sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(own) - parent_discount * len(own) + (theta + parent_discount * tables) / (vocabulary + 1)) / (theta + guests)

    def sit(tables, new, d):
        """The table a customer takes: its place, or -1 for a new one."""
        x = rng.random() * (sum(tables) - d * len(tables) + new)
        for i, n in enumerate(tables):
            x -= n - d
            if x < 0:
                return i
        return -1

    def add(u, w):
        own = seats.setdefault(u, {}).setdefault(w, [])
        i = sit(own, (theta + discount * sum(map(len, seats[u].values()))) * parent(w), discount)
        if i >= 0:
            own[i] += 1
            return
        own.append(1)
        up = root.setdefault(w, [])
        j = sit(up, (theta + parent_discount * sum(map(len, root.values()))) / (vocabulary + 1), parent_discount)
        if j >= 0:
            up[j] += 1
        else:
            up.append(1)

    def leave(tables):
        """One customer goes; whether a table closes."""
        i = rng.choices(range(len(tables)), tables)[0]
        tables[i] -= 1
        if not tables[i]:
            del tables[i]
            return True
        return False

    for u, w in pairs:
        add(u, w)
    for sweep in range(sweeps):
        for u, w in pairs:
            if leave(seats[u][w]):
                leave(root[w])
            add(u, w)
        if sweep >= sweeps // 5:
            for u, w in asked:
                own = seats.get(u, {})
                tables, customers = sum(map(len, own.values())), sum(map(sum, own.values()))
                here = own.get(w, [])
                total[u, w] += (sum(here) - discount * len(here) + (theta + discount * tables) * parent(w)) / (theta + customers)
    kept = sweeps - sweeps // 5
    return {k: total[k] / kept for k in asked}


def test_scores_agree_with_a_sampler_of_single_customers(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("red blue green fast slow cat dog bird".split(), [9, 5, 3, 3, 2, 2, 1, 1], k=rng.randint(3, 9))) for _ in range(40)]
    model = lm.fit(frame(spark, [(i, x, None, None, None) for i, x in enumerate(texts)]))
    new = ["red blue cat", "green green dog bird", "slow unseen fast red", ""]
    asked = {(u, w) for x in new for u, w in zip(["^", *tokens(x)], tokens(x), strict=False)}
    p = one_by_one(texts, model.settings.discount, model.settings.parent_discount, 60, asked)
    got = {r["doc_id"]: r["score"] for r in model.score(frame(spark, [(i, x, None, None, None) for i, x in enumerate(new)])).collect()}
    for i, x in enumerate(new):
        want = sum(math.log10(p[u, w]) for u, w in zip(["^", *tokens(x)], tokens(x), strict=False))
        assert abs(got[i] - want) < 0.03 * len(tokens(x)) + 0.08, (x, got[i], want)


def test_seating_follows_the_restaurant_rule():
    rng = np.random.default_rng(0)
    n, others, base, d = 3, 4.0, 0.2, 0.5
    tables, _ = lm._seat(rng, np.full(40000, n), np.full(40000, others), np.full(40000, base), d)
    a = (1 + d * (others + 1)) * base
    stay = (1 - d) / (a + 1 - d) * (2 - d) / (a + 2 - d)
    assert abs((tables == 1).mean() - stay) < 0.01
    big, _ = lm._seat(rng, np.array([5000, 5000, 1]), np.full(3, 10.0), np.full(3, 0.01), d)
    assert big[2] == 1 and (big[:2] < 400).all()


def test_reruns_agree_and_empty_tables(spark):
    docs = frame(spark, rows(3))
    a, b = (sorted(map(tuple, lm.score_documents(docs).collect()), key=str) for _ in range(2))
    assert a == b
    assert lm.score_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_each_previous_word_is_a_restaurant_of_its_own(spark):
    """Words whose hashes agree in the first 18 bits do not share a restaurant."""
    seen: dict = {}
    for i in range(4000):
        words = lm._Tokens(pa.array([f"v{i}"])).words
        k = int(lm.tk.mix64(words[(words != lm._END) & (words != lm._START)])[0]) >> (64 - 18)
        if k in seen:
            break
        seen[k] = f"v{i}"
    a, b = seen[k], f"v{i}"
    model = lm.fit(frame(spark, [(i, f"{a} left", None, None, None) for i in range(200)] + [(200 + i, f"{b} right", None, None, None) for i in range(200)]))
    got = {r["doc_id"]: r["score"] for r in model.score(frame(spark, [(1, f"{b} right", None, None, None), (2, f"{b} left", None, None, None)])).collect()}
    customers = [int(n) for r in model.sizes.collect() for n in lm._arrays(r["sizes"])[1]]
    assert sorted(customers) == [200, 200, 200, 200, 400]
    # p(b | start) is a half, and all else nearly 1; one restaurant for both words gives another half.
    assert got[1] > math.log10(0.5) - 0.05 and got[1] > got[2] + 1


def test_sizes_are_renewed_after_each_sweep_and_probabilities_averaged(spark):
    data = [(i, " ".join(["the cat sat on the mat", "a dog ran to the park", "the cat ran"][i % 3].split() * 4), None, None, None) for i in range(60)]
    model = lm.fit(frame(spark, data))
    tables = [0] * len(model.sweeps)
    for r in model.sizes.collect():
        for k, x in enumerate(lm._arrays(r["sizes"])[3:]):
            tables[k] += int(x.sum())
    assert tables == [s.pairs for s in model.sweeps] and len(set(tables)) > 1
    # p is the mean over sweeps of each sweep's own p, not p of the means.
    s = [lm.replace(model.first, pairs=100.0, tables=50.0), lm.replace(model.first, pairs=300.0, tables=90.0)]
    words = np.array([[5], [40], [20], [90], [6], [8], [3], [30]])
    each = [(7 - s[0].discount * t + (1 + s[0].discount * n) * lm._parent(np.array([g]), np.array([r]), x)[0]) / 41 for x, t, n, g, r in ((s[0], 2, 3, 20, 6), (s[1], 4, 30, 90, 8))]
    got = lm._probability(tuple(s), words, np.array([[7], [6]]), np.array([0]), np.array([0]))
    assert math.isclose(got[0], sum(each) / 2)


def test_a_chunk_is_gone_before_the_next_is_read(monkeypatch):
    """Counting and asking hold the arrays of one chunk at a time, and few at once: workers share their executor's memory."""
    words = np.random.default_rng(1).integers(10**5, 2 * 10**5, (3, 10, 100_000)).astype(str)
    batches = [pa.RecordBatch.from_pydict({"text": [" ".join(w) for w in part], "doc_id": list(range(10))}) for part in words]
    lm._Tokens(batches[0].column(0))  # makes the table of powers, which stays
    monkeypatch.setattr(lm.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 1))
    for kernel, columns in ((lm._count(8), ["text"]), (lm._ask(8), ["text", "doc_id"])):
        tracemalloc.start()
        chunks = sum(1 for _ in kernel(b.select(columns) for b in batches))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert chunks == 3 and peak < 90 * words[0].size


def test_a_step_is_one_file_a_task(spark, monkeypatch):
    """What buckets keep and what they send go into one file, and are read apart."""
    files, write = [], lm.Steps.write

    def look(*args, **named):
        done = write(*args, **named)
        files.append(len(done.inputFiles()))
        return done

    monkeypatch.setattr(lm.Steps, "write", look)
    monkeypatch.setattr("vecspark.llm.chunks.Sizes.buckets", lambda *_: 4)
    monkeypatch.setattr(lm, "dealt", lambda frame, key, parts: frame.repartitionById(2, F.col(key)).groupBy(key))
    lm.fit(frame(spark, rows(4)))
    assert len(files) == 2 + lm.SWEEPS and max(files) <= 2


def test_what_is_kept_and_what_is_sent_are_columns_apart(spark):
    notes = spark.createDataFrame([(1, -1, 0, 2.0, 3.0, b"kept"), (1, 4, 0, 0.0, 0.0, b"sent"), (2, 1, 0, 0.0, 0.0, None)], lm._NOTE)
    apart = lm._apart(notes)
    assert lm._kept(apart).collect() + lm._sent(apart).orderBy("bucket").collect() == notes.orderBy("bucket", "peer").collect()
