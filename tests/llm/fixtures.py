"""Small tables with the awkward cases that every corpus operator must accept."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def rows(seed: int = 7, n: int = 60, vocabulary: int = 400):
    """Random prose with copies, near copies, shared passages, nulls, empties and a long text."""
    rng = random.Random(seed)
    word = ["".join(rng.choice("abcdeéfgß") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    prose = lambda k: " ".join(rng.choice(word) for _ in range(k))
    passage = prose(80)
    texts = [prose(rng.randint(0, 200)) for _ in range(n)]
    texts += [texts[3], texts[3], texts[5] + " tail", prose(20) + "\n" + passage, passage + "\t" + prose(9), None, None, "", " \n ", "one", "one", prose(3000), "\x0b".join([passage] * 3)]
    out = [(i, x, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None]), None if x is None else len(x)) for i, x in enumerate(texts)]
    return [*out, out[2], out[2], (None, "no id " + prose(40), "en", "a", 3), (None, None, None, None, None)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)
