"""The registered corpus queries: each applies one operator to its whole table.

``QUERIES`` maps names to ``(spark, sf_dir) -> DataFrame``; ``ORACLE`` maps those that SQL
can express to the equivalent DuckDB statement.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import langid
from vecspark.llm.decontam import contaminated
from vecspark.llm.licenses import find_licenses
from vecspark.llm.lm import score_documents
from vecspark.llm.mixing import allocate
from vecspark.llm.neardup import near_duplicates
from vecspark.llm.secrets import digest, find_secrets
from vecspark.llm.substring import remove_repeated_windows
from vecspark.llm.tokencount import Vocabulary, token_counts
from vecspark.llm.topk import integer_vectors, top_products

#: Rank file of the vocabulary that tokens are counted under.
VOCABULARY = os.environ.get("VECSPARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP3_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(q.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = allocate(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS k,
      (1.5 * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE level * w <= cap ORDER BY k LIMIT 1)) AS target,
      ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0 AS shift FROM l),
u AS (SELECT doc_id, source, size, count(*) AS same FROM d GROUP BY ALL),
p AS (SELECT u.*, source_size, target, shift, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      sum(same) OVER (PARTITION BY u.source ORDER BY size DESC, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto
      FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, (floor(rate * upto + shift) - floor(rate * (upto - same) + shift))::BIGINT AS copies FROM p),
d2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS nth FROM d)
SELECT d.doc_id, d.size, q.source_size, q.target,
       ((copies // same + CASE WHEN nth <= copies % same THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d2 d JOIN q ON d.doc_id IS NOT DISTINCT FROM q.doc_id AND d.source IS NOT DISTINCT FROM q.source AND d.size = q.size
"""


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END, ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id
         JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
hit AS (SELECT rid, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM hit),
one AS (SELECT rid, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t FROM one ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""

def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    done = langid.predict(langid.fit(docs.filter(~out)), docs)
    return done.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "item_id", "n_words", "n_covered", "n_tiles", "coverage")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), Vocabulary.load(VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_license_scan": op2_license_scan,
    "op3_exact_topk": op3_exact_topk,
    "op4_mix_sources": op4_mix_sources,
    "op5_lm_score": op5_lm_score,
    "op6_minhash_neardup": op6_minhash_neardup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
}

ORACLE: dict[str, str] = {
    "op3_exact_topk": OP3_SQL,
    "op4_mix_sources": OP4_SQL,
    "op6_minhash_neardup": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
}
