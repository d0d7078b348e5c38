"""From raw documents to a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns documents; it is written out and read
again before the next. Rows with awkward values pass through as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import langid
from vecspark.llm.chunks import cut
from vecspark.llm.decontam import remove_contaminated
from vecspark.llm.mixing import mix
from vecspark.llm.neardup import near_duplicates
from vecspark.llm.secrets import redact_secrets

#: Least calibrated probability of a document's language: likelier than all others together.
LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; those without letters go.

    Learns from the documents that are not held out for testing.
    """
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.keep_identified(model, docs, LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id, in one row.

    Of rows with one id, that of the least text stays (null last; then by the other
    columns), so reruns agree. Documents without an id cannot be grouped and all stay.
    """
    kept = cut(near_duplicates(docs).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    once = docs.join(kept.filter("n = 1").select("doc_id"), "doc_id", "left_semi")
    again = docs.join(kept.filter("n > 1").select("doc_id"), "doc_id", "left_semi")
    order = F.struct(F.col("text").isNull(), "text", F.to_json(F.struct(*(c for c in docs.columns if c != "text"))))
    first = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return once.unionByName(first).unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts blanked."""
    return redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, one row for each copy."""
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("mix_sources", mix_sources),
]

#: The learned language model and string tiling have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``, each written to the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = cut(docs)
    return docs
