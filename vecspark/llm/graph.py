"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.chunks import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return tuple(row)


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    small = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every linked node but the smallest of each component.

    ``links``: two columns of orderable ids. Null ends and self-links are ignored. Every
    step is an aggregation or an equi-join, written to the shared checkpoint folder; a
    node with very many links costs no task more than its partial minimum.
    """
    a, b = links.columns
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter((F.col(a).isNotNull()) & (F.col(b).isNotNull()) & (F.col("u") != F.col("v"))).distinct())
    before = _state(edges)
    while before[0]:
        edges = cut(_stars(edges))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
