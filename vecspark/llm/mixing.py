"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every document has the same expected number of copies, its rate. Documents
of a source stand in order of falling size; the prefix sum of the rates plus one offset
per source gives a document as many copies as it crosses integers. The order by size
keeps the words taken close to the target. Positions come from a range partitioning, so no
task holds a whole source: counts of each range are summed first, rows are numbered
within their range after. Rows alike stand side by side as one unit; each gets its share of
the unit's copies and the first ones the odd copies, so that a unit of any size keeps to the
target. Where they are numbered, that is done in the same way: counted by partition first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.chunks import cut, shuffle_partitions
from vecspark.llm.textkit import WORD_PATTERN

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most a source may give as a multiple of its own.
SHARE, MOST = 1.5, 2
SEED = "mix"


#: Rows of one unit that a task emits, and units that are broadcast at most (under 32 MB).
PIECE, FEW = 1 << 16, 200_000


def _offset(source: Column) -> Column:
    """A number in [0, 1) for each source."""
    text = F.concat(F.lit(SEED + ":"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from a table of sources and their sizes.

    Targets share ``share`` times all words by weight; one above ``most`` times its source's
    size stops there and the rest share the excess, until none is above. That is the
    level at which the sources, by falling scarcity, first fit: one row per source is all
    that the windows here see.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")
    s = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    scarce = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = scarce.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "left": share * F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "k": F.row_number().over(scarce),
    }).withColumn("level", F.col("left") / F.col("w_left"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("k"))
    s = s.withColumn("first", F.min(fits).over(everything))
    level = F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(everything)
    s = s.withColumn("reach", level)
    return s.select("source", "source_size", F.when(F.col("reach").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("reach") * F.col("w"))).alias("target"))


def _positions(docs: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Copies of each unit, rows alike in id, source and text: ``id``, ``src``, ``hash``, ``size``, ``same`` (its rows), ``copies``."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    sized = _hashed(docs.select("doc_id", "text", "source")).select(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.col("__hash").alias("hash"), size.alias("size"))
    units = cut(sized).groupBy("id", "src", "hash", "size").agg(F.count(F.lit(1)).alias("same"))
    parts = shuffle_partitions(docs.sparkSession)
    order = [F.col("size").desc(), F.col("id").asc_nulls_last(), F.col("hash")]
    ranged = cut(units.repartitionByRange(parts, F.col("src").asc_nulls_last(), *order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("src", "part").agg(F.sum("same").alias("n"), F.sum(F.col("same") * F.col("size")).alias("words"))
    targets = source_targets(counts.groupBy(F.col("src").alias("source")).agg(F.sum("words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    starts = starts.join(targets, F.col("src").eqNullSafe(F.col("source"))).select(F.col("src").alias("s"), F.col("part").alias("p"), "before", "source_size", "target")
    within = Window.partitionBy("part", "src").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("same").over(within)).join(starts, (F.col("part") == F.col("p")) & F.col("src").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    end, offset = F.col("before") + F.col("upto"), _offset(F.col("src"))
    copies = F.floor(rate * end + offset) - F.floor(rate * (end - F.col("same")) + offset)
    return placed.select("id", "src", "hash", "size", "same", "source_size", "target", copies.cast("long").alias("copies"))


def _times(nth: Column) -> Column:
    """Copies of the nth row of its unit: an even share, the first rows taking the odd ones."""
    each = F.floor(F.col("copies") / F.col("same"))
    return each + (nth <= F.col("copies") - each * F.col("same")).cast("long")


def allocate(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``copies``; text is dropped.

    ``docs``: ``doc_id``, ``text``, ``source``. The size is the number of words (null text:
    0). Null is a source of its own, the last. Rows alike in id, source and text share
    their copies evenly, the odd ones going to the first; so a null ``doc_id`` is no special
    case, and reruns agree. A source of no words has target 0 and gives no copies. An empty
    table gives an empty result. Other columns are ignored.
    """
    units = _positions(docs, weights, share, most)
    name = lambda frame: frame.select(F.col("id").alias("doc_id"), F.col("src").alias("source"), "size", "source_size", "target", _times(F.col("nth")).alias("copies"))
    small = units.filter(F.col("same") <= PIECE).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("same"))))
    # Large units go out in pieces, dealt to all tasks.
    pieces = units.filter(F.col("same") > PIECE).withColumn("piece", F.explode(F.expr(f"sequence(0L, (same - 1) div {PIECE})")))
    pieces = pieces.repartition(shuffle_partitions(docs.sparkSession))
    large = pieces.withColumn("nth", F.explode(F.expr(f"sequence(piece * {PIECE} + 1, least(same, (piece + 1) * {PIECE}))")))
    return name(small).unionByName(name(large))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of units numbered from 1 (``nth``), no task holding more of a unit than one partition of the rows has."""
    unit = ["id", "src", "hash"]
    rows = cut(rows).withColumn("__part", F.spark_partition_id())
    counts = rows.groupBy("__part", *unit).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*unit).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__u{c}") for c in unit), F.coalesce(before, F.lit(0)).alias("__before"))
    here = F.row_number().over(Window.partitionBy("__part", *unit).orderBy("hash"))
    same = F.col("__part") == F.col("__p")
    for c in unit:
        same = same & F.col(c).eqNullSafe(F.col(f"__u{c}"))
    return rows.withColumn("__here", here).join(counts, same).withColumn("nth", F.col("__before") + F.col("__here"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: every document as many times as it has copies, with ``copy`` from 1.

    All columns of ``docs`` are kept, and ``copy`` gets a trailing underscore where they have
    one of that name; see ``allocate`` for how copies are set.
    """
    units = cut(_positions(docs, weights, share, most).filter("copies > 0").select("id", "src", "hash", "same", "copies"))
    shared = [c for c in (*units.columns, "nth") if c in docs.columns]
    held = _hashed(docs).withColumnsRenamed({c: f"__doc_{c}" for c in shared})
    own = lambda c: F.col(f"__doc_{c}" if c in shared else c)

    def met(some: DataFrame) -> DataFrame:
        return held.join(some, (F.col("__hash") == F.col("hash")) & own("doc_id").eqNullSafe(F.col("id")) & own("source").eqNullSafe(F.col("src")))

    done = met(units.filter("same = 1")).withColumn("nth", F.lit(1))
    alike = units.filter("same > 1")
    n = alike.count()
    if n:
        # Few units of rows alike are met without moving the documents.
        more = _numbered(met(F.broadcast(alike) if n <= FEW else alike))
        done = done.unionByName(more.select(*done.columns))
    name = "copy"
    while name in docs.columns:
        name += "_"
    done = done.withColumn("__times", _times(F.col("nth"))).filter("__times > 0")
    return done.select(*(own(c).alias(c) for c in docs.columns), F.explode(F.expr("sequence(1, cast(__times as int))")).alias(name))
