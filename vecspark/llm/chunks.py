"""Documents dealt into chunks by hash, for two-way exchanges between chunks and key buckets.

Corpus-wide lookups here follow one pattern. A chunk (a few MB of documents) sends each
key bucket one packed row of its distinct keys, so a key shared by a third of all rows
costs one entry per chunk; each bucket answers with one packed row per chunk. Chunks are
a function of a document's id, its text and the partition it was read in, so that a lost
task computes the same chunk again, and a row repeated throughout the table is spread over
as many chunks as it has partitions.

There is at most one message for each chunk and bucket. Both sizes grow with the square root
of the input (``CHUNK_BYTES`` to ``MOST_CHUNK_BYTES``), so that the number of messages grows
in proportion to it until the bound, and as the square of it beyond, up to one for each key.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES, MOST_CHUNK_BYTES = 8 << 20, 32 << 20
#: Input up to which chunks have their least size.
_SMALL = 8 << 30


@dataclass(frozen=True)
class Sizes:
    rows: int
    text_bytes: int
    partitions: int

    @property
    def _growth(self) -> float:
        return min(MOST_CHUNK_BYTES / CHUNK_BYTES, max(1.0, (self.text_bytes / _SMALL) ** 0.5))

    @property
    def chunks(self) -> int:
        return max(2 * self.partitions, int(self.text_bytes / (CHUNK_BYTES * self._growth)) + 1)

    def buckets(self, entries_per_byte: float, entries: int) -> int:
        """Buckets of about ``entries`` keys each, of more in large inputs; their number follows the input only."""
        return int(self.text_bytes * entries_per_byte / (entries * self._growth)) + 1


_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bounded(docs: DataFrame) -> DataFrame:
    """The same frame; its session hands rows to Python in batches of ``BATCH_BYTES``, unless it sets a size itself."""
    conf = docs.sparkSession.conf
    if _BATCH not in conf.getAll:
        conf.set(_BATCH, BATCH_BYTES)
    return docs


def slim(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``text`` (string) of the documents, all that most operators read."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def measure(docs: DataFrame, text: str = "text") -> Sizes:
    """Rows and text bytes of the whole input, in one scan of one column."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return Sizes(int(row["n"]), int(row["b"]), shuffle_partitions(docs.sparkSession))


def in_chunks(docs: DataFrame, chunks: int, key: str = "__chunk") -> DataFrame:
    """Adds the chunk of each row: a hash of its id, its text and the partition it is in."""
    return docs.withColumn(key, F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int"))


def dealt(frame: DataFrame, key: str, parts: int):
    """The frame grouped by an int, groups dealt out in turn, so that tasks get equal shares of them."""
    return frame.repartitionById(parts, F.col(key)).groupBy(key)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the session's spark.checkpoint.dir; a session on one machine that has none gets a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            at = tempfile.mkdtemp(prefix="vecspark-checkpoint-")
        sc.setCheckpointDir(at)


def cut(df: DataFrame) -> DataFrame:
    """Writes the frame to the shared checkpoint folder and reads on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


class Steps:
    """Tables that hold the steps of a longer job: each is written, read on from, and removed when the block ends or before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Steps:
        return self

    def write(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark)
        with _tidy(self.spark):
            df.write.option("compression", "none").parquet(path)
        done = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(done)] = (path, done)
        return done

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(self.spark, self.paths.pop(id(t))[0])

    def __exit__(self, *_) -> None:
        self.drop(*(t for _, t in list(self.paths.values())))


def _remove(spark: SparkSession, file: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """What is made and run in the block leaves no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut_alone(df: DataFrame) -> DataFrame:
    """``cut`` for a step whose exchanges nothing else reads: its shuffle files go once it is written."""
    with _tidy(df.sparkSession):
        # The setting counts where a frame is made, so this is a frame of its own.
        return cut(df.select("*"))


def drop(written: DataFrame) -> None:
    """Removes the files of a frame that ``cut`` returned and that nothing will read again."""
    file = written._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _remove(written.sparkSession, file.get())


def on_group(fn, *bound):
    """``fn(*bound, key, table)`` as a grouped function (Spark inspects signatures, so no partial)."""

    def call(key, table):
        return fn(*bound, key, table)

    return call


def on_pair(fn, *bound):
    """``fn(*bound, key, left, right)`` as a cogrouped function."""

    def call(key, left, right):
        return fn(*bound, key, left, right)

    return call


def on_batches(fn, *bound):
    """``fn(*bound, batch)``, giving batches, over an iterator of batches."""

    def call(batches):
        for batch in batches:
            yield from fn(*bound, batch)

    return call
