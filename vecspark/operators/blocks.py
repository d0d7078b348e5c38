"""Shards of a base that stay in one place while their queries pass by.

Base rows are exchanged once, by shard; each query is exchanged once for every shard that it
asks. Within a partition the rows of a shard come first and its queries follow in order, so
a task holds one shard and one block of queries, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.transforms import matrix_of


@dataclass
class Block:
    """Rows of one side: ``ids``, ``vectors`` (lists of double) and further columns by name."""

    table: pa.Table

    @property
    def ids(self) -> np.ndarray:
        return self.table.column("id").to_numpy()

    @property
    def vectors(self) -> pa.Array:
        return self.table.column("v").combine_chunks()

    @property
    def matrix(self) -> np.ndarray:
        return matrix_of(self.vectors)

    def column(self, name: str) -> pa.ChunkedArray:
        return self.table.column(name)


def through_shards(
    base: DataFrame,
    queries: DataFrame,
    shards: int,
    block: int,
    load: Callable[[Block], Any],
    answer: Callable[[Any, Block], pa.RecordBatch],
    schema: str,
    asks: DataFrame | None = None,
) -> DataFrame:
    """``answer(load(rows of a shard), a block of its queries)`` for all shards and blocks.

    ``base``: ``shard``, ``id``, ``v`` (array of double) and further columns; ``queries``:
    ``id``, ``v`` and further columns, sent to every shard; or ``asks``: the same with a
    ``shard``, sent to that one only. Names of further columns must differ between the sides.
    """
    if asks is None:
        asks = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    known = ("shard", "id", "v")
    left, right = ([c for c in frame.columns if c not in known] for frame in (base, asks))
    types = {**dict(base.dtypes), **dict(asks.dtypes)}
    names = [*left, *right]

    def side(frame: DataFrame, number: int) -> DataFrame:
        more = [F.col(c) if c in frame.columns else F.lit(None).cast(types[c]).alias(c) for c in names]
        return frame.select("shard", F.lit(number).cast("tinyint").alias("side"), "id", "v", *more)

    both = side(base, 0).unionByName(side(asks, 1))
    both = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, held, waiting, n = None, [], None, [], 0

        def ask() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, waiting, n
            if waiting and rows is not None:
                held, rows = (load(Block(pa.Table.from_batches(rows))) if rows else None), None
            if waiting and held is not None:
                yield answer(held, Block(pa.Table.from_batches(waiting)))
            waiting, n = [], 0

        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if shard[lo] != at:
                    yield from ask()
                    at, rows, held = shard[lo], [], None
                if kind[lo] == 0:
                    rows.append(batch.slice(lo, hi - lo))
                    continue
                for start in range(lo, hi, block):
                    part = batch.slice(start, min(block, hi - start))
                    if n + part.num_rows > block:
                        yield from ask()
                    waiting.append(part)
                    n += part.num_rows
        yield from ask()

    return both.mapInArrow(run, schema)
