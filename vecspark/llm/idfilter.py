"""A Bloom filter over ids, to leave rows behind before they are shuffled to a join.

Its size follows the number of ids up to a fixed bound, so it may be broadcast; beyond that
it lets more rows through. The join that follows decides, so results never depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecspark.llm import textkit as tk
from vecspark.llm.chunks import on_group

BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 1 << 19, 1 << 28
#: Bytes of the table that are joined by one task.
_RANGE = 1 << 12


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = tk.mix64(ids.astype(np.int64).view(np.uint64))
    return (h % np.uint64(bits)).astype(np.int64), (tk.mix64(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bits)).astype(np.int64)


def _collect(bits: int):
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = table.reshape(-1, _RANGE)
        full = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_pydict({"part": pa.array(full, pa.int32()), "body": pa.array([tk.squeeze(parts[i].tobytes()) for i in full], pa.binary())})

    return call


def _join(key: tuple, table: pa.Table) -> pa.Table:
    total = None
    for body in table.column("body"):
        own = np.frombuffer(tk.expand(body.as_py()), np.uint8)
        total = own if total is None else total | own
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([tk.squeeze(total.tobytes())], pa.binary())})


def likely_rows(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` (long) is among ``ids`` (one column of long, no nulls), and a few others."""
    n = ids.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_ID * n):
        bits *= 2
    parts = ids.mapInArrow(_collect(bits), "part int, body binary").groupBy("part").applyInArrow(on_group(_join), "part int, body binary")
    table = np.zeros(bits // 8, np.uint8).reshape(-1, _RANGE)
    for r in parts.collect():
        table[r["part"]] = np.frombuffer(tk.expand(r["body"]), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(table.ravel())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(column))
            a, b = _places(own.fill_null(0).to_numpy(zero_copy_only=False), bits)
            hit = ((shared.value[a >> 3] >> (a & 7)) & (shared.value[b >> 3] >> (b & 7)) & 1).astype(bool)
            yield batch.filter(pa.array(hit & ~np.asarray(own.is_null())))

    return rows.mapInArrow(keep, rows.schema)
