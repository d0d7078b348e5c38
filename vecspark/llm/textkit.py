"""Byte-level text kernels shared by the corpus operators.

Words are the maximal runs of bytes outside ``{0x20, 0x09..0x0D}``; all separators are
ASCII, so splitting UTF-8 bytes equals splitting code points. Everything here works on
one Arrow batch at a time and is vectorised over all documents of that batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

SEPARATORS = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Text handled by one kernel call, and the stretch hashed at once.
SLICE_BYTES = 8 << 20
_STRETCH = 1 << 20

_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U64 = np.uint64
_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
#: Base of a second hash of words, independent of the first.
OTHER_BYTE_BASE = 0xBF58476D1CE4E5B9
#: Bases of the two independent window polynomials.
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i below n (base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            made.append(np.cumprod(p))
        have = (made[0], made[1])
        if size <= 4 << 20:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """The batch in runs of rows of at most ``limit`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def filled(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """The rows of all batches in tables of nearly ``limit`` bytes of text (more only for a single longer text)."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, text, limit):
            column = part.column(part.schema.get_field_index(text))
            n = int(text_buffer(column)[1][-1])
            if held and size + n > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word."""
    sep = _IS_SEP[buf]
    starts_at, ends_at = ~sep, ~sep
    starts_at[1:] &= sep[:-1]
    ends_at[:-1] &= sep[1:]
    full = offs[1:] > offs[:-1]
    first, last = offs[:-1][full], offs[1:][full] - 1
    starts_at[first] = ~sep[first]
    ends_at[last] = ~sep[last]
    starts = np.flatnonzero(starts_at)
    return starts, np.flatnonzero(ends_at) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BYTE_BASE) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, mixed with its length; another base gives another hash."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + _STRETCH, "right")))
        lo = int(starts[at])
        part = buf[lo : int(ends[end - 1])]
        up, down = powers(base, len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
        s, e = starts[at:end] - lo, ends[at:end] - lo
        out[at:end] = mix64((sums[e] - sums[s]) * down[s] ^ ((e - s).astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
        at = end
    return out


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def windows(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rolling polynomial hash of every k consecutive word hashes (also across rows)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(base, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mix64((sums[k:] - sums[:n]) * down[:n])


def inside_rows(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k words that lie within one row."""
    total = int(first[-1])
    if total < k:
        return np.zeros(0, np.int64)
    row_end = np.repeat(first[1:], np.diff(first))
    at = np.arange(total, dtype=np.int64)
    return at[at + k <= row_end]


_zc, _zd = None, None


def squeeze(data: bytes) -> bytes:
    global _zc
    _zc = _zc or zstandard.ZstdCompressor(level=1, write_checksum=False)
    return _zc.compress(data)


def expand(data: bytes) -> bytes:
    global _zd
    _zd = _zd or zstandard.ZstdDecompressor()
    return _zd.decompress(data)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned values as byte planes of their differences; the high planes vanish under compression."""
    deltas = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(deltas.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpack_sorted(data: bytes, n: int, dtype: type = np.uint64) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(data, np.uint8, n * width).reshape(width, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)
