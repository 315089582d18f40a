"""Vectorised fingerprints over raw UTF-8 buffers (numpy, one pass per operation).

All functions work on a block: ``data`` is the concatenation of several texts and ``starts``
(``len(texts) + 1`` entries) says where each begins, so no Python code runs per character or word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MULT_A = U64(0x9E3779B97F4A7C15)
MULT_B = U64(0xC2B2AE3D27D4EB4F)
SHIFT = U64(29)
BLOCK_BYTES = 4 << 20


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows ``[i, j)`` of at most ``limit`` bytes (one long text may exceed it)."""
    if not batch.num_rows:
        return
    data, starts = binary_column(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + limit, "right")) - 1)
        j = min(j, batch.num_rows)
        yield i, j, data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        i = j


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit combination of two fingerprints."""
    h = a * MULT_A
    h ^= h >> SHIFT
    h += b
    h *= MULT_B
    h ^= h >> SHIFT
    return h


def gram8(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as an integer; positions past the end read zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.lib.stride_tricks.as_strided(padded.view(), (len(data) + 1, 8), (1, 1))
    return np.ascontiguousarray(words).view(U64).ravel()[: len(data)]


def shifted(h: np.ndarray, by: int) -> np.ndarray:
    """``h`` moved ``by`` positions to the left, zeros after the end."""
    out = np.zeros_like(h)
    if by < len(h):
        out[: len(h) - by] = h[by:]
    return out
