"""Columns between Arrow batches and NumPy, and packed blocks of integers for compact shuffles."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

_LIBC = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None


def texts_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(name).to_pylist()


def release() -> None:
    """Give freed memory of this worker back to the system; workers are kept from task to task, and with them what they hold."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lean(f: Callable) -> Callable:
    """``f`` over batches, that releases memory at its end."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def lean_group(f: Callable) -> Callable:
    """``f`` over tables of groups, that releases memory after each."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            release()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            release()

    return one if f.__code__.co_argcount == 1 else two


def place_of(df: DataFrame, name: str, needed: bool = True) -> int | None:
    """Where a column is, whatever the case of its name."""
    found = [k for k, c in enumerate(df.columns) if c.lower() == name]
    if not found and needed:
        raise ValueError(f"no column {name} among {df.columns}")
    return found[0] if found else None


def texts_at(batch: pa.RecordBatch, at: int) -> list[str | None]:
    """A column as texts, whatever its type."""
    column = batch.column(at)
    return (column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())).to_pylist()


def take_ids(column: pa.Array, rows) -> pa.Array:
    """The ids of these rows; nulls stay null and large integers exact."""
    return column.take(pa.array(np.asarray(rows, np.int64)))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Non-negative integers as byte planes under zstd; sorted ones as differences."""
    x = np.ascontiguousarray(values, np.uint64)
    if ascending and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width | (128 if ascending else 0)]) + zstandard.compress(planes.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    width, ascending = blob[0] & 127, blob[0] & 128
    raw = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    x = out.view(np.uint64).reshape(-1)
    return np.cumsum(x, dtype=np.uint64) if ascending else x
