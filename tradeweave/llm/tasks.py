"""What every Arrow task of the operators has in common: bounded slices, and memory given back.

A worker process outlives its task, and the next operator's tasks run in it. So a
task works on slices of few rows and few bytes, and returns what it freed to the
system when it ends; else each stage of a pipeline would add to the one before.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice ends before it holds more rows or bytes, unless a single row does.
ROWS = 256
BYTES = 1 << 21


def sliced(batches, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``size`` bytes of texts and lists."""
    for batch in batches:
        n = batch.num_rows
        ends = np.zeros(n, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                ends += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            elif pa.types.is_list(column.type):
                ends += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(ends)
        at = 0
        while at < n:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + size, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def release() -> None:
    """Give freed memory back to the system, as far as allocators allow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded(step: Callable, rows: int = ROWS, size: int = BYTES) -> Callable:
    """``step`` over slices, for ``mapInArrow``; its memory is given back when it ends."""

    def task(batches):
        try:
            yield from step(sliced(batches, rows, size))
        finally:
            release()

    return task
