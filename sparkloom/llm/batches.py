"""Memory of Python workers: values a slice at a time, and what tasks give back.

Spark bounds an Arrow batch by bytes (64 MB) and by rows (10,000), and has it beside its heap, as has the worker.
At 2 KB a text such batches took 300 MB more of an executor than smaller ones, so operators lower the rows,
for the whole session and all to one number, whichever comes first; results are lazy, and a number of each
operator's own would be that of whichever was called last.  Functions don't depend on it: they turn texts into
Python objects in slices of about ``SLICE`` bytes, and put narrow rows together to larger tables.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE = 4 << 20  # bytes
ROWS = 1000  # of a batch
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def use(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to ``ROWS``, unless it has fewer."""
    if not 0 < int(spark.conf.get(_KEY)) <= ROWS:
        spark.conf.set(_KEY, str(ROWS))


def cuts(sizes: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive slices of about ``limit`` bytes, one row at least, from the rows' sizes."""
    if len(sizes):
        part = (np.cumsum(sizes) - sizes) // limit
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        yield from ((a, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True))


def parts(*arrays: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Slices of rows by the bytes of these strings or binaries."""
    return cuts(sum(pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in arrays), limit)


def texts(array: pa.Array) -> Iterator[list[str | None]]:
    """The values of an array of strings, slice by slice."""
    for at, n in parts(array):
        yield array.slice(at, n).to_pylist()


def merged(parts: Iterator[pa.RecordBatch], limit: int = SLICE // 4) -> Iterator[pa.RecordBatch]:
    """Batches put together to some of about ``limit`` bytes."""
    held, size = [], 0
    for batch in parts:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def framed(function):
    """A function of Arrow batches that hands ``function`` frames of narrow rows, put together, and takes frames from it."""

    def run(parts):
        for frame in function(batch.to_pandas() for batch in merged(parts)):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)
        release()

    return run


def release() -> None:
    """Gives memory that is free in this worker back to the machine; workers outlive their tasks.

    Where the C library has no such call nothing happens."""
    with contextlib.suppress(OSError, AttributeError):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
