"""Sums of one fixed-size vector over all tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Places that travel as one row, and tasks that merge what all tasks send.
SEGMENT, MERGE_TASKS = 4096, 16
_SCHEMA = "segment int, counts binary"


def _rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, part in enumerate(total.reshape(-1, SEGMENT)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["segment", "counts"])


def _put(total: np.ndarray, segment: int, counts: bytes) -> None:
    total[segment * SEGMENT : (segment + 1) * SEGMENT] += np.frombuffer(zlib.decompress(counts), np.int64)


def _task(add: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            add(batch, total)
        yield from _rows(total)

    return run


def _merge(batch: pa.RecordBatch, total: np.ndarray) -> None:
    for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        _put(total, segment, counts)


def vector_sum(rows: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> np.ndarray:
    """The sum over all tasks of what ``add(batch, total)`` adds up in place.

    Each task sends one vector of ``size`` (a multiple of SEGMENT); a few tasks
    add these up, each with one vector in memory, and the driver their sums.
    """
    sent = rows.mapInArrow(_task(add, size), _SCHEMA).repartition(MERGE_TASKS).mapInArrow(_task(_merge, size), _SCHEMA)
    total = np.zeros(size, np.int64)
    for segment, counts in sent.toLocalIterator():
        _put(total, segment, counts)
    return total
