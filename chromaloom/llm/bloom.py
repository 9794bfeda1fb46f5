"""A Bloom filter of bounded size, built in parallel and safe to broadcast.

The filter never has more than ``MAX_BITS`` bits (128 MB, once in the driver and
in each Python worker). That is 16 bits a key for 67 million keys and 4 for 268
million; with more keys it saturates: more rows are flagged than need be, and the
exact step behind it still gives the same result. ``blocks`` says into how many
parts of the hash space an input has to be cut to keep 4 bits a key.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY, LEAST_BITS_PER_KEY = 16, 4
MOST_PROBES = 4
MIN_BITS = 1 << 18
MAX_BITS = 1 << 30
PAGE = 1 << 15  # bits, 4 KB
#: Keys that a task holds at once, rows of a batch of pages, and bits that a merging task holds.
CHUNK, PAGES_A_BATCH, BITS_A_MERGE = 400_000, 500, 1 << 25
#: Rows whose pages one task merges, and most tasks that merge.
ROWS_A_MERGE, MERGE_TASKS = 2_000_000, 512

#: Bits, and probes of a key.
Shape = tuple[int, int]


def shape_for(keys: int) -> Shape:
    bits = min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(max(1, keys) * BITS_PER_KEY))))
    return bits, min(MOST_PROBES, max(1, round(0.7 * bits / max(1, keys))))


def blocks(keys: int) -> int:
    return max(1, math.ceil(keys * LEAST_BITS_PER_KEY / MAX_BITS))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-xorshift hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _probes(keys: np.ndarray, shape: Shape) -> list[np.ndarray]:
    a = mix(keys.astype(np.int64).view(np.uint64))
    b = mix(a + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(shape[0] - 1)).astype(np.int64) for i in range(shape[1])]


_SCHEMA = "page int, bits binary"


def _batches(rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    pages, bits = [], []
    for page, packed in rows:
        pages.append(page)
        bits.append(packed)
        if len(pages) == PAGES_A_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int32()), pa.array(bits, pa.binary())], names=["page", "bits"])
            pages, bits = [], []
    if pages:
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int32()), pa.array(bits, pa.binary())], names=["page", "bits"])


def _touched(keys: np.ndarray, shape: Shape) -> Iterator[tuple[int, bytes]]:
    """The pages that some keys set, each as places in it (the top bit says
    whether two rows set it) or, where that is shorter, as bits of any row and
    bits of two. A key sets each of its bits once per row."""
    distinct, n = np.unique(keys, return_counts=True)
    # one row's probes may meet: count a bit once for each key
    p = np.sort(np.stack(_probes(distinct, shape)), axis=0)
    first = np.vstack([np.ones((1, p.shape[1]), bool), p[1:] != p[:-1]])
    count = np.broadcast_to(np.minimum(n, 2), p.shape)[first]
    order = np.argsort(p[first], kind="stable")
    place, at = np.unique(p[first][order], return_index=True)
    again = np.add.reduceat(count[order], at) >= 2 if len(at) else np.empty(0, bool)
    cuts = np.flatnonzero(np.diff(place // PAGE)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(place)]):
        inside = place[lo:hi] % PAGE
        if 2 * len(inside) < PAGE // 4:
            yield int(place[lo] // PAGE), (inside | again[lo:hi] * PAGE).astype("<u2").tobytes()
        else:
            bits = np.zeros((2, PAGE), bool)
            bits[0, inside], bits[1, inside[again[lo:hi]]] = True, True
            yield int(place[lo] // PAGE), np.packbits(bits, axis=1).tobytes()


def _count(shape: Shape) -> Callable:
    """Each task sends what its keys set, a bounded number of keys at a time."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                held.append(batch.column(0).slice(at, CHUNK).drop_null().to_numpy(zero_copy_only=False))
                n += len(held[-1])
                if n >= CHUNK:
                    yield np.concatenate(held)
                    held, n = [], 0
        if n:
            yield np.concatenate(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(row for keys in parts(batches) for row in _touched(keys, shape))

    return run


def _merge(repeated: bool) -> Callable:
    """A task holds the pages that are dealt to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(raw) == PAGE // 4:
                    new = np.frombuffer(raw, np.uint8).reshape(2, -1)
                else:
                    at = np.frombuffer(raw, "<u2")
                    bits = np.zeros((2, PAGE), bool)
                    bits[0, at % PAGE], bits[1, at[at >= PAGE] % PAGE] = True, True
                    new = np.packbits(bits, axis=1)
                old = held.setdefault(page, np.zeros((2, PAGE // 8), np.uint8))
                old[1] |= new[1] | (old[0] & new[0])
                old[0] |= new[0]
        yield from _batches((page, zlib.compress(bits[int(repeated)].tobytes(), 1)) for page, bits in held.items() if bits[int(repeated)].any())

    return run


def build(spark: SparkSession, keys: DataFrame, rows: int, repeated: bool) -> tuple[Shape, object]:
    """(shape, broadcast filter) of the one long column of ``keys``.

    ``repeated``: of the keys that may occur in two rows; else of all keys. The
    pages of all tasks merge in as many tasks as rows and bits ask for; the
    driver gets each page once.
    """
    shape = shape_for(rows)
    tasks = min(MERGE_TASKS, max(1, rows // ROWS_A_MERGE, shape[0] // BITS_A_MERGE))
    pages = keys.mapInArrow(_count(shape), _SCHEMA).repartition(tasks, "page").mapInArrow(_merge(repeated), _SCHEMA)
    filled = np.zeros(shape[0] // 8, np.uint8)
    # one filter at most, whole
    for page, packed in pages.collect():
        filled[page * (PAGE // 8) : (page + 1) * (PAGE // 8)] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return shape, spark.sparkContext.broadcast(filled.tobytes())


def test(table: np.ndarray, keys: np.ndarray, shape: Shape) -> np.ndarray:
    """Which keys the filter may hold; later probes only look at what is left."""
    left = np.arange(len(keys))
    for p in _probes(keys.view(np.int64), shape):
        p = p[left]
        left = left[(table[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(keys), bool)
    out[left] = True
    return out


def might_contain(key: str, shape: Shape, filled: object) -> Column:
    @F.pandas_udf("boolean")
    def held(keys: pd.Series) -> pd.Series:
        return pd.Series(test(np.frombuffer(filled.value, np.uint8), keys.to_numpy(np.int64), shape))

    return held(F.coalesce(F.col(key), F.lit(0).cast("long")))
