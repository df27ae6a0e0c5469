"""A count sketch of bounded size: per bucket of a 64-bit key an upper bound of its count, on a logarithmic scale of one byte.

It has 2^bits bytes, whatever it counts, so it may go to the driver and to every executor. It only steers an order or skips
keys that are surely absent or single; no result depends on how well it counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

_SLICES = 64
_FLUSH = 1 << 22
_BLOB = "slice int, blob binary"


def bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.uint32)


def level(counts: np.ndarray) -> np.ndarray:
    """0 for 0, 1 for 1, then 8 steps for each doubling."""
    return np.where(counts < 2, counts, np.minimum(np.ceil(8 * np.log2(np.maximum(counts, 1))), 255)).astype(np.uint8)


def at_most(levels: np.ndarray) -> np.ndarray:
    """The largest count that has this level."""
    return np.where(levels < 2, levels, np.floor(2.0 ** (levels / 8.0)))


def build(df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """Levels of all buckets, from the keys that ``keys_of`` gives for each batch of ``df``. No rows give zeros."""
    width = (1 << bits) // _SLICES

    def blobs(buckets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not buckets:
            return
        value, count = np.unique(np.concatenate(buckets), return_counts=True)
        cuts = np.searchsorted(value, np.arange(1, _SLICES, dtype=np.uint32) * np.uint32(width))
        rows = []
        for k, (v, c) in enumerate(zip(np.split(value, cuts), np.split(count, cuts))):
            if len(v):
                step = np.diff(v, prepend=np.uint32(k * width))
                rows.append((k, zlib.compress(step.tobytes() + c.astype(np.uint32).tobytes(), 3)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "blob"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(bucket(keys_of(batch), bits))
            n += len(held[-1])
            if n >= _FLUSH:
                yield from blobs(held)
                held, n = [], 0
        yield from blobs(held)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        k = int(part["slice"].iloc[0])
        total = np.zeros(width, dtype=np.int64)
        for blob in part["blob"]:
            both = np.frombuffer(zlib.decompress(blob), dtype=np.uint32)
            step, count = both[: len(both) // 2], both[len(both) // 2 :]
            total[np.cumsum(step.astype(np.int64))] += count
        return pd.DataFrame({"slice": [k], "blob": [zlib.compress(level(total).tobytes(), 3)]})

    out = np.zeros(1 << bits, dtype=np.uint8)
    for k, blob in df.mapInArrow(local, _BLOB).groupBy("slice").applyInPandas(add, _BLOB).collect():
        out[k * width : (k + 1) * width] = np.frombuffer(zlib.decompress(blob), dtype=np.uint8)
    return out
