"""Counts of 64-bit hashes in a fixed number of buckets, summed over a whole DataFrame.

The table has the same size for any input, so it may be sent to every task. It
only steers work (an order of n-grams, a first sieve of keys); results are never
read from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 14


def blobs(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The segments of a table that hold any count, compressed."""
    packer = zstandard.ZstdCompressor(level=1)
    for k in range(0, len(counts), SEGMENT):
        part = counts[k : k + SEGMENT]
        if part.any():
            yield k // SEGMENT, packer.compress(part.astype("<i8").tobytes())


def summed(segments: DataFrame, bits: int) -> np.ndarray:
    """The table that rows (segment int, counts binary) of all partitions add up to: 2 ** bits counts, at the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(blob), "<i8")
                totals[k] = totals[k] + part if k in totals else part
        packer = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([packer.compress(t.tobytes()) for t in totals.values()], pa.binary())], ["segment", "counts"])

    kind = "segment int, counts binary"
    # two rounds, so that no task reads a segment of every partition
    once = segments.select("segment", "counts").repartition("segment", F.pmod(F.xxhash64("counts"), F.lit(32))).mapInArrow(add, kind)
    table = np.zeros(1 << bits, np.int64)
    for row in once.repartition("segment").mapInArrow(add, kind).collect():
        part = np.frombuffer(zstandard.decompress(bytes(row["counts"])), "<i8")
        table[row["segment"] * SEGMENT : row["segment"] * SEGMENT + len(part)] += part
    return table


def of_longs(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bucket counts of a long column; bucket(x, bits) finds a value's bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.int64)
        for batch in batches:
            table += np.bincount(bucket(np.asarray(batch.column(0).drop_null()), bits), minlength=1 << bits)
        found = list(blobs(table))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["segment", "counts"])

    return summed(keys.select(column).mapInArrow(count, "segment int, counts binary"), bits)


def bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
