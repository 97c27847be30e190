"""Numeric columns shipped as one binary value, and a bounded bitmap filter over 64-bit keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 27
#: Bits of the largest bitmap whose blocks are made on the executors, and of such a block.
WIDE_BITS, BLOCK_BITS = 30, 16


def bitmap(keys: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """A bitmap with at least 16 bits to a key, up to 2**27 bits (16 MB): true for all given 64-bit keys, and for few others.

    Beyond that bound it lets more keys through; whoever uses it joins exactly afterwards.
    """
    bits = min(MOST_BITS, max(12, int(16 * max(count, 1) - 1).bit_length()))
    slot = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - bits)
    words = keys.select(slot.alias("s")).select(F.shiftrightunsigned("s", 6).alias("at"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("bit"))
    out = np.zeros(1 << max(bits - 6, 0), np.int64)
    for at, bit in words.groupBy("at").agg(F.bit_or("bit")).toLocalIterator():
        out[at] = bit
    return bits, out.view(np.uint64)


def wide_bitmap(keys: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """As bitmap, but of up to 2**30 bits (128 MB); the driver takes whole blocks instead of a row for each word. The keys' upper bits must be spread evenly."""
    bits = min(WIDE_BITS, max(BLOCK_BITS, int(16 * max(count, 1) - 1).bit_length()))
    slot = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - bits).alias("slot")

    def packed(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.sort(batch.column(0).to_numpy())
            which, first = np.unique(at >> BLOCK_BITS, return_index=True)
            for k, some in zip(which.tolist(), np.split(at & ((1 << BLOCK_BITS) - 1), first[1:])):
                real = np.zeros(1 << BLOCK_BITS, np.uint8)
                real[some] = 1
                real = np.packbits(real, bitorder="little")
                blocks[k] = blocks[k] | real if k in blocks else real
        yield from (pa.record_batch([pa.array([k]), pa.array([x.tobytes()], pa.binary())], ["block", "bits"]) for k, x in blocks.items())

    out = np.zeros(1 << (bits - 3), np.uint8)
    some = keys.select(slot).repartition(max(6, count >> 22), F.shiftright("slot", BLOCK_BITS)).mapInArrow(packed, "block long, bits binary")
    for block, x in some.toLocalIterator(prefetchPartitions=True):
        out[block << (BLOCK_BITS - 3) : (block + 1) << (BLOCK_BITS - 3)] = np.frombuffer(x, np.uint8)
    return bits, out.view(np.uint64)


def maybe(keys: np.ndarray, filter_: tuple[int, np.ndarray]) -> np.ndarray:
    bits, words = filter_
    slot = keys.astype(np.uint64) >> np.uint64(64 - bits)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
