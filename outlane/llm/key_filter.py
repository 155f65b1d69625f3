"""A Bloom filter over hashes, built by tasks and bounded in size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a segment (64 KB) in which all bits of a key lie.
SEGMENT = 1 << 19
BITS_PER_KEY = 16
#: Most bits of a filter (128 MB).  More keys than it suits let more pass.
MOST_BITS = 1 << 30


class KeyFilter:
    """Packed bits; ``has`` may be true for a key that was not added."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = places(hashes, len(self.bits) * 8)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0).astype(bool)


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    """[2, key] bits of each key."""
    segment = (hashes >> np.uint64(40)) % np.uint64(size // SEGMENT)
    inside = np.stack([hashes % np.uint64(SEGMENT), (hashes >> np.uint64(20)) % np.uint64(SEGMENT)])
    return (segment * np.uint64(SEGMENT) + inside).astype(np.int64)


def built(hashes: DataFrame, count: int, most_bits: int = MOST_BITS) -> KeyFilter:
    """Filter of the signed hashes in column ``h``.

    Tasks make the segments they touch, segments meet by number; only merged
    segments, ``most_bits`` at most, reach the driver.
    """
    size = SEGMENT
    while size < min(count * BITS_PER_KEY, most_bits):
        size *= 2

    def partial(batches):
        made = {}
        for batch in batches:
            at = np.unique(places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size).ravel())
            for part in np.split(at, np.flatnonzero(np.diff(at // SEGMENT)) + 1):
                if len(part):
                    own = made.setdefault(int(part[0] // SEGMENT), np.zeros(SEGMENT // 8, np.uint8))
                    np.bitwise_or.at(own, (part % SEGMENT) >> 3, (1 << (part & 7)).astype(np.uint8))
        for segment, bits in made.items():
            yield _row(segment, bits)

    def merge(batches):
        kept = {}
        for batch in batches:
            for segment, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits = np.frombuffer(bits, np.uint8)
                kept[segment] = kept[segment] | bits if segment in kept else bits
        for segment, bits in kept.items():
            yield _row(segment, bits)

    made = hashes.mapInArrow(partial, "segment int, bits binary").repartition("segment").mapInArrow(merge, "segment int, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for segment, bits in made.collect():
        out[segment * SEGMENT // 8:(segment + 1) * SEGMENT // 8] = np.frombuffer(bits, np.uint8)
    return KeyFilter(out)


def _row(segment: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])
