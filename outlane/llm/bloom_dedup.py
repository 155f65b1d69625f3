"""Exact de-duplication with two Bloom passes.

Pass one adds the hash of every text to a filter that remembers for each bit
whether it was set once or more often.  Pass two reads the hashes again: a text
with a bit that was set only once has no copy and passes straight through.  Only
the others are shuffled, as (id, hash) rows, and compared by their SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlane.llm.common import written

#: Bits of a filter segment (64 KB), and bits a row is given.
SEGMENT = 1 << 19
BITS_PER_ROW = 16
#: Most bits of the filter (128 MB).  More rows than it suits make more rows
#: shuffle, and change nothing in the result.
MOST_BITS = 1 << 30


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha): SHA-256 of the whole text with A-Z lower-cased; null is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = pc.cast(pc.ascii_lower(pc.fill_null(batch.column(1), "")), pa.large_binary())
            offsets, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1].tolist(), memoryview(texts.buffers()[2] or b"")
            digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], names=["id", "sha"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, sha binary")


def _bits(column: pa.Array, size: int) -> np.ndarray:
    """[2, row] bits of the filter, both in the row's segment."""
    words = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)
    segment = words[:, 0] % np.uint64(size // SEGMENT)
    inside = np.stack([words[:, 1] % np.uint64(SEGMENT), words[:, 2] % np.uint64(SEGMENT)])
    return (segment * np.uint64(SEGMENT) + inside).astype(np.int64)


def _unpacked(data: bytes | None) -> np.ndarray:
    return np.zeros(SEGMENT, bool) if data is None else np.unpackbits(np.frombuffer(data, np.uint8)).view(bool)


def repeat_filter(rows: DataFrame, size: int) -> np.ndarray:
    """Packed bits that were set more than once.

    Tasks make the segments they touch, segments meet by their number and are
    merged as they arrive; ``size`` bounds what reaches the driver.
    """
    def partial(batches):
        once, more, waiting, count = {}, {}, [], 0

        def flush():
            at, n = np.unique(np.concatenate(waiting), return_counts=True)
            cuts = np.flatnonzero(np.diff(at // SEGMENT)) + 1
            for part, times in zip(np.split(at, cuts), np.split(n, cuts)):
                segment, part = int(part[0] // SEGMENT), part % SEGMENT
                a, b = _unpacked(once.get(segment)), _unpacked(more.get(segment))
                b[part] |= a[part] | (times > 1)
                a[part] = True
                once[segment], more[segment] = np.packbits(a).tobytes(), np.packbits(b).tobytes()

        for batch in batches:
            if batch.num_rows:
                waiting.append(_bits(batch.column(0), size).ravel())
                count += len(waiting[-1])
            if count >= 2_000_000:
                flush()
                waiting, count = [], 0
        if waiting:
            flush()
        for segment in once:
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([once[segment]], pa.binary()), pa.array([more[segment]], pa.binary())], names=["segment", "once", "more"])

    def merge(batches):
        kept = {}
        for batch in batches:
            for segment, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if segment in kept:
                    c, d = kept[segment]
                    kept[segment] = (c | a, d | b | (c & a))
                else:
                    kept[segment] = (a, b)
        for segment, (_, more) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([more.tobytes()], pa.binary())], names=["segment", "more"])

    made = (rows.select("sha").mapInArrow(partial, "segment int, once binary, more binary")
            .repartition("segment").mapInArrow(merge, "segment int, more binary"))
    out = np.zeros(size // 8, np.uint8)
    for segment, more in made.collect():
        out[segment * SEGMENT // 8:(segment + 1) * SEGMENT // 8] = np.frombuffer(more, np.uint8)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha (binary).

    Texts are equal if identical after lower-casing A-Z; null is the empty
    text.  Of equal texts the row with the largest id stays; rows that repeat
    that id are marked kept alike.  A null id is kept only if no row of its
    group has one.  An empty table gives no rows; other columns are not read.
    """
    rows = written(hashed(docs, id_col, text_col))
    size = SEGMENT
    while size < min(rows.count() * BITS_PER_ROW, most_bits):
        size *= 2
    shared = docs.sparkSession.sparkContext.broadcast(repeat_filter(rows, size))
    kind = rows.schema["id"].dataType.simpleString()

    def tag(batches):
        for batch in batches:
            if batch.num_rows:
                at = _bits(batch.column(1), size)
                again = ((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(again)], names=["id", "sha", "again"])

    tagged = rows.mapInArrow(tag, f"id {kind}, sha binary, again boolean")
    maybe = written(tagged.filter("again").select("id", "sha"))
    groups = written(maybe.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    alone = tagged.filter("NOT again").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    met = (maybe.join(groups.withColumnRenamed("sha", "group_sha"), F.col("sha") == F.col("group_sha"), "left")
           .select("id", "sha", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")))
    return alone.unionAll(met).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)"""
