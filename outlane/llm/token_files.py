"""Token-id files: frequency-ranked ids in byte-aligned variable length.

Ids are replaced by their rank in the corpus, so the 256 most frequent take one
byte, the next 65,280 two, and so on.  Lengths stand apart from the bytes, two
bits each in a control stream; a reader finds all lengths of a block in a table
indexed by control byte and gathers the values with numpy.

A file set is a folder with two Parquet tables: ``ids`` (rank, id) and
``blocks`` (shard, begin, doc ids, lengths, control, data).  Spark writes both,
so a lost task leaves nothing behind and any store that Spark knows will do.
Blocks, and the documents in them, are in ascending order of document id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlane.llm.common import remove, written
from outlane.llm.tokens import blocks, library_table

#: Ids of a block; a longer document is a block of its own.
BLOCK_IDS = 500_000
#: Lengths of the four values of a control byte.
LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    four[:len(values)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(extra + np.int64(1))
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = ends - extra - 1
    data[first] = values & 0xFF
    for k in (1, 2, 3):
        longer = np.flatnonzero(extra >= k)
        if len(longer):
            data[first[longer] + k] = values[longer] >> (8 * k) & 0xFF
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    data = np.frombuffer(data, np.uint8)
    first = np.cumsum(lengths) - lengths
    out = data[first].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if len(longer):
            out[longer] |= data[first[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, path: str, kind: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, ids): ids of the tokenizers library with the end id, two bytes each
    if they fit, else four."""
    id_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        table = library_table(path, kind)
        for batch in blocks(batches, 1):
            ids, counts = table.encode(batch.column(1))
            counts = counts.astype(np.int64) + 1
            ends = np.cumsum(counts)
            out = np.full(int(ends[-1]), end_id, "<u2" if table.most_id < 65536 and end_id < 65536 else "<u4")
            inside = np.ones(len(out), bool)
            inside[ends - 1] = False
            out[inside] = ids
            edge = np.concatenate([[0], ends]) * out.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), data], names=["id", "n", "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {id_kind}, n long, ids binary")


def _joined(ids: pa.Array, total: int) -> np.ndarray:
    """All ids of a binary column, whatever their width."""
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
    data = np.frombuffer(ids.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.view("<u2" if len(data) == 2 * total else "<u4")


def write_token_files(docs: DataFrame, folder: str, path: str, kind: str = "word", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write a file set to ``folder``.

    A null or empty text is the end id alone.  Null ids come first; rows that
    repeat an id stand together, shorter ones first.  An empty table makes a
    file set without blocks.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = written(tokenised(docs, path, kind, end_id, id_col, text_col))

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            if batch.num_rows:
                got = np.bincount(_joined(batch.column(1), int(np.sum(batch.column(0).to_numpy()))))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[:len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    # at most as many rows as the vocabulary has ids
    counts = rows.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["n", "id"], ascending=[False, True])
    order = counts["id"].to_numpy().astype(np.int64)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ids")
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(rank_of)
    id_type = rows.schema["id"].dataType
    id_kind = id_type.simpleString()

    def encode(batches):
        shard, begin = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            piece = (np.cumsum(sizes) - sizes) // BLOCK_IDS
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                total = int(sizes[a:b].sum())
                control, data = pack(shared.value[_joined(batch.column(2).slice(a, b - a), total)])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([begin], pa.int64()), pa.array([total], pa.int64()), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a)),
                                                  pa.array([sizes[a:b]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                                                 names=["shard", "begin", "n_ids", "docs", "lengths", "control", "data"])
                begin += total

    (rows.repartitionByRange("id", "n", F.xxhash64("ids")).sortWithinPartitions("id", "n", "ids")
     .mapInArrow(encode, f"shard int, begin long, n_ids long, docs array<{id_kind}>, lengths array<long>, control binary, data binary")
     .write.option("compression", "zstd").parquet(f"{folder}/blocks"))
    remove(spark, rows)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files alone: id, start (ids of all documents
    before it), n_tokens, ids (unsigned 32-bit, little-endian)."""
    ranked = spark.read.parquet(f"{folder}/ids").toPandas().sort_values("rank")
    shared = spark.sparkContext.broadcast(ranked["id"].to_numpy().astype("<u4"))
    made = spark.read.parquet(f"{folder}/blocks")
    # one row per shard, so as many as there are files
    shards = made.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that its size is known before the blocks are joined to it
    heads = written(shards.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("head")))
    id_kind = made.schema["docs"].dataType.elementType.simpleString()

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                begin, total, docs, sizes = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2).slice(i, 1).flatten(), batch.column(3).slice(i, 1).flatten()
                ids = shared.value[unpack(batch.column(4)[i].as_buffer(), batch.column(5)[i].as_buffer(), total)]
                ends = np.cumsum(sizes.to_numpy())
                edge = np.concatenate([[0], ends]).astype(np.int64) * 4
                data = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(edge), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([docs, pa.array(begin + edge[:-1] // 4), sizes, data], names=["id", "start", "n_tokens", "ids"])

    return (made.join(heads, F.col("shard") == F.col("s")).select((F.col("begin") + F.col("head")).alias("begin"), "n_ids", "docs", "lengths", "control", "data")
            .mapInArrow(decode, f"id {id_kind}, start long, n_tokens long, ids binary"))
