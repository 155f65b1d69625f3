"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of the tokens of its documents.  In every round a queue
earns its share of a window as credit, whole tokens are served and the rest is
carried, so after r rounds a queue has served floor(r * quantum) tokens.  What
the rounds serve is one stream, cut into windows: every window but the last is
full and holds each source in its target proportion, give or take a token per
source.  When a queue is empty the others share its part; that is a new phase.

Because credits are counts, the place of a token follows from its place in its
queue by arithmetic.  Tasks need only where each of their queues begins, which
is a sum over earlier tasks: deficits carry across windows and partitions and
no task sees a whole queue.

A schedule over very many sources would not be small.  Sources beyond ``QUEUES``
get one queue with the sum of their targets, inside of which documents are in
the order of weighted fair queueing: by the tokens of their source before them
divided by its target.  Every source thus keeps its own proportion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlane.functions.order import with_position
from outlane.llm.common import written
from outlane.llm.tokens import blocks, library_table

#: Sources with a queue of their own; all others are interleaved in one more queue.
QUEUES = 255
SHARED = "\x01shared"
#: Credits are counted in parts of a token.
_BITS = 20
_PARTS = 1 << _BITS


@dataclass
class Schedule:
    """Phases of the round-robin: what is served before each, and the quanta."""

    window: int
    names: list[str]
    base: np.ndarray  # [phase + 1, queue] tokens served before the phase
    quanta: np.ndarray  # [phase, queue] credit of a round in parts of a token


def schedule(totals: dict[str, int], window: int, targets: dict[str, float] | None = None) -> Schedule:
    """Target proportions default to the sources' shares of all tokens."""
    names = sorted(totals)
    left = [totals[n] for n in names]
    weight = [float(totals[n] if targets is None else targets.get(n, 0)) for n in names]
    if any(w < 0 for w in weight):
        raise ValueError("target proportions must not be negative")
    base, quanta = [np.zeros(len(names), np.int64)], []
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        whole = sum(weight[i] for i in active)
        if whole == 0:  # only sources without a target are left
            weight, whole = [1.0] * len(names), float(len(active))
        k = [0] * len(names)
        for i in active:
            k[i] = max(round(window * _PARTS * weight[i] / whole), 1) if weight[i] > 0 else 0
        rounds = min(-(-left[i] * _PARTS // k[i]) for i in active if k[i])
        served = [min(n, rounds * q >> _BITS) for n, q in zip(left, k)]
        left = [n - s for n, s in zip(left, served)]
        base.append(base[-1] + np.array(served, np.int64))
        quanta.append(np.array(k, np.int64))
    return Schedule(window, names, np.array(base), np.array(quanta, np.int64).reshape(len(quanta), len(names)))


def _served(rounds: np.ndarray, quanta: np.ndarray) -> np.ndarray:
    """floor(rounds * quanta / parts) without overflow."""
    return (rounds >> _BITS) * quanta + (((rounds & (_PARTS - 1)) * quanta) >> _BITS)


def place(plan: Schedule, queue: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """Pieces of runs of tokens, each given by its queue, start there and size.

    Returns (run, start in the run, length, sequence, offset), in run order.
    """
    runs, starts, lengths, places = [], [], [], []
    for p in range(len(plan.quanta)):
        k, low, high = plan.quanta[p], plan.base[p], plan.base[p + 1]
        first = np.maximum(begin, low[queue])
        last = np.minimum(begin + size, high[queue])
        who = np.flatnonzero(first < last)
        if not len(who):
            continue
        q, a, b = queue[who], first[who] - low[queue[who]], last[who] - low[queue[who]]
        r0, r1 = ((a + 1) * _PARTS - 1) // k[q], (b * _PARTS - 1) // k[q]
        n = r1 - r0 + 1
        owner = np.repeat(np.arange(len(who)), n)
        r = np.repeat(r0 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        s = np.maximum(_served(r, k[q][owner]), a[owner])
        e = np.minimum(_served(r + 1, k[q][owner]), b[owner])
        some = e > s
        owner, r, s, e = owner[some], r[some], s[some], e[some]
        rounds, at = np.unique(r, return_inverse=True)
        limit = high - low
        before = np.minimum(_served(rounds[:, None], k[None, :]), limit)
        share = np.minimum(_served(rounds[:, None] + 1, k[None, :]), limit) - before
        head = low.sum() + before.sum(axis=1)[:, None] + np.cumsum(share, axis=1) - share
        own = q[owner]
        runs.append(who[owner])
        starts.append(s + low[own] - begin[who[owner]])
        lengths.append(e - s)
        places.append(head[at, own] + s - before[at, own])
    if not runs:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    run, start, length, to = (np.concatenate(x) for x in (runs, starts, lengths, places))
    order = np.lexsort((start, run))
    run, start, length, to = run[order], start[order], length[order], to[order]
    n = (to + length - 1) // plan.window - to // plan.window + 1  # cut at the ends of windows
    owner = np.repeat(np.arange(len(run)), n)
    window = (to // plan.window)[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    s = np.maximum(window * plan.window, to[owner])
    e = np.minimum((window + 1) * plan.window, (to + length)[owner])
    return run[owner], start[owner] + s - to[owner], e - s, window, s - window * plan.window


def tokenised(docs: DataFrame, path: str, kind: str, end_id: int, source_col: str, id_col: str, text_col: str) -> DataFrame:
    """(id, source, task, begin, n, ids): ``begin`` counts the source's tokens that
    the same task has read before; ids are unsigned 32-bit, the end id last."""
    id_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        table, task, seen = library_table(path, kind), TaskContext.get().partitionId(), {}
        for batch in blocks(batches, 2):
            ids, counts = table.encode(batch.column(2))
            counts = counts.astype(np.int64) + 1
            ends = np.cumsum(counts)
            out = np.full(int(ends[-1]), end_id, "<u4")
            inside = np.ones(len(out), bool)
            inside[ends - 1] = False
            out[inside] = ids
            begin = []
            for name, n in zip(batch.column(1).to_pylist(), counts.tolist()):
                begin.append(seen.get(name, 0))
                seen[name] = begin[-1] + n
            edge = np.concatenate([[0], ends]) * 4
            data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(counts), task, np.int32)), pa.array(begin, pa.int64()), pa.array(counts), data],
                                             names=["id", "source", "task", "begin", "n", "ids"])

    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), source, F.col(text_col)).mapInArrow(run, f"id {id_kind}, source string, task int, begin long, n long, ids binary")


def interleaved(tail: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, task, begin, place): place of each document of ``tail`` (source, task,
    begin, head, n) in the shared queue.

    Documents are in the order of (tokens of the source before them) / weight;
    sources without a weight come after all others, by share of their tokens.
    """
    before = (F.col("head") + F.col("begin")).cast("double")
    late = F.col("weight") <= 0
    turn = tail.join(weights, "source").select("source", "task", "begin", "n", late.cast("int").alias("late"), (before / F.when(late, F.col("total")).otherwise(F.col("weight"))).alias("turn"), before.alias("before"))
    placed = with_position(turn.withColumn("all", F.lit(0)), ["all"], [("late", "asc"), ("turn", "asc"), ("source", "asc"), ("before", "asc")], "p", {"upto": F.col("n")})
    return placed.select("source", "task", "begin", (F.col("upto") - F.col("n")).alias("place"))


def packed(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 0, window: int = 1024, targets: dict[str, float] | None = None,
           source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", queues: int = QUEUES) -> DataFrame:
    """One row per piece: id, start, ids (binary), doc_tokens, sequence_id, offset.

    Every token of every document (its ids, then ``end_id``) lies in exactly one
    piece; sequences are numbered from 0 and filled without gaps, all but the
    last to ``window`` tokens.  A null or empty text is its end id alone; null
    sources are the source with the empty name; null or repeated ids are packed
    as rows of their own.  The ``queues`` sources with the highest targets (without
    ``targets``: with most tokens) have their own queue, the others are
    interleaved in one with the sum of their targets.  A queue takes documents of
    a source in the order of the input's partitions.  An empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = written(tokenised(docs, path, kind, end_id, source_col, id_col, text_col))
    sums = written(rows.groupBy("source", "task").agg(F.sum("n").alias("n")))
    totals = sums.groupBy("source").agg(F.sum("n").alias("total"))
    if targets is None:
        weights = totals.withColumn("weight", F.col("total").cast("double"))
    else:
        if any(w < 0 for w in targets.values()):
            raise ValueError("target proportions must not be negative")
        given = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, weight double")
        weights = totals.join(given, "source", "left").na.fill(0.0, ["weight"])
    weights = written(weights)
    first = weights.orderBy(F.desc("weight"), F.desc("total"), "source").limit(queues).collect()
    plan_totals, plan_targets = {r.source: r.total for r in first}, {r.source: r.weight for r in first}
    many = weights.count() > len(first)
    own = F.col("source").isin(list(plan_totals))
    shared = SHARED
    while shared in plan_totals:
        shared += SHARED
    if many:
        rest = weights.filter(~own).agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).first()
        plan_totals[shared], plan_targets[shared] = rest.total, rest.weight
    plan = schedule(plan_totals, window, None if targets is None else plan_targets)
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    heads = written(sums.select("source", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("head")))
    number = {name: i for i, name in enumerate(plan.names)}
    kind_of_id = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            size = batch.column(3).to_numpy()
            if not len(size):
                continue
            queue_at = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            run_at, start, length, sequence, offset = place(plan, queue_at, batch.column(2).to_numpy(), size)
            ids = batch.column(4)
            edge = np.zeros(len(length) + 1, np.int64)
            np.cumsum(length * 4, out=edge[1:])
            # pieces of a batch lie in the order of its tokens: its bytes are cut, not copied
            low = int(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset])
            data = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(edge.astype(np.int32)), ids.buffers()[2].slice(low)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(run_at)), pa.array(start), data, pa.array(size[run_at]), pa.array(sequence), pa.array(offset.astype(np.int32))],
                                             names=["id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

    known = rows.join(heads, ["source", "task"])
    placed = (known.filter(own) if many else known).select("id", F.col("source").alias("queue"), (F.col("begin") + F.col("head")).alias("begin"), "n", "ids")
    if many:
        turns = written(interleaved(known.filter(~own).drop("id", "ids"), weights))
        tail = rows.filter(~own).join(turns, ["source", "task", "begin"])
        placed = placed.unionAll(tail.select("id", F.lit(shared).alias("queue"), F.col("place").alias("begin"), "n", "ids"))
    return placed.mapInArrow(run, f"id {kind_of_id}, start long, ids binary, doc_tokens long, sequence_id long, offset int")


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): whole sequences, padded to ``window`` unless
    their size is a power of two."""
    one = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    kind = "sequence_id long, ids binary, n_tokens int"

    def run(batches):
        pad = np.array([pad_id], "<u4").tobytes()
        for batch in batches:
            made, counts = [], []
            for parts in batch.column(1).to_pylist():
                data = b"".join(p["ids"] for p in parts)
                n = len(data) // 4
                counts.append(n)
                made.append(data if n & (n - 1) == 0 else data + pad * (window - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(counts, pa.int32())], names=["sequence_id", "ids", "n_tokens"])

    return one.mapInArrow(run, kind)
