"""Near-duplicate vectors with inverted lists and product quantisation.

Unit vectors are put in the list of their nearest centroid; the residual is
coded by subspace.  A query is compared with the lists it probes: distances come
from a table of its products with the codewords (asymmetric: the query is not
coded), and what is within reach by them, allowing each vector its own coding
error, is compared exactly in double precision.

Probes: a vector at distance d from the query lies in another list only if the
query is within d of that list's cell.  A near copy moves in some direction out
of many, so its part along the line between two centroids is far below d: cells
within ``REACH`` are probed (0.15; the bound that needs no such argument is
sqrt(2 - 2 * least cosine) = 0.316 at 0.95, and can be asked for).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlane.llm.common import components, remove, written

REACH = 0.15
#: Expected vectors of the sample that centroids and codewords are fitted on.
SAMPLE_ROWS = 32_768
MOST_LISTS = 4096
SUBSPACES = 8
CODEWORDS = 256
#: Members that a task holds at a time; more where there would be over
#: ``MOST_GROUPS`` groups.
GROUP_ROWS = 4096
MOST_GROUPS = 10_000
_PAIRS = 1 << 19


def unit_rows(data: list[bytes], width: int) -> np.ndarray:
    """Rows of unit length in double precision; shorter vectors end in zeros."""
    if all(len(x) == 8 * width for x in data):
        out = np.frombuffer(b"".join(data), "<f8").reshape(len(data), width).copy()
    else:
        out = np.zeros((len(data), width))
        for i, x in enumerate(data):
            out[i, :len(x) // 8] = np.frombuffer(x, "<f8")
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0)


def centres(rows: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows of the sample."""
    out = np.unique(rows, axis=0)
    out = out[np.linspace(0, len(out) - 1, min(count, len(out))).astype(int)].copy()
    for _ in range(rounds):
        near = squared(rows, out).argmin(axis=1)
        order = np.argsort(near, kind="stable")
        own, first = np.unique(near[order], return_index=True)
        out[own] = np.add.reduceat(rows[order], first, axis=0) / np.diff(np.append(first, len(rows)))[:, None]
    return out


class Quantiser:
    """Coarse centroids and the codewords of residuals."""

    def __init__(self, sample: np.ndarray, lists: int, reach: float):
        self.width = sample.shape[1]
        self.step = -(-self.width // SUBSPACES)
        self.coarse = centres(sample, lists)
        near = squared(sample, self.coarse).argmin(axis=1)
        left = self._split(sample - self.coarse[near])
        self.words = [centres(left[:, m], CODEWORDS, 6) for m in range(SUBSPACES)]
        self.gap = np.sqrt(np.maximum(squared(self.coarse, self.coarse), 1e-18))
        self.reach = reach

    def _split(self, rows: np.ndarray) -> np.ndarray:
        whole = np.zeros((len(rows), SUBSPACES * self.step))
        whole[:, :self.width] = rows
        return whole.reshape(len(rows), SUBSPACES, self.step)

    def lists(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own list of each row, and [row, list] whether it probes the list."""
        far = squared(rows, self.coarse)
        own = far.argmin(axis=1)
        cell = (far - far[np.arange(len(rows)), own][:, None]) / (2 * self.gap[own])
        probe = cell <= self.reach
        probe[np.arange(len(rows)), own] = True
        return own, probe

    def cell_distance(self, rows: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        a, b = ((rows - self.coarse[k]) ** 2 for k in (other, own))
        return np.where(own == other, 0, (a.sum(axis=1) - b.sum(axis=1)) / (2 * self.gap[own, other]))

    def encode(self, rows: np.ndarray, own: np.ndarray):
        """Codes, coding errors, and the part of a squared distance that does not
        depend on the query: |w|^2 + 2 c.w over the codewords w of the row."""
        left = self._split(rows - self.coarse[own])
        base = self._split(self.coarse[own])
        codes = np.zeros((len(rows), SUBSPACES), np.uint8)
        error, fixed = np.zeros(len(rows)), np.zeros(len(rows))
        for m, words in enumerate(self.words):
            codes[:, m] = squared(left[:, m], words).argmin(axis=1)
            chosen = words[codes[:, m]]
            error += ((left[:, m] - chosen) ** 2).sum(axis=1)
            fixed += (chosen * chosen).sum(axis=1) + 2 * (base[:, m] * chosen).sum(axis=1)
        return codes, np.sqrt(error), fixed.astype(np.float32)

    def tables(self, rows: np.ndarray) -> list[np.ndarray]:
        """[subspace][row, codeword]: -2 q.w, the query's part of a distance."""
        parts = self._split(rows)
        return [(-2 * parts[:, m] @ words.T).astype(np.float32) for m, words in enumerate(self.words)]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it is joined to), for nodes that are not the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, least)
        np.minimum.at(after, right, least)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class _Group:
    """Members of one group by list, and the queries compared with them."""

    def __init__(self, model: Quantiser, cosine: float):
        self.model, self.cosine = model, cosine
        self.limit = math.sqrt(max(2 - 2 * cosine, 0)) + 1e-6
        self.clear()

    def clear(self) -> None:
        self.waiting, self.lists = [], None

    def add(self, ids, copies, rows) -> None:
        self.waiting.append((ids, copies, rows))

    def _seal(self) -> None:
        ids, copies, rows = (np.concatenate(x) for x in zip(*self.waiting))
        own = squared(rows, self.model.coarse).argmin(axis=1)
        codes, error, fixed = self.model.encode(rows, own)
        self.lists = {}
        for k in np.unique(own).tolist():
            at = np.flatnonzero(own == k)
            self.lists[k] = (ids[at], copies[at], rows[at], codes[at], ((error[at] + self.limit) ** 2).astype(np.float32) + np.float32(1e-4), fixed[at])

    def compare(self, ids, copies, rows):
        """Yields (a, b, n) arrays: n links to add to a, or an edge if n is 0."""
        if not self.waiting:
            return
        if self.lists is None:
            self._seal()
        model = self.model
        own, probe = model.lists(rows)
        tables = model.tables(rows)
        far = squared(rows, model.coarse)
        a, b, held = [], [], 0
        for k, (m_ids, m_copies, m_rows, codes, allowed, fixed) in self.lists.items():
            who = np.flatnonzero(probe[:, k])
            step = max(1, _PAIRS // len(m_ids))
            for i in range(0, len(who), step):
                q = who[i:i + step]
                near = far[q, k].astype(np.float32)[:, None] + fixed[None, :]
                for m in range(SUBSPACES):
                    near += np.take(tables[m][q], codes[:, m], axis=1)
                x, y = np.nonzero(near <= allowed[None, :])
                for j in range(0, len(x), 65536):
                    qx, my = q[x[j:j + 65536]], y[j:j + 65536]
                    ok = (np.einsum("ij,ij->i", rows[qx], m_rows[my]) >= self.cosine) & (ids[qx] != m_ids[my])
                    qx, my = qx[ok], my[ok]
                    if not len(qx):
                        continue
                    count = np.bincount(qx, weights=m_copies[my], minlength=len(ids)).astype(np.int64)
                    some = np.flatnonzero(count)
                    yield ids[some], ids[some], count[some]
                    # links that the member, as a query, does not find itself
                    lone = model.cell_distance(m_rows[my], np.full(len(my), k), own[qx]) > model.reach
                    if lone.any():
                        yield m_ids[my[lone]], m_ids[my[lone]], copies[qx[lone]]
                    a.append(ids[qx])
                    b.append(m_ids[my])
                    held += len(qx)
                    if held > 1_000_000:
                        node, least = spanning(np.concatenate(a), np.concatenate(b))
                        a, b, held = [node], [least], len(node)
        if held:
            node, least = spanning(np.concatenate(a), np.concatenate(b))
            yield node, least, np.zeros(len(node), np.int64)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, reach: float = REACH, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    n_links counts the other rows linked directly, copies included;
    component_id is the smallest id that links reach.  Identical vectors are
    compared one time and count as many times as they occur.  Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing,
    and a row with a null id likewise.  Vectors of different length are compared as if the
    shorter one ended in zeros.  An empty table gives no rows; other columns
    are not read.
    """
    spark = vectors.sparkSession
    vector = F.col("v")
    rows = written(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
                   .withColumn("ok", F.coalesce(F.col("id").isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                                                & F.exists(vector, lambda x: x != 0), F.lit(False)))
                   .withColumns({"h": F.when(F.col("ok"), F.xxhash64("v")), "g": F.when(F.col("ok"), F.xxhash64(F.lit("near"), vector))}))
    packed = written(rows.filter("ok").groupBy("h", "g").agg(F.min("id").alias("rid"), F.count("*").alias("copies"), F.first("v").alias("v")))
    totals = packed.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not totals["n"]:
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    count, width = totals["n"], totals["width"]
    drawn = packed.filter(F.pmod(F.xxhash64(F.lit("sample"), "rid"), F.lit(1 << 30)) < int(min(1.0, sample_rows / count) * (1 << 30))).orderBy("rid").select("v").limit(2 * sample_rows).collect()
    if not drawn:
        drawn = packed.orderBy("rid").select("v").limit(1).collect()
    sample = unit_rows([np.array(r[0], "<f8").tobytes() for r in drawn], width)
    model = Quantiser(sample, max(1, min(round(math.sqrt(count)), MOST_LISTS, len(sample) // 8 or 1)), reach)
    shared = spark.sparkContext.broadcast(model)

    def vectors_of(column) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        sizes = column.value_lengths().to_numpy()
        if (sizes == width).all():
            out = flat.reshape(-1, width).copy()
        else:
            out = np.zeros((len(sizes), width))
            out[np.arange(width)[None, :] < sizes[:, None]] = flat
        out /= np.abs(out).max(axis=1, keepdims=True)
        return out / np.sqrt((out * out).sum(axis=1, keepdims=True))

    def sizes(batches):
        total = np.zeros(len(shared.value.coarse), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(squared(vectors_of(batch.column(0)), shared.value.coarse).argmin(axis=1), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "n"])

    per_list = np.zeros(len(model.coarse), np.int64)
    for r in packed.select("v").mapInArrow(sizes, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        per_list[r[0]] = r[1]
    begin = np.cumsum(per_list) - per_list
    group_rows = max(GROUP_ROWS, -(-count // MOST_GROUPS))
    groups = max(1, -(-int(per_list.sum()) // group_rows))

    def deal(batches):
        """Members to their group (a large list spans several), queries to every
        group with a list that they probe."""
        model = shared.value
        low, high = begin // group_rows, np.minimum((begin + np.maximum(per_list, 1) - 1) // group_rows, groups - 1)
        reaches = np.zeros((len(low), groups), np.float32)
        for k in range(len(low)):
            if per_list[k]:
                reaches[k, low[k]:high[k] + 1] = 1
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, data = part.column(0).to_numpy(), vectors_of(part.column(2))
                own, probe = model.lists(data)
                share = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.float64) / (1 << 24)
                home = np.minimum((begin[own] + (share * per_list[own]).astype(np.int64)) // group_rows, groups - 1)
                who, to = np.nonzero(probe.astype(np.float32) @ reaches)
                take = pa.array(np.concatenate([np.arange(len(ids)), who]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([home, to]).astype(np.int32)), pa.array(np.concatenate([np.zeros(len(ids), bool), np.ones(len(who), bool)])),
                                                  part.column(0).take(take), part.column(1).take(take), part.column(2).take(take)], names=["grp", "query", "rid", "copies", "v"])

    def compare(batches):
        state, now = _Group(shared.value, cosine), None
        for batch in batches:
            grp, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(grp) != 0) | (query[1:] != query[:-1])) + 1).tolist(), len(grp)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e == s:
                    continue
                if grp[s] != now:
                    state.clear()
                    now = grp[s]
                for i in range(s, e, 2048):
                    part = batch.slice(i, min(2048, e - i))
                    own = part.column(2).to_numpy(), part.column(3).to_numpy(), vectors_of(part.column(4))
                    if not query[s]:
                        state.add(*own)
                        continue
                    for a, b, n in state.compare(*own):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    dealt = packed.select("rid", "copies", "v").mapInArrow(deal, "grp int, query boolean, rid long, copies long, v array<double>")
    found = written(dealt.repartitionById(groups, "grp").sortWithinPartitions("grp", "query").mapInArrow(compare, "a long, b long, n long"))
    links = found.filter("n > 0").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("n = 0").select("a", "b"))
    named = (packed.select("h", "g", "rid", "copies").join(links, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
             .select(F.col("h").alias("rh"), F.col("g").alias("rg"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rid").alias("component_id")))
    named = written(named)
    remove(spark, packed, found)
    return (rows.select("id", "h", "g").join(named, (F.col("h") == F.col("rh")) & (F.col("g") == F.col("rg")), "left")
            .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = v.vec_id"""
