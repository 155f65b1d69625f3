"""Clustering around centroids in integers, with Orchard's nearest-centroid search.

Every centroid has a list of all centroids in ascending distance.  A vector walks
down the list of the closest centroid known so far; if an entry is closer it goes
on in that entry's list, and it stops when the list's entries are further from
the list's centroid than twice its own distance, since none of those can be
closer (strictly further: an equal one with a smaller number may win the tie).
Visited centroids are marked, so no distance is taken twice.

All arithmetic is exact, so results do not depend on partitions: sums per
centroid are added up by Spark, and only centroids reach the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlane.llm.common import written

#: Vectors that walk together.
BLOCK = 4096
#: Components up to this size have squared distances of 64 components in 64 bits.
SAFE = 1 << 27


class Centroids:
    """Integer centroids with their neighbour lists."""

    def __init__(self, points: list[list[int]]):
        self.points = points
        size = len(points)
        gaps = [[sum((a - b) ** 2 for a, b in zip(x, y)) for y in points] for x in points]
        self.order = np.array([sorted(range(size), key=lambda j, i=i: (gaps[i][j], j)) for i in range(size)], np.int64).reshape(size, size)
        small = all(abs(v) <= SAFE for x in points for v in x)
        self.exact = np.array(points, np.int64 if small else object)
        self.gap = np.array([[gaps[i][j] for j in self.order[i]] for i in range(size)], np.int64 if small else object)
        self.small = small

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row; ties take the smaller number.

        ``rows`` are int64 with components up to ``SAFE``, or Python integers."""
        points, gap = self.exact, self.gap
        if rows.dtype == object or not self.small:
            rows, points, gap = rows.astype(object), points.astype(object), gap.astype(object)
        n, size = len(rows), len(points)
        best = np.zeros(n, np.int64)
        far = ((rows - points[0]) ** 2).sum(axis=1)
        seen = np.zeros((n, size), bool)
        seen[:, 0] = True
        place = np.ones(n, np.int64)  # each list begins with its own centroid
        active = np.arange(n)
        while True:
            active = active[place[active] < size]
            at = best[active]
            active = active[(gap[at, place[active]] <= 4 * far[active]).astype(bool)]
            if not len(active):
                return best, far
            entry = self.order[best[active], place[active]]
            place[active] += 1
            new = ~seen[active, entry]
            who, entry = active[new], entry[new]
            seen[who, entry] = True
            d = ((rows[who] - points[entry]) ** 2).sum(axis=1)
            closer = ((d < far[who]) | ((d == far[who]) & (entry < best[who]))).astype(bool)
            who = who[closer]
            best[who], far[who], place[who] = entry[closer], d[closer], 1


def whole_numbers(vectors: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept rows, floor(scale * x) of each): vectors of ``size`` components, none
    null or not finite."""
    vectors = vectors.cast(pa.list_(pa.float64())) if not pa.types.is_null(vectors.type) else pa.array([None] * len(vectors), pa.list_(pa.float64()))
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)  # null components become NaN
    fits = np.flatnonzero((np.diff(offsets) == size) & vectors.is_valid().to_numpy(zero_copy_only=False))
    rows = values[offsets[:-1][fits][:, None] + np.arange(size)].reshape(len(fits), size)
    good = np.isfinite(rows).all(axis=1)
    kept, rows = fits[good], rows[good]
    with np.errstate(over="ignore"):
        floors = np.floor(scale * rows)
    if not len(rows) or np.abs(floors).max(initial=0) <= SAFE:
        return kept, floors.astype(np.int64)
    exact = np.array([[math.floor(scale * v) if math.isfinite(scale * v) else scale * int(v) for v in row] for row in rows.tolist()], object)
    return kept, exact.reshape(rows.shape)


def _start(vectors: DataFrame, count: int, size: int, scale: int, seed: int) -> list[list[int]]:
    """Vectors with the smallest hashes of ``seed:id``, in ascending order; rows
    that repeat an id are ordered by their components, null ids come last."""
    def run(batches):
        best = []
        for batch in batches:
            kept, rows = whole_numbers(batch.column(1), size, scale)
            ids = batch.column(0).take(pa.array(kept)).to_pylist()
            own = [(x is None, hashlib.sha256(f"{seed}:{x}".encode()).hexdigest(), r) for x, r in zip(ids, rows.tolist())]
            best = sorted(best + own)[:count]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in best], pa.bool_()), pa.array([x[1] for x in best], pa.string()), pa.array([[str(v) for v in x[2]] for x in best], pa.list_(pa.string()))], names=["last", "hash", "point"])

    made = vectors.mapInArrow(run, "last boolean, hash string, point array<string>")
    found = sorted((r.last, r.hash, [int(v) for v in r.point]) for r in made.orderBy("last", "hash").limit(2 * count).collect())
    return [x[2] for x in found[:count]]


def _sums(vectors: DataFrame, centroids: Centroids, size: int, scale: int) -> list:
    """(cluster, count, component sums) over all vectors: one row per centroid and task leaves."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        total = {}
        for batch in batches:
            kept, rows = whole_numbers(batch.column(1), size, scale)
            for i in range(0, len(kept), BLOCK):
                block = rows[i:i + BLOCK]
                cluster, _ = shared.value.nearest(block)
                for c in np.unique(cluster).tolist():
                    own = block[cluster == c]
                    n, sums = total.get(c, (0, [0] * size))
                    total[c] = n + len(own), [a + int(b) for a, b in zip(sums, own.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([[str(v) for v in x[1]] for x in total.values()], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    wide = "decimal(38,0)"
    made = vectors.mapInArrow(run, "cluster int, n long, sums array<string>")
    parts = made.select("cluster", "n", *[F.col("sums")[k].cast(wide).alias(f"s{k}") for k in range(size)])
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(size)]).collect()


def _assigned(vectors: DataFrame, centroids: Centroids, size: int, scale: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            kept, rows = whole_numbers(batch.column(1), size, scale)
            got = [shared.value.nearest(rows[i:i + BLOCK]) for i in range(0, len(kept), BLOCK)] or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            cluster = np.concatenate([x[0] for x in got])
            distance = [int(v) for x in got for v in x[1]]  # over 64 bits raises
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {kind}, cluster int, distance long")


def clustered(vectors: DataFrame, count: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia,
    inertia, centroid (components of its final centroid).

    Kept are vectors with exactly ``size`` components, none null or not finite;
    component x becomes floor(scale * x).  Centroids start as the ``count`` vectors
    with the smallest SHA-256 of ``seed:id`` and are moved ``rounds`` times to the
    componentwise floor of their vectors' mean; empty ones stay.  Ties take the
    smaller centroid.  Fewer vectors than ``count`` make fewer centroids, equal
    ones included; no kept vector gives no rows.  Repeated ids are kept as rows, a
    null id too, which starts a centroid only if there are not enough others.
    Distances, sums and means are exact; a distance or an inertia of over 63 bits
    raises.  Other columns are not read.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    points = _start(given, count, size, scale, seed)
    for _ in range(rounds if points else 0):
        points = [list(p) for p in points]
        for row in _sums(given, Centroids(points), size, scale):
            points[row.cluster] = [int(row[f"s{k}"]) // row.n for k in range(size)]
    rows = written(_assigned(given, Centroids(points), size, scale)) if points else spark.createDataFrame([], f"id {given.schema['id'].dataType.simpleString()}, cluster int, distance long")
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()} if points else {}
    total = sum(inertia.values())
    # one row per centroid
    centroids = spark.createDataFrame([(c, s, total, points[c]) for c, s in sorted(inertia.items())], "of int, cluster_inertia long, inertia long, centroid array<bigint>").coalesce(1)
    return rows.join(F.broadcast(centroids), F.col("cluster") == F.col("of")).drop("of")


_ASSIGN = """
d{k} AS (SELECT vec_id, c, sum((x - m) * (x - m)) AS dist FROM v JOIN c{k} USING (j) GROUP BY ALL),
a{k} AS (SELECT vec_id, c, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) AS r FROM d{k}) WHERE r = 1),"""
_MOVE = """
c{next} AS (SELECT c, j, coalesce(n.m, o.m) AS m FROM c{k} AS o LEFT JOIN (
  SELECT c, j, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS m FROM v JOIN a{k} USING (vec_id) GROUP BY ALL) AS n USING (c, j)),"""
SQL = """
WITH v AS (SELECT vec_id, j, CAST(floor(64 * CAST(embedding[j] AS DOUBLE)) AS BIGINT) AS x FROM embeddings, range(1, 65) AS t(j)
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v) QUALIFY c < 16),
c0 AS (SELECT c, j, x AS m FROM v JOIN s USING (vec_id)),""" + "".join(_ASSIGN.format(k=k) + (_MOVE.format(k=k, next=k + 1) if k < 3 else "") for k in range(4)) + """
h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a3 JOIN h USING (c)"""
