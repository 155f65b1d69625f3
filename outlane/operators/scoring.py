"""Nearest-neighbour, centroid and density scores against normal references.

Series travel as one row with an array.  A query row meets reference rows of
its dataset inside one task as a matrix product; pairs are never rows.  A
reference of more rows than one block is cut by its nearest pivot and the distance
to it; a query first searches the block that it lies in, which bounds the distance
of its neighbours, and then only blocks that the triangle inequality does not
rule out.  Neighbours of blocks are merged to the exact result, and blocks with
many queries are dealt over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlane.functions.columns import array_sum
from outlane.functions.order import exact_quantiles, with_position
from outlane.operators.quality import reference_rows
from outlane.session import stage

#: Rows of a block: every query row travels once for each reference block that it
#: must see, every reference row once for each query block.
QUERY_BLOCK = 16_384
REFERENCE_BLOCK = 16_384
MOST_PIVOTS = 256
#: Cells of a distance matrix, and coordinates that are measured again at a time.
CELLS, MEASURED = 4_000_000, 4_000_000
NEAR = "array<struct<d:double,rid:bigint>>"

# Guards of the density scores and of the robust scaling.
RADIUS_EPS = 1e-9
SPREAD_EPS = 1e-6


# ---- scaling ----------------------------------------------------------------

def feature_quantiles(reference: DataFrame, quantiles: dict[str, float], keys=("dataset",)) -> DataFrame:
    """Per (keys, feature) exact linear quantiles of an array column ``vec``,
    whatever the number of reference rows."""
    long = reference.select(*keys, F.posexplode("vec").alias("feature", "v"))
    return exact_quantiles(long, [*keys, "feature"], "v", quantiles)


def pack(features: DataFrame, columns: list[str], keys=("dataset",)) -> DataFrame:
    """Long per-feature values -> one array per column (bounded by the width)."""
    packed = features.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("feature", *columns))).alias("p"))
    return packed.select(*keys, *[F.col(f"p.{c}").alias(c) for c in columns])


def robust_scale(rows: DataFrame, reference: DataFrame, keys=("dataset",)) -> DataFrame:
    """(x - median) / (p90 - p10) per feature, fitted on the reference."""
    fit = feature_quantiles(reference, {"lo": 0.1, "mid": 0.5, "hi": 0.9}, keys)
    width = F.col("hi") - F.col("lo")
    fit = pack(fit.withColumn("width", F.when(width == 0, 1.0).otherwise(width)), ["mid", "width"], keys)
    scaled = F.transform(F.arrays_zip("vec", "mid", "width"), lambda z: (z["vec"] - z["mid"]) / z["width"])
    return rows.join(fit, list(keys)).withColumn("vec", scaled).drop("mid", "width")


# ---- neighbours -------------------------------------------------------------

def _nearest(q: np.ndarray, ref: np.ndarray, rid: np.ndarray, own: np.ndarray | None, k: int, most: np.ndarray | None = None) -> list:
    """k nearest reference rows of each query, ties to the lower reference id; with
    ``most``, the distance of the k-th one elsewhere, only rows within it.

    A matrix product ranks them; what it cannot tell apart from the k-th by
    more than its rounding error is measured again, coordinate by coordinate,
    all candidates of some queries at a time.
    """
    size_q, size_r = (q * q).sum(axis=1), (ref * ref).sum(axis=1)
    rough = size_q[:, None] + size_r[None, :] - 2 * q @ ref.T
    if own is not None:
        rough[own] = np.inf
    slack = 2e-12 * (size_q + size_r.max()) * q.shape[1] + 1e-300
    limit = np.full(len(q), np.inf)
    if most is not None:
        limit = most * most * (1 + 1e-9) + slack
    open_ = np.flatnonzero(~np.isfinite(limit))
    if len(open_):
        take = min(k, len(ref))
        limit[open_] = np.partition(rough[open_], take - 1, axis=1)[:, take - 1] + slack[open_]
    counts = ((rough <= limit[:, None]) & (rough < np.inf)).sum(axis=1)
    out, ends = [], np.cumsum(counts)
    begin, step = 0, max(1, MEASURED // max(1, q.shape[1]))
    while begin < len(q):  # candidates of some queries, of one at least
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + step, side="right")))
        part = rough[begin:end]
        who, near = np.nonzero((part <= limit[begin:end, None]) & (part < np.inf))
        dist = np.sqrt(((q[begin + who] - ref[near]) ** 2).sum(axis=1))
        order = np.lexsort((rid[near], dist, who))
        who, d, r = who[order], dist[order].tolist(), rid[near[order]].tolist()
        starts = np.searchsorted(who, np.arange(end - begin + 1)).tolist()
        out += [[{"d": d[j], "rid": r[j]} for j in range(a, min(a + k, b))] for a, b in zip(starts[:-1], starts[1:])]
        begin = end
    return out


def _block_neighbours(k: int, skip_self: bool):
    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"dataset": [], "split": [], "idx": [], "near": []})
        ref, rid = np.stack(right["ref_vec"].to_numpy()).astype(float), right["rid"].to_numpy()
        out = []
        step = max(1, CELLS // len(ref))
        for start in range(0, len(left), step):
            part = left.iloc[start:start + step]
            q = np.stack(part["query_vec"].to_numpy()).astype(float)
            own = None
            if skip_self:
                own = (part["split"].to_numpy() == "TRAIN")[:, None] & (part["idx"].to_numpy()[:, None] == rid[None, :])
            out += _nearest(q, ref, rid, own, k, part["most"].to_numpy() if "most" in part else None)
        found = pd.DataFrame({"dataset": left["dataset"], "split": left["split"], "idx": left["idx"], "near": out})
        # a block without nearer rows has nothing to send
        return found[[len(x) > 0 for x in out]] if "most" in left else found
    return work


def neighbours(rows: DataFrame, reference: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
    """(dataset, split, idx, near): the k nearest reference rows, ties to the
    lower reference id.

    ``rows``: (dataset, split, idx, vec); ``reference``: (dataset, idx, vec), any
    number of rows.
    """
    sizes = stage(reference.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")))
    large = sizes.filter(F.col("n") > REFERENCE_BLOCK)
    left = rows.select("dataset", "split", "idx", F.col("vec").alias("query_vec"))
    right = reference.select("dataset", F.col("idx").alias("rid"), F.col("vec").alias("ref_vec"))
    if large.isEmpty():
        return _merged(_searched(left.join(sizes.select("dataset"), "dataset", "left_semi"), right, ["dataset"], k, skip_self), k)
    names = large.select("dataset")
    small = sizes.filter(F.col("n") <= REFERENCE_BLOCK).select("dataset")
    found = _searched(left.join(small, "dataset", "left_semi"), right.join(small, "dataset", "left_semi"), ["dataset"], k, skip_self)
    return _merged(found.unionByName(_pruned(left.join(names, "dataset", "left_semi"), right.join(names, "dataset", "left_semi"), large, k, skip_self)), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("dataset", "split", "idx").agg(F.flatten(F.collect_list("near")).alias("near"))
    return merged.withColumn("near", F.slice(F.array_sort("near"), 1, k))


def _searched(left: DataFrame, right: DataFrame, keys: list[str], k: int, skip_self: bool) -> DataFrame:
    """Each query of ``left`` against the one block of ``right`` with its keys;
    queries of a block are dealt over tasks, which get the block each."""
    counts = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qn"))
    dealt = left.join(counts, keys).withColumn("qb", F.pmod(F.xxhash64("idx"), F.col("qn")).cast("int")).drop("qn")
    copies = right.join(counts, keys).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1))).drop("qn")
    keys = [*keys, "qb"]
    copies = copies.select("rid", "ref_vec", *[F.col(c).alias(f"ref_{c}") for c in keys])
    return dealt.groupBy(*keys).cogroup(copies.groupBy(*[f"ref_{c}" for c in keys])).applyInPandas(
        _block_neighbours(k, skip_self), f"dataset string, split string, idx bigint, near {NEAR}")


# -- pruning by pivots ---------------------------------------------------------

def row_chunks(df: DataFrame, vec: str, *others: str) -> DataFrame:
    """(dataset, ids, data): rows of a dataset packed by the thousand, so that what
    a dataset has in common is joined once a chunk."""
    counts = df.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / 1000).alias("chunks"))
    packed = df.join(counts, "dataset").groupBy("dataset", F.pmod(F.xxhash64(*others), F.col("chunks"))).agg(F.collect_list(F.struct(*others, vec)).alias("r"))
    return packed.select("dataset", *[F.col(f"r.{c}").alias(c) for c in others], F.flatten(f"r.{vec}").alias("data"))


def _far(x: np.ndarray, pivots: list) -> np.ndarray:
    return np.stack([np.sqrt(((x - np.asarray(p, float)) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _data(batch: pa.RecordBatch, i: int, rows: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("data"))[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def reference_blocks(reference: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows by (dataset, cell, ring), and per dataset its pivots and blocks.

    A cell has the rows nearest to one of up to ``MOST_PIVOTS`` pivots, one per
    ``REFERENCE_BLOCK`` rows; a ring has that many rows in order of their distance to
    the pivot.  Pivots are rows in hash order: they matter for speed only.
    """
    named = reference.withColumnRenamed("rid", "idx")
    first = reference_rows(named.select("dataset", "idx", "ref_vec"), MOST_PIVOTS, "pivot")
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(F.xxhash64("idx"), "idx"))
    wanted = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") / REFERENCE_BLOCK))
    pivots = stage(first.join(sizes, "dataset").withColumn("r", rank).filter(F.col("r") <= wanted).groupBy("dataset").agg(F.collect_list("ref_vec").alias("pivots")))

    def assign(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rid = batch.column(1)[i].values
                x = _data(batch, i, len(rid))
                far = _far(x, batch.column(3)[i].as_py())
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(x)), rid, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]), _vectors(x)],
                                                 names=["dataset", "rid", "cell", "far", "ref_vec"])

    cells = row_chunks(reference, "ref_vec", "rid").join(pivots, "dataset").select("dataset", "rid", "data", "pivots").mapInArrow(assign, "dataset string, rid bigint, cell int, far double, ref_vec array<double>")
    placed = with_position(stage(cells), ["dataset", "cell"], [("far", "asc"), ("rid", "asc")], "p")
    blocks = stage(placed.withColumn("ring", F.floor((F.col("p") - 1) / REFERENCE_BLOCK).cast("int")).drop("p"))
    rings = blocks.groupBy("dataset", "cell", "ring").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n"))
    return blocks, stage(rings.groupBy("dataset").agg(F.collect_list(F.struct("cell", "ring", "low", "high", "n")).alias("rings")).join(pivots, "dataset"))


def visits(queries: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """(dataset, split, idx, query_vec, cell, ring): blocks that each query must see.

    Without a column ``most`` it is the block with the least bound; with it (the
    distance of the k-th neighbour so far) all others whose bound does not exceed it.
    """
    again = "most" in queries.columns
    others = ["split", "idx", *(["most"] if again else [])]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                split, idx = batch.column(1)[i].values, batch.column(2)[i].values
                x = _data(batch, i, len(idx))
                rings = batch.column(batch.num_columns - 2)[i].as_py()
                cell, ring, low, high, n = (np.array([r[c] for r in rings]) for c in ("cell", "ring", "low", "high", "n"))
                far = _far(x, batch.column(batch.num_columns - 1)[i].as_py())
                for at in range(0, len(x), max(1, 4_000_000 // len(rings))):
                    own = far[at:at + max(1, 4_000_000 // len(rings))]
                    to = own[:, cell]
                    bound = np.maximum(np.maximum(to - high, low - to), 0)
                    home = np.lexsort((ring[None, :] + 0 * to, to, bound + np.where(n > k, 0, 1e300)[None, :]), axis=1)[:, 0]
                    if again:
                        most = batch.column(3)[i].values.to_numpy(zero_copy_only=False)[at:at + len(own)]
                        see = bound <= (most + 1e-9 * (1 + np.abs(own).max(axis=1)))[:, None]
                        see[np.arange(len(own)), home] = False
                        who, block = np.nonzero(see)
                    else:
                        who, block = np.arange(len(own)), home
                    if len(who):
                        take = pa.array(who + at)
                        kept = [pa.array(most[who])] if again else []
                        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(who)), split.take(take), idx.take(take), _vectors(x[who + at]), pa.array(cell[block].astype(np.int32)), pa.array(ring[block].astype(np.int32)), *kept],
                                                         names=["dataset", "split", "idx", "query_vec", "cell", "ring", *(["most"] if again else [])])

    packed = row_chunks(queries, "query_vec", *others).join(marks, "dataset").select("dataset", *others, "data", "rings", "pivots")
    return packed.mapInArrow(run, "dataset string, split string, idx bigint, query_vec array<double>, cell int, ring int" + (", most double" if again else ""))


def _pruned(left: DataFrame, right: DataFrame, sizes: DataFrame, k: int, skip_self: bool) -> DataFrame:
    blocks, marks = reference_blocks(right, sizes)
    blocks, keys = blocks.drop("far"), ["dataset", "cell", "ring"]
    left = stage(left)
    first = stage(_searched(visits(left, marks, k), blocks, keys, k, skip_self))
    most = F.when(F.size("near") == k, F.array_max(F.transform("near", lambda x: x["d"]))).otherwise(F.lit(float("inf")))
    bounded = left.join(first.select("dataset", "split", "idx", most.alias("most")), ["dataset", "split", "idx"])
    return first.unionByName(_searched(stage(visits(bounded, marks, k)), blocks, keys, k, skip_self))


def mean_distance(near="near"):
    return F.when(F.size(near) > 0, array_sum(F.transform(near, lambda x: x["d"])) / F.size(near)).otherwise(0.0)


def knn_scores(near: DataFrame) -> DataFrame:
    """Mean distance to the nearest reference rows; TRAIN rows skip themselves."""
    return near.select("dataset", "split", "idx", mean_distance().alias("score"))


def density_scores(near: DataFrame, mode: str) -> DataFrame:
    """Own radius against the radius of the neighbours: ratio or local gap."""
    base = stage(near.withColumn("base", mean_distance()))  # three readers of a costly result
    radius = base.filter("split = 'TRAIN'").select(
        "dataset", F.col("idx").alias("rid"), (F.col("base") + RADIUS_EPS).alias("radius"))
    # a row without neighbours, the only one of its TRAIN side, is its own
    rids = F.when((F.size("near") == 0) & (F.col("split") == "TRAIN"), F.array("idx")).otherwise(F.col("near.rid"))
    spread = base.select("dataset", "split", "idx", "base", F.explode_outer(rids).alias("rid"))
    local = (spread.join(radius, ["dataset", "rid"], "left").groupBy("dataset", "split", "idx")
             .agg(F.first("base").alias("base"), (F.avg("radius") + RADIUS_EPS).alias("local")))
    if mode == "ratio":
        return local.select("dataset", "split", "idx", (F.col("base") / F.col("local")).alias("score"))
    typical = exact_quantiles(radius, ["dataset"], "radius", {"typical": 0.5}).withColumn("typical", F.col("typical") + RADIUS_EPS)
    return local.join(typical, "dataset").select(
        "dataset", "split", "idx", ((F.col("base") - F.col("local")) / F.col("typical")).alias("score"))


def local_gap(rows: DataFrame, k: int = 3) -> DataFrame:
    """Robust scaling, k neighbours, local gap: the standard row score.

    ``rows``: (dataset, split, idx, vec).
    """
    reference = rows.filter("split = 'TRAIN'")
    scaled = stage(robust_scale(rows, reference))
    near = neighbours(scaled, scaled.filter("split = 'TRAIN'"), k)
    return density_scores(near, "local_gap")


# ---- deviations and centroids ----------------------------------------------

def robust_deviation(rows: DataFrame, reference: DataFrame, top_k: int | None) -> DataFrame:
    """|x - median| / MAD per robust-scaled feature; mean of the k largest."""
    scaled = stage(robust_scale(rows, reference))
    train = scaled.filter("split = 'TRAIN'")
    mid = pack(feature_quantiles(train, {"mid": 0.5}), ["mid"])
    gap = lambda: F.transform(F.arrays_zip("vec", "mid"), lambda z: F.abs(z["vec"] - z["mid"]))
    gaps = scaled.join(mid, "dataset").withColumn("vec", gap()).drop("mid")
    mad = pack(feature_quantiles(gaps.filter("split = 'TRAIN'"), {"mad": 0.5}), ["mad"])
    dev = F.transform(F.arrays_zip("vec", "mad"), lambda z: z["vec"] / (z["mad"] + SPREAD_EPS))
    out = gaps.join(mad, "dataset").withColumn("dev", dev)
    best = F.col("dev") if top_k is None else F.slice(F.sort_array("dev", asc=False), 1, top_k)
    return out.select("dataset", "split", "idx", (array_sum(best) / F.size(best)).alias("score"))


def centroids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector per group, summed map-side position by position."""
    return pack(rows.select(*keys, F.posexplode("vec").alias("feature", "v"))
                .groupBy(*keys, "feature").agg(F.avg("v").alias("center")), ["center"], tuple(keys))


def distance(a="vec", b="center"):
    return F.sqrt(array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def centroid_scores(rows: DataFrame) -> DataFrame:
    center = centroids(rows.filter("split = 'TRAIN'"), ["dataset"])
    return rows.join(center, "dataset").select("dataset", "split", "idx", distance().alias("score"))
