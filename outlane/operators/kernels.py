"""Convolution-kernel features: random kernels, dictionary kernels, pooling.

A kernel bank is configuration: a few hundred small rows derived by hashing, so
every engine and every partition agrees on it.  The convolutions are dense
arithmetic and run on Arrow batches; outputs are pooled or counted before they
leave the task and never become rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlane.operators.prep import SLICE, array_udf, stacked
from outlane.operators.scoring import row_chunks
from outlane.session import stage

# Kernel lengths; range of the bias quantile.
LENGTHS = (7, 9, 11)
BIAS_LOW, BIAS_HIGH = 0.1, 0.9
BLOCK_SIZE = 256
#: Parts into which a round of selection cuts the range of a kernel's outputs.
BUCKETS = 256


def draw(*parts) -> float:
    """Uniform draw in [0, 1): first 32 bits of a SHA-256, as in SQL."""
    text = "|".join(str(p) for p in parts)
    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16) / 4294967296.0


def dilation_powers(length: int) -> int:
    return max(0, int(math.log2(max(1, (length - 1) / 8))))


@lru_cache(maxsize=64)
def random_kernels(length: int, count: int, seed: int = 26, first: int = 0) -> list[dict]:
    """Centred Gaussian weights, power-of-two dilation, padding flag, bias.

    Kernel ``i`` depends only on (seed, length, i): blocks of one bank are
    ranges of i and wider banks extend narrower ones.
    """
    bank = []
    for i in range(first, first + count):
        u = lambda *tag: draw(seed, length, i, *tag)
        width = LENGTHS[int(u("len") * len(LENGTHS))]
        normal = [math.sqrt(-2 * math.log(1 - u("r", j))) * math.cos(2 * math.pi * u("a", j)) for j in range(width)]
        mean = sum(normal) / width
        bank.append({"weights": [w - mean for w in normal], "dilation": 2 ** int(u("dil") * (dilation_powers(length) + 1)),
                     "padding": u("pad") >= 0.5, "bias": 2 * u("bias") - 1})
    return bank


def dictionary_kernels() -> list[list[float]]:
    """The 84 length-9 kernels with three weights 2 and six weights -1."""
    return [[2.0 if j in chosen else -1.0 for j in range(9)] for chosen in combinations(range(9), 3)]


@lru_cache(maxsize=64)
def dictionary_params(length: int, count: int, seed: int = 28) -> list[dict]:
    base = dictionary_kernels()
    return [{"weights": base[i % len(base)], "dilation": 2 ** int(draw(seed, length, i, "dil") * (dilation_powers(length) + 1)),
             "padding": draw(seed, length, i, "pad") >= 0.5,
             "quantile": BIAS_LOW + (BIAS_HIGH - BIAS_LOW) * draw(seed, length, i, "q")} for i in range(count)]


def convolve(x: np.ndarray, kernel: dict) -> np.ndarray:
    """Dilated valid correlation of every row; half-width zero padding."""
    w, d = kernel["weights"], kernel["dilation"]
    span = (len(w) - 1) * d + 1
    if kernel["padding"]:
        x = np.pad(x, ((0, 0), (span // 2, span // 2)))
    if x.shape[1] < span:
        x = np.pad(x, ((0, 0), (0, span - x.shape[1])))
    size = x.shape[1] - span + 1
    return sum(weight * x[:, j * d:j * d + size] for j, weight in enumerate(w))


def rocket_features(values, count: int, seed: int = 26, first: int = 0) -> Column:
    """Per kernel the maximum and the share of positive outputs."""
    def work(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), 2 * count))
        for i, kernel in enumerate(random_kernels(x.shape[1], count, seed, first)):
            conv = convolve(x, kernel) + kernel["bias"]
            out[:, 2 * i] = conv.max(axis=1)
            out[:, 2 * i + 1] = (conv > 0).mean(axis=1)
        return out
    return array_udf(work, values)


def block_features(values, block: int, size: int = BLOCK_SIZE) -> Column:
    """Features of one disjoint kernel range: independent evidence A, B, C."""
    return rocket_features(values, size, first=block * size)


def mean_responses(values, count: int, seed: int = 26) -> Column:
    """Mean output of each kernel of a bank, without its bias."""
    return array_udf(lambda x: np.stack([convolve(x, kernel).mean(axis=1) for kernel in random_kernels(x.shape[1], count, seed)], axis=1), values)


def convolution(values, kernel: dict) -> Column:
    """The raw outputs of one kernel."""
    return array_udf(lambda x: convolve(x, kernel) + kernel.get("bias", 0.0), values)


# ---- fitted biases ----------------------------------------------------------

def fit_biases(reference: DataFrame, length: int, count: int, seed: int = 28) -> DataFrame:
    """(dataset, biases): per dataset the linear quantile of all TRAIN outputs of
    each parameter set.

    Exact selection in rounds.  A round counts the outputs in ``BUCKETS`` parts of
    the range that holds the wanted rank, with the least and greatest of each
    part; counts are added up by Spark, the part with the rank is the next range,
    and a part with one value ends it.  Tasks convolve again in every round, so
    outputs are never stored, and what leaves a task does not grow with its rows.
    """
    rows = stage(row_chunks(reference.select("dataset", "idx", "values"), "values", "idx").select("dataset", "data"))
    params = dictionary_params(length, count, seed)
    schema = "dataset string, feature int, bucket int, n bigint, low double, high double"

    def counted(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, x = batch.column(0)[i].as_py(), batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)
                ranges = None if batch.column(2)[i].as_py() is None else {r["feature"]: (r["low"], r["high"]) for r in batch.column(2)[i].as_py()}
                feature, bucket, n, low, high = [], [], [], [], []
                for k in range(count) if ranges is None else sorted(ranges):
                    v = np.sort(convolve(x, params[k]).ravel())
                    at = np.zeros(len(v), np.int64)
                    if ranges is not None:
                        begin, end = ranges[k]
                        v = v[np.searchsorted(v, begin):np.searchsorted(v, end, side="right")]
                        at = np.minimum(((v - begin) / (end - begin) * BUCKETS).astype(np.int64), BUCKETS - 1)
                    if len(v):
                        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                        last = np.concatenate([first[1:], [len(v)]])
                        feature += [k] * len(first)
                        bucket += at[first].tolist()
                        n += (last - first).tolist()
                        low += v[first].tolist()
                        high += v[last - 1].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(feature, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64()), pa.array(low, pa.float64()), pa.array(high, pa.float64())],
                                                 names=["dataset", "feature", "bucket", "n", "low", "high"])

    def summed(ranges: DataFrame | None) -> DataFrame:
        given = rows.withColumn("ranges", F.lit(None).cast("array<struct<feature:int,low:double,high:double>>")) if ranges is None else rows.join(ranges, "dataset")
        return given.select("dataset", "data", "ranges").mapInArrow(counted, schema).groupBy("dataset", "feature", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    level = F.element_at(F.array(*[F.lit(p["quantile"]) for p in params]), F.col("feature") + 1)
    place = (F.col("n") - 1) * level
    none = F.lit(None).cast("double")
    state = stage(summed(None).select("dataset", "feature", "low", "high", F.floor(place).alias("rank"), (place - F.floor(place)).alias("part"), F.col("n").alias("inside"), none.alias("after")))
    while True:
        ranges = state.filter("low < high").groupBy("dataset").agg(F.collect_list(F.struct("feature", "low", "high")).alias("ranges"))
        if ranges.isEmpty():
            break
        order = Window.partitionBy("dataset", "feature").orderBy("bucket")
        parts = summed(ranges).select("dataset", "feature", F.col("low").alias("l"), F.col("high").alias("h"), F.col("n").alias("m"), (F.sum("n").over(order) - F.col("n")).alias("before"), F.lead("low").over(order).alias("next"))
        found = state.join(parts, ["dataset", "feature"], "left").filter(F.col("m").isNull() | ((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("m"))))
        # a finished range keeps what it has; ``after`` is the least value above the range
        state = stage(found.select("dataset", "feature", F.coalesce("l", "low").alias("low"), F.coalesce("h", "high").alias("high"), (F.col("rank") - F.coalesce("before", F.lit(0))).alias("rank"), "part",
                                   F.coalesce("m", "inside").alias("inside"), F.coalesce("next", "after").alias("after")))
    upper = F.when(F.col("rank") + 1 < F.col("inside"), F.col("low")).otherwise(F.coalesce("after", "low"))
    bias = F.col("low") + (upper - F.col("low")) * F.col("part")
    return state.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("feature", bias.alias("bias")))).alias("p")).select("dataset", F.col("p.bias").alias("biases"))


def pooled_features(rows: DataFrame, biases: DataFrame, length: int, count: int, seed: int = 28, all_pools: bool = True) -> DataFrame:
    """Pooling against TRAIN biases: share above, mean excess, mean index and
    longest run (or the share alone)."""
    params = dictionary_params(length, count, seed)
    width = 4 if all_pools else 1

    def pooled(values: pd.Series, bias: pd.Series) -> pd.Series:
        out = [None] * len(values)
        for where, x in stacked(values):
            limits = np.stack(bias.iloc[where].to_numpy())
            feats = np.zeros((len(x), width * count))
            for i, kernel in enumerate(params):
                excess = convolve(x, kernel) - limits[:, i:i + 1]
                above = excess > 0
                hits = above.sum(axis=1)
                feats[:, width * i] = above.mean(axis=1)
                if all_pools:
                    some, safe = hits > 0, np.maximum(hits, 1)
                    at = np.arange(above.shape[1]) / max(1, above.shape[1] - 1)
                    places = np.arange(1, above.shape[1] + 1)
                    best = (places - np.maximum.accumulate(np.where(above, 0, places), axis=1)).max(axis=1)
                    feats[:, width * i + 1] = np.where(some, (excess * above).sum(axis=1) / safe, 0)
                    feats[:, width * i + 2] = np.where(some, (above * at).sum(axis=1) / safe, 0)
                    feats[:, width * i + 3] = best / above.shape[1]
            for j, row in zip(where, feats):
                out[j] = row
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, bias in batches:  # a slice is sent before the next one is made
            for begin in range(0, len(values), SLICE):
                yield pooled(values.iloc[begin:begin + SLICE], bias.iloc[begin:begin + SLICE])

    return rows.join(biases, "dataset").withColumn("vec", run("values", "biases")).drop("biases")
