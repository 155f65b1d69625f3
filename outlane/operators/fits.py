"""k-means and diagonal mixtures fitted on all TRAIN rows, by rounds of sums.

TRAIN rows are packed once into blocks of about ``BLOCK_ROWS``; a hot dataset is
many blocks.  A model belongs to a dataset, a fold (it is fitted on the rows of the
other folds; -1: on all) and a number of parts.  Each round every block adds
its rows to the sums of every model of its dataset, Spark adds the sums up with
map-side combine, and the models of a dataset, one small row, are moved.  Blocks
are never copied per fold and no task or driver holds a dataset.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlane.functions.columns import array_sum, let
from outlane.operators.scoring import distance
from outlane.session import stage

BLOCK_ROWS = 1000
ROUNDS = 25
#: Rounds of a mixture, and the mean gain of log-likelihood that ends them.
MIXTURE_ROUNDS, GAIN = 30, 1e-3
#: Added to every variance of a mixture.
VARIANCE_FLOOR = 1e-4
#: Sums that a task holds before it hands them on.
HELD = 10_000
MODELS = ("array<struct<fold:int,k:int,done:boolean,n:double,fit:double,weight:array<double>,mean:array<array<double>>,var:array<array<double>>>>")


# ---- rows in blocks -----------------------------------------------------------

def blocks(rows: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """(dataset, idx, fold, data): TRAIN rows in blocks; ``data`` are the vectors
    end to end.  Without a ``plan`` every row has fold -2, so a model of fold -1
    is fitted on all."""
    train = rows.filter("split = 'TRAIN'").select("dataset", "idx", "vec")
    placed = train.withColumn("fold", F.lit(-2)) if plan is None else train.join(plan.select("dataset", "idx", F.col("fold").cast("int").alias("fold")), ["dataset", "idx"])
    sizes = placed.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    keyed = placed.join(sizes, "dataset").withColumn("block", F.pmod(F.xxhash64("idx"), F.col("blocks")))
    packed = keyed.groupBy("dataset", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "fold", "vec"))).alias("r"))
    return packed.select("dataset", F.col("r.idx").alias("idx"), F.col("r.fold").alias("fold"), F.flatten("r.vec").alias("data"))


def _matrix(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    idx, fold = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (1, 2))
    return idx, fold, batch.column(3)[i].values.to_numpy(zero_copy_only=False).reshape(len(idx), -1)


def _gaps(x: np.ndarray, centers: list) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in np.asarray(centers, float)], axis=1)


# ---- one round ------------------------------------------------------------------

def _summed(packed: DataFrame, models: DataFrame, add) -> DataFrame:
    """(dataset, sums): per model and part the sum of what ``add(x, model)``, a list
    of vectors, gives over all blocks."""
    schema = "dataset string, fold int, k int, part int, sums array<double>"

    def run(batches):
        total = {}

        def out():
            keys = list(total)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[j] for k in keys], pa.int32()) for j in (1, 2, 3)), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))],
                                              names=["dataset", "fold", "k", "part", "sums"])

        for batch in batches:
            for i in range(batch.num_rows):
                name, (_, fold, x) = batch.column(0)[i].as_py(), _matrix(batch, i)
                for model in batch.column(4)[i].as_py():
                    mine = x[fold != model["fold"]]
                    if model["done"] or not len(mine):
                        continue
                    for part, vector in enumerate(add(mine, model)):
                        key = (name, model["fold"], model["k"], part)
                        total[key] = total[key] + vector if key in total else vector
                if len(total) > HELD:
                    yield out()
                    total.clear()
        yield out()

    found = packed.join(models, "dataset").select("dataset", "idx", "fold", "data", "models").mapInArrow(run, schema)
    flat = found.select("dataset", "fold", "k", "part", F.posexplode("sums").alias("at", "v")).groupBy("dataset", "fold", "k", "part", "at").agg(F.sum("v").alias("v"))
    parts = flat.groupBy("dataset", "fold", "k", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("sums"))
    return parts.groupBy("dataset").agg(F.collect_list(F.struct("fold", "k", "part", "sums")).alias("sums"))


def _moved(models: DataFrame, sums: DataFrame, move) -> DataFrame:
    """Models of each dataset after ``move(model, sums by part)`` changed them."""
    def run(batches):
        for batch in batches:
            out = []
            for of, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                by = {}
                for s in found or []:
                    by.setdefault((s["fold"], s["k"]), {})[s["part"]] = np.array(s["sums"])
                for model in of:
                    if not model["done"] and (model["fold"], model["k"]) in by:
                        move(model, by[model["fold"], model["k"]])
                out.append(of)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, batch.schema.field(1).type)], names=["dataset", "models"])

    joined = models.join(sums, "dataset", "left").select("dataset", "models", "sums")
    return stage(joined.mapInArrow(run, f"dataset string, models {MODELS}"))


def _open(models: DataFrame) -> bool:
    return not models.filter(F.exists("models", lambda m: ~m["done"])).isEmpty()


# ---- k-means ----------------------------------------------------------------------

def _empty(packed: DataFrame, plan: DataFrame | None) -> DataFrame:
    """One model without centres per dataset and fold."""
    names = packed.select("dataset").distinct()
    folds = names.withColumn("folds", F.lit(None).cast("int")) if plan is None else names.join(plan.groupBy("dataset").agg(F.max("folds").cast("int").alias("folds")), "dataset")
    every = F.when(F.col("folds").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("folds") - 1))
    model = lambda f: F.struct(f.alias("fold"), F.lit(0).alias("k"), F.lit(False).alias("done"), F.lit(0.0).alias("n"), F.lit(0.0).alias("fit"),
                               F.expr("CAST(array() AS array<double>)").alias("weight"), F.expr("CAST(array() AS array<array<double>>)").alias("mean"), F.expr("CAST(array() AS array<array<double>>)").alias("var"))
    return folds.select("dataset", F.transform(every, model).alias("models"))


def _picked(packed: DataFrame, models: DataFrame, most: int) -> DataFrame:
    """One more start per model: the row nearest to the mean, then the row furthest
    from all starts; equal ones by the least idx.  No more starts than rows."""
    schema = "dataset string, fold int, key double, idx bigint, vec array<double>"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, (idx, fold, x) = batch.column(0)[i].as_py(), _matrix(batch, i)
                for model in batch.column(4)[i].as_py():
                    mine = fold != model["fold"]
                    if not mine.any() or len(model["mean"]) >= min(most, model["n"]):
                        continue
                    gap = -_gaps(x[mine], model["mean"]).min(axis=1) if model["mean"] else _gaps(x[mine], model["var"])[:, 0]
                    best = np.lexsort((idx[mine], gap))[0]
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([model["fold"]], pa.int32()), pa.array([float(gap[best])]), pa.array([int(idx[mine][best])], pa.int64()),
                                                      pa.array([x[mine][best].tolist()], pa.list_(pa.float64()))], names=["dataset", "fold", "key", "idx", "vec"])

    found = packed.join(models, "dataset").select("dataset", "idx", "fold", "data", "models").mapInArrow(run, schema)
    best = found.groupBy("dataset", "fold").agg(F.min(F.struct("key", "idx", "vec")).alias("b"))
    sums = best.groupBy("dataset").agg(F.collect_list(F.struct("fold", F.lit(0).alias("k"), F.lit(0).alias("part"), F.col("b.vec").alias("sums"))).alias("sums"))
    return _moved(models, sums, lambda model, by: model["mean"].append(by[0].tolist()))


def _starts(packed: DataFrame, plan: DataFrame | None, most: int) -> DataFrame:
    def first(model, by):  # the mean waits in the place of the variances
        model["n"], model["var"] = float(by[0][0]), [(by[0][1:] / by[0][0]).tolist()]

    models = stage(_empty(packed, plan))
    models = _moved(models, _summed(packed, models, lambda x, model: [np.concatenate([[len(x)], x.sum(axis=0)])]), first)
    for _ in range(most):
        models = _picked(packed, models, most)
    return models


def _lloyd(packed: DataFrame, models: DataFrame, rounds: int) -> DataFrame:
    def add(x, model):
        near = _gaps(x, model["mean"]).argmin(axis=1)
        return [np.concatenate([[np.sum(near == j)], x[near == j].sum(axis=0)]) for j in range(len(model["mean"]))]

    def move(model, by):
        after = [(by[j][1:] / by[j][0]).tolist() if by[j][0] else c for j, c in enumerate(model["mean"])]
        model["done"], model["mean"] = after == model["mean"], after

    for _ in range(rounds):
        models = _moved(models, _summed(packed, models, add), move)
        if not _open(models):
            break
    return models


def kmeans_models(packed: DataFrame, k: int, plan: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(dataset, models): ``k`` centres per dataset and fold.

    Starts are the row nearest to the mean and then furthest rows, so nothing is
    drawn; a round moves centres to the means of their rows (ties: the first
    centre), empty ones stay; it ends at a fixed point or after ``rounds``.
    """
    return _lloyd(packed, _starts(packed, plan, k), rounds)


# ---- mixtures ------------------------------------------------------------------------

def _joint(x: np.ndarray, model: dict) -> np.ndarray:
    mean, var = np.array(model["mean"]), np.array(model["var"])
    return np.log(model["weight"]) - 0.5 * np.stack([(np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1) for m, v in zip(mean, var)], axis=1)


def mixture_models(packed: DataFrame, most: int, plan: DataFrame | None = None, floor: float = VARIANCE_FLOOR, rounds: int = MIXTURE_ROUNDS) -> DataFrame:
    """(dataset, models): diagonal mixtures of 1 to ``most`` parts, k-means centres as
    starts; of them the one with the least BIC stays, the smaller of equal ones.

    A round replaces weights, means and variances by the weighted sums over all
    rows.  A model ends when its mean log-likelihood gains less than ``GAIN`` and
    keeps the parameters that this likelihood was taken with.
    """
    starts = _starts(packed, plan, most)
    wanted = F.flatten(F.transform("models", lambda m: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(m["mean"]))), lambda k: F.struct(
        m["fold"].alias("fold"), k.alias("k"), F.lit(False).alias("done"), m["n"].alias("n"), m["fit"].alias("fit"), m["weight"].alias("weight"), F.slice(m["mean"], F.lit(1), k).alias("mean"), m["var"].alias("var")))))
    models = _lloyd(packed, stage(starts.select("dataset", wanted.alias("models"))), ROUNDS)

    def spread(x, model):
        return [np.concatenate([[len(x)], x.sum(axis=0), (x ** 2).sum(axis=0)])]

    def begin(model, by):
        n, d = by[0][0], (len(by[0]) - 1) // 2
        mean = by[0][1:1 + d] / n
        var = np.maximum(by[0][1 + d:] / n - mean ** 2, 0) + floor
        k = len(model["mean"])
        model["weight"], model["var"], model["fit"] = [1 / k] * k, [var.tolist()] * k, -math.inf

    def add(x, model):
        logp = _joint(x, model)
        top = logp.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
        part = np.exp(logp - total[:, None])
        return [np.concatenate([[total.sum() if j == 0 else 0.0, p.sum()], p @ x, p @ x ** 2]) for j, p in enumerate(part.T)]

    def move(model, by, final=False):
        fit = by[0][0]
        model["done"] = bool(final or fit - model["fit"] < GAIN * model["n"])
        model["fit"] = float(fit)
        if not model["done"]:
            d = (len(by[0]) - 2) // 2
            mass = np.array([by[j][1] for j in range(model["k"])]) + 1e-9
            model["weight"] = (mass / mass.sum()).tolist()
            mean = [by[j][2:2 + d] / mass[j] for j in range(model["k"])]
            model["mean"] = [m.tolist() for m in mean]
            model["var"] = [(np.maximum(by[j][2 + d:] / mass[j] - mean[j] ** 2, 0) + floor).tolist() for j in range(model["k"])]

    reopened = F.transform("models", lambda m: m.withField("done", F.lit(False)))
    models = stage(models.withColumn("models", reopened))
    models = _moved(models, _summed(packed, models, spread), begin)
    for r in range(rounds + 1):
        last = r == rounds
        models = _moved(models, _summed(packed, models, add), lambda model, by, last=last: move(model, by, last))
        if not _open(models):
            break
    size = lambda m: F.size(m["mean"][0])
    bic = lambda m: -2 * m["fit"] + (2 * m["k"] * size(m) + m["k"] - 1) * F.log(m["n"])
    rated = models.select("dataset", F.explode("models").alias("m")).select("dataset", "m", F.struct(bic(F.col("m")).alias("bic"), F.col("m.k").alias("k")).alias("rate"))
    best = rated.groupBy("dataset", "m.fold").agg(F.min_by("m", "rate").alias("m"))
    return best.groupBy("dataset").agg(F.collect_list("m").alias("models"))


# ---- scores ---------------------------------------------------------------------------

def center_score(model, vec="vec"):
    """Distance to the nearest centre."""
    return F.array_min(F.transform(model["mean"], lambda c: distance(vec, c)))


def mixture_score(model, vec="vec"):
    """Negative log-likelihood of a row."""
    parts = F.arrays_zip(model["weight"].alias("w"), model["mean"].alias("m"), model["var"].alias("v"))
    quad = lambda p: array_sum(F.zip_with(F.zip_with(vec, p["m"], lambda x, m: (x - m) * (x - m)), p["v"], lambda s, v: s / v + F.log(2 * math.pi * v)))
    return let(F.transform(parts, lambda p: F.log(p["w"]) - quad(p) / 2), lambda l: -(F.array_max(l) + F.log(array_sum(F.transform(l, lambda v: F.exp(v - F.array_max(l)))))))


class Fitted:
    """A scorer of rows (dataset, split, idx, vec) from models of ``fit``.

    Called, it fits on the TRAIN side and scores all rows.  ``folded`` gives
    cross-fitted scores: TRAIN rows by the model that has not seen their fold, other
    rows by the median over all models of their dataset.
    """

    def __init__(self, fit, score):
        self.fit, self.score = fit, score

    def __call__(self, rows: DataFrame) -> DataFrame:
        models = self.fit(stage(blocks(rows)), None)
        return rows.join(models, "dataset").select("dataset", "split", "idx", self.score(F.col("models")[0]).alias("score"))

    def folded(self, rows: DataFrame, plan: DataFrame) -> DataFrame:
        models = self.fit(stage(blocks(rows, plan)), plan)
        # folds first: models are wide and would travel with every row
        placed = rows.join(plan.select("dataset", "idx", F.lit("TRAIN").alias("split"), "fold"), ["dataset", "split", "idx"], "left")
        joined = placed.join(models, "dataset")
        used = F.filter("models", lambda m: F.col("fold").isNull() | (m["fold"] == F.col("fold")))
        scores = F.array_sort(F.transform(used, lambda m: self.score(m)))
        n = F.size(scores)
        middle = (F.element_at("s", F.floor((F.col("n") + 1) / 2).cast("int")) + F.element_at("s", F.floor(F.col("n") / 2 + 1).cast("int"))) / 2
        return joined.select("dataset", "split", "idx", scores.alias("s"), n.alias("n")).select("dataset", "split", "idx", middle.alias("score"))


def kmeans(k: int) -> Fitted:
    """Distance to the nearest of k centres."""
    return Fitted(lambda packed, plan: kmeans_models(packed, k, plan), center_score)


def gmm(most: int, floor: float = VARIANCE_FLOOR) -> Fitted:
    """Negative log-likelihood of a diagonal mixture; BIC picks 1..most parts."""
    return Fitted(lambda packed, plan: mixture_models(packed, most, plan, floor), mixture_score)
