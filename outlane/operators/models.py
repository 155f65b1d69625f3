"""Cross-fitted and generated scores, augmentation and periodicity.

Cross-fitting turns (dataset, fold) into a dataset of its own: rows of the other
folds are its TRAIN side, rows of the fold its HELD side.  Any scorer of rows
then works unchanged and all folds run in one plan.  A scorer that can do better
than copy the rows for every fold has a method ``folded``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlane.functions.columns import array_mean, array_std, array_sum, hash_key, let, uniform
from outlane.functions.order import exact_quantiles, with_position
from outlane.operators.features import factor
from outlane.operators.fits import gmm, kmeans  # noqa: F401  scorers by name
from outlane.operators.quality import reference_rows
from outlane.operators.scoring import centroids, distance, local_gap, mean_distance, neighbours
from outlane.session import stage

FOLDS = 5
SCORE = "dataset string, split string, idx bigint, score double"


# ---- folds ------------------------------------------------------------------

def score_folds(train: DataFrame, seed: str = "fold") -> DataFrame:
    """Folds of cross-fitted scores: five, or one per row if there are fewer."""
    plan = fold_plan(train, seed)
    few = F.least(F.lit(FOLDS).cast("long"), F.col("folds"))
    return plan.withColumn("fold", F.pmod("fold", few)).withColumn("folds", few)


def fold_plan(train: DataFrame, seed: str = "fold", folds: int = FOLDS) -> DataFrame:
    """Fold of each TRAIN row: none below 2, leave-one-out below 20, else ``folds``."""
    keyed = train.select("dataset", "idx").withColumn("h", hash_key(seed, F.col("dataset"), F.col("idx")))
    placed = with_position(keyed, ["dataset"], [("h", "asc"), ("idx", "asc")], "r")
    n = train.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    fold = F.when(F.col("n") < 20, F.col("r") - 1).otherwise(F.pmod(F.col("r") - 1, F.lit(folds)))
    number = F.when(F.col("n") < 20, F.col("n")).otherwise(F.lit(folds).cast("long"))
    return placed.join(n, "dataset").filter("n >= 2").select("dataset", "idx", fold.alias("fold"), number.alias("folds"))


def cross_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows per (dataset, fold): TRAIN = other folds, HELD = the fold, TEST."""
    train = rows.filter("split = 'TRAIN'").drop("split").join(plan, ["dataset", "idx"])
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("folds") - 1)).alias("f")
    fits = train.select("dataset", "idx", "vec", "fold", at).select(
        "dataset", "f", F.when(F.col("f") == F.col("fold"), "HELD").otherwise("TRAIN").alias("split"), "idx", "vec")
    sizes = plan.select("dataset", "folds").distinct()
    tests = rows.filter("split = 'TEST'").join(sizes, "dataset").select("dataset", at, F.lit("TEST").alias("split"), "idx", "vec")
    both = fits.unionByName(tests)
    return both.withColumn("dataset", F.concat_ws("#", "dataset", "f")).drop("f")


def crossfit(rows: DataFrame, scorer, plan: DataFrame | None = None) -> DataFrame:
    """Out-of-fold TRAIN scores and TEST scores as the median over folds.

    ``scorer`` maps rows (dataset, split, idx, vec) to (dataset, split, idx,
    score), fitting on the TRAIN side.  What it leaves out or scores NULL, NaN or
    infinite gets the distance to the centre of the same fold's TRAIN side.
    """
    plan = stage(plan if plan is not None else score_folds(rows.filter("split = 'TRAIN'")))
    names, key, score = plan.select("dataset").distinct(), ["dataset", "split", "idx"], F.col("score")
    some = rows.join(names, "dataset", "left_semi")
    got = scorer.folded(some, plan) if hasattr(scorer, "folded") else _over_folds(scorer(stage(cross_rows(some, plan))))
    good = stage(got.filter(score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))).select(*key, "score"))
    # a dataset with one TRAIN row has no folds: distance to that row
    whole = good.unionByName(centroid(rows.join(names, "dataset", "left_anti")))
    failed = stage(some.select(*key).join(good, key, "left_anti"))
    if failed.isEmpty():
        return whole
    centre = _over_folds(centroid(stage(cross_rows(some.join(failed.select("dataset").distinct(), "dataset", "left_semi"), plan))))
    return whole.unionByName(centre.join(failed, key, "left_semi"))


def _over_folds(scores: DataFrame) -> DataFrame:
    """Scores of (dataset#fold) rows brought back to their dataset."""
    named = scores.filter("split <> 'TRAIN'").withColumn("dataset", F.regexp_replace("dataset", "#[0-9]+$", ""))
    got = exact_quantiles(named, ["dataset", "split", "idx"], "score", {"score": 0.5})
    return got.withColumn("split", F.when(F.col("split") == "HELD", "TRAIN").otherwise(F.col("split")))


def crossfit_source(rows: DataFrame, scorer, least: int = 5) -> DataFrame:
    """Out-of-fold TRAIN scores next to full-fit TEST scores, with the smallest
    attainable p; datasets with too little TRAIN are left out."""
    n = rows.filter("split = 'TRAIN'").groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    kept = rows.join(n.select("dataset"), "dataset", "left_semi")
    oof = crossfit(kept, scorer, fold_plan(kept.filter("split = 'TRAIN'"))).filter("split = 'TRAIN'")
    full = scorer(kept).filter("split = 'TEST'")
    both = oof.withColumn("phase", F.lit("out_of_fold")).unionByName(full.withColumn("phase", F.lit("full_fit")))
    return both.join(n, "dataset").withColumn("min_p", 1 / (F.col("n") + 1)).drop("n")


# ---- scorers ----------------------------------------------------------------

class LocalOutlierFactor:
    """Local outlier factor against the TRAIN side, as neighbour joins.

    Cross-fitted, neighbours are searched once among all TRAIN rows, with a margin:
    those of a fold's model are the ones outside the fold.  Only rows that are
    left with fewer than ``k`` are searched again.
    """

    #: Neighbours searched for each one that is wanted, when folds may take some.
    MARGIN = 2.5

    def __init__(self, k: int):
        self.k = k

    def __call__(self, rows: DataFrame) -> DataFrame:
        near = stage(neighbours(rows, rows.filter("split = 'TRAIN'"), self.k))
        return self._factors(near.select("dataset", "split", "idx", F.explode("near").alias("n")).select("dataset", "split", "idx", "n.d", "n.rid"))

    @staticmethod
    def _factors(links: DataFrame) -> DataFrame:
        """Scores from links (dataset, split, idx, d, rid) to TRAIN rows."""
        far = links.filter("split = 'TRAIN'").groupBy("dataset", F.col("idx").alias("rid")).agg(F.max("d").alias("kd"))
        reach = links.join(far, ["dataset", "rid"]).groupBy("dataset", "split", "idx").agg(
            (1 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
        other = reach.filter("split = 'TRAIN'").select("dataset", F.col("idx").alias("rid"), F.col("lrd").alias("other"))
        return links.join(other, ["dataset", "rid"]).groupBy("dataset", "split", "idx").agg(F.avg("other").alias("o")).join(
            reach, ["dataset", "split", "idx"]).select("dataset", "split", "idx", (F.col("o") / F.col("lrd")).alias("score"))

    def folded(self, rows: DataFrame, plan: DataFrame) -> DataFrame:
        return _over_folds(self._factors(stage(self.fold_links(rows, plan))))

    def fold_links(self, rows: DataFrame, plan: DataFrame) -> DataFrame:
        """Links of every row to its ``k`` nearest of each fold's TRAIN side; the
        dataset is named dataset#fold, rows of the fold are on the HELD side."""
        train = rows.filter("split = 'TRAIN'")
        wide = neighbours(rows, train, math.ceil(self.MARGIN * self.k))
        links = wide.select("dataset", "split", "idx", F.explode_outer("near").alias("n")).select("dataset", "split", "idx", "n.d", "n.rid")
        of = plan.select("dataset", F.col("idx").alias("rid"), F.col("fold").alias("rfold"))
        near = links.join(of, ["dataset", "rid"], "left").groupBy("dataset", "split", "idx").agg(F.sort_array(F.collect_list(F.when(F.col("rid").isNotNull(), F.struct("d", "rid", "rfold")))).alias("near"))
        own = plan.select("dataset", "idx", F.lit("TRAIN").alias("split"), "fold")
        sizes = plan.groupBy("dataset").agg(F.first("folds").alias("folds"), F.count(F.lit(1)).alias("n"))
        per_fold = plan.groupBy("dataset", F.col("fold").alias("f")).agg(F.count(F.lit(1)).alias("left_out"))
        asked = near.join(sizes, "dataset").join(own, ["dataset", "split", "idx"], "left").withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("folds") - 1)))
        side = F.when(F.col("split") != "TRAIN", F.col("split")).when(F.col("fold") == F.col("f"), F.lit("HELD")).otherwise(F.lit("TRAIN"))
        kept = F.slice(F.filter("near", lambda x: x["rfold"] != F.col("f")), 1, self.k)
        # all that there is: TRAIN rows outside the fold but for the row itself
        there = F.col("n") - F.col("left_out") - F.when(side == "TRAIN", 1).otherwise(0)
        got = stage(asked.join(per_fold, ["dataset", "f"]).select("dataset", "f", "split", "idx", side.alias("side"), kept.alias("near"), (F.size(kept) >= F.least(F.lit(self.k), there)).alias("enough")))
        name = F.concat_ws("#", "dataset", F.col("f").cast("string"))
        found = got.filter("enough").select(name.alias("dataset"), F.col("side").alias("split"), "idx", "near.d", "near.rid")
        short = got.filter("NOT enough").select("dataset", "f", "split", "idx", "side")
        if not short.isEmpty():
            queries = short.join(rows, ["dataset", "split", "idx"]).select(name.alias("dataset"), F.col("side").alias("split"), "idx", "vec")
            fits = short.select("dataset", "f").distinct().join(train.drop("split"), "dataset").join(own.drop("split"), ["dataset", "idx"]).filter("f <> fold")
            more = neighbours(queries, fits.select(name.alias("dataset"), "idx", "vec"), self.k)
            found = found.unionByName(more.select("dataset", "split", "idx", "near.d", "near.rid"))
        return found.select("dataset", "split", "idx", F.explode(F.arrays_zip("d", "rid")).alias("z")).select("dataset", "split", "idx", "z.d", "z.rid")


def lof(k: int) -> LocalOutlierFactor:
    return LocalOutlierFactor(k)


def centroid(rows: DataFrame) -> DataFrame:
    center = centroids(rows.filter("split = 'TRAIN'"), ["dataset"])
    return rows.join(center, "dataset").select("dataset", "split", "idx", distance().alias("score"))


def injection_centroid(rows: DataFrame, synthetic: DataFrame, weight: float = 0.25) -> DataFrame:
    """Distance to the normal centre minus a share of that to the synthetic."""
    normal = centroids(rows.filter("split = 'TRAIN'"), ["dataset"])
    fake = centroids(synthetic, ["dataset"]).withColumnRenamed("center", "fake")
    got = rows.join(normal, "dataset").join(fake, "dataset")
    return got.select("dataset", "split", "idx", (distance() - weight * distance("vec", "fake")).alias("score"))


def small_train(rows: DataFrame, stored: DataFrame | None = None, tiny: int = 5, small: int = 30, width: int = 5) -> DataFrame:
    """Score by the size of the TRAIN side.

    n <= tiny: distance to the mean.  Below ``small``: PCA, then a Gaussian
    kernel density with the data's covariance and Scott's factor; principal
    components are uncorrelated, so the covariance is their variances, and the
    whole TRAIN side fits beside a row as one array.  From ``small`` on: the
    ``stored`` reconstruction score (dataset, split, idx, score), or the distance
    to the mean where there is none.
    """
    n = rows.filter("split = 'TRAIN'").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    sized = rows.join(n, "dataset")
    near = centroid(sized.filter((F.col("n") <= tiny) | (F.col("n") >= small)).drop("n"))
    if stored is not None:
        large = n.filter(F.col("n") >= small).select("dataset")
        known = stored.join(large, "dataset", "left_semi").select("dataset", "split", "idx", F.col("score").alias("_stored"))
        near = near.join(known, ["dataset", "split", "idx"], "left").select("dataset", "split", "idx", F.coalesce("_stored", "score").alias("score"))
    dense = stage(factor(sized.filter((F.col("n") > tiny) & (F.col("n") < small)).drop("n"), width, True))
    train = dense.filter("split = 'TRAIN'")
    spread = (train.select("dataset", F.posexplode("vec").alias("feature", "v")).groupBy("dataset", "feature").agg(F.var_samp("v").alias("v"))
              .groupBy("dataset").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "v"))), lambda x: F.greatest(x["v"], F.lit(1e-12))).alias("spread")))
    packed = train.groupBy("dataset").agg(F.collect_list("vec").alias("ref")).join(spread, "dataset")
    count, d = F.size("ref"), F.size("spread")
    factor2 = F.pow(count, -2.0 / (d + 4))  # square of Scott's factor
    gap = lambda r: array_sum(F.zip_with(F.zip_with("vec", r, lambda a, b: (a - b) * (a - b)), "spread", lambda s, v: s / v))
    logs = F.transform("ref", lambda r: -0.5 * gap(r) / factor2)
    total = let(logs, lambda v: F.array_max(v) + F.log(array_sum(F.transform(v, lambda x: F.exp(x - F.array_max(v))))))
    norm = F.log(count) + 0.5 * (d * (math.log(2 * math.pi) + F.log(factor2)) + array_sum(F.transform("spread", lambda v: F.log(v))))
    kde = dense.join(packed, "dataset").select("dataset", "split", "idx", (norm - total).alias("score"))
    return near.unionByName(kde)


#: TRAIN rows of a dataset that a labelled fit sees at most, first in hash order.
FIT_ROWS = 1000
# Folds of the pseudo classifier, TRAIN rows that it needs, inverse
# penalty, quantiles of its scaling.
PSEUDO_FOLDS, PSEUDO_LEAST, PSEUDO_C, PSEUDO_RANGE = 3, 30, 0.5, (0.1, 0.9)


def pseudo_fit(x: np.ndarray, y: np.ndarray, c: float = PSEUDO_C, rounds: int = 40) -> tuple[float, np.ndarray]:
    """(bias, slope) of the class-balanced logistic fit on features scaled by median
    and quantile range of the normal rows; the slopes of scaled features are
    penalised, the bias is not.  Newton's rounds end at a fixed point."""
    low, mid, high = np.quantile(x[y == 0], [PSEUDO_RANGE[0], 0.5, PSEUDO_RANGE[1]], axis=0)
    width = np.where(high > low, high - low, 1.0)
    z = np.hstack([np.ones((len(x), 1)), (x - mid) / width])
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    beta, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1]) / c
    ridge[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    slope = beta[1:] / width
    return float(beta[0] - (slope * mid).sum()), slope


def pseudo_classifier(rows: DataFrame, pseudo: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """P(anomaly) of a logistic fit of normal against pseudo rows, cross-fitted in
    three folds; a dataset with fewer than ``PSEUDO_LEAST`` TRAIN rows gets its
    local gap instead.

    ``pseudo`` rows carry the idx of their TRAIN parent, so a fold holds out a
    row together with its perturbations.  The fit sees at most ``fit_rows``
    TRAIN rows of a dataset and their perturbations; all rows are scored.
    """
    sizes = rows.filter("split = 'TRAIN'").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    few = rows.join(sizes.filter(F.col("n") < PSEUDO_LEAST).select("dataset"), "dataset", "left_semi")
    many = rows.join(sizes.filter(F.col("n") >= PSEUDO_LEAST).select("dataset"), "dataset", "left_semi")
    reference = stage(reference_rows(many.filter("split = 'TRAIN'"), fit_rows))
    pseudo = pseudo.join(reference.select("dataset", "idx"), ["dataset", "idx"], "left_semi")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "idx"], kind="stable")
        bias, slope = pseudo_fit(np.stack(pdf["vec"].to_numpy()).astype(float), pdf["y"].to_numpy().astype(float))
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "bias": [bias], "slope": [slope]})

    # in hash order every third row, as in ``fold_plan``
    plan = stage(fold_plan(many.filter("split = 'TRAIN'"), folds=PSEUDO_FOLDS))
    fakes = cross_rows(pseudo.withColumn("split", F.lit("TRAIN")), plan).filter("split = 'TRAIN'").withColumn("y", F.lit(1))
    train = cross_rows(reference, plan).filter("split = 'TRAIN'").withColumn("y", F.lit(0)).unionByName(fakes)
    model = train.select("dataset", "idx", "vec", "y").groupBy("dataset").applyInPandas(fit, "dataset string, bias double, slope array<double>")
    logit = F.col("bias") + array_sum(F.zip_with("vec", "slope", lambda a, b: a * b))
    scored = cross_rows(many, plan).filter("split <> 'TRAIN'").join(model, "dataset").select("dataset", "split", "idx", (1 / (1 + F.exp(-logit))).alias("score"))
    return _over_folds(scored).unionByName(local_gap(few))


# ---- stored reconstructions -------------------------------------------------

def reconstruction_score(x="x", recon="recon", mu="mu", logvar="logvar", beta: float = 0.001) -> Column:
    """Mean squared error plus beta times the KL term, from stored arrays."""
    mse = array_mean(F.zip_with(x, recon, lambda a, b: (a - b) * (a - b)))
    kl = -0.5 * array_sum(F.zip_with(mu, logvar, lambda m, v: 1 + v - m * m - F.exp(v)))
    return mse + beta * kl


def gaussian_nll(x, mu, logvar) -> Column:
    """Mean negative log-likelihood of a series under a predicted Gaussian."""
    terms = F.transform(F.arrays_zip(F.col(x).alias("x"), F.col(mu).alias("m"), F.col(logvar).alias("v")), lambda z: (
        0.5 * z["v"] + 0.5 * math.log(2 * math.pi) + (z["x"] - z["m"]) * (z["x"] - z["m"]) / (2 * F.exp(z["v"]))))
    return array_mean(terms)


def spectral_loss(x="x", recon="recon") -> Column:
    """Relative difference plus mean log difference of two windowed spectra."""
    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        def magnitude(v):
            v = np.asarray(v, dtype=float)
            width = 64 if len(v) >= 128 else 32 if len(v) >= 64 else 16
            # periodic Hann window, centred frames with reflected ends
            window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
            frames = np.lib.stride_tricks.sliding_window_view(np.pad(v, width // 2, mode="reflect"), width)[:: width // 4]
            return np.abs(np.fft.rfft(frames * window, axis=1))

        def loss(a, b):
            a, b = magnitude(a), magnitude(b)
            norm = np.linalg.norm(a) or 1.0
            return float(np.linalg.norm(a - b) / norm + np.abs(np.log(a + 1e-5) - np.log(b + 1e-5)).mean())

        return pd.Series([loss(a, b) for a, b in zip(left, right)])

    return run(x, recon)


def density_weights(near: DataFrame) -> DataFrame:
    """exp(own radius / median radius), scaled to mean one per dataset."""
    base = stage(near.filter("split = 'TRAIN'").select("dataset", "idx", mean_distance().alias("r")))
    mid = exact_quantiles(base, ["dataset"], "r", {"tau": 0.5})
    raw = base.join(mid, "dataset").withColumn("w", F.exp(F.col("r") / F.when(F.col("tau") == 0, 1e-5).otherwise(F.col("tau"))))
    mean = raw.groupBy("dataset").agg(F.avg("w").alias("mean"))
    return raw.join(mean, "dataset").select("dataset", "idx", (F.col("w") / F.col("mean")).alias("weight"))


# ---- generated series -------------------------------------------------------

def _pick(low, high, *parts) -> Column:
    return low + (high - low) * uniform(*parts)


def _segment(seed: str, low: float, high: float, *tags) -> tuple[Column, Column]:
    n = F.size("values")
    width = F.greatest(F.lit(1), F.rint(n * _pick(low, high, seed, F.col("dataset"), F.col("idx"), *tags, "w")).cast("int"))
    start = F.floor(uniform(seed, F.col("dataset"), F.col("idx"), *tags, "s") * F.greatest(F.lit(1), n - width + 1)).cast("int")
    return start, width


def _lift() -> Column:
    """Add _m to the points from _a on; the draws are bound once per row."""
    drawn = F.struct(F.col("_a").alias("a"), F.col("_w").alias("w"), F.col("_m").alias("m"))
    return let(drawn, lambda p: F.transform("values", lambda x, i: F.when(
        (i >= p["a"]) & (i < p["a"] + p["w"]), x + p["m"]).otherwise(x)))


def pseudo_series(train: DataFrame, seed: str = "pseudo") -> DataFrame:
    """Spike, step and shuffle versions of each TRAIN series (kind, values)."""
    out = None
    sign = lambda k: F.when(uniform(seed, F.col("dataset"), F.col("idx"), k, "sign") < 0.5, -1.0).otherwise(1.0)
    for kind, low, high, weak, strong in (("spike", 0.01, 0.04, 2.5, 4.0), ("step", 0.10, 0.30, 1.0, 2.0), ("shuffle", 0.10, 0.25, 0.0, 0.0)):
        start, width = _segment(seed, low, high, kind)
        rows = train.withColumn("_a", start).withColumn("_w", width).withColumn(
            "_m", sign(kind) * _pick(weak, strong, seed, F.col("dataset"), F.col("idx"), kind, "amp"))
        if kind == "shuffle":
            keyed = F.transform(F.slice("values", F.col("_a") + 1, F.col("_w")), lambda x, i: F.struct(
                hash_key(seed, F.col("dataset"), F.col("idx"), "order", i).alias("h"), x.alias("x")))
            body = F.transform(F.array_sort(keyed), lambda e: e["x"])
            tail = F.slice("values", F.col("_a") + F.col("_w") + 1, F.size("values"))
            values = F.concat(F.slice("values", F.lit(1), F.col("_a")), body, tail)
        else:
            values = _lift()
        part = rows.select("dataset", "idx", F.lit(kind).alias("kind"), values.alias("values"))
        out = part if out is None else out.unionByName(part)
    return out


def inject(train: DataFrame, seed: str = "inject") -> DataFrame:
    """One altered copy per TRAIN series: shift, scale, ramp, splice, reverse.

    The splice donor is the neighbour in hash order, found by an equi join; a
    donor shorter than the segment cannot give one, so the segment is reversed.
    """
    keys = (F.col("dataset"), F.col("idx"))
    placed = with_position(train.withColumn("_h", hash_key(seed, *keys)), ["dataset"], [("_h", "asc"), ("idx", "asc")], "_r")
    n = train.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    donors = placed.select("dataset", F.col("_r").alias("_next"), F.col("values").alias("_donor"))
    rows = placed.join(n, "dataset").withColumn("_next", F.pmod(F.col("_r"), F.col("_n")) + 1).join(donors, ["dataset", "_next"])
    u = lambda tag: uniform(seed, *keys, tag)
    length = F.size("values")
    low, high = F.greatest(F.lit(4), F.floor(length / 32)), F.greatest(F.lit(5), F.floor(length / 8) + 1)
    rows = rows.withColumn("kind", F.floor(u("kind") * 5).cast("int")).withColumn(
        "_w", (low + F.floor(u("w") * (high - low))).cast("int")).withColumn(
        "_a", F.floor(u("s") * F.greatest(F.lit(1), length - F.col("_w") + 1)).cast("int")).withColumn(
        "_b", F.floor(u("d") * F.greatest(F.lit(1), F.size("_donor") - F.col("_w") + 1)).cast("int"))
    sign = F.when(u("sign") < 0.5, -1.0).otherwise(1.0)
    rows = rows.withColumn("_m", F.when(F.col("kind") == 0, sign * (2.5 + u("amp")) * (array_std("values") + 1e-6))
                           .when(F.col("kind") == 1, 0.2 + 2.6 * u("amp")).otherwise(3.0 * sign))
    seg = F.slice("values", F.col("_a") + 1, F.col("_w"))
    new = (F.when(F.col("kind") == 0, F.transform(seg, lambda x: x + F.col("_m")))
           .when(F.col("kind") == 1, F.transform(seg, lambda x: x * F.col("_m")))
           .when(F.col("kind") == 2, F.transform(seg, lambda x, i: x + F.col("_m") * i / F.greatest(F.lit(1), F.col("_w") - 1)))
           .when((F.col("kind") == 3) & (F.size("_donor") >= F.col("_w")), F.slice("_donor", F.col("_b") + 1, F.col("_w"))).otherwise(F.reverse(seg)))
    values = F.concat(F.slice("values", F.lit(1), F.col("_a")), new, F.slice("values", F.col("_a") + F.col("_w") + 1, length))
    return rows.select("dataset", "idx", "kind", values.alias("values"))


def _gauss(seed: str, i, *keys) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, *keys, i, "r"))) * F.cos(2 * math.pi * uniform(seed, *keys, i, "a"))


def augment(train: DataFrame, target: int, seed: str = "aug") -> DataFrame:
    """Grow TRAIN to ``target`` rows by jitter (.03), scale (.9-1.1) or both.

    Copies are spread over the rows along a hash order: row r makes the copies
    r, r + n, r + 2n, ... so nothing is gathered.
    """
    keys = (F.col("dataset"), F.col("idx"), F.col("copy"))
    placed = with_position(train.withColumn("_h", hash_key(seed, F.col("dataset"), F.col("idx"))), ["dataset"], [("_h", "asc"), ("idx", "asc")], "_r")
    n = train.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    extra = F.lit(target) - F.col("_n")
    times = F.when(F.col("_r") <= extra, F.floor((extra - F.col("_r")) / F.col("_n")) + 1).otherwise(0)
    rows = placed.join(n, "dataset").withColumn("_t", times).filter("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_t"))))
    kind = F.floor(uniform(seed, *keys, "kind") * 3)
    rows = rows.withColumn("_k", kind).withColumn("_s", F.when(F.col("_k") == 0, 1.0).otherwise(_pick(0.9, 1.1, seed, *keys, "scale")))
    noisy = F.transform("values", lambda x, i: (x + F.when(F.col("_k") == 1, 0.0).otherwise(0.03 * _gauss(seed, i, *keys))) * F.col("_s"))
    return rows.select("dataset", "idx", "copy", noisy.alias("values")).unionByName(
        train.select("dataset", "idx", F.lit(0).cast("long").alias("copy"), "values"))


def tile(train: DataFrame, target: int = 500) -> DataFrame:
    """Repeat TRAIN rows in order until the dataset has ``target`` rows."""
    n = train.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    rows = train.join(n, "dataset")
    times = F.when(F.col("_n") >= target, 1).otherwise(F.floor((target - 1 - F.col("idx")) / F.col("_n")) + 1)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), times.cast("long") - 1))
    return rows.filter((F.col("idx") < target) | (F.col("_n") >= target)).withColumn("copy", copies).withColumn(
        "place", F.col("copy") * F.col("_n") + F.col("idx")).drop("_n")


def warp_permute(rows: DataFrame, seed: str = "multi", segments: int = 4) -> DataFrame:
    """Sine time-warp or segment shuffle of a series, chosen by hash."""
    keys = (F.col("dataset"), F.col("idx"))
    n = F.size("values")
    tagged = rows.withColumn("kind", F.when(uniform(seed, *keys, "kind") < 0.5, "warp").otherwise("permute")).withColumn(
        "_p", _pick(0.0, 2 * math.pi, seed, *keys, "phase"))
    at = lambda i, p: F.greatest(F.lit(0), F.least(n - 1, F.rint(i + 0.05 * n * F.sin(2 * math.pi * i / n + p)).cast("int")))
    warped = let(F.col("_p"), lambda p: F.transform("values", lambda x, i: F.get("values", at(i, p))))
    edge = lambda j: F.floor(n * j / segments).cast("int")
    order = F.array_sort(F.array(*[F.struct(hash_key(seed, *keys, "seg", F.lit(j)).alias("h"), F.lit(j).alias("j")) for j in range(segments)]))
    shuffled = F.flatten(F.transform(order, lambda s: F.slice("values", edge(s["j"]) + 1, edge(s["j"] + 1) - edge(s["j"]))))
    return tagged.withColumn("values", F.when(F.col("kind") == "warp", warped).otherwise(shuffled)).drop("_p")


# ---- periodicity ------------------------------------------------------------

def _autocorrelation_peak(x: np.ndarray, limit: float) -> bool:
    """A local autocorrelation peak above the limit at lag five or later."""
    x = x - x.mean()
    power = (x ** 2).sum()
    if len(x) < 15 or power == 0:
        return False
    size = 2 * len(x)
    acf = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[:len(x)] / power
    mid = acf[5:-1]
    peaks = (mid > acf[4:-2]) & (mid > acf[6:])
    return bool((mid[peaks] > limit).any())


def _detrended(x: np.ndarray) -> np.ndarray:
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * (t @ x) / max(1e-12, t @ t)


def _spectral_entropy(power: np.ndarray) -> float:
    total = power.sum()
    share = power / total if total > 0 else np.full(len(power), 1 / len(power))
    return float(-(share * np.log2(share + 1e-12)).sum() / np.log2(len(share)))


def periodic_flag(values, mode: str = "acf") -> Column:
    """1 when a series is periodic: ACF peak, or detrended ACF or entropy."""
    @F.pandas_udf("int")
    def run(series: pd.Series) -> pd.Series:
        def flag(v) -> int:
            x = np.asarray(v, dtype=float)
            if mode == "acf":
                return int(_autocorrelation_peak(x, 0.40))
            if len(x) < 15:
                return 0
            x = _detrended(x)
            if x.std() == 0:
                return 0
            return int(_autocorrelation_peak(x, 0.45) or _spectral_entropy(np.abs(np.fft.rfft(x)) ** 2) < 0.65)
        return pd.Series([flag(v) for v in series])
    return run(values)


def periodic_datasets(rows: DataFrame, mode: str = "acf") -> DataFrame:
    """Datasets where at least half of the series are periodic."""
    share = rows.withColumn("f", periodic_flag("values", mode)).groupBy("dataset").agg(F.avg("f").alias("share"))
    return share.withColumn("periodic", (F.col("share") >= 0.5).cast("int"))


def periodic_by_mean(train: DataFrame, least: int = 128) -> DataFrame:
    """Length-gated check of the mean TRAIN series: ACF or Welch entropy."""
    from outlane.operators.scoring import pack
    mean = train.select("dataset", F.posexplode("values").alias("feature", "v")).groupBy("dataset", "feature").agg(F.avg("v").alias("m"))

    @F.pandas_udf("int")
    def run(series: pd.Series) -> pd.Series:
        def flag(v) -> int:
            x = np.asarray(v, dtype=float)
            if len(x) < least:
                return 0
            x = _detrended(x)
            width, hop = min(len(x), 256), max(1, min(len(x), 256) // 2)
            size = max(256, int(2 ** np.ceil(np.log2(len(x)))))
            window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
            frames = [x[a:a + width] for a in range(0, len(x) - width + 1, hop)]
            power = np.mean([np.abs(np.fft.rfft((f - f.mean()) * window, size)) ** 2 for f in frames], axis=0)
            power[1:-1] *= 2
            return int(_autocorrelation_peak(x, 0.45) or (power.sum() > 0 and _spectral_entropy(power) < 0.65))
        return pd.Series([flag(v) for v in series])

    return pack(mean, ["m"]).select("dataset", F.size("m").alias("length"), run("m").alias("periodic"))
