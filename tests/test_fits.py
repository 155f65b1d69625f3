"""Fits by rounds of sums against whole-matrix versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlane.operators import fits, models

SCHEMA = "dataset string, split string, idx bigint, vec array<double>"


def clusters(n=3000, width=4, seed=1):
    """The last two thirds form a third cluster."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[n // 6:n // 3] += 12
    x[n // 3:] -= 15
    return x


def frame(spark, x, tests, name="d"):
    rows = [(name, "TRAIN", i, [float(v) for v in r]) for i, r in enumerate(x)] + [(name, "TEST", i, [float(v) for v in r]) for i, r in enumerate(tests)]
    return spark.createDataFrame(rows, SCHEMA)


def lloyd(x, k, rounds=fits.ROUNDS):
    centers = [x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()]]
    while len(centers) < min(k, len(x)):
        centers.append(x[np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0).argmax()])
    centers = np.array(centers)
    for _ in range(rounds):
        near = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centers[j] for j in range(len(centers))])
    return centers


def models_of(df):
    return {(r.dataset, m["fold"]): m for r in df.collect() for m in r.models}


def test_kmeans_sees_all_rows(spark, monkeypatch):
    monkeypatch.setattr(fits, "BLOCK_ROWS", 250)
    x = clusters()
    df = frame(spark, x, x[:3]).repartition(5)
    packed = fits.blocks(df)
    assert packed.count() == 12
    got = models_of(fits.kmeans_models(packed, 3))["d", -1]
    assert np.allclose(got["mean"], lloyd(x, 3)) and got["done"]
    assert np.allclose(sorted(np.round(np.mean(got["mean"], axis=1))), [-15, 0, 12])


def test_kmeans_of_folds_leaves_the_fold_out(spark):
    x = clusters(300)
    df = frame(spark, x, x[:7])
    plan = models.score_folds(df.filter("split = 'TRAIN'")).cache()
    fold = {r.idx: r.fold for r in plan.collect()}
    folds = np.array([fold[i] for i in range(300)])
    want = {f: lloyd(x[folds != f], 3) for f in range(5)}
    got = {(r.split, r.idx): r.score for r in models.crossfit(df, models.kmeans(3)).collect()}
    near = lambda v, c: np.sqrt(((v - c) ** 2).sum(axis=1)).min()
    assert np.allclose([got["TRAIN", i] for i in range(300)], [near(x[i], want[folds[i]]) for i in range(300)])
    assert np.allclose([got["TEST", i] for i in range(7)], [np.median([near(x[i], want[f]) for f in range(5)]) for i in range(7)])


def test_mixture_sees_all_rows_and_its_bic_is_least(spark, monkeypatch):
    monkeypatch.setattr(fits, "BLOCK_ROWS", 400)
    x = clusters(1500)
    df = frame(spark, x, x[:3])
    got = models_of(fits.mixture_models(fits.blocks(df), 3))["d", -1]
    assert got["k"] == 3 and np.allclose(sorted(got["weight"]), [1 / 6, 1 / 6, 2 / 3], atol=0.01) and abs(sum(got["weight"]) - 1) < 1e-9
    logp = np.log(got["weight"]) - 0.5 * np.stack([(np.log(2 * np.pi * np.array(v)) + (x - m) ** 2 / v).sum(axis=1) for m, v in zip(got["mean"], got["var"])], axis=1)
    fit = np.log(np.exp(logp - logp.max(axis=1, keepdims=True)).sum(axis=1)) + logp.max(axis=1)
    assert np.isclose(got["fit"], fit.sum())
    part = np.exp(logp - fit[:, None])
    # fixed point: one more round hardly moves it
    assert np.allclose(part.T @ x / part.sum(axis=0)[:, None], got["mean"], atol=0.05)
    scores = {(r.split, r.idx): r.score for r in fits.gmm(3)(df).collect()}
    assert np.allclose([scores["TEST", i] for i in range(3)], -fit[:3])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_fewer_rows_than_parts(spark, n):
    x = np.arange(2.0 * n).reshape(n, 2)
    df = frame(spark, x, [[50.0, 50.0]]).unionByName(frame(spark, clusters(40, 2), np.zeros((1, 2)), "other"))
    for scorer in (models.kmeans(3), models.gmm(3)):
        got = models.crossfit(df, scorer)
        assert got.filter("dataset = 'd'").count() == n + 1 and got.filter("dataset = 'other'").count() == 41
        assert got.filter(F.col("score").isNull() | F.isnan("score")).count() == 0


def test_scores_that_fail_become_distances_to_the_centre(spark):
    x = clusters(60)
    df = frame(spark, x, x[:4])
    broken = lambda rows: models.centroid(rows).withColumn("score", F.when(F.col("idx") % 3 == 0, float("nan")).when(F.col("idx") % 3 == 1, F.col("score")))
    key = lambda rows: sorted((r.split, r.idx, round(r.score, 9)) for r in rows.collect())
    assert key(models.crossfit(df, broken)) == key(models.crossfit(df, models.centroid))


def test_score_folds_are_five_at_most(spark):
    x = clusters(33)
    both = frame(spark, x, []).unionByName(frame(spark, x[:4], [], "few")).unionByName(frame(spark, x[:12], [], "dozen"))
    plan = models.score_folds(both)
    assert {r.dataset: (r.n, r.folds) for r in plan.groupBy("dataset").agg(F.countDistinct("fold").alias("n"), F.max("folds").alias("folds")).collect()} == {"d": (5, 5), "few": (4, 4), "dozen": (5, 5)}


def test_models_do_not_travel_with_rows_to_their_folds(spark, monkeypatch):
    """rows meet their folds first, the wide models after that."""
    from outlane.operators import fits

    rows = spark.range(40).selectExpr("'a' AS dataset", "CASE WHEN id < 30 THEN 'TRAIN' ELSE 'TEST' END AS split", "id AS idx", "array(double(id % 7), double(id % 5)) AS vec")
    plan = rows.filter("split = 'TRAIN'").selectExpr("dataset", "idx", "int(idx % 5) AS fold", "5 AS folds")
    text = fits.kmeans(2).folded(rows, plan)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= text.index("Join Inner") < text.index("Join LeftOuter")
