"""Operators without a SQL twin, against brute force on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlane.operators import features, images, kernels, models, reports
from outlane.operators.scoring import neighbours


def vec_rows(spark, x, split="TRAIN", name="d"):
    return [(name, split, i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.fixture()
def points(spark):
    rng = np.random.default_rng(1)
    train, test = rng.normal(size=(40, 6)), np.vstack([rng.normal(size=(9, 6)), np.full((1, 6), 8.0)])
    return train, test, spark.createDataFrame(vec_rows(spark, train) + vec_rows(spark, test, "TEST"), "dataset string, split string, idx bigint, vec array<double>")


def table(df, split="TEST", col="score"):
    return np.array([r[col] for r in df.filter(F.col("split") == split).orderBy("idx").collect()])


@pytest.mark.parametrize("centred", [True, False])
def test_factor_matches_svd(points, centred):
    train, test, df = points
    mean = train.mean(axis=0) if centred else 0
    axes = np.linalg.svd(train - mean, full_matrices=False)[2][:3]
    axes = axes * np.sign(axes[np.arange(3), np.abs(axes).argmax(axis=1)])[:, None]
    assert np.allclose(table(features.factor(df, 3, centred), col="vec"), (test - mean) @ axes.T)


@pytest.mark.parametrize("centred", [True, False])
def test_wide_vectors_by_subspace_iteration(spark, monkeypatch, centred):
    """600 values: no product matrix is made, the axes are those of an SVD."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(features, "_gram", None)
    x = rng.normal(size=(1200, 12)) * np.geomspace(9, 0.5, 12) @ rng.normal(size=(12, 600)) + 0.05 * rng.normal(size=(1200, 600)) + 3
    train, test = x[:1150], x[1150:]
    df = spark.createDataFrame(vec_rows(spark, train) + vec_rows(spark, test, "TEST") + vec_rows(spark, x[:3], name="few") + vec_rows(spark, test[:2], "TEST", "few"), "dataset string, split string, idx bigint, vec array<double>").repartition(3)
    got = features.factor(df, 4, centred).cache()
    for name, own, rows in (("d", train, test), ("few", x[:3], test[:2])):
        mean = own.mean(axis=0) if centred else 0
        axes = np.linalg.svd(own - mean, full_matrices=False)[2][:4]
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
        some = min(4, len(own) - centred)
        assert np.allclose(table(got.filter(F.col("dataset") == name), col="vec")[:, :some], ((rows - mean) @ axes.T)[:, :some], atol=1e-5)


def test_sliding_shapelets_of_long_series(spark):
    """64 shapes of two widths on 2,048 points, flat stretches and large offsets included."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5, 2048)).cumsum(axis=1) + 1e4
    x[1, 300:700] = 7.0
    shapes = [rng.normal(size=40 if k % 2 else 111) for k in range(62)] + [(w - w.mean()) / (w.std() + 1e-6) for w in (x[0, 50:90], x[2, 900:1011])]
    rows = spark.createDataFrame([("d", i, [float(v) for v in r]) for i, r in enumerate(x)] + [("d", 9, [float(v) for v in x[0, :200]])], "dataset string, idx bigint, values array<double>").repartition(2)
    given = spark.createDataFrame([("d", [[float(v) for v in s] for s in shapes])], "dataset string, shapelets array<array<double>>")
    got = {r.idx: r.vec for r in features.shapelet_distances(rows, given).collect()}
    for i, own in [*enumerate(x), (9, x[0, :200])]:
        for k, shape in enumerate(shapes):
            w = np.lib.stride_tricks.sliding_window_view(own, len(shape))
            w = (w - w.mean(axis=1, keepdims=True)) / (w.std(axis=1, keepdims=True) + 1e-6)
            assert got[i][k] == pytest.approx(np.sqrt(((w - shape) ** 2).mean(axis=1)).min(), abs=1e-5)
    assert got[0][62] < 1e-6 and got[2][63] < 1e-6


def test_neighbour_blocks_are_exact(points):
    train, test, df = points
    d = np.sqrt(((test[:, None] - train[None]) ** 2).sum(axis=2))
    got = neighbours(df, df.filter("split = 'TRAIN'"), 4)
    near = [[n["d"] for n in r["near"]] for r in got.filter("split = 'TEST'").orderBy("idx").collect()]
    assert np.allclose(near, np.sort(d, axis=1)[:, :4])


def test_ties_go_to_the_lower_id(spark):
    data = vec_rows(spark, np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [1.0, 0.0]])) + vec_rows(spark, np.zeros((1, 2)), "TEST")
    df = spark.createDataFrame(data, "dataset string, split string, idx bigint, vec array<double>")
    got = neighbours(df, df.filter("split = 'TRAIN'"), 3).filter("split = 'TEST'").first()
    assert [n["rid"] for n in got["near"]] == [0, 1, 2]


def test_long_train_sides_are_used_whole(spark):
    """1,500 TRAIN rows in one dataset: every row is scored against all others."""
    from outlane.operators import scoring
    x = np.random.default_rng(6).normal(size=(1510, 3))
    data = vec_rows(spark, x[:1500]) + vec_rows(spark, x[1500:], "TEST")
    df = spark.createDataFrame(data, "dataset string, split string, idx bigint, vec array<double>").repartition(4)
    got = {(r.split, r.idx): r.score for r in scoring.local_gap(df).collect()}
    low, mid, high = np.quantile(x[:1500], [0.1, 0.5, 0.9], axis=0)
    z = (x - mid) / (high - low)
    d = np.sqrt(((z[:, None] - z[None, :1500]) ** 2).sum(axis=2))
    d[np.arange(1500), np.arange(1500)] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    base = np.take_along_axis(d, near, axis=1).mean(axis=1)
    radius = base[:1500] + 1e-9
    want = (base - (radius[near].mean(axis=1) + 1e-9)) / (np.median(radius) + 1e-9)
    assert len(got) == 1510
    assert np.allclose([got["TRAIN", i] for i in range(1500)] + [got["TEST", i] for i in range(10)], want)


def test_lone_train_row(spark):
    from outlane.operators import scoring
    data = vec_rows(spark, np.array([[1.0, 2.0]])) + vec_rows(spark, np.array([[1.0, 2.5]]), "TEST")
    df = spark.createDataFrame(data, "dataset string, split string, idx bigint, vec array<double>")
    got = {r.split: r.score for r in scoring.local_gap(df).collect()}
    assert got["TRAIN"] == pytest.approx(-1, abs=1e-6) and got["TEST"] > 1000
    folded = {r.split: r.score for r in models.crossfit(df, models.centroid).collect()}
    assert folded == {"TRAIN": 0.0, "TEST": 0.5}


def test_neighbours_over_many_blocks(points, monkeypatch):
    from outlane.operators import scoring
    train, test, df = points
    monkeypatch.setattr(scoring, "REFERENCE_BLOCK", 8)
    monkeypatch.setattr(scoring, "QUERY_BLOCK", 5)
    got = neighbours(df, df.filter("split = 'TRAIN'"), 3)
    d = np.sqrt(((test[:, None] - train[None]) ** 2).sum(axis=2))
    near = [[n["rid"] for n in r["near"]] for r in got.filter("split = 'TEST'").orderBy("idx").collect()]
    assert np.array_equal(near, np.argsort(d, axis=1)[:, :3])


@pytest.mark.parametrize("scorer", [models.kmeans(3), models.gmm(2), models.lof(5), models.centroid])
def test_crossfit_finds_the_outlier(points, scorer):
    _, _, df = points
    got = models.crossfit(df, scorer).cache()
    assert table(got).argmax() == 9
    assert len(table(got, "TRAIN")) == 40


def test_small_train_routes_by_size(spark, points):
    train, test, _ = points
    data = vec_rows(spark, train[:4], name="tiny") + vec_rows(spark, test, "TEST", "tiny") + vec_rows(spark, train[:20], name="small") + vec_rows(spark, test, "TEST", "small")
    got = models.small_train(spark.createDataFrame(data, "dataset string, split string, idx bigint, vec array<double>"))
    for name in ("tiny", "small"):
        assert table(got.filter(F.col("dataset") == name)).argmax() == 9


def test_classifier_separates(spark, points):
    train, _, df = points
    pseudo = spark.createDataFrame([("d", i, [float(v) + 6 for v in row]) for i, row in enumerate(train)], "dataset string, idx bigint, vec array<double>")
    got = models.pseudo_classifier(df, pseudo).cache()
    assert table(got)[9] > 0.9 and np.median(table(got, "TRAIN")) < 0.1


def test_classifier_is_a_fixed_point_of_the_penalised_loss():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(60, 4)), rng.normal(size=(120, 4)) + [2, 0, 0, 0]])
    y = np.repeat([0.0, 1.0], [60, 120])
    bias, slope = models.pseudo_fit(x, y)
    width = np.diff(np.quantile(x[:60], [0.1, 0.9], axis=0), axis=0)[0]
    p = 1 / (1 + np.exp(-(bias + x @ slope)))
    weight = np.where(y == 1, 180 / 240, 180 / 120)
    mid = np.median(x[:60], axis=0)
    gradient = ((x - mid) / width).T @ (weight * (p - y)) + slope * width / models.PSEUDO_C
    assert np.abs(gradient).max() < 1e-6 and abs((weight * (p - y)).sum()) < 1e-6


def test_classifier_of_folds_and_of_small_sides(spark, points):
    from outlane.operators import scoring
    train, test, df = points
    fakes = train + np.array([6.0, -6, 6, -6, 6, -6])
    rows = df.unionByName(spark.createDataFrame(vec_rows(spark, train[:29], name="few") + vec_rows(spark, test, "TEST", "few"), df.schema))
    pseudo = spark.createDataFrame([(n, i, [float(v) for v in row]) for n, k in (("d", 40), ("few", 29)) for i, row in enumerate(fakes[:k])], "dataset string, idx bigint, vec array<double>")
    got = {(r.dataset, r.split, r.idx): r.score for r in models.pseudo_classifier(rows, pseudo).collect()}
    gap = {(r.split, r.idx): r.score for r in scoring.local_gap(rows.filter("dataset = 'few'")).collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "few"} == pytest.approx(gap)
    fold = {r.idx: r.fold for r in models.fold_plan(df.filter("split = 'TRAIN'"), folds=3).collect()}
    folds = np.array([fold[i] for i in range(40)])
    by = {}
    for f in range(3):
        fits = folds != f
        bias, slope = models.pseudo_fit(np.vstack([train[fits], fakes[fits]]), np.repeat([0.0, 1.0], fits.sum()))
        by[f] = lambda x, bias=bias, slope=slope: 1 / (1 + np.exp(-(bias + x @ slope)))
    assert np.allclose([got["d", "TRAIN", i] for i in range(40)], [by[folds[i]](train[i]) for i in range(40)], atol=1e-7)
    assert np.allclose([got["d", "TEST", i] for i in range(10)], [np.median([by[f](x) for f in range(3)]) for x in test], atol=1e-7)


def series(spark, n=6, length=64, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, length))
    return x, spark.createDataFrame([("d", i, [float(v) for v in row]) for i, row in enumerate(x)], "dataset string, idx bigint, values array<double>")


def test_injection_changes_one_segment(spark):
    x, df = series(spark, 20)
    for r in models.inject(df).collect():
        changed = np.flatnonzero(~np.isclose(x[r.idx], r["values"]))
        assert len(r["values"]) == 64
        assert len(changed) == 0 or changed.max() - changed.min() < 64 // 8 + 2


def test_shuffle_keeps_values_and_warp_keeps_length(spark):
    x, df = series(spark, 8)
    for r in models.pseudo_series(df).filter("kind = 'shuffle'").collect():
        assert np.allclose(np.sort(r["values"]), np.sort(x[r.idx]))
    for r in models.warp_permute(df).collect():
        assert len(r["values"]) == 64
        if r.kind == "permute":
            assert np.allclose(np.sort(r["values"]), np.sort(x[r.idx]))


def test_augmentation_reaches_the_target(spark):
    x, df = series(spark, 7)
    got = models.augment(df, 30)
    assert got.count() == 30
    first = got.filter("copy > 0").first()
    assert np.abs(np.array(first["values"]) - x[first.idx]).max() < 1.0
    assert models.tile(df, 30).count() == 30


def test_periodicity(spark):
    t = np.arange(160)
    rng = np.random.default_rng(0)
    data = [("wave", i, list(np.sin(2 * np.pi * t / 16 + i))) for i in range(3)] + [("noise", i, [float(v) for v in rng.normal(size=160)]) for i in range(3)]
    df = spark.createDataFrame([(a, b, [float(v) for v in c]) for a, b, c in data], "dataset string, idx bigint, values array<double>")
    for mode in ("acf", "detrended"):
        assert dict(models.periodic_datasets(df, mode).select("dataset", "periodic").collect()) == {"wave": 1, "noise": 0}
    assert dict(models.periodic_by_mean(df).select("dataset", "periodic").collect()) == {"wave": 1, "noise": 0}


def test_spectral_loss_is_zero_for_a_copy(spark):
    _, df = series(spark)
    got = df.withColumn("shift", F.transform("values", lambda v: v * 2)).select(
        models.spectral_loss("values", "values").alias("same"), models.spectral_loss("values", "shift").alias("other")).first()
    assert got.same == 0 and got.other > 0.5


def test_lbp_and_glcm_match_brute_force(spark):
    size, levels = 6, 8
    px = np.random.default_rng(5).uniform(size=(4, size, size))
    df = spark.createDataFrame([(i, [float(v) for v in p.ravel()]) for i, p in enumerate(px)], "id int, image array<double>")
    got = df.select("id", images.lbp("image", size).alias("lbp"), images.glcm("image", size, levels).alias("glcm")).orderBy("id").collect()
    for p, r in zip(px, got):
        hist = np.zeros(256)
        for y in range(1, size - 1):
            for x in range(1, size - 1):
                hist[sum((p[y + dy, x + dx] >= p[y, x]) << b for b, (dy, dx) in enumerate(images.NEIGHBOURS))] += 1
        assert np.allclose(r.lbp, hist / (hist.sum() + 1e-6))
        q = np.minimum(levels - 1, ((p - p.min()) / (p.max() - p.min() + 1e-6) * levels).astype(int))
        m = np.zeros((levels, levels))
        for y in range(size):
            for x in range(size - 1):
                m[q[y, x], q[y, x + 1]] += 1
                m[q[y, x + 1], q[y, x]] += 1
        m /= m.sum() + 1e-6
        i, j = np.indices(m.shape)
        assert np.allclose(r.glcm[:4], [((i - j) ** 2 * m).sum(), (abs(i - j) * m).sum(), (m / (1 + abs(i - j))).sum(), (m * m).sum()])


def test_spectrogram_and_scalogram_shapes(spark):
    _, df = series(spark)
    r = df.select(images.spectrogram("values", 8).alias("a"), images.scalogram("values", 8).alias("b")).first()
    for image in (r.a, r.b):
        assert len(image) == 64 and min(image) == 0 and 0.99 < max(image) <= 1


def test_kernel_blocks_are_prefixes_of_one_bank():
    wide = kernels.random_kernels(64, 12)
    assert kernels.random_kernels(64, 4, first=8) == wide[8:]
    assert len(kernels.dictionary_kernels()) == 84
    assert all(abs(sum(k["weights"])) < 1e-9 for k in wide)


def test_tolerance_match_equals_greedy(spark):
    rng = np.random.default_rng(2)
    left, right = sorted({int(v) for v in rng.integers(0, 200, 60)}), sorted({int(v) for v in rng.integers(0, 200, 60)})
    free, hits = list(right), 0
    for x in left:
        near = [v for v in free if abs(v - x) <= 2]
        if near:
            free.remove(min(near, key=lambda v: (abs(v - x), v)))
            hits += 1
    frame = lambda ids: spark.createDataFrame([("d", i) for i in ids], "dataset string, idx bigint")
    got = reports.tolerance_match(frame(left), frame(right), 2).first()
    assert (got.matched, got.left_only, got.right_only) == (hits, len(left) - hits, len(free))
