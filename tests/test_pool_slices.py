"""Pooled features leave a worker in slices and are those of the whole batch."""

import numpy as np

from outlane.operators import kernels


def test_shares_of_slices(spark, monkeypatch):
    monkeypatch.setattr(kernels, "SLICE", 7)
    x = np.random.default_rng(3).normal(size=(40, 30))
    rows = spark.createDataFrame([("d", "TRAIN", i, r.tolist()) for i, r in enumerate(x)], "dataset string, split string, idx bigint, values array<double>").coalesce(1)
    biases = kernels.fit_biases(rows, 30, 3)
    limits = biases.first().biases
    got = {r.idx: r.vec for r in kernels.pooled_features(rows, biases, 30, 3, all_pools=False).collect()}
    for k, p in enumerate(kernels.dictionary_params(30, 3)):
        want = (kernels.convolve(x, p) > limits[k]).mean(axis=1)
        assert np.allclose([got[i][k] for i in range(40)], want)
