"""Fitted biases are exact quantiles of all outputs, whatever their distribution."""

import numpy as np
import pytest

from outlane.operators import kernels, scoring

SCHEMA = "dataset string, split string, idx bigint, values array<double>"


@pytest.mark.parametrize("kind", ["noise", "heavy", "ties", "constant", "one"])
def test_biases_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(kernels, "BUCKETS", 8)
    rng = np.random.default_rng(5)
    n = 1 if kind == "one" else 2300
    x = rng.normal(size=(n, 20))
    if kind == "heavy":
        x = np.exp(6 * x)
        x[0, 0] = 1e12
    elif kind == "ties":
        x = rng.integers(0, 2, (n, 20)).astype(float)
    elif kind == "constant":
        x = np.full((n, 20), 2.5)
    rows = spark.createDataFrame([("d", "TRAIN", i, r.tolist()) for i, r in enumerate(x)] + [("e", "TRAIN", i, r.tolist()) for i, r in enumerate(x[:5])], SCHEMA).repartition(4)
    assert scoring.row_chunks(rows.select("dataset", "idx", "values"), "values", "idx").count() == (4 if n > 1 else 2)
    got = {r.dataset: r.biases for r in kernels.fit_biases(rows, 20, 6).collect()}
    for name, part in (("d", x), ("e", x[:5])):
        want = [np.quantile(kernels.convolve(part, p), p["quantile"]) for p in kernels.dictionary_params(20, 6)]
        assert np.allclose(got[name], want, rtol=1e-12, atol=1e-12)


def test_longest_run(spark):
    x = np.random.default_rng(7).normal(size=(40, 30))
    rows = spark.createDataFrame([("d", "TRAIN", i, r.tolist()) for i, r in enumerate(x)], SCHEMA)
    biases = kernels.fit_biases(rows, 30, 3)
    limits = biases.first().biases
    got = {r.idx: r.vec for r in kernels.pooled_features(rows, biases, 30, 3).collect()}
    for k, p in enumerate(kernels.dictionary_params(30, 3)):
        for i, row in enumerate(kernels.convolve(x, p) > limits[k]):
            runs = "".join("x" if v else " " for v in row).split()
            assert got[i][4 * k + 3] == pytest.approx(max(map(len, runs), default=0) / len(row))
