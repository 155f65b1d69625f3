"""Pruned neighbour search: exact, and it sees a small part of the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlane.operators import scoring

SCHEMA = "dataset string, split string, idx bigint, vec array<double>"


def clustered(n, width=6, clusters=12, seed=3):
    rng = np.random.default_rng(seed)
    centers = 40 * rng.normal(size=(clusters, width))
    return centers[rng.integers(0, clusters, n)] + rng.normal(size=(n, width))


def frame(spark, train, test, name="d"):
    rows = [(name, "TRAIN", i, [float(v) for v in r]) for i, r in enumerate(train)] + [(name, "TEST", i, [float(v) for v in r]) for i, r in enumerate(test)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(train, test, k):
    out = {}
    for split, rows in (("TRAIN", train), ("TEST", test)):
        for i, x in enumerate(rows):
            d = np.sqrt(((x - train) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((np.arange(len(train)), d)) if not (split == "TRAIN" and j == i)][:k]
            out["d", split, i] = [(round(float(d[j]), 9), int(j)) for j in order]
    return out


def found(df):
    return {(r.dataset, r.split, r.idx): [(round(n.d, 9), n.rid) for n in r.near] for r in df.collect()}


@pytest.mark.parametrize("kind", ["clustered", "noise", "copies"])
def test_pruned_search_is_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(scoring, "REFERENCE_BLOCK", 50)
    monkeypatch.setattr(scoring, "QUERY_BLOCK", 40)
    x = clustered(420) if kind == "clustered" else np.random.default_rng(2).normal(size=(420, 6)) if kind == "noise" else np.repeat(np.random.default_rng(4).normal(size=(7, 6)), 60, axis=0)
    train, test = x[:360], x[360:]
    df = frame(spark, train, test).unionByName(frame(spark, train[:20], test[:5], "small"))
    got = found(scoring.neighbours(df, df.filter("split = 'TRAIN'"), 4))
    want = brute(train, test, 4)
    assert {key: v for key, v in got.items() if key[0] == "d"} == want
    assert {key[1:]: v for key, v in got.items() if key[0] == "small"} == {key[1:]: v for key, v in brute(train[:20], test[:5], 4).items()}


def test_clustered_data_visit_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "REFERENCE_BLOCK", 50)
    train, test = clustered(2000), clustered(100, seed=3)
    df = frame(spark, train, test)
    right = df.filter("split = 'TRAIN'").select("dataset", F.col("idx").alias("rid"), F.col("vec").alias("ref_vec"))
    blocks, marks = scoring.reference_blocks(right, right.groupBy("dataset").agg(F.count("*").alias("n")))
    total = blocks.select("cell", "ring").distinct().count()
    assert blocks.count() == 2000 and total >= 40
    left = df.filter("split = 'TEST'").select("dataset", "split", "idx", F.col("vec").alias("query_vec"))
    first = scoring.visits(left, marks, 3)
    assert first.count() == 100
    near = brute(train, test, 3)
    bound = spark.createDataFrame([("d", "TEST", i, near["d", "TEST", i][-1][0]) for i in range(100)], "dataset string, split string, idx bigint, most double")
    second = scoring.visits(left.join(bound, ["dataset", "split", "idx"]), marks, 3)
    assert second.count() < 0.2 * 100 * total


def links(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.dataset, r.split, r.idx), []).append((round(r.d, 9), r.rid))
    return {key: sorted(v) for key, v in out.items()}


@pytest.mark.parametrize("margin", [1.0, 2.5])
def test_one_graph_serves_all_folds(spark, monkeypatch, margin):
    """The links of each fold are those of a search of its own; a margin of 1 makes
    most rows short."""
    from outlane.operators import models

    calls = []
    search = scoring.neighbours
    monkeypatch.setattr(models, "neighbours", lambda *a: calls.append(1) or search(*a))
    monkeypatch.setattr(models.LocalOutlierFactor, "MARGIN", margin)
    df = frame(spark, clustered(60), clustered(9, seed=8)).unionByName(frame(spark, clustered(3), clustered(2), "few")).unionByName(frame(spark, clustered(8), clustered(2), "some")).cache()
    plan = models.score_folds(df.filter("split = 'TRAIN'")).cache()
    got = links(models.lof(5).fold_links(df, plan))
    assert len(calls) <= 2
    crossed = models.cross_rows(df, plan)
    own = search(crossed, crossed.filter("split = 'TRAIN'"), 5)
    assert got == {key: v for key, v in found(own).items() if v}


def test_blocks_without_nearer_rows_send_nothing():
    """A bound from the first block is kept; ties go by id."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    ref, q = np.round(rng.normal(size=(200, 4)), 1), np.round(rng.normal(size=(50, 4)), 1)
    dist = np.sqrt(((q[:, None] - ref[None]) ** 2).sum(axis=2))
    right = pd.DataFrame({"rid": np.arange(200)[::-1], "ref_vec": list(ref)})
    left = pd.DataFrame({"dataset": "a", "split": "TEST", "idx": np.arange(50), "query_vec": list(q)})
    want = [sorted(zip(d, range(199, -1, -1)))[:3] for d in dist.tolist()]
    of = lambda df: {r.idx: [(x["d"], x["rid"]) for x in r.near] for r in df.itertuples()}
    work = scoring._block_neighbours(3, True)
    assert of(work(left, right)) == dict(enumerate(want))
    some = left.assign(most=[w[-1][0] if i % 2 else w[0][0] / 2 if w[0][0] else -1.0 for i, w in enumerate(want)])
    got = of(work(some, right))
    assert all(got[i] == want[i] for i in range(1, 50, 2)) and not set(got) & {i for i in range(0, 50, 2) if want[i][0][0] > 0}
    assert scoring.REFERENCE_BLOCK >= 16_384 <= scoring.QUERY_BLOCK
