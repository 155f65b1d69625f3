"""Tolerance matching over blocks against the sequential rule."""

import random

import pytest

from outlane.operators import reports


def sequential(left, right, tolerance):
    free, matched = set(right), 0
    for x in sorted(set(left)):
        near = [v for v in range(x - tolerance, x + tolerance + 1) if v in free]
        if near:
            free.remove(min(near, key=lambda v: (abs(v - x), v)))
            matched += 1
    return matched, len(set(left)) - matched, len(free)


def lines(kind, n, seed=4):
    rng = random.Random(seed)
    if kind == "shifted":  # every left position takes the one that its neighbour wanted
        return list(range(0, n, 2)), list(range(-1, n, 2))
    if kind == "taken":  # a chain that one extra position at the begin shifts to the end
        return [0, *range(0, n)], list(range(-1, n - 1))
    if kind == "same":
        return list(range(n)), list(range(n))
    return sorted(rng.sample(range(-n, n), n)), sorted(rng.sample(range(-n, n), n))


@pytest.mark.parametrize("kind", ["shifted", "taken", "same", "random"])
@pytest.mark.parametrize("tolerance", [0, 1, 2, 7])
def test_blocks_equal_the_sequential_rule(spark, monkeypatch, kind, tolerance):
    monkeypatch.setattr(reports, "MATCH_BLOCK", 8)
    left, right = lines(kind, 1500)
    frame = lambda rows: spark.createDataFrame([("d", int(x)) for x in rows] + [("d", int(rows[0]))], "dataset string, idx bigint").repartition(3)
    got = reports.tolerance_match(frame(left), frame(right), tolerance).collect()
    assert [(r.matched, r.left_only, r.right_only) for r in got] == [sequential(left, right, tolerance)]


def test_one_sided_datasets_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(reports, "MATCH_BLOCK", 4)
    left = spark.createDataFrame([("a", 1), ("a", 400), ("a", 401), ("b", 5)], "dataset string, idx bigint")
    right = spark.createDataFrame([("a", 2), ("a", 401), ("c", 5), ("c", 6)], "dataset string, idx bigint")
    got = {r.dataset: (r.matched, r.left_only, r.right_only) for r in reports.tolerance_match(left, right, 1).collect()}
    assert got == {"a": (2, 1, 0), "b": (0, 1, 0), "c": (0, 0, 2)}
    assert reports.tolerance_match(left.limit(0), right.limit(0), 1).count() == 0


def test_a_dense_island_of_a_million_positions_is_many_tasks(spark):
    n = 1_000_000
    left = spark.range(n).selectExpr("'d' AS dataset", "id AS idx").filter("idx % 3 <> 1")
    right = spark.range(n).selectExpr("'d' AS dataset", "id AS idx").filter("idx % 5 < 3")
    blocks = reports._match_blocks(left, right, 1, reports.MATCH_BLOCK)
    assert blocks.count() == -(-n // reports.MATCH_BLOCK) and blocks.selectExpr("max(size(lefts))").first()[0] <= reports.MATCH_BLOCK
    got = reports.tolerance_match(left, right, 1).first()
    assert (got.matched, got.left_only, got.right_only) == sequential([i for i in range(n) if i % 3 != 1], [i for i in range(n) if i % 5 < 3], 1)
