"""Configurations and strategies as rows, operators by name."""

import pytest
from pyspark.sql import functions as F

from outlane.operators import experiments as E

SCORES = "dataset string, source string, idx bigint, score double"


def test_equal_settings_are_computed_once_and_users_can_register(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(E, "NAMED", {kind: dict(named) for kind, named in E.NAMED.items()})

    @E.register("feature", "ends")
    def ends(rows):
        calls.append("ends")
        return rows.withColumn("vec", F.array(F.element_at("values", 1), F.element_at("values", -1))).drop("values")

    @E.register("score", "first")
    def first(rows, k):
        calls.append("first")
        return rows.withColumn("score", F.element_at("vec", 1) * k)

    rows = spark.createDataFrame([("d", s, i, [float(i), 1.0, float(-i)]) for s in ("TRAIN", "TEST") for i in range(6)], "dataset string, split string, idx bigint, values array<double>")
    configs = spark.createDataFrame([("a", "ends", "none", 0, "first", 2), ("b", "ends", "none", 0, "first", 2), ("c", "ends", "none", 0, "first", 3), ("d", "raw", "none", 0, "centroid", 0)],
                                    "config string, feature string, compression string, width int, score string, k int")
    got = E.config_scores(rows, configs)
    assert calls.count("ends") == 1 and calls.count("first") == 2 and got.count() == 48
    picked = {(r.config, r.idx): r.score for r in got.filter("split = 'TEST' and config <> 'd'").collect()}
    assert picked["a", 5] == picked["b", 5] == 10.0 and picked["c", 5] == 15.0
    rules = spark.createDataFrame([("one", 0.2), ("none", 0.0)], "rule string, rate double")
    truth = spark.createDataFrame([("d", i, int(i > 3)) for i in range(6)], "dataset string, idx bigint, y int")
    swept = {(r.config, r.rule): (r.threshold, r.tp, r.fp, r.fn, r.f1) for r in E.config_sweep(got, rules, truth).collect()}
    assert swept["a", "none"] == (10.0, 0, 0, 2, 0.0) and swept["a", "one"] == (8.0, 1, 0, 1, pytest.approx(2 / 3))
    with pytest.raises(ValueError):
        E.config_scores(rows, configs.withColumn("feature", F.lit("unknown")))
    with pytest.raises(ValueError):
        E.register("model", "x")


def test_rows_of_a_strategy():
    assert E.strategy_rows({"s": ["two 2% max 5", "rocket auto if few"]}) == [("s", 0, "two", 0.02, 5, None, None), ("s", 1, "rocket", None, None, "auto", "few")]
    assert len(E.STRATEGIES) == 41


def test_tiers_caps_and_gates(spark):
    """One dataset where all agree, one where only the images do, one with rocket alone."""
    fired = {"all": {"rocket": [1, 2, 3], "image_a": [1, 2, 3], "image_b": [1, 2, 3]}, "pair": {"rocket": [], "image_a": [4, 5], "image_b": [4, 5]}, "lone": {"rocket": [6, 7, 8], "image_a": [], "image_b": []}}
    rows = [(d, s, i, (10.0 if i in hit else 0.0) + i / 10) for d, by in fired.items() for s, hit in by.items() for i in range(1, 101)]
    scores = spark.createDataFrame(rows, SCORES)
    limits = spark.createDataFrame([(d, s, 11.0 - 1) for d in fired for s in ("rocket", "image_a", "image_b")], "dataset string, source string, threshold double")
    limits = limits.withColumn("threshold", F.lit(10.05))
    sizes = spark.createDataFrame([(d, 100) for d in fired], "dataset string, n bigint")
    exceed = spark.createDataFrame([(d, s, 0.01) for d in fired for s in ("rocket", "image_a", "image_b")], "dataset string, source string, exceed_rate double")
    got = {}
    for r in E.strategy_selections(scores, limits, sizes, exceed, E.strategy_table(spark)).collect():
        got.setdefault(r.strategy, {}).setdefault(r.dataset, set()).add(r.idx)
    assert got["index_2of3"] == {"all": {1, 2, 3}, "pair": {4, 5}}
    assert got["cap_1pct_2of3"] == {"all": {3}, "pair": {5}}
    assert got["rocket_when_any_index_overlap"] == {"all": {1, 2, 3}}
    assert got["imaging_pair_when_rocket_zero"] == {"all": {1, 2, 3}, "pair": {4, 5}, "lone": {6, 7, 8}}
    assert got["guarded_rocket_index_reference"] == {"all": {1, 2, 3}, "lone": {6, 7, 8}}
    assert got["auto_budget_train_exceed_2of3"] == {"all": {2, 3}, "pair": {4, 5}}  # ceil(100 * 0.015) = 2
    assert got["disagreement_guard_rocket_top1pct"] == {"all": {2, 3}, "pair": {4, 5}, "lone": {8}}
    assert got["fallback_adaptive_1to3"]["lone"] == {6, 7, 8} and got["final_operational_v1"]["lone"] == {8}
    assert got["confidence_high_3of3"] == {"all": {2, 3}}
