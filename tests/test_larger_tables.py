"""What showed on larger copies of the tables only."""

from outlane.functions import order
from outlane.operators import selection, thresholds
from outlane.plans.fusion import reliabilities


def test_draws_are_not_broadcast(spark, tables):
    """Sizes behind an explode are guessed too small."""
    plan = reliabilities(tables)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x and "_t#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_estimates_of_many_digits(spark):
    """estimates multiply at every join."""
    from outlane.session import stage

    df = spark.range(0, 1, 1, 1)
    for _ in range(14):
        df = stage(df.crossJoin(df.withColumnRenamed("id", "other")).coalesce(1)).select("id")
    assert order._scanned_bytes(df) > order.SMALL_INPUT_BYTES


def test_gaps_that_rounding_tells_apart(spark):
    """of gaps of 0.1 the last one among the upper three is the cut."""
    scores = [0.4, 0.3, 0.2, 0.1] + [0.05] * 16
    test = spark.createDataFrame([("a", i, s) for i, s in enumerate(scores)], "dataset string, idx long, score double")
    assert sorted(r.idx for r in selection.tail_gap(test).collect()) == [0, 1, 2]


def test_threshold_of_equal_scores(spark):
    """between equal scores a quantile is that score."""
    rows = [(f"{v}|{n}", i, v) for v in (29.27, 122.79, 2.11) for n in range(2, 41) for i in range(n)]
    train = spark.createDataFrame(rows, "dataset string, idx long, score double")
    got = thresholds.sweep(train, ["dataset"], (("q5", "quantile", 0.05), ("q10", "quantile", 0.1)))
    assert all(r.threshold == float(r.dataset.split("|")[0]) for r in got.collect())
    even = spark.createDataFrame([("a", i, float(i)) for i in range(21)], "dataset string, idx long, score double")
    found = {r.rule: r.threshold for r in thresholds.sweep(even, ["dataset"], (("q5", "quantile", 0.05), ("half", "quantile", 0.125), ("cap", "cap", 3))).collect()}
    assert found == {"q5": 19.0, "half": 17.5, "cap": 17.0}


def test_wide_results_are_made_in_slices(spark):
    """A worker makes few results at a time."""
    import numpy as np
    from outlane.operators.prep import SLICE, array_udf

    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "transform(sequence(0, id % 3), x -> double(id + x)) AS values")
    got = rows.select("id", array_udf(lambda x: np.stack([np.full(len(x), len(x)), x.sum(axis=1)], axis=1), "values").alias("r")).collect()
    assert len(got) == 1000 and max(r.r[0] for r in got) <= SLICE
    assert all(r.r[1] == sum(r.id + x for x in range(r.id % 3 + 1)) for r in got)


def test_smoothing_costs_no_call_of_python_for_each_dataset(spark, monkeypatch):
    """many small datasets; a null score makes the average null from there on."""
    from outlane.streaming import online

    scores = spark.range(0, 300, 1, 2).selectExpr("concat('u', id % 30) AS dataset", "id div 30 AS idx", "CASE WHEN id = 150 THEN NULL ELSE double(id) END AS score")
    begins = scores.select("dataset").distinct().selectExpr("dataset", "2D AS x")
    with monkeypatch.context() as patch:
        patch.setattr(online, "stage", lambda df: df)
        plan = online.smoothed(scores, begins)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
    got = {(r.dataset, r.idx): r.ema for r in online.smoothed(scores, begins, 4).collect()}
    for u in range(30):
        x = 2.0
        for i in range(10):
            x = None if x is None or (u, i) == (0, 5) else 0.15 * (30 * i + u) + 0.85 * x
            assert got[f"u{u}", i] == x or abs(got[f"u{u}", i] - x) < 1e-9


def test_rounds_of_the_kde_hold_no_memory_at_once(spark):
    """joins that are no broadcasts had all rounds in the tasks of one stage."""
    rows = [(f"u{i % 7}", i // 7, float(i * 37 % 101)) for i in range(700)]
    train = spark.createDataFrame(rows, "dataset string, idx long, score double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = thresholds.kde(train, ["dataset"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") <= 2 and "Generate" not in plan
