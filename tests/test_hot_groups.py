"""The split path for hot groups gives the numbers of the plain path."""

import pytest
from pyspark.sql import functions as F

from outlane.functions import order
from outlane.operators import evaluate, fusion, thresholds


@pytest.fixture()
def hot(spark):
    spark.conf.set(order.HOT_ROWS_CONF, "50")
    yield
    spark.conf.unset(order.HOT_ROWS_CONF)


@pytest.fixture()
def skewed(spark):
    """One dataset holds most rows and most of its scores are equal."""
    i = F.col("id")
    return spark.range(3000).select(
        F.when(i % 10 < 7, "big").otherwise(F.concat(F.lit("s"), i % 40)).alias("dataset"), i.alias("idx"),
        F.when(i % 3 == 0, "TEST").otherwise("TRAIN").alias("split"),
        F.when(i % 2 == 0, 1.0).otherwise(F.round(F.sin(i.cast("double")) * 50, 1)).alias("score"), (i % 7 == 0).cast("int").alias("y"))


CASES = {
    "position": lambda df: order.with_position(df, ["dataset"], [("score", "desc"), ("idx", "asc")], "rn", {"c": F.col("y")}).select("dataset", "idx", "rn", "c"),
    "cumulative": lambda df: order.with_cumulative(df, ["dataset"], "score", {"c": F.col("y")}).select("dataset", "idx", "c"),
    "cumulative_desc": lambda df: order.with_cumulative(df, ["dataset"], "score", {"c": F.col("y")}, True).select("dataset", "idx", "c"),
    "quantiles": lambda df: order.exact_quantiles(df, ["dataset"], "score", {"a": 0.1, "b": 0.5, "c": 0.97}),
    "weighted": lambda df: order.exact_quantiles(df.withColumn("w", F.col("idx") % 4), ["dataset"], "score", {"a": 0.3, "b": 0.9}, "w"),
    "cap": lambda df: thresholds.count_cap(df, ["dataset"], 0.05),
    "sweep": lambda df: thresholds.sweep(df, ["dataset"]),
    "conformal": lambda df: fusion.conformal_p(df, ["dataset"]).select("dataset", "idx", "p"),
    "auc": lambda df: evaluate.auc_roc(df),
    "auc_pr": lambda df: evaluate.auc_pr(df),
}


ODD_CASES = {
    "position": lambda df: order.with_position(df, ["dataset"], [("score", "desc"), ("idx", "asc")], "rn").select("dataset", "idx", "rn"),
    "position_asc": lambda df: order.with_position(df, ["dataset"], [("score", "asc"), ("idx", "desc")], "rn").select("dataset", "idx", "rn"),
    "cumulative": lambda df: order.with_cumulative(df, ["dataset"], "score", {"c": F.col("y")}).select("dataset", "idx", "c"),
    "cumulative_desc": lambda df: order.with_cumulative(df, ["dataset"], "score", {"c": F.col("y")}, True).select("dataset", "idx", "c"),
    "conformal": lambda df: fusion.conformal_p(df, ["dataset"]).select("dataset", "idx", "p"),
}


@pytest.mark.parametrize("name", ODD_CASES)
def test_null_nan_and_infinity(spark, skewed, name):
    """Both paths keep every row and agree on where odd values stand."""
    i = F.col("idx") % 11
    odd = skewed.withColumn("score", F.when(i == 0, None).when(i == 1, float("nan")).when(i == 2, float("inf")).when(i == 3, float("-inf")).otherwise(F.col("score")))
    key = lambda df: sorted(map(repr, rounded(df)))
    plain = key(ODD_CASES[name](odd))
    spark.conf.set(order.HOT_ROWS_CONF, "50")
    try:
        split = key(ODD_CASES[name](odd))
    finally:
        spark.conf.unset(order.HOT_ROWS_CONF)
    assert split == plain


def rounded(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in sorted(map(tuple, df.collect()), key=repr)]


@pytest.mark.parametrize("name", CASES)
def test_same_result(spark, skewed, name):
    plain = rounded(CASES[name](skewed))
    spark.conf.set(order.HOT_ROWS_CONF, "50")
    try:
        assert order.has_hot_group(skewed, ["dataset"])
        split = rounded(CASES[name](skewed))
    finally:
        spark.conf.unset(order.HOT_ROWS_CONF)
    assert split == plain


def test_hot_group_is_spread(spark, skewed, hot):
    keyed = skewed.withColumn("_k", F.struct("score", "idx"))
    bounds = order._splits(keyed, ["dataset"]).filter("dataset = 'big'").first()
    assert len(bounds["_bounds"]) > 50


def test_partition_count_does_not_matter(spark, skewed):
    results = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rounded(CASES["conformal"](skewed.repartition(int(n)))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
