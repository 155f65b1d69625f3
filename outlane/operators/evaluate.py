"""Evaluation and reporting aggregates.  Labels enter here and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlane.functions.order import exact_quantiles, with_position


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2 * tp + fp + fn)


def confusion(flags: DataFrame, keys: list[str] = ["dataset"], pred="pred", y="y") -> DataFrame:
    """tp/fp/fn, precision, recall and F1 per group; empty sides give 0."""
    p, t = F.col(pred) == 1, F.col(y) == 1
    out = flags.groupBy(*keys).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (out.withColumn("precision", tp / F.greatest(F.lit(1), tp + fp))
            .withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", f1_of(tp, fp, fn)))


def threshold_flags(scores: DataFrame, thresholds: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:
    return scores.join(thresholds, keys).withColumn("pred", (F.col("score") > F.col("threshold")).cast("int"))


def index_flags(truth: DataFrame, selected: DataFrame, keys: list[str] = []) -> DataFrame:
    """Label rows flagged by membership in a selection (set evaluation)."""
    picked = selected.select("dataset", *keys, "idx").distinct().withColumn("hit", F.lit(1))
    return truth.join(picked, ["dataset", *keys, "idx"], "left").withColumn("pred", F.coalesce("hit", F.lit(0))).drop("hit")


def auc_roc(labelled: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:
    """Tie-aware area under ROC from rank sums; one-class groups give 0.5.

    Per distinct score: negatives strictly below plus half of the equal ones.
    """
    steps = labelled.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    cum = with_position(steps, keys, [("score", "asc")], "_rn", {"below": F.col("q")})
    out = cum.groupBy(*keys).agg(
        F.sum(F.col("p") * (F.col("below") - F.col("q") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return out.select(*keys, F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("u") / (F.col("np") * F.col("nq")))
                      .otherwise(0.5).alias("auc_roc"))


def auc_pr(labelled: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:
    """Trapezoid area under precision-recall, one point per distinct score."""
    steps = labelled.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("c"))
    cum = with_position(steps, keys, [("score", "desc")], "rn", {"tp": F.col("p"), "k": F.col("c")})
    total = labelled.groupBy(*keys).agg(F.sum("y").alias("pos"))
    prec = F.col("tp") / F.col("k")
    # the previous point is rebuilt from the running sums; no second window
    before_k, before_tp = F.col("k") - F.col("c"), F.col("tp") - F.col("p")
    before = F.when(before_k > 0, before_tp / before_k).otherwise(1.0)
    area = F.col("p") / F.col("pos") * (prec + before) / 2
    return cum.join(total, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("pos") > 0, area)), F.lit(0.0)).alias("auc_pr"))


def best_k_f1(labelled: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:
    """Best F1 over all cut positions (ties: the later row first)."""
    cum = with_position(labelled, keys, [("score", "desc"), ("idx", "desc")], "k", {"tp": F.col("y")})
    total = labelled.groupBy(*keys).agg(F.sum("y").alias("pos"))
    f1 = F.when(F.col("pos") > 0, 2.0 * F.col("tp") / (F.col("k") + F.col("pos"))).otherwise(0.0)
    return cum.join(total, keys).groupBy(*keys).agg(F.max(f1).alias("best_f1"))


def rank_diagnostics(labelled: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:
    """Where the anomalies stand in the score order."""
    placed = with_position(labelled, keys, [("score", "desc"), ("idx", "asc")], "rank")
    size = labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top_score"))
    hits = placed.filter("y = 1")
    best = hits.groupBy(*keys).agg(F.min("rank").alias("best"), F.max("score").alias("best_anomaly_score"))
    mid = exact_quantiles(hits, keys, "rank", {"median_rank": 0.5})
    out = size.join(best, keys, "left").join(mid, keys, "left")
    out = out.withColumn("best", F.coalesce("best", "n")).withColumn("median_rank", F.coalesce("median_rank", F.col("n").cast("double")))
    out = out.withColumn("best_anomaly_score", F.coalesce("best_anomaly_score", F.lit(0.0)))
    tops = [(F.col("best") <= k).cast("int").alias(f"in_top{k}") for k in (1, 2, 3, 5)]
    return out.select(*keys, "n", F.col("best").alias("best_rank"), "median_rank", (F.col("best") / F.col("n")).alias("best_rank_pct"),
                      *tops, (F.col("best") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))).cast("int").alias("in_top10pct"),
                      "top_score", "best_anomaly_score", (F.col("top_score") - F.col("best_anomaly_score")).alias("top_gap"))


# ---- summaries --------------------------------------------------------------

def quality_summary(detail: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision and macro F1 of per-dataset rows, never mixed."""
    return detail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        (F.sum("tp") / F.greatest(F.lit(1), F.sum(F.col("tp") + F.col("fp")))).alias("micro_precision"),
        F.avg("f1").alias("macro_f1"), F.count_if(F.col("f1") == 0).alias("zero_f1"),
        F.avg("fp").alias("mean_fp"), (100 * F.sum(F.col("tp") + F.col("fp")) / F.count(F.lit(1))).alias("alerts_per_100"))


def config_summary(detail: DataFrame, keys: list[str]) -> DataFrame:
    """Distribution of F1 per configuration plus the mean of family means."""
    spread = exact_quantiles(detail, keys, "f1", {"median_f1": 0.5, "p25_f1": 0.25})
    main = detail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("datasets"), F.avg("f1").alias("mean_f1"), F.count_if(F.col("f1") == 0).alias("zero_f1"),
        F.count_if(F.col("f1") >= 0.5).alias("f1_ge_half"), F.avg("fp").alias("mean_fp"))
    return main.join(spread, keys).join(family_macro(detail, keys), keys)


def family_macro(detail: DataFrame, keys: list[str]) -> DataFrame:
    means = detail.groupBy(*keys, "family").agg(F.avg("f1").alias("m"))
    return means.groupBy(*keys).agg(F.avg("m").alias("family_macro_f1"))


def workload_summary(counts: DataFrame, keys: list[str], col: str = "n") -> DataFrame:
    spread = exact_quantiles(counts, keys, col, {"median": 0.5, "p90": 0.9, "p95": 0.95})
    main = counts.groupBy(*keys).agg(
        F.avg(col).alias("mean"), F.max(col).alias("max"), F.count_if(F.col(col) == 0).alias("zero"),
        F.count_if(F.col(col) >= 5).alias("ge5"), F.count_if(F.col(col) >= 10).alias("ge10"))
    return main.join(spread, keys)
