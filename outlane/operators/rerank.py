"""Reranking of weak alerts, review picks and lane routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlane.functions.order import with_position
from outlane.operators.selection import intersect, minus, union

# Rank depth, support bonus and source weights of the reranker.
MAX_RANK = 12
SUPPORT_BONUS = 0.08
WEIGHTS = {"rocket": 0.36, "image_a": 0.22, "image_b": 0.22, "multi_fg": 0.12, "multi_cap": 0.08}

# (column, direction) order of candidates, best first.
BEST_FIRST = [("score", "desc"), ("support", "desc"), ("best_rank", "asc"), ("rank_sum", "asc"), ("idx", "asc")]


def rank_map(scores: DataFrame, depth: int = MAX_RANK) -> DataFrame:
    """(dataset, source, idx, rank) of the best rows per source."""
    return with_position(scores, ["dataset", "source"], [("score", "desc"), ("idx", "asc")], "rank").filter(F.col("rank") <= depth)


def guard_orders(ranks: DataFrame, exceed: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Drop the order of a source whose TRAIN exceed rate is above its limit."""
    limit = F.lit(None).cast("double")
    for source, value in limits.items():
        limit = F.when(F.col("source") == source, value).otherwise(limit)
    safe = exceed.filter((F.col("exceed_rate") <= limit) | limit.isNull()).select("dataset", "source")
    return ranks.join(safe, ["dataset", "source"], "left_semi")


def score_candidates(candidates: DataFrame, ranks: DataFrame, weights: dict[str, float] = WEIGHTS,
                     depth: int = MAX_RANK) -> DataFrame:
    """Weighted closeness to the top, support, best rank and rank sum."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("source") == name, value).otherwise(w)
    found = candidates.select("dataset", "idx").distinct().join(ranks.filter(F.col("rank") <= depth), ["dataset", "idx"], "left")
    got = found.groupBy("dataset", "idx").agg(
        F.coalesce(F.sum(w * (depth + 1 - F.col("rank")) / depth), F.lit(0.0)).alias("w"), F.count("rank").alias("support"),
        F.coalesce(F.min("rank"), F.lit(depth + 1)).alias("best_rank"), F.coalesce(F.sum("rank"), F.lit(999)).alias("rank_sum"))
    bonus = SUPPORT_BONUS * F.greatest(F.lit(0), F.col("support") - 1)
    return got.select("dataset", "idx", F.round(F.col("w") + bonus, 9).alias("score"), "support", "best_rank", "rank_sum")


def candidate_order(scored: DataFrame) -> DataFrame:
    return with_position(scored, ["dataset"], BEST_FIRST, "place")


def weak_base(base: DataFrame, scored: DataFrame, max_support: int = 1, min_best_rank: int = 6,
              max_score: float | None = None) -> DataFrame:
    """Alerts with little support and no high rank."""
    info = base.select("dataset", "idx").join(scored, ["dataset", "idx"], "left")
    weak = (F.coalesce("support", F.lit(0)) <= max_support) & (F.coalesce("best_rank", F.lit(99)) >= min_best_rank)
    if max_score is not None:
        weak = weak & (F.coalesce("score", F.lit(0.0)) <= max_score)
    return info.filter(weak).select("dataset", "idx")


def best_outside(scored: DataFrame, base: DataFrame, min_support: int = 0, max_best_rank: int = 99,
                 min_gain: float | None = None) -> DataFrame:
    """Best candidate outside the base set with its gain over the base."""
    base_best = base.select("dataset", "idx").join(scored, ["dataset", "idx"]).groupBy("dataset").agg(F.max("score").alias("base_best"))
    outside = minus(scored, base).join(base_best, "dataset", "left").withColumn(
        "gain", F.round(F.col("score") - F.coalesce("base_best", F.lit(0.0)), 9))
    ok = (F.col("support") >= min_support) & (F.col("best_rank") <= max_best_rank)
    if min_gain is not None:
        ok = ok & (F.col("gain") >= min_gain)
    key = F.struct(-F.col("score"), -F.col("support"), F.col("best_rank"), F.col("rank_sum"), F.col("idx"))
    picked = outside.filter(ok).groupBy("dataset").agg(
        F.min_by(F.struct("idx", "score", "support", "best_rank", "gain"), key).alias("c"))
    return picked.select("dataset", "c.*")


def replace_weak(base: DataFrame, scored: DataFrame, train_counts: DataFrame, names: DataFrame,
                 tiny: int = 10, min_support: int = 2, max_best_rank: int = 3, min_gain: float = 0.04) -> DataFrame:
    """Swap weak sparse alerts for the consensus candidate.

    Returns one row per dataset with the decision and its diagnostics; see
    ``apply_replacement`` for the rows.
    """
    n_base = base.groupBy("dataset").agg(F.count(F.lit(1)).alias("base_n"))
    n_weak = weak_base(base, scored).groupBy("dataset").agg(F.count(F.lit(1)).alias("weak_n"))
    top = best_outside(scored, base)
    got = names.join(n_base, "dataset", "left").join(n_weak, "dataset", "left").join(top, "dataset", "left").join(
        train_counts, "dataset", "left").fillna(0, ["base_n", "weak_n", "n_train"])
    ok = ((F.col("n_train") > tiny) & (F.col("base_n") <= 1) & (F.col("weak_n") > 0) & (F.col("support") >= min_support)
          & (F.col("best_rank") <= max_best_rank) & (F.col("gain") >= min_gain))
    return got.select("dataset", F.col("idx").alias("top_candidate"), "support", "best_rank", "gain",
                      F.coalesce(ok, F.lit(False)).cast("int").alias("replaced"))


def apply_replacement(base: DataFrame, scored: DataFrame, decision: DataFrame) -> DataFrame:
    done = decision.filter("replaced = 1")
    dropped = intersect(weak_base(base, scored).join(done.select("dataset"), "dataset", "left_semi"), base)
    return union(minus(base, dropped), done.select("dataset", F.col("top_candidate").alias("idx")))


def pick_review(scored: DataFrame, hard: DataFrame, limit: int, min_support: int, max_best_rank: int, min_score: float) -> DataFrame:
    """The best non-hard candidates that pass all limits."""
    ok = (F.col("support") >= min_support) & (F.col("best_rank") <= max_best_rank) & (F.col("score") >= min_score)
    return candidate_order(minus(scored, hard).filter(ok)).filter(F.col("place") <= limit)


def weighted_candidates(ranks: DataFrame, weights: DataFrame, depth: int = MAX_RANK) -> DataFrame:
    """Candidate scores with a weight per dataset and source."""
    got = ranks.join(weights, ["dataset", "source"]).groupBy("dataset", "idx").agg(
        F.round(F.sum(F.col("weight") * (depth + 1 - F.col("rank")) / depth), 9).alias("score"),
        F.count(F.lit(1)).alias("support"), F.min("rank").alias("best_rank"), F.sum("rank").alias("rank_sum"))
    return got


def budgeted_consensus(scored: DataFrame, base: DataFrame, allowance: DataFrame, min_support: int = 2) -> DataFrame:
    """Base rows plus the best supported new rows within a per-dataset budget."""
    fresh = candidate_order(minus(scored.filter(F.col("support") >= min_support), base)).join(allowance, "dataset")
    return union(base, fresh.filter(F.col("place") <= F.col("budget")))


def independent_review(ranks: DataFrame, hard: DataFrame, main: str, max_rank: int, other_rank: int, min_other: int) -> DataFrame:
    """Best row of the main source with enough other sources behind it."""
    other = F.count_if((F.col("source") != main) & (F.col("rank") <= other_rank))
    own = F.min(F.when(F.col("source") == main, F.col("rank")))
    got = minus(ranks, hard).groupBy("dataset", "idx").agg(own.alias("own"), other.alias("other"))
    ok = got.filter((F.col("own") <= max_rank) & (F.col("other") >= min_other))
    return ok.groupBy("dataset").agg(F.min_by("idx", F.struct("own", "idx")).alias("idx"))


# ---- block evidence ---------------------------------------------------------

def block_review(a: DataFrame, b: DataFrame, hard: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Rows both blocks exceed and nobody alerts; the best by block B.

    ``b`` carries its score; ``calibrated`` lists datasets with enough TRAIN.
    """
    both = minus(intersect(b, a), hard).join(calibrated, "dataset", "left_semi")
    return both.groupBy("dataset").agg(F.max_by("idx", F.struct("score", -F.col("idx"))).alias("idx"))


def joint_exceed(train_a: DataFrame, train_b: DataFrame) -> DataFrame:
    """TRAIN rows that both blocks alert."""
    return intersect(train_a, train_b).groupBy("dataset").agg(F.count(F.lit(1)).alias("joint_exceed"))


def confirm_priority(review: DataFrame, high: DataFrame, standard: DataFrame, block_c: DataFrame) -> DataFrame:
    """Review rows become priority when the dataset has no high lane, some
    standard lane, and block C confirms the row."""
    quiet = review.join(high.select("dataset").distinct(), "dataset", "left_anti").join(
        standard.select("dataset").distinct(), "dataset", "left_semi")
    return intersect(quiet, block_c)


def confidence_tiers(hard: DataFrame, block_b: DataFrame) -> DataFrame:
    """Hard rows split by block-B support."""
    flag = block_b.select("dataset", "idx").distinct().withColumn("b", F.lit(1))
    return hard.select("dataset", "idx").join(flag, ["dataset", "idx"], "left").select(
        "dataset", "idx", F.when(F.col("b") == 1, "high").otherwise("standard").alias("tier"))


def weak_signal(rows: DataFrame) -> DataFrame:
    """Datasets whose alert evidence is thin enough to be reviewed."""
    return rows.filter((F.col("predicted") <= 1) & (F.col("exceed_rate") <= 0.015) & (F.col("max_exceed_rate") <= 0.015)
                       & (F.col("support") >= 4) & (F.col("gain") <= 0.30))


def agreement_guard(candidates: DataFrame, *context: DataFrame) -> DataFrame:
    """Datasets whose candidate set touches hard, review or top rows."""
    return intersect(candidates, union(*context)).select("dataset").distinct()


def gated_review(sources: list[DataFrame], gate: DataFrame, context: DataFrame, cap: int) -> DataFrame:
    """Ordered union of source candidates for gated datasets, capped.

    Earlier sources come first; a row keeps its best place.
    """
    rows = None
    for i, source in enumerate(sources):
        part = source.join(gate, "dataset", "left_semi").join(
            agreement_guard(source, context), "dataset", "left_semi").select(
            "dataset", "idx", F.struct(F.lit(i).alias("list"), F.col("rank").alias("at")).alias("o"))
        rows = part if rows is None else rows.unionByName(part)
    flat = rows.groupBy("dataset", "idx").agg(F.min("o").alias("o")).select(
        "dataset", "idx", F.col("o.list").alias("list"), F.col("o.at").alias("at"))
    return with_position(flat, ["dataset"], [("list", "asc"), ("at", "asc"), ("idx", "asc")], "place").filter(F.col("place") <= cap)


def review_policies(hard: DataFrame, review: DataFrame) -> DataFrame:
    """hard only / top1 / top2 / top3: one row set per policy."""
    levels = F.explode(F.array([F.struct(F.lit(n).alias("policy"), F.lit(k).alias("k"))
                                for n, k in (("hard_only", 0), ("top1", 1), ("top2", 2), ("top3", 3))]))
    h = hard.select("dataset", "idx", F.lit(0).alias("place"), levels.alias("p"))
    r = review.select("dataset", "idx", "place", levels.alias("p")).filter(F.col("place") <= F.col("p.k"))
    both = h.unionByName(r)
    return both.groupBy(F.col("p.policy").alias("policy"), "dataset", "idx").agg(F.min("place").alias("place")).select(
        "policy", "dataset", "idx", (F.col("place") > 0).cast("int").alias("review"))


# ---- lanes ------------------------------------------------------------------

LANES = ("hard", "standard_review", "priority_review")


def _flag(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("dataset", "idx").distinct().withColumn(name, F.lit(1))


def route(high: DataFrame, standard: DataFrame, priority: DataFrame, sizes: DataFrame) -> DataFrame:
    """hard > standard > priority; an index outside the TEST set is an error."""
    all_rows = _flag(high, "h").join(_flag(standard, "s"), ["dataset", "idx"], "full_outer").join(
        _flag(priority, "p"), ["dataset", "idx"], "full_outer").join(sizes, "dataset")
    lane = F.when(F.col("h") == 1, "hard").when(F.col("s") == 1, "standard_review").otherwise("priority_review")
    inside = F.assert_true((F.col("idx") >= 0) & (F.col("idx") < F.col("n")), F.lit("index outside the TEST set"))
    return all_rows.filter(inside.isNull()).select("dataset", "idx", lane.alias("lane"))


def route_by_evidence(candidates: DataFrame, block_b: DataFrame, block_c: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Every TEST row gets a lane: B confirms hard, C priority, rest standard."""
    flags = _flag(candidates, "c").join(_flag(block_b, "b"), ["dataset", "idx"], "left").join(
        _flag(block_c, "x"), ["dataset", "idx"], "left")
    lane = (F.when(F.col("c").isNull(), "none").when(F.col("b") == 1, "hard").when(F.col("x") == 1, "priority_review")
            .otherwise("standard_review"))
    return test_rows.select("dataset", "idx").join(flags, ["dataset", "idx"], "left").select("dataset", "idx", lane.alias("lane"))


def family_fold(family: Column | str, folds: int = 5) -> Column:
    """SHA-256 of the family name modulo the fold count (first 64 bits)."""
    return (F.conv(F.substring(F.sha2(family, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(folds)).cast("int")
