"""Score normalisation, rank fusion and conformal p-values.

All comparisons with TRAIN are tie-inclusive running counts over one ordering
of the group; TRAIN rows carry weight 1 and TEST rows weight 0, so appending
TEST rows cannot change an earlier result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlane.functions.columns import uniform
from outlane.functions.order import exact_quantiles, has_hot_group, with_cumulative, with_position

ID = ["dataset", "split", "idx"]

# Fusion weights, bonus and the smallest p-value.
RANK_WEIGHTS = {"rocket": 0.5, "image_a": 0.25, "image_b": 0.25}
P_FLOOR = 1e-10


def is_train() -> Column:
    return (F.col("split") == "TRAIN").cast("long")


def percentile_ranks(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Position / (n - 1) in ascending order, ties by index; single row -> 0."""
    placed = with_position(scores, keys, [("score", "asc"), ("idx", "asc")], "_rn")
    n = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_n") > 1, (F.col("_rn") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return placed.join(n, keys).withColumn("rank", share).drop("_rn", "_n")


def repair_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """NaN -> TRAIN median, +-inf -> TRAIN max/min (finite TRAIN scores)."""
    s = F.col("score")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == F.lit(float("inf")))
    fine = scores.filter((F.col("split") == "TRAIN") & ~bad)
    mid = exact_quantiles(fine, keys, "score", {"_mid": 0.5})
    ends = fine.groupBy(*keys).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    fixed = (F.when(s.isNull() | F.isnan(s), F.coalesce("_mid", F.lit(0.0))).when(s == F.lit(float("inf")), F.coalesce("_hi", F.lit(0.0)))
             .when(s == F.lit(float("-inf")), F.coalesce("_lo", F.lit(0.0))).otherwise(s))
    return scores.join(mid, keys, "left").join(ends, keys, "left").withColumn("score", fixed).drop("_mid", "_lo", "_hi")


def train_rank(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Share of TRAIN scores <= s (right-sided); no TRAIN -> 0."""
    cum = with_cumulative(scores, keys, "score", {"_le": is_train()})
    n = scores.groupBy(*keys).agg(F.sum(is_train()).alias("_n"))
    return cum.join(n, keys).withColumn(
        "rank", F.when(F.col("_n") > 0, F.col("_le") / F.col("_n")).otherwise(0.0)).drop("_le", "_n")


def weighted_ranks(ranks: DataFrame, weights: dict[str, float], keys: list[str] = ID) -> DataFrame:
    """Sum of weight x rank over the named sources."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("source") == name, F.lit(value)).otherwise(w)
    return ranks.filter(F.col("source").isin(list(weights))).groupBy(*keys).agg(F.sum(w * F.col("rank")).alias("score"))


def mean_rank(ranks: DataFrame, keys: list[str] = ID) -> DataFrame:
    return ranks.groupBy(*keys).agg(F.avg("rank").alias("score"))


def combine(ranks: DataFrame, exceed: Column, sources: tuple[str, str, str], keys: list[str] = ID) -> DataFrame:
    """The family of combinations of three sources, one aggregation.

    ``exceed`` marks rows above their own source threshold.
    """
    first, second, third = (F.sum(F.when(F.col("source") == s, F.col("rank")).otherwise(0.0)) for s in sources)
    hits = F.sum(exceed.cast("int"))
    bonus = 0.01 * F.avg("rank")
    return ranks.filter(F.col("source").isin(list(sources))).groupBy(*keys).agg(
        F.avg("rank").alias("rank_mean"), F.max("rank").alias("rank_max"), F.min("rank").alias("rank_min"),
        (0.50 * first + 0.35 * second + 0.15 * third).alias("weighted_50_35_15"),
        (0.20 * first + 0.30 * second + 0.50 * third).alias("weighted_20_30_50"),
        (hits + bonus).alias("agreement"), (hits + bonus > 1.5).cast("int").alias("agree_2of3"),
        (hits + bonus > 2.5).cast("int").alias("agree_3of3"))


def rank_levels(ranks: DataFrame) -> DataFrame:
    """Mean rank per source over its variants, and over everything, at once."""
    keyed = ranks.groupBy(*ID, F.col("source")).agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("c"))
    level = F.explode(F.array(F.col("source"), F.lit("all")))
    return keyed.select(*ID, level.alias("level"), "s", "c").groupBy(*ID, "level").agg((F.sum("s") / F.sum("c")).alias("score"))


def combination_grid(ranks: DataFrame, key_sets: dict[str, list[str]]) -> DataFrame:
    """Mean/max/min rank for each named set of sources."""
    sets = F.array(*[F.when(F.col("source").isin(members), F.lit(name)) for name, members in key_sets.items()])
    tagged = ranks.withColumn("key_set", F.explode(F.array_compact(sets)))
    return tagged.groupBy("key_set", *ID).agg(
        F.avg("rank").alias("rank_mean"), F.max("rank").alias("rank_max"), F.min("rank").alias("rank_min"))


def length_routed(rows: DataFrame, length: Column, short: Column, long: Column, limit: int = 150) -> DataFrame:
    return rows.withColumn("score", F.when(length < limit, short).otherwise(long))


# ---- conformal --------------------------------------------------------------

def conformal_p(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(1 + #TRAIN >= s) / (n + 1); no TRAIN or a bad score -> 1."""
    s = F.col("score")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == F.lit(float("inf")))
    counted = with_cumulative(scores, keys, "score", {"_ge": F.when(~bad, is_train()).otherwise(F.lit(0))}, descending=True)
    n = scores.groupBy(*keys).agg(F.sum(F.when(~bad, is_train()).otherwise(0)).alias("_n"))
    p = F.when((F.col("_n") == 0) | bad, 1.0).otherwise((1 + F.col("_ge")) / (F.col("_n") + 1))
    return counted.join(n, keys).withColumn("p", p).drop("_ge", "_n")


def leave_self_out_p(scores: DataFrame, keys: list[str]) -> DataFrame:
    """As above, but a TRAIN row does not count itself."""
    s = F.coalesce(F.when(F.isnan("score"), 0.0).otherwise(F.col("score")), F.lit(0.0))
    safe = F.greatest(F.lit(-1e12), F.least(F.lit(1e12), s))
    counted = with_cumulative(scores.withColumn("_s", safe), keys, "_s", {"_ge": is_train()}, descending=True)
    n = scores.groupBy(*keys).agg(F.sum(is_train()).alias("_n"))
    low = 1 / (F.col("_n") + 1)
    p = (1 + F.greatest(F.lit(0), F.col("_ge") - is_train())) / (F.col("_n") + 1)
    return counted.join(n, keys).withColumn("p", F.least(F.lit(1.0), F.greatest(low, p))).drop("_s", "_ge", "_n")


def fuse_p(pvalues: DataFrame, sources: int, alpha: float, keys: list[str] = ["dataset", "idx"]) -> DataFrame:
    """Bonferroni, Cauchy and Fisher fusion plus the agreement count."""
    p = F.col("p")
    inner = F.greatest(F.lit(P_FLOOR), F.least(F.lit(1 - P_FLOOR), p))
    got = pvalues.groupBy(*keys).agg(
        F.least(F.lit(1.0), sources * F.min("p")).alias("bonferroni_p"),
        F.avg(F.tan((0.5 - inner) * math.pi)).alias("_t"),
        (-F.sum(F.log(F.greatest(F.lit(P_FLOOR), p)))).alias("_half"), F.count_if(p <= alpha).alias("agree"))
    cauchy = F.least(F.lit(1.0), F.greatest(F.lit(P_FLOOR), 0.5 - F.atan("_t") / math.pi))
    # chi-square tail with an even number of degrees of freedom: a finite sum
    series = sum((F.pow(F.col("_half"), F.lit(i)) / math.factorial(i) for i in range(sources)), F.lit(0.0))
    return got.select(*keys, "bonferroni_p", cauchy.alias("cauchy_p"), (F.exp(-F.col("_half")) * series).alias("fisher_p"), "agree")


def select_by_p(fused: DataFrame, method: str, alpha: float) -> DataFrame:
    if method == "agreement":
        return fused.filter("agree >= 2")
    return fused.filter(F.col(f"{method}_p") <= alpha)


def calibration_status(train: DataFrame, least: int = 5) -> DataFrame:
    n = train.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_train"))
    return n.withColumn("status", F.when(F.col("n_train") < least, f"insufficient_calibration_n_train_lt{least}").otherwise("calibrated")) \
            .withColumn("abstain", (F.col("n_train") < least).cast("int"))


def resolution_status(minimum_p: DataFrame, alpha: float, required: int = 2) -> DataFrame:
    """Sources whose smallest attainable p reaches alpha; too few block."""
    ok = F.col("min_p") <= alpha
    got = minimum_p.groupBy("dataset").agg(F.count_if(ok).alias("eligible"), F.collect_set(F.when(ok, F.col("source"))).alias("names"))
    return got.select("dataset", "eligible", F.concat_ws(" ", F.array_sort("names")).alias("eligible_sources"),
                      (F.col("eligible") < required).cast("int").alias("blocked"))


# Prior weight per source.
PRIORS = {"rocket": 0.45, "image_a": 0.275, "image_b": 0.275}


def reliability(train: DataFrame, exceed: DataFrame, repeats: int = 16, seed: str = "boot") -> DataFrame:
    """1 / (1 + tail ratio + bootstrap spread + 25 x exceed), n < 8 -> 0.

    A resample draws positions by hash; draws are counted per position and the
    p95 of a resample is a weighted quantile, so no resample is ever gathered.
    """
    keys = ["dataset", "source"]
    n = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = has_hot_group(train, keys)  # a resample has no more rows than its group
    qs = exact_quantiles(train, keys, "score", {"q25": 0.25, "q75": 0.75, "q90": 0.9, "q95": 0.95}, hot=hot)
    placed = with_position(train, keys, [("score", "asc"), ("idx", "asc")], "_i").hint("merge").join(n, keys)
    draws = placed.select(*keys, "n", "_i", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep"))
    target = F.floor(uniform(seed, F.col("dataset"), F.col("source"), F.col("rep"), F.col("_i")) * F.col("n")) + 1
    # one shuffle for the counts and the join; sizes behind an explode are guessed
    # too small, so that without the hint all draws would be broadcast
    counts = draws.withColumn("_t", target).repartition(*keys, "_t").groupBy(*keys, "rep", "_t").agg(F.count(F.lit(1)).alias("w"))
    drawn = counts.hint("merge").join(placed.select(*keys, F.col("_i").alias("_t"), "score"), keys + ["_t"])
    boot = exact_quantiles(drawn, keys + ["rep"], "score", {"b": 0.95}, "w", hot).groupBy(*keys).agg(F.stddev_pop("b").alias("boot_std"))
    iqr = F.greatest(F.col("q75") - F.col("q25"), F.lit(1e-8))
    tail = F.greatest(F.lit(0.0), F.col("q95") - F.col("q90")) / iqr
    rel = 1 / (1 + tail + F.col("boot_std") / iqr + F.least(F.lit(2.0), 25 * F.col("exceed_rate")))
    joined = n.join(qs, keys).join(boot, keys).join(exceed, keys)
    return joined.select(*keys, F.when(F.col("n") < 8, 0.0).otherwise(rel).alias("reliability"))


def adaptive_weights(rel: DataFrame, priors: dict[str, float] = PRIORS) -> DataFrame:
    """prior x (0.25 + reliability), normalised per dataset."""
    prior = F.lit(0.0)
    for name, value in priors.items():
        prior = F.when(F.col("source") == name, F.lit(value)).otherwise(prior)
    raw = rel.filter(F.col("source").isin(list(priors))).withColumn("raw", prior * (0.25 + F.col("reliability")))
    total = raw.groupBy("dataset").agg(F.sum("raw").alias("total"))
    return raw.join(total, "dataset").select("dataset", "source", (F.col("raw") / F.col("total")).alias("weight"))


def stability_weights(ranks: DataFrame) -> DataFrame:
    """1 / (tail + 0.5 x spread) of TRAIN ranks per source, each at least 0.05."""
    train = ranks.filter("split = 'TRAIN'")
    q = exact_quantiles(train, ["dataset", "source"], "score", {"q50": 0.5, "q75": 0.75, "q25": 0.25, "q95": 0.95})
    tail, spread = F.col("q95") - F.col("q50"), F.col("q75") - F.col("q25")
    low = F.lit(0.05)
    raw = q.withColumn("raw", 1 / (1e-6 + F.greatest(tail, low) + 0.5 * F.greatest(spread, low)))
    total = raw.groupBy("dataset").agg(F.sum("raw").alias("total"))
    return raw.join(total, "dataset").select("dataset", "source", (F.col("raw") / F.col("total")).alias("weight"))


def train_rank_finite(scores: DataFrame, keys: list[str]) -> DataFrame:
    """TRAIN-reference rank that repairs bad scores and counts finite TRAIN."""
    s = F.col("score")
    fine = ~(s.isNull() | F.isnan(s) | (F.abs(s) == F.lit(float("inf"))))
    flagged = scores.withColumn("_w", F.when(fine, is_train()).otherwise(F.lit(0)))
    repaired = repair_scores(flagged, keys)
    cum = with_cumulative(repaired, keys, "score", {"_le": F.col("_w")})
    n = flagged.groupBy(*keys).agg(F.sum("_w").alias("_n"))
    return cum.join(n, keys).withColumn("rank", F.col("_le") / F.greatest(F.lit(1), "_n")).drop("_le", "_n", "_w")
