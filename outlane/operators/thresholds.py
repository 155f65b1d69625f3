"""Thresholds from TRAIN scores alone.

Every operator takes TRAIN scores with group keys and returns one row per group
(and rule) with a ``threshold``; alerts are strictly above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlane.functions.columns import normal_cdf, normal_quantile_value
from outlane.functions.order import exact_quantiles, has_hot_group, with_cumulative, with_position
from outlane.session import stage


def finite(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    return scores.filter(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf"))))


def empirical(train: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The linear (1 - q) quantile."""
    return exact_quantiles(train, keys, "score", {"threshold": 1 - q})


def count_cap(train: DataFrame, keys: list[str], rate: float | Column) -> DataFrame:
    """The (cap + 1)-th largest TRAIN score, cap = floor(rate * n) < n."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    kept = finite(train).withColumn("_id", F.col("idx"))
    placed = with_position(kept, keys, [("score", "desc"), ("_id", "asc")], "_rn")
    n = train.transform(finite).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    cap = F.greatest(F.lit(0), F.least(F.floor(rate * F.col("n")), F.col("n") - 1))
    caps = n.withColumn("cap", cap.cast("bigint"))
    # the hint: scores behind an explode are guessed too small and would be broadcast
    return placed.hint("merge").join(caps, keys).filter(F.col("_rn") == F.col("cap") + 1).select(
        *keys, F.col("score").alias("threshold"), "cap", "n", (F.col("cap") / F.greatest(F.lit(1), "n")).alias("q_effective"))


# Threshold rules of the sweep as (name, kind, parameter).
SWEEP_RULES = (
    ("quantile_0p5", "quantile", 0.005), ("quantile_1", "quantile", 0.01), ("quantile_2", "quantile", 0.02),
    ("quantile_3", "quantile", 0.03), ("quantile_5", "quantile", 0.05),
    ("cap_0", "cap", 0), ("cap_1", "cap", 1), ("cap_2", "cap", 2), ("cap_3", "cap", 3),
    ("cap_1pct", "rate", 0.01), ("cap_2pct", "rate", 0.02), ("cap_3pct", "rate", 0.03), ("cap_5pct", "rate", 0.05))


def sweep(train: DataFrame, keys: list[str], rules=SWEEP_RULES) -> DataFrame:
    """All rules at once: one ordering, then each rule picks its positions.

    A rule is a pair of neighbouring order statistics and a weight, so the
    sorted scores are read once for any number of rules.  Equal neighbours give
    their own value, so a score that ties with them is not above it.
    """
    kept = finite(train)
    placed = with_position(kept, keys, [("score", "desc"), ("idx", "asc")], "_rn")
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")

    def position(kind: str, value) -> Column:
        if kind == "quantile":
            return (n - 1) * F.lit(1 - float(value))
        cap = F.lit(int(value)) if kind == "cap" else F.floor(F.lit(float(value)) * n)
        return (n - 1 - F.greatest(F.lit(0), F.least(cap, n - 1))).cast("double")

    # positions count from the lowest score, rows are numbered from the highest
    table = F.array(*[F.struct(F.lit(r).alias("rule"), position(k, v).alias("pos")) for r, k, v in rules])
    wanted = sizes.select(*keys, "n", F.explode(table).alias("r")).select(*keys, "n", "r.rule", "r.pos")
    ends = wanted.select(*keys, "rule", "pos", (n - 1 - F.floor("pos")).alias("low"), (n - 1 - F.ceil("pos")).alias("high"))
    ends = ends.select("*", F.explode(F.array_distinct(F.array("low", "high"))).alias("at"))
    hit = ends.join(placed.select(*keys, (F.col("_rn") - 1).alias("at"), "score"), keys + ["at"])
    found = hit.groupBy(*keys, "rule").agg(
        F.max(F.when(F.col("at") == F.col("low"), F.col("score"))).alias("_low"),
        F.max(F.when(F.col("at") == F.col("high"), F.col("score"))).alias("_high"), F.max(F.col("pos") - F.floor("pos")).alias("_share"))
    return found.select(*keys, "rule", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("threshold"))


def dynamic_q(n_test) -> Column:
    return F.greatest(F.lit(0.001), 1 / F.greatest(F.lit(1), n_test))


def rate_policy(method: str, n_test="n_test", median_len="median_len", family="family",
                weak_families: tuple[str, ...] = ()) -> Column:
    """Alert rate of a threshold method as a column over the catalog."""
    length, n = F.col(median_len), F.col(n_test)
    if method.startswith("count_cap_") and method.endswith("pct"):
        return F.lit(float(method[len("count_cap_"):-len("pct")]) / 100)
    if method == "dynamic_1_over_n":
        return dynamic_q(n)
    if method == "adaptive_v0":
        return F.when((n > 50) & ~length.between(513, 1024), 0.03).otherwise(0.02)
    if method == "family_guard_v1":
        return F.when(F.col(family).isin(list(weak_families)) | (length >= 512), 0.03).otherwise(0.02)
    raise ValueError(f"unknown rate policy {method}")


# ---- fitted tails -----------------------------------------------------------

def _moments(train: DataFrame, keys: list[str]) -> DataFrame:
    """n, min, mean, population deviation, biased skew, and log moments."""
    kept = finite(train)
    low = kept.groupBy(*keys).agg(F.min("score").alias("low"), F.avg("score").alias("mean"),
                                  F.stddev_pop("score").alias("std"), F.skewness("score").alias("skew"),
                                  F.count(F.lit(1)).alias("n"))
    shifted = F.col("score") - F.col("low") + 1e-6
    logs = kept.join(low, keys).groupBy(*keys).agg(
        F.avg(F.log(shifted)).alias("ln_mean"), F.stddev_pop(F.log(shifted)).alias("ln_std"),
        F.avg(shifted).alias("shift_mean"))
    return low.join(logs, keys)


def gamma_quantile(mean: Column, ln_mean: Column, p: float) -> Column:
    """Gamma quantile: closed-form shape estimate, Wilson-Hilferty quantile.

    The shape is within 1.5 % of the likelihood estimate; the quantile is within
    1 % for shapes above 0.5.
    """
    s = F.log(mean) - ln_mean
    shape = (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)
    z = normal_quantile_value(p)
    cube = 1 - 1 / (9 * shape) + z / (3 * F.sqrt(shape))
    return mean * cube * cube * cube


def skew_adaptive(train: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Log-normal for strong skew, normal for none, gamma between."""
    z = normal_quantile_value(1 - q)
    fits = _moments(train, keys).join(empirical(train, keys, q).withColumnRenamed("threshold", "fallback"), keys)
    lognormal = F.exp(F.col("ln_mean") + z * F.col("ln_std")) + F.col("low") - 1e-6
    normal = F.col("mean") + z * F.col("std")
    gamma = gamma_quantile(F.col("shift_mean"), F.col("ln_mean"), 1 - q) + F.col("low") - 1e-6
    flat = (F.col("std") == 0) | F.isnan("skew") | F.col("skew").isNull()
    fitted = F.when(flat, F.col("fallback")).when(F.col("skew") > 1.2, lognormal).when(F.col("skew") < 0.2, normal).otherwise(gamma)
    return fits.select(*keys, _finite_or(fitted, F.col("fallback")).alias("threshold"), "skew")


def _finite_or(value: Column, other: Column) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, other).otherwise(value)


def tail_fit(train: DataFrame, keys: list[str], tail: float) -> DataFrame:
    """Generalised Pareto fit of the excesses by probability-weighted moments."""
    base = exact_quantiles(finite(train), keys, "score", {"base": tail})
    n = finite(train).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    over = finite(train).join(base, keys).filter("score > base").withColumn("excess", F.col("score") - F.col("base"))
    placed = with_position(over, keys, [("excess", "asc"), ("idx", "asc")], "_i")
    total = over.groupBy(*keys).agg(F.count(F.lit(1)).alias("nt"))
    joined = placed.join(total, keys)
    # weight of the i-th smallest excess: share of the sample above it
    above = (F.col("nt") - F.col("_i")) / F.greatest(F.lit(1), F.col("nt") - 1)
    fit = joined.groupBy(*keys).agg(F.max("nt").alias("nt"), F.avg("excess").alias("b0"), F.avg(F.col("excess") * above).alias("a1"))
    return base.join(n, keys).join(fit, keys, "left")


def _tail_quantile(p: Column) -> Column:
    b0, a1 = F.col("b0"), F.col("a1")
    k = b0 / (b0 - 2 * a1) - 2
    sigma = 2 * b0 * a1 / (b0 - 2 * a1)
    return F.when(F.abs(k) < 1e-9, -sigma * F.log(1 - p)).otherwise(sigma / k * (1 - F.pow(1 - p, k)))


def peaks_over_threshold(train: DataFrame, keys: list[str], q: float, tail: float = 0.9) -> DataFrame:
    """Tail quantile above p90/p95; ten excesses or fewer fall back."""
    fit = tail_fit(train, keys, tail).join(
        skew_adaptive(train, keys, q).select(*keys, F.col("threshold").alias("adaptive")), keys)
    p = F.least(F.lit(0.9999), F.greatest(F.lit(0.9), 1 - q * F.col("n") / F.col("nt")))
    value = F.when(F.coalesce("nt", F.lit(0)) > 10, F.col("base") + _tail_quantile(p))
    return fit.select(*keys, _finite_or(value, F.col("adaptive")).alias("threshold"), F.coalesce("nt", F.lit(0)).alias("excesses"))


def fixed_tail(train: DataFrame, keys: list[str], q: float = 0.02) -> DataFrame:
    """The older variant with its own clipping and a named fallback."""
    fit = tail_fit(train, keys, 0.9).join(
        skew_adaptive(train, keys, q).select(*keys, F.col("threshold").alias("adaptive")), keys)
    raw = 1 - q * F.col("n") / F.col("nt")
    p = F.when(raw < 0, 0.98).when(raw >= 1, 0.999).otherwise(raw)
    value = F.when(F.coalesce("nt", F.lit(0)) > 10, F.col("base") + _tail_quantile(p))
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return fit.select(*keys, F.when(ok, value).otherwise(F.col("adaptive")).alias("threshold"),
                      F.when(ok, "evt_gpd").otherwise("adaptive_fallback").alias("method"))


# Fixed value: the Euler-Mascheroni constant.
EULER = 0.5772156649015329


def block_maxima(train: DataFrame, keys: list[str], block: int = 20, least: int = 5) -> DataFrame:
    """Maxima of consecutive blocks; fewer than five blocks keep raw scores."""
    kept = finite(train)
    n = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    tagged = kept.join(n, keys).withColumn(
        "block", F.when(F.floor(F.col("n") / block) >= least, F.floor(F.col("idx") / block)).otherwise(F.col("idx")))
    return tagged.groupBy(*keys, "block").agg(F.max("score").alias("m"))


def block_tail(train: DataFrame, keys: list[str], p: float = 0.98) -> DataFrame:
    """Gumbel by moments and Weibull by log moments of block maxima."""
    fit = block_maxima(train, keys).groupBy(*keys).agg(
        F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"),
        F.avg(F.log(F.greatest(F.col("m"), F.lit(1e-9)))).alias("ln_mean"),
        F.stddev_pop(F.log(F.greatest(F.col("m"), F.lit(1e-9)))).alias("ln_std"))
    import math
    scale = F.col("std") * math.sqrt(6) / math.pi
    gumbel = F.col("mean") - EULER * scale - scale * math.log(-math.log(p))
    shape = math.pi / (F.col("ln_std") * math.sqrt(6))
    weibull = F.exp(F.col("ln_mean") + EULER / shape) * F.pow(F.lit(-math.log(1 - p)), 1 / shape)
    return fit.select(*keys, gumbel.alias("gumbel"), F.when(F.col("ln_std") > 0, weibull).otherwise(F.col("mean")).alias("weibull"))


def lognormal(train: DataFrame, keys: list[str], q: float = 0.02) -> DataFrame:
    """Log-normal quantile of the positive scores; shifted when fewer than 5."""
    z = normal_quantile_value(1 - q)
    ln = lambda c: F.log(F.when(c > 0, c))
    fit = train.groupBy(*keys).agg(
        F.count_if(F.col("score") > 0).alias("pos"), F.avg(ln(F.col("score"))).alias("m"), F.stddev_pop(ln(F.col("score"))).alias("s"),
        F.avg(ln(F.col("score") + 1e-8)).alias("m2"), F.stddev_pop(ln(F.col("score") + 1e-8)).alias("s2"))
    m, s = (F.when(F.col("pos") >= 5, F.col(a)).otherwise(F.col(b)) for a, b in (("m", "m2"), ("s", "s2")))
    return fit.join(empirical(train, keys, q).withColumnRenamed("threshold", "fallback"), keys).select(
        *keys, _finite_or(F.exp(m + z * s), F.col("fallback")).alias("threshold"))


KDE_GRID = 1000
KDE_STRIDES = (100, 10, 1)
#: Scores of a task: each is eleven rows for a while, which sizes of shuffles do not show.
KDE_ROWS = 50_000


def kde(train: DataFrame, keys: list[str], q: float = 0.02) -> DataFrame:
    """First point of a 1000-point grid on [min, 2 max] with KDE mass >= 1 - q.

    The mass is monotone, so three rounds of eleven points (strides 100, 10, 1)
    find the crossing: three aggregations instead of a grid-by-score product.
    """
    dealt = train.select(*keys, "score")
    if not has_hot_group(dealt, keys):  # a hot group is left to skew handling
        dealt = dealt.repartition(max(1, -(-dealt.count() // KDE_ROWS)), *keys)
    dealt = stage(dealt)
    fit = dealt.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"),
                                   (F.stddev_samp("score") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h"))
    grid = lambda i: F.col("lo") + (2 * F.col("hi") - F.col("lo")) * i / (KDE_GRID - 1)
    below = lambda x: F.avg(normal_cdf((x - F.col("score")) / F.col("h")))
    # the hint: scores are many however they are guessed; it keeps their parts
    rows = stage(dealt.hint("merge").join(fit, keys))  # read once per round
    # rounds are written out: sorts and aggregations of one task would all hold memory at once
    bracket = stage(rows.groupBy(*keys).agg(below(F.col("lo")).alias("floor")).withColumn("start", F.lit(0)))
    for stride in KDE_STRIDES:
        # eleven points per score exist only until the map-side average
        points = rows.hint("merge").join(bracket, keys).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(10))))
        x = grid(F.least(F.col("start") + F.col("j") * stride, F.lit(KDE_GRID - 1)))
        mass = points.groupBy(*keys, "start", "floor", "j").agg(below(x).alias("m"))
        reached = F.min(F.when(F.col("m") - F.col("floor") >= 1 - q, F.col("j")))
        hit = reached if stride == 1 else F.greatest(reached - 1, F.lit(0))
        at = F.when(hit.isNotNull(), F.least(F.col("start") + hit * stride, F.lit(KDE_GRID - 1)))
        bracket = stage(mass.groupBy(*keys, "start", "floor").agg(at.alias("_at")).select(
            *keys, "floor", F.col("_at").alias("start")))
    limits = rows.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    out = bracket.join(limits, keys).join(empirical(rows, keys, q).withColumnRenamed("threshold", "fallback"), keys)
    return out.select(*keys, _finite_or(grid(F.col("start")), F.col("fallback")).alias("threshold"))


def ks_statistic(train: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of positive scores to their log-normal fit, asymptotic p."""
    pos = train.filter("score > 0")
    fit = pos.groupBy(*keys).agg(F.avg(F.log("score")).alias("m"), F.stddev_pop(F.log("score")).alias("s"), F.count(F.lit(1)).alias("n"))
    placed = with_position(pos, keys, [("score", "asc"), ("idx", "asc")], "_i").join(fit, keys)
    cdf = normal_cdf((F.log("score") - F.col("m")) / F.col("s"))
    gap = F.greatest(F.col("_i") / F.col("n") - cdf, cdf - (F.col("_i") - 1) / F.col("n"))
    d = placed.groupBy(*keys).agg(F.max(gap).alias("d"), F.max("n").alias("n"))
    lam2 = F.col("n") * F.col("d") * F.col("d")
    series = sum(((-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam2) for k in range(1, 9))
    return d.select(*keys, "n", "d", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)).alias("p"))


def ks_gated(train: DataFrame, keys: list[str], q: float = 0.02) -> DataFrame:
    """Log-normal when the fit is not rejected at 5 %, otherwise KDE."""
    a = lognormal(train, keys, q).withColumnRenamed("threshold", "ln_t")
    b = kde(train, keys, q).withColumnRenamed("threshold", "kde_t")
    both = a.join(b, keys).join(ks_statistic(train, keys), keys, "left")
    use_ln = (F.coalesce("n", F.lit(0)) >= 10) & (F.coalesce("p", F.lit(0.0)) >= 0.05)
    return both.select(*keys, F.when(use_ln, F.col("ln_t")).otherwise(F.col("kde_t")).alias("threshold"),
                       F.when(use_ln, "lognormal").otherwise("kde").alias("method"))


def size_hybrid(train: DataFrame, keys: list[str], q: float = 0.02, small: int = 100) -> DataFrame:
    n = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = n.join(lognormal(train, keys, q).withColumnRenamed("threshold", "ln_t"), keys).join(
        kde(train, keys, q).withColumnRenamed("threshold", "kde_t"), keys)
    return both.select(*keys, F.when(F.col("n") < small, F.col("kde_t")).otherwise(F.col("ln_t")).alias("threshold"))


# ---- pooled -----------------------------------------------------------------

def family_pooled(train: DataFrame, q: float, own_weight: float = 0.0, least_pool: int = 8) -> DataFrame:
    """Quantile of all TRAIN scores of a family, own scores optionally repeated.

    """
    pools = train.groupBy("family").agg(F.count(F.lit(1)).alias("pool_n"))
    own = empirical(train, ["family", "dataset"], 1 - q).withColumnRenamed("threshold", "own_t")
    if own_weight <= 0:
        mixed = empirical(train, ["family"], 1 - q).withColumnRenamed("threshold", "mix_t")
        both = own.join(mixed, "family").join(pools, "family")
    else:
        both = own.join(_mixture_quantile(train, pools, q, own_weight), "dataset").join(pools, "family")
    return both.select("dataset", "family", F.when(F.col("pool_n") < least_pool, F.col("own_t")).otherwise(F.col("mix_t")).alias("threshold"))


def _mixture_quantile(train: DataFrame, pools: DataFrame, q: float, own_weight: float) -> DataFrame:
    """Quantile of a family pool plus own rows repeated, without building it.

    Between two neighbouring own scores the mixture is the pool shifted by a
    constant, so its k-th value is either an own score or the pool value at a
    known position: one running count per row and one equi join.
    """
    n = train.groupBy("family", "dataset").agg(F.count(F.lit(1)).alias("n"))
    times = F.greatest(F.lit(1), F.floor(F.col("pool_n") * own_weight / F.col("n"))).cast("bigint")
    plan = n.join(pools, "family").withColumn("times", times)
    pos = (F.col("pool_n") + F.col("n") * F.col("times") - 1) * F.lit(float(q))
    asked = plan.select("family", "dataset", "n", "times", (pos - F.floor(pos)).alias("share"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.floor(pos).alias("k")), F.struct(F.lit(1).alias("side"), F.ceil(pos).alias("k")))).alias("a"))
    asked = asked.select("family", "dataset", "n", "times", "share", "a.side", (F.col("a.k") + 1).alias("k"))
    counted = with_cumulative(train.select("family", "dataset", "score"), ["family"], "score", {"pool_le": F.lit(1)})
    same = counted.groupBy("family", "score").agg(F.count(F.lit(1)).alias("pool_eq"))
    counted = with_cumulative(counted, ["family", "dataset"], "score", {"own_le": F.lit(1)})
    steps = counted.groupBy("family", "dataset", "score").agg(
        F.max("pool_le").alias("pool_le"), F.max("own_le").alias("own_le"), F.count(F.lit(1)).alias("own_eq")).join(same, ["family", "score"])
    at = steps.join(asked, ["family", "dataset"]).filter(F.col("pool_le") + F.col("times") * F.col("own_le") >= F.col("k"))
    first = at.groupBy("family", "dataset", "side", "k").agg(F.min_by(F.struct(
        "score", (F.col("own_le") - F.col("own_eq")).alias("own_lt"), (F.col("pool_le") - F.col("pool_eq")).alias("pool_lt")), "score").alias("f"))
    found = asked.join(first, ["family", "dataset", "side", "k"], "left")
    below = F.coalesce(F.col("f.own_lt"), F.col("n"))
    on_own = F.col("f.score").isNotNull() & (F.col("k") > F.col("f.pool_lt") + F.col("times") * below)
    found = found.withColumn("place", F.when(~F.coalesce(on_own, F.lit(False)), F.col("k") - F.col("times") * below))
    ids = train.select("family", "score", F.struct("dataset", "idx").alias("_id"))
    placed = with_position(ids, ["family"], [("score", "asc"), ("_id", "asc")], "place").select("family", "place", F.col("score").alias("pool_score"))
    value = found.join(placed, ["family", "place"], "left").withColumn("v", F.coalesce("pool_score", "f.score"))
    side = lambda x: F.max(F.when(F.col("side") == x, F.col("v")))
    return value.groupBy("dataset").agg((side(0) + (side(1) - side(0)) * F.max("share")).alias("mix_t"))


# ---- diagnostics ------------------------------------------------------------

def train_exceed(train: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """How many TRAIN rows a threshold would alert, count and share."""
    over = (F.col("score") > F.col("threshold")).cast("int")
    return train.hint("merge").join(thresholds, keys).groupBy(*keys).agg(
        F.sum(over).alias("exceed_count"), F.avg(over).alias("exceed_rate"))


def margins(test: DataFrame, thresholds: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """Top score order and the gaps top1-top2 and top1-threshold.

    Only the best ``top`` rows of a group are gathered, so the list is bounded.
    """
    from pyspark.sql import Window
    window = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("idx").desc())
    best = test.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= top)
    packed = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "idx", "score"))).alias("p"))
    count = test.join(thresholds, keys).groupBy(*keys).agg(
        F.count_if(F.col("score") > F.col("threshold")).alias("selected"),
        *[f(F.when(F.col("score") > F.col("threshold"), F.col("score"))).alias(name) for f, name in ((F.max, "most_selected"), (F.min, "least_selected"))])
    out = packed.join(thresholds, keys).join(count, keys)
    first, second = F.get("p", 0)["score"], F.get("p", 1)["score"]
    return out.select(*keys, "selected", "most_selected", "least_selected", second.alias("top2_score"), F.concat_ws(" ", F.transform("p", lambda x: x["idx"].cast("string"))).alias("top_order"),
                      first.alias("top1_score"), (first - second).alias("top_gap"), (first - F.col("threshold")).alias("threshold_margin"))
