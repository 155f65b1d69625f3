"""Experiments as rows: configurations, threshold rules and selection strategies.

A table of configurations says which feature, compression and score each one uses;
features are computed once per distinct setting, whatever the number of
configurations that read them.  Strategies are a table too: a list of tiers, each
a pool of fired rows with a cap and a gate.  Features, compressions and scores go
by name; :func:`register` adds one of the user's own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlane.functions import columns as C
from outlane.functions.order import with_position
from outlane.operators import features as X
from outlane.operators import kernels as N
from outlane.operators import scoring as K
from outlane.operators.selection import agreement_rows, first_tier
from outlane.session import stage

#: kind -> name -> operator.  A feature maps rows (dataset, split, idx, values) to
#: (dataset, split, idx, vec), a compression (rows, width) and a score (rows, k) keep
#: the keys; a score adds ``score``.
NAMED: dict[str, dict[str, Callable]] = {"feature": {}, "compression": {}, "score": {}}


def register(kind: str, name: str):
    """Make an operator known to configurations by name."""
    if kind not in NAMED:
        raise ValueError(f"{kind} is not one of {', '.join(NAMED)}")

    def add(fn: Callable) -> Callable:
        NAMED[kind][name] = fn
        return fn
    return add


def named(kind: str, name: str) -> Callable:
    if name not in NAMED[kind]:
        raise ValueError(f"no {kind} is called {name}; there are {', '.join(sorted(NAMED[kind]))}")
    return NAMED[kind][name]


def _vec(value: Callable) -> Callable:
    return lambda rows: rows.withColumn("vec", value("values")).drop("values")


register("feature", "raw")(_vec(F.col))
register("feature", "z")(_vec(C.z_norm))
register("feature", "z_diff")(_vec(lambda v: C.first_difference(C.z_norm(v))))
register("feature", "rocket")(_vec(lambda v: N.rocket_features(C.z_norm(v), 64)))
register("compression", "none")(lambda rows, width: rows)
register("compression", "pca")(lambda rows, width: X.factor(rows, width, True))
register("compression", "svd")(lambda rows, width: X.factor(rows, width, False))
register("score", "centroid")(lambda rows, k: K.centroid_scores(rows))
register("score", "knn")(lambda rows, k: K.knn_scores(K.neighbours(rows, rows.filter("split = 'TRAIN'"), k)))
register("score", "local_gap")(lambda rows, k: K.local_gap(rows, k))


# ---- configurations -----------------------------------------------------------

def config_scores(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """(config, dataset, split, idx, score) of every row of ``configs``: (config,
    feature, compression, width, score, k).  Equal settings are computed once."""
    table = [r.asDict() for r in configs.distinct().collect()]  # the experiment's specification
    made, out = {}, {}
    for c in table:
        feature, packed = (c["feature"],), (c["feature"], c["compression"], c["width"])
        if feature not in made:
            made[feature] = stage(named("feature", c["feature"])(rows))
        if packed not in made:
            made[packed] = stage(named("compression", c["compression"])(made[feature], c["width"])) if c["compression"] != "none" else made[feature]
        setting = (*packed, c["score"], c["k"])
        if setting not in out:
            out[setting] = (named("score", c["score"])(made[packed], c["k"]).select("dataset", "split", "idx", "score"), [])
        out[setting][1].append(c["config"])
    parts = [scores.withColumn("config", F.explode(F.array(*[F.lit(n) for n in sorted(names)]))) for scores, names in out.values()]
    return reduce(DataFrame.unionByName, parts).select("config", "dataset", "split", "idx", "score")


def config_sweep(scores: DataFrame, rules: DataFrame, truth: DataFrame) -> DataFrame:
    """(config, rule, dataset, threshold, tp, fp, fn, f1): every configuration under
    every rule (rule, rate): the threshold is passed by floor(rate * n) TRAIN rows.

    All rules read one ordering of the TRAIN scores; a test row is counted once
    for all of them.
    """
    keys = ["config", "dataset"]
    train = scores.filter("split = 'TRAIN'")
    placed = with_position(train, keys, [("score", "desc"), ("idx", "asc")], "p")
    sizes = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    table = [(r.rule, float(r.rate)) for r in rules.collect()]
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), (F.floor(F.lit(r) * F.col("n")) + 1).alias("p")) for n, r in table]))
    limits = sizes.select(*keys, wanted.alias("w")).select(*keys, "w.rule", "w.p").join(placed, [*keys, "p"]).select(*keys, "rule", F.col("score").alias("threshold"))
    packed = limits.groupBy(*keys).agg(F.collect_list(F.struct("rule", "threshold")).alias("limits"))
    test = scores.filter("split = 'TEST'").join(truth.select("dataset", "idx", "y"), ["dataset", "idx"]).join(packed, keys)
    fired = test.select(*keys, "y", F.explode("limits").alias("l"), "score").groupBy(*keys, "l.rule", "l.threshold").agg(
        F.count_if((F.col("score") > F.col("l.threshold")) & (F.col("y") == 1)).alias("tp"), F.count_if((F.col("score") > F.col("l.threshold")) & (F.col("y") == 0)).alias("fp"),
        F.count_if((F.col("score") <= F.col("l.threshold")) & (F.col("y") == 1)).alias("fn"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return fired.withColumn("f1", f1)


# ---- strategies ---------------------------------------------------------------

# Pool, rate, greatest count, budget and gate of each tier; a later
# tier counts only where the earlier ones select nothing.
STRATEGIES = {
    "index_2of3": ["two"],
    "rocket_when_any_index_overlap": ["rocket if overlap"],
    "imaging_pair_when_rocket_zero": ["rocket", "pair"],
    "rocket_default_index_reference": ["rocket"],
    "guarded_index_2of3": ["two 2%"],
    "guarded_rocket_or_imaging_pair": ["rocket if few", "pair 2% if no_rocket"],
    "guarded_rocket_index_reference": ["rocket if few"],
    "cap_1pct_2of3": ["two 1%"],
    "cap_2pct_2of3": ["two 2%"],
    "cap_3pct_2of3": ["two 3%"],
    "cap_5pct_2of3": ["two 5%"],
    "cap_max1_2of3": ["two max 1"],
    "cap_max3_2of3": ["two max 3"],
    "cap_max5_2of3": ["two max 5"],
    "cap_min2pct_max5_2of3": ["two 2% max 5"],
    "cap_min3pct_max5_2of3": ["two 3% max 5"],
    "guarded_2of3_only": ["two 2%"],
    "fallback_imaging_pair_when_empty": ["two 2%", "pair 2%"],
    "fallback_rocket_when_empty": ["two 2%", "rocket 2%"],
    "fallback_pair_then_rocket_when_empty": ["two 2%", "pair 2%", "rocket 1%"],
    "confidence_high_3of3": ["three 2%"],
    "confidence_medium_2of3": ["two 2%"],
    "confidence_tier_high_then_medium": ["three 2%", "two 2%"],
    "confidence_tier_with_low_rocket": ["three 2%", "two 2%", "rocket 1%"],
    "auto_budget_train_exceed_2of3": ["two auto"],
    "auto_budget_3of3_else_2of3": ["three auto", "two auto"],
    "auto_budget_low_fp_max5": ["two auto max 5"],
    "auto_budget_rocket_fallback": ["two auto", "rocket auto max 5"],
    "sparse_overlap_fallback_rocket": ["two 2%", "rocket 2%"],
    "sparse_overlap_fallback_imaging_pair": ["two 2%", "pair 2%"],
    "disagreement_guard_rocket_top1pct": ["rocket 1% if disagree", "two 2% if agree"],
    "conservative_hardness_selector": ["three 2%", "two 2%", "pair 1%"],
    "final_high_precision": ["three 2%", "two 2% max 5"],
    "final_balanced": ["two 3%", "pair 1%", "rocket 1%"],
    "final_low_fp": ["three max 3", "two max 3"],
    "final_operational_v1": ["two 2% max 5", "pair max 1", "rocket max 1"],
    "exp68_reference_operational_v1": ["two 2% max 5", "pair max 1", "rocket max 1"],
    "fallback_top2_when_empty": ["two 2% max 5", "pair max 2", "rocket max 2"],
    "fallback_top3_when_empty": ["two 2% max 5", "pair max 3", "rocket max 3"],
    "fallback_adaptive_1to3": ["two 2% max 5", "pair adaptive", "rocket adaptive"],
    "fallback_rocket_2pct_when_empty": ["two 2% max 5", "rocket 2%"],
}
# Rate of a group of rocket alerts that counts as few; train budget.
FEW, BUDGET_FACTOR, BUDGET_LOW, BUDGET_HIGH = 0.03, 1.5, 0.005, 0.03


def strategy_rows(strategies: dict[str, list[str]]) -> list[tuple]:
    """(strategy, tier, pool, rate, most, budget, gate) of each tier."""
    out = []
    for name, tiers in strategies.items():
        for tier, text in enumerate(tiers):
            cap, _, gate = text.partition(" if ")
            pool, *words = cap.split()
            rate = next((float(w[:-1]) / 100 for w in words if w.endswith("%")), None)
            most = int(words[words.index("max") + 1]) if "max" in words else None
            out.append((name, tier, pool, rate, most, next((w for w in words if w in ("auto", "adaptive")), None), gate or None))
    return out


def strategy_table(spark: SparkSession, strategies: dict[str, list[str]] | None = None) -> DataFrame:
    return spark.createDataFrame(strategy_rows(STRATEGIES if strategies is None else strategies), "strategy string, tier int, pool string, rate double, most bigint, budget string, gate string")


def strategy_selections(scores: DataFrame, thresholds: DataFrame, sizes: DataFrame, exceed: DataFrame, table: DataFrame, factor: float = BUDGET_FACTOR) -> DataFrame:
    """(strategy, dataset, idx) of every strategy of ``table``.

    Fired rows get their place in each pool from two orderings; what gates and
    budgets need is one row per dataset; tiers meet the rows by pool.
    """
    rows = stage(agreement_rows(scores, thresholds))
    count = lambda c: F.sum(c).cast("long")
    facts = rows.groupBy("dataset").agg(count("rocket").alias("n_rocket"), count("image_a").alias("n_a"), count("image_b").alias("n_b"), count("two").alias("n_two"),
                                        F.max(((F.col("rocket") == 1) & ((F.col("image_a") == 1) | (F.col("image_b") == 1))).cast("int")).alias("overlap"))
    train = exceed.filter("source <> 'multi'").groupBy("dataset").agg(F.least(F.lit(BUDGET_HIGH), F.greatest(F.lit(BUDGET_LOW), F.avg("exceed_rate") * factor)).alias("train_rate"))
    facts = facts.join(sizes, "dataset").join(train, "dataset")
    share = lambda r: F.greatest(F.lit(1), F.ceil(F.col("n") * r))
    apart = F.greatest("n_rocket", "n_a", "n_b") >= 2 * F.greatest(F.lit(1), F.col("n_two"))
    gates = {"overlap": F.col("overlap") == 1, "few": (F.col("n_rocket") > 0) & (F.col("n_rocket") <= share(FEW)), "no_rocket": F.col("n_rocket") == 0, "disagree": apart, "agree": ~apart}
    open_ = F.array_compact(F.array(*[F.when(on, F.lit(g)) for g, on in gates.items()]))
    voices = sum((F.col(c) > 0).cast("int") for c in ("n_rocket", "n_a", "n_b"))
    adaptive = F.when((F.col("n_rocket") >= 3) & (F.col("n_two") == 0), 3).when(voices >= 2, 2).otherwise(1)
    facts = facts.select("dataset", "n", open_.alias("open"), adaptive.cast("long").alias("adaptive"), share(F.col("train_rate")).alias("auto"))
    pools = F.explode(F.array_compact(F.array(*[F.when(F.col(p) == 1, F.struct(F.lit(p).alias("pool"), F.col(f"at_{p}").alias("place"))) for p in ("two", "three", "rocket", "pair")])))
    placed = rows.select("dataset", "idx", pools.alias("p")).select("dataset", "idx", "p.pool", "p.place").join(facts, "dataset")
    none: Column = F.lit(None)
    limit = F.least(F.coalesce(F.when(F.col("rate").isNotNull(), share(F.col("rate"))), F.col("n")), F.coalesce("most", "n"),
                    F.when(F.col("budget") == "auto", F.col("auto")).when(F.col("budget") == "adaptive", F.col("adaptive")).otherwise(none), F.col("n"))
    tagged = placed.join(table, "pool").filter(F.col("gate").isNull() | F.array_contains("open", F.col("gate"))).filter(F.col("place") <= limit)
    return first_tier(tagged.select("strategy", "tier", "dataset", "idx"), ["strategy", "dataset"]).select("strategy", "dataset", "idx")
