"""Queries for selections, budgets, agreement and choosers."""

from pyspark.sql import functions as F

from outlane.functions.columns import r6 as R6
from outlane.operators import selection as S
from outlane.operators import thresholds as T
from outlane.plans.fusion import DSS, base, pvalues
from outlane.plans.registry import fragment, query, r6
from outlane.plans.thresholds import cap_sql

fragment("all_cap", "scores", cap_sql("(SELECT * FROM scores WHERE split = 'TRAIN')", "0.1", "dataset, source"))
fragment("fired", "scores all_cap", """
SELECT s.dataset, s.family, s.source, idx, score FROM scores s JOIN all_cap c USING (dataset, source) WHERE split = 'TEST' AND score > threshold""")
fragment("sizes", "test", "SELECT dataset, count(*) AS n FROM test GROUP BY 1")
fragment("fired_rocket", "fired", "SELECT dataset, idx, score FROM fired WHERE source = 'rocket'")
fragment("support", "fired", """
SELECT dataset, idx, count(CASE WHEN source <> 'multi' THEN 1 END) AS b, count(*) AS s,
  max(CASE WHEN source = 'rocket' THEN 1 ELSE 0 END) AS r, min(CASE WHEN source IN ('image_a', 'image_b') THEN 1 ELSE 0 END) AS only_images,
  count(CASE WHEN source IN ('image_a', 'image_b') THEN 1 END) AS images FROM fired GROUP BY 1, 2""")


def test(t):
    return t.score().filter("split = 'TEST'")


def test_all(t):
    return t.scores().filter("split = 'TEST'")


def caps_all(t, rate=0.1):
    """One threshold per dataset and source; several readers of a costly result."""
    return t.once(f"caps {rate}", lambda: T.count_cap(t.scores().filter("split = 'TRAIN'"), DSS, rate).select(*DSS, "threshold"))


def fired(t, source=None):
    got = t.once("fired", lambda: S.above(test_all(t), caps_all(t), DSS))
    return got if source is None else got.filter(F.col("source") == source)


def ranked_sql(where: str, order: str = "score DESC, idx DESC", rel: str = "test") -> str:
    return f"""SELECT s.dataset, idx FROM {rel} s JOIN sizes USING (dataset) QUALIFY row_number() OVER (PARTITION BY s.dataset ORDER BY {order}) <= {where}"""


@query("top_k", "test sizes", ranked_sql("3"))
def _(t):
    return S.top_k(test(t), 3).select("dataset", "idx")


STRATS = {"top_1": "1", "prior_q_02": "ceil(n * 0.02)", "prior_q_05_min_k_3": "greatest(ceil(n * 5 / 100), 3)", "sqrt_n_tail": "ceil(sqrt(n))"}


@query("strategy_top_k", "test sizes", " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, * FROM ({ranked_sql(f'greatest(1, least(n, {k}))')})" for s, k in STRATS.items()))
def _(t):
    return S.by_strategies(test(t), list(STRATS)).select("strategy", "dataset", "idx")


fragment("gap_cut", "test sizes", """
WITH r AS (SELECT s.dataset, score, n, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM test s JOIN sizes USING (dataset)
           WINDOW w AS (PARTITION BY s.dataset ORDER BY score DESC, idx DESC))
SELECT dataset, arg_max(rank, (score - nxt) * 1000000 + rank) AS k FROM r WHERE rank <= least(n, greatest(3, ceil(n * 0.1)) + 1) - 0 AND rank < n
  AND rank <= greatest(3, ceil(n * 0.1)) GROUP BY 1""")


@query("largest_tail_gap", "test sizes gap_cut", """
SELECT s.dataset, idx FROM test s JOIN sizes USING (dataset) LEFT JOIN gap_cut g ON g.dataset = s.dataset
QUALIFY row_number() OVER (PARTITION BY s.dataset ORDER BY score DESC, idx DESC) <= CASE WHEN n <= 2 THEN 1 ELSE coalesce(k, 1) END""")
def _(t):
    return S.tail_gap(test(t)).select("dataset", "idx")


@query("stable_score_order", "test sizes", """
SELECT s.dataset, idx, row_number() OVER (PARTITION BY s.dataset ORDER BY score DESC, idx) AS rank FROM test s QUALIFY rank <= 10""")
def _(t):
    return S.top_k(test(t), 10, later_first=False).select("dataset", "idx", "rank")


@query("score_margin_at_k", "test", f"""
SELECT dataset, {r6('max(CASE WHEN r = 3 THEN score END) - max(CASE WHEN r = 4 THEN score END)')} AS margin FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, idx) AS r FROM test) GROUP BY 1""")
def _(t):
    return S.score_margin(test(t), 3).withColumn("margin", R6("margin"))


ASC = "score DESC, idx"


@query("cap_by_rate", "fired_rocket sizes", ranked_sql("greatest(1, ceil(n * 0.05))", ASC, "fired_rocket"))
def _(t):
    return S.cap_rate(fired(t, "rocket"), S.test_sizes(test(t)), 0.05).select("dataset", "idx")


@query("cap_by_count", "fired_rocket sizes", ranked_sql("2", ASC, "fired_rocket"))
def _(t):
    return S.cap_count(fired(t, "rocket"), ["dataset"], F.lit(2)).select("dataset", "idx")


@query("cap_rate_and_max", "fired_rocket sizes", ranked_sql("least(3, greatest(1, ceil(n * 0.1)))", ASC, "fired_rocket"))
def _(t):
    return S.cap_rate_max(fired(t, "rocket"), S.test_sizes(test(t)), 0.1, 3).select("dataset", "idx")


fragment("exceed", "scores all_cap", """
SELECT s.dataset, s.source, avg(CASE WHEN score > threshold THEN 1 ELSE 0 END) AS exceed_rate FROM scores s JOIN all_cap c USING (dataset, source) WHERE split = 'TRAIN' GROUP BY 1, 2""")


def exceed(t):
    return t.once("exceed", lambda: T.train_exceed(t.scores().filter("split = 'TRAIN'"), caps_all(t), DSS))


@query("train_derived_budget", "exceed sizes", f"""
SELECT dataset, {r6('rate')} AS rate, n, CAST(greatest(1, least(5, ceil(n * rate))) AS BIGINT) AS budget FROM (
  SELECT dataset, least(0.03, greatest(0.005, avg(exceed_rate) * 0.15)) AS rate FROM exceed WHERE source <> 'multi' GROUP BY 1) JOIN sizes USING (dataset)""")
def _(t):
    got = S.train_budget(exceed(t).filter("source <> 'multi'"), S.test_sizes(test(t)), multiplier=0.15, most=5)
    return got.withColumn("rate", R6("rate"))


@query("length_budget", "sizes", "SELECT dataset, CAST(greatest(2, least(8, ceil(n * 0.1))) AS BIGINT) AS budget FROM sizes")
def _(t):
    return S.test_sizes(test(t)).select("dataset", S.length_budget(F.col("n"), 0.1, 2, 8).alias("budget"))


@query("family_adjusted_budget", "sizes test", """
SELECT dataset, CAST(CASE WHEN family IN ('f1') THEN greatest(2, ceil(n * 0.55)) WHEN family IN ('f2', 'f3') THEN greatest(2, ceil(n * 0.7)) ELSE n END AS BIGINT) AS budget
FROM sizes JOIN (SELECT DISTINCT dataset, family FROM test) USING (dataset)""")
def _(t):
    n = test(t).groupBy("dataset", "family").agg(F.count(F.lit(1)).alias("n"))
    return n.select("dataset", S.family_budget(F.col("n"), F.col("family"), ["f1"], ["f2", "f3"]).cast("bigint").alias("budget"))


@query("fixed_budget_grid", "fired_rocket", """
SELECT CAST(k AS INTEGER) AS k, dataset, idx FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, idx) AS r FROM fired_rocket),
  (SELECT unnest([1, 2, 3, 5]) AS k) WHERE r <= k""")
def _(t):
    return S.fixed_budgets(fired(t, "rocket"), [0, 1, 2, 3, 5]).select("k", "dataset", "idx")


@query("at_least_k_agreement", "support", "SELECT dataset, idx FROM support WHERE b >= 2")
def _(t):
    return S.at_least(fired(t), 2, list(S.BASE))


@query("p_value_agreement", "pvalues", """
SELECT dataset, idx, count(CASE WHEN p <= 0.1 THEN 1 END) AS support, CASE WHEN count(CASE WHEN p <= 0.1 THEN 1 END) >= 2 THEN 1 ELSE 0 END AS selected
FROM pvalues WHERE split = 'TEST' GROUP BY 1, 2""")
def _(t):
    return S.p_agreement(pvalues(t), 0.1)


@query("threshold_only_candidates", "support", "SELECT dataset, idx FROM support WHERE b >= 2 OR s >= 2")
def _(t):
    return S.threshold_candidates(fired(t))


fragment("base_ranks", "scores", """
SELECT dataset, source, idx, row_number() OVER (PARTITION BY dataset, source ORDER BY score DESC, idx) AS rank FROM scores WHERE split = 'TEST'""")
fragment("fused_order", "base_ranks", """
SELECT dataset, idx, fused, row_number() OVER (PARTITION BY dataset ORDER BY fused, idx) AS place FROM (
  SELECT dataset, idx, round(sum(CASE source WHEN 'rocket' THEN 0.5 ELSE 0.25 END * rank), 6) AS fused FROM base_ranks WHERE source <> 'multi' GROUP BY 1, 2)""")


@query("rank_fusion_top_k", "fused_order", "SELECT dataset, idx, place FROM fused_order WHERE place <= 3")
def _(t):
    return S.fused_order(test_all(t)).filter("place <= 3").select("dataset", "idx", "place")


@query("margin_guarded_fusion", "fused_order", """
SELECT o.dataset, idx FROM fused_order o JOIN (
  SELECT dataset, coalesce(max(CASE WHEN place = 4 THEN fused END) - max(CASE WHEN place = 3 THEN fused END) < 1.0, false) AS thin FROM fused_order GROUP BY 1) USING (dataset)
WHERE place <= CASE WHEN thin THEN 2 ELSE 3 END""")
def _(t):
    return S.fused_margin(S.fused_order(test_all(t)), F.lit(3)).select("dataset", "idx")


@query("guarded_rank_fusion", "fused_order base_ranks", """
WITH top AS (SELECT * FROM base_ranks WHERE rank <= 5 AND source <> 'multi'),
two AS (SELECT dataset, idx FROM top GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT dataset, idx FROM top WHERE source = 'rocket')
SELECT 'rocket_top' AS guard, dataset, idx FROM fused_order SEMI JOIN r USING (dataset, idx) WHERE place <= 3
UNION ALL SELECT 'two_model_top', dataset, idx FROM fused_order SEMI JOIN two USING (dataset, idx) WHERE place <= 3
UNION ALL SELECT 'rocket_or_two_model_top', dataset, idx FROM fused_order SEMI JOIN (SELECT * FROM r UNION SELECT * FROM two) u USING (dataset, idx) WHERE place <= 3""")
def _(t):
    parts = [S.fused_guarded(test_all(t), 3, g, 5).withColumn("guard", F.lit(g)) for g in ("rocket_top", "two_model_top", "rocket_or_two_model_top")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _strategy_sql():
    sets = {"two": ("SELECT f.dataset, f.idx, score FROM support f JOIN r USING (dataset, idx) WHERE b >= 2"),
            "three": ("SELECT f.dataset, f.idx, score FROM support f JOIN r USING (dataset, idx) WHERE b >= 3"),
            "rocket": ("SELECT f.dataset, f.idx, score FROM support f JOIN r USING (dataset, idx) WHERE r = 1"),
            "pair": ("SELECT f.dataset, f.idx, score FROM support f JOIN i USING (dataset, idx) WHERE images = 2")}

    def capped(name, limit):
        return f"SELECT s.dataset, idx FROM {name}_set s JOIN sizes USING (dataset) QUALIFY row_number() OVER (PARTITION BY s.dataset ORDER BY score DESC, idx) <= {limit}"

    rate = lambda n, r: capped(n, f"greatest(1, ceil(n * {r}))")
    chains = {
        "index_2of3": ["SELECT dataset, idx FROM two_set"], "cap_1pct_2of3": [rate("two", 0.01)], "cap_3pct_2of3": [rate("two", 0.03)],
        "cap_max3_2of3": [capped("two", 3)], "cap_min2pct_max5_2of3": [capped("two", "least(5, greatest(1, ceil(n * 0.02)))")],
        "fallback_pair_then_rocket": [rate("two", 0.02), rate("pair", 0.02), rate("rocket", 0.01)],
        "confidence_high_then_medium": [rate("three", 0.02), rate("two", 0.02)],
        "conservative_hardness": [rate("three", 0.02), rate("two", 0.02), rate("pair", 0.01)],
        "final_balanced": [rate("two", 0.03), rate("pair", 0.01), rate("rocket", 0.01)],
        "final_low_fp": [capped("three", 3), capped("two", 3)],
        "final_operational": [capped("two", "least(5, greatest(1, ceil(n * 0.02)))"), capped("pair", 1), capped("rocket", 1)]}
    rows = " UNION ALL ".join(f"SELECT '{n}' AS strategy, {i} AS tier, * FROM ({q})" for n, c in chains.items() for i, q in enumerate(c))
    head = ", ".join(f"{n}_set AS ({q})" for n, q in sets.items())
    return f"""WITH r AS (SELECT dataset, idx, score FROM scores WHERE split = 'TEST' AND source = 'rocket'),
i AS (SELECT dataset, idx, score FROM scores WHERE split = 'TEST' AND source = 'image_b'), {head}, tagged AS ({rows})
SELECT strategy, dataset, idx FROM tagged QUALIFY tier = min(tier) OVER (PARTITION BY strategy, dataset)"""


@query("agreement_strategy_sets", "support scores sizes", _strategy_sql())
def _(t):
    return S.strategy_sets(test_all(t), caps_all(t), S.test_sizes(test(t)))


@query("calibrated_profiles", "scores", " UNION ALL ".join(f"""
SELECT '{p}' AS profile, dataset, idx FROM (SELECT s.dataset, s.source, idx FROM scores s JOIN ({cap_sql("(SELECT * FROM scores WHERE split = 'TRAIN' AND source <> 'multi')", r, 'dataset, source')}) USING (dataset, source)
  WHERE split = 'TEST' AND score > threshold) GROUP BY 1, 2, 3 HAVING count(*) >= 2""" for p, r in (("strict", 0.05), ("middle", 0.1), ("relaxed", 0.15))))
def _(t):
    rates = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(r).alias("rate")) for p, r in (("strict", 0.05), ("middle", 0.1), ("relaxed", 0.15))]))
    rows = base(t).withColumn("r", rates).select("r.profile", "r.rate", "dataset", "source", "split", "idx", "score")
    keys = ["profile", "dataset", "source"]
    limits = T.count_cap(rows.filter("split = 'TRAIN'"), keys + ["rate"], F.col("rate")).select(*keys, "threshold")
    hits = S.above(rows.filter("split = 'TEST'"), limits, keys)
    return hits.groupBy("profile", "dataset", "idx").agg(F.count(F.lit(1)).alias("c")).filter("c >= 2").drop("c")


@query("fallback_when_empty", "support test sizes", """
WITH t AS (SELECT dataset, idx, 0 AS tier FROM support WHERE b >= 3 UNION ALL
  SELECT dataset, idx, 1 FROM (SELECT s.dataset, idx FROM test s QUALIFY row_number() OVER (PARTITION BY s.dataset ORDER BY score DESC, idx) <= 2))
SELECT dataset, idx FROM t QUALIFY tier = min(tier) OVER (PARTITION BY dataset)""")
def _(t):
    parts = S.tier(S.at_least(fired(t), 3, list(S.BASE)), "x", 0).unionByName(S.tier(S.top_k(test(t), 2, later_first=False), "x", 1))
    return S.first_tier(parts, ["dataset"]).select("dataset", "idx")


fragment("summary", "scores all_cap exceed", """
SELECT *, predicted / n AS alert_rate FROM (
  SELECT s.dataset, s.source, count(CASE WHEN score > threshold THEN 1 END) AS predicted, count(*) AS n FROM scores s JOIN all_cap USING (dataset, source) WHERE split = 'TEST' GROUP BY 1, 2)
JOIN exceed USING (dataset, source)""")


def guard(rate=0.2, train=0.1):
    return f"(predicted > 0 AND predicted <= greatest(1, ceil(n * {rate})) AND exceed_rate <= {train})"


def summary(t):
    return S.source_summary(test_all(t), caps_all(t), exceed(t))


@query("guard_pass", "summary", f"SELECT dataset, source, predicted, n, {r6('exceed_rate')} AS exceed_rate FROM summary WHERE {guard()}")
def _(t):
    return summary(t).filter(S.passes_guard(0.2, 0.1)).select("dataset", "source", "predicted", "n", R6("exceed_rate").alias("exceed_rate"))


fragment("calm", "summary", "SELECT *, exceed_rate / 4 AS calm_rate FROM summary")
CALM = "(predicted > 0 AND predicted <= greatest(1, ceil(n * {}) ) AND calm_rate <= {})"


def calm(t):
    return summary(t).withColumn("exceed_rate", F.col("exceed_rate") / 4)


@query("confidence_chooser", "calm", f"""
WITH p AS (SELECT *, CASE WHEN source = 'rocket' AND {CALM.format(0.03, 0.035)} THEN 0 WHEN source LIKE 'image%' AND {CALM.format(0.02, 0.025)} THEN 1
  WHEN source = 'rocket' AND predicted > 0 AND alert_rate <= 0.05 THEN 2 END AS p FROM calm),
b AS (SELECT * FROM p WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY p, CASE WHEN p = 1 THEN calm_rate ELSE 0 END, predicted, source) = 1)
SELECT dataset, coalesce(b.source, 'none') AS source, CASE b.p WHEN 0 THEN 'first_guard' WHEN 1 THEN 'image_guard' WHEN 2 THEN 'first_nonzero' ELSE 'no_candidate' END AS reason
FROM (SELECT DISTINCT dataset FROM calm) LEFT JOIN b USING (dataset)""")
def _(t):
    return S.choose_confident(calm(t))


@query("agreement_count_chooser", "summary", """
WITH n AS (SELECT dataset, sum(CASE WHEN source = 'rocket' THEN predicted END) AS r, sum(CASE WHEN source = 'image_a' THEN predicted END) AS a, sum(CASE WHEN source = 'image_b' THEN predicted END) AS b FROM summary GROUP BY 1)
SELECT dataset, CASE WHEN r > 0 AND (a > 0 OR b > 0) THEN 'rocket' WHEN r = 0 AND a > 0 AND b > 0 THEN CASE WHEN a <= b THEN 'image_a' ELSE 'image_b' END WHEN r > 0 THEN 'rocket' ELSE 'none' END AS source,
  CASE WHEN r > 0 AND (a > 0 OR b > 0) THEN 'first_agrees_with_image' WHEN r = 0 AND a > 0 AND b > 0 THEN 'image_pair' WHEN r > 0 THEN 'first_only' ELSE 'no_count_agreement' END AS reason FROM n""")
def _(t):
    return S.choose_agreement_count(summary(t))


@query("fp_guarded_chooser", "calm", f"""
WITH b AS (SELECT dataset, source FROM calm WHERE {CALM.format(0.02, 0.025)} QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY
  round(least(predicted, greatest(1, ceil(n * 0.02))) / (greatest(1, ceil(n * 0.02)) + 1.0) - 5.0 * calm_rate - alert_rate + CASE WHEN source = 'rocket' THEN 0.10 ELSE 0.0 END, 9) DESC, predicted, source DESC) = 1)
SELECT dataset, coalesce(source, 'none') AS source, CASE WHEN source IS NULL THEN 'fp_guard_rejected_all' ELSE 'fp_guard_score' END AS reason FROM (SELECT DISTINCT dataset FROM calm) LEFT JOIN b USING (dataset)""")
def _(t):
    return S.choose_fp_guarded(calm(t))


@query("selection_materialise", "summary", """
SELECT dataset, coalesce(source, 'none') AS source, CASE WHEN source IS NULL THEN 'no_candidate' ELSE 'fired' END AS reason
FROM (SELECT DISTINCT dataset FROM summary) LEFT JOIN (SELECT dataset, source FROM summary WHERE source = 'rocket' AND predicted > 0) USING (dataset)""")
def _(t):
    rows = summary(t)
    return S._or_none(rows, rows.filter("source = 'rocket' and predicted > 0").select("dataset", "source", F.lit("fired").alias("reason")))


fragment("detail", "scores all_cap truth", """
SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM (
  SELECT s.dataset, s.family, s.source, count(CASE WHEN score > threshold AND y = 1 THEN 1 END) AS tp, count(CASE WHEN score > threshold AND y = 0 THEN 1 END) AS fp,
    count(CASE WHEN score <= threshold AND y = 1 THEN 1 END) AS fn
  FROM scores s JOIN all_cap USING (dataset, source) JOIN truth t ON t.dataset = s.dataset AND t.idx = s.idx WHERE split = 'TEST' GROUP BY 1, 2, 3)""")


def detail(t):
    from outlane.operators import evaluate as E
    flags = E.threshold_flags(test_all(t), caps_all(t), DSS).join(t.truth().drop("family"), ["dataset", "idx"])
    return E.confusion(flags, ["dataset", "family", "source"])


@query("family_prior", "detail", """
WITH v AS (SELECT *, f1 - 0.03 * fp AS v FROM detail), l AS (SELECT *, sum(v) OVER w AS s, count(*) OVER w AS c FROM v WINDOW w AS (PARTITION BY family, source))
SELECT dataset, source FROM l QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY round((s - v) / (c - 1), 9) DESC, CASE WHEN source = 'rocket' THEN 0 ELSE 1 END, source DESC) = 1""")
def _(t):
    return S.family_prior(detail(t))


@query("best_of_upper_bound", "detail", "SELECT dataset, source FROM detail QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, fp, source DESC) = 1")
def _(t):
    return S.best_of(detail(t))


@query("specialist_switch", "summary sizes", """
SELECT dataset, CASE WHEN s.predicted > 0 AND s.exceed_rate <= 0.095 AND s.predicted <= greatest(1, ceil(z.n * 0.15)) THEN 'multi' ELSE 'rocket' END AS source
FROM sizes z JOIN (SELECT * FROM summary WHERE source = 'multi') s USING (dataset)""")
def _(t):
    rows = summary(t)
    base_rows = rows.filter("source = 'rocket'").select("dataset", "source")
    return S.switch_source(base_rows, rows.filter("source = 'multi'"), S.test_sizes(test(t)), 0.095, 0.15)


@query("overlap_switch", "fired exceed sizes", """
WITH b AS (SELECT dataset, idx FROM fired WHERE source = 'rocket'), m AS (SELECT dataset, idx FROM fired WHERE source = 'multi'),
c AS (SELECT z.dataset, (SELECT count(*) FROM b WHERE b.dataset = z.dataset) AS base_n, (SELECT count(*) FROM b JOIN m USING (dataset, idx) WHERE b.dataset = z.dataset) AS overlap FROM sizes z)
SELECT c.*, CASE WHEN exceed_rate <= 0.095 AND (overlap > 0 OR base_n = 0) THEN 'specialist' ELSE 'base' END AS source FROM c JOIN exceed e ON e.dataset = c.dataset AND e.source = 'multi'""")
def _(t):
    special = exceed(t).filter("source = 'multi'").select("dataset", "exceed_rate")
    return S.overlap_switch(fired(t, "rocket"), fired(t, "multi"), special, S.test_sizes(test(t)).select("dataset"), 0.095)


@query("index_intersection_selector", "fired", """
WITH a AS (SELECT dataset, idx FROM fired WHERE source = 'rocket'), t AS (
  SELECT dataset, idx, 0 AS tier FROM a SEMI JOIN (SELECT * FROM fired WHERE source = 'multi') m USING (dataset, idx) UNION ALL SELECT dataset, idx, 1 FROM a)
SELECT dataset, idx FROM t QUALIFY tier = min(tier) OVER (PARTITION BY dataset)""")
def _(t):
    return S.intersection_or_fallback(fired(t, "rocket"), fired(t, "multi"), fired(t, "rocket"))


@query("confident_top1", "test all_cap", """
WITH r AS (SELECT dataset, idx, score, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM test WINDOW w AS (PARTITION BY dataset ORDER BY score DESC, idx))
SELECT r.dataset, idx FROM r JOIN all_cap c ON c.dataset = r.dataset AND c.source = 'rocket' WHERE r = 1 AND score - threshold >= 0 AND score - nxt >= 5""")
def _(t):
    limits = caps_all(t).filter("source = 'rocket'").select("dataset", "threshold")
    return S.confident_top1(test(t), limits, 0.0, 5.0)


@query("four_source_candidates", "support base_ranks sizes scores", """
WITH g AS (SELECT dataset, idx FROM base_ranks JOIN sizes USING (dataset) WHERE source = 'rocket' AND rank <= greatest(3, least(8, ceil(n * 0.2)))),
c AS (SELECT s.dataset, s.idx, s.s, score FROM support s SEMI JOIN g USING (dataset, idx) JOIN (SELECT dataset, idx, score FROM scores WHERE source = 'rocket' AND split = 'TEST') USING (dataset, idx))
SELECT k AS need, dataset, idx FROM (SELECT 2 AS k, * FROM c WHERE s >= 2 UNION ALL SELECT 3, * FROM c WHERE s >= 3)
QUALIFY row_number() OVER (PARTITION BY k, dataset ORDER BY score DESC, idx) <= 3""")
def _(t):
    sizes = S.test_sizes(test(t))
    guard_rows = S.top_k(test(t).join(sizes, "dataset"), S.length_budget(F.col("n"), 0.2, 3, 8), later_first=False)
    sup = S.intersect(S.support(fired(t)), guard_rows).join(test(t).select("dataset", "idx", "score"), ["dataset", "idx"])
    need = F.explode(F.array_compact(F.array(*[F.when(F.col("support") >= k, F.lit(k)) for k in (2, 3)])))
    return S.cap_count(sup.withColumn("need", need), ["need", "dataset"], F.lit(3)).select("need", "dataset", "idx")


@query("no_alert_repair", "support test sizes", """
WITH h AS (SELECT dataset, idx FROM support WHERE b >= 3), t AS (SELECT dataset, idx FROM test QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, idx) = 1)
SELECT * FROM h UNION ALL SELECT * FROM t WHERE dataset NOT IN (SELECT dataset FROM h)""")
def _(t):
    hard = S.at_least(fired(t), 3, list(S.BASE))
    top = S.top_k(test(t), 1, later_first=False).select("dataset", "idx", F.lit(0).alias("priority"))
    return S.repair_silent(hard, top, S.test_sizes(test(t)).select("dataset"))


@query("safe_no_alert_repair", "support scores exceed all_cap train", """
WITH h AS (SELECT dataset, idx FROM support WHERE b >= 3),
r AS (SELECT s.dataset, s.source, idx, score - threshold AS m FROM scores s JOIN all_cap USING (dataset, source) WHERE split = 'TEST'
      QUALIFY row_number() OVER (PARTITION BY s.dataset, s.source ORDER BY score DESC, idx) = 1),
c AS (SELECT r.dataset, idx, CASE WHEN r.source = 'multi' AND exceed_rate <= 0.095 AND m >= 0 THEN 0 WHEN r.source = 'rocket' AND exceed_rate <= 0.098 THEN 1 END AS priority FROM r JOIN exceed e ON e.dataset = r.dataset AND e.source = r.source)
SELECT * FROM h UNION ALL SELECT dataset, idx FROM c WHERE priority IS NOT NULL AND dataset NOT IN (SELECT dataset FROM h)
  AND dataset NOT IN (SELECT dataset FROM train GROUP BY 1 HAVING count(*) <= 30) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY priority, idx) = 1""")
def _(t):
    from outlane.functions.order import with_position
    hard = S.at_least(fired(t), 3, list(S.BASE))
    top = with_position(test_all(t), DSS, [("score", "desc"), ("idx", "asc")], "rank").filter("rank = 1")
    facts = top.join(caps_all(t), DSS).join(exceed(t), DSS)
    priority = (F.when((F.col("source") == "multi") & (F.col("exceed_rate") <= 0.095) & (F.col("score") >= F.col("threshold")), 0)
                .when((F.col("source") == "rocket") & (F.col("exceed_rate") <= 0.098), 1))
    candidates = facts.select("dataset", "idx", priority.alias("priority")).filter("priority is not null")
    n_train = t.score().filter("split = 'TRAIN'").groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).filter("n > 30").select("dataset")
    return S.repair_silent(hard, candidates, n_train)


@query("rebuilt_base_choice", "calm fired", f"""
WITH p AS (SELECT *, CASE WHEN source = 'rocket' AND {CALM.format(0.03, 0.035)} THEN 0 WHEN source LIKE 'image%' AND {CALM.format(0.02, 0.025)} THEN 1
  WHEN source = 'rocket' AND predicted > 0 AND alert_rate <= 0.05 THEN 2 END AS p FROM calm),
b AS (SELECT * FROM p WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY p, CASE WHEN p = 1 THEN calm_rate ELSE 0 END, predicted, source) = 1)
SELECT f.dataset, f.source, idx FROM fired f SEMI JOIN b ON b.dataset = f.dataset AND b.source = f.source""")
def _(t):
    chosen = S.choose_confident(calm(t)).select("dataset", "source")
    return fired(t).join(chosen, DSS, "left_semi").select("dataset", "source", "idx")


@query("hybrid_of_selectors", "fired", """
WITH a AS (SELECT dataset, idx FROM fired WHERE source = 'rocket'), b AS (SELECT dataset, idx FROM fired WHERE source = 'multi')
SELECT * FROM b UNION ALL SELECT * FROM a WHERE dataset NOT IN (SELECT dataset FROM b)""")
def _(t):
    parts = S.tier(fired(t, "multi"), "x", 0).unionByName(S.tier(fired(t, "rocket"), "x", 1))
    return S.first_tier(parts, ["dataset"]).select("dataset", "idx")


@query("candidate_union", "fired scores", """
WITH u AS (SELECT DISTINCT dataset, idx FROM fired WHERE source IN ('image_a', 'multi'))
SELECT u.dataset, u.idx FROM u JOIN scores s ON s.dataset = u.dataset AND s.idx = u.idx AND split = 'TEST' AND source = 'rocket'
QUALIFY row_number() OVER (PARTITION BY u.dataset ORDER BY score DESC, u.idx) <= 4""")
def _(t):
    both = S.union(fired(t, "image_a"), fired(t, "multi")).join(test(t).select("dataset", "idx", "score"), ["dataset", "idx"])
    return S.cap_count(both, ["dataset"], F.lit(4)).select("dataset", "idx")


@query("ordered_union_cap", "base_ranks", """
WITH u AS (SELECT dataset, idx, min(CASE source WHEN 'multi' THEN 0 ELSE 1 END * 100 + rank) AS o FROM base_ranks WHERE source IN ('multi', 'image_b') AND rank <= 3 GROUP BY 1, 2)
SELECT dataset, idx, row_number() OVER (PARTITION BY dataset ORDER BY o) AS place FROM u QUALIFY place <= 4""")
def _(t):
    order = S.source_ranks(test_all(t)).filter("rank <= 3").withColumnRenamed("rank", "place")
    return S.ordered_union(order.filter("source = 'multi'"), order.filter("source = 'image_b'"), 4).select("dataset", "idx", "place")


@query("disagreement_sets", "fired", """
WITH a AS (SELECT dataset, idx FROM fired WHERE source = 'rocket'), b AS (SELECT dataset, idx FROM fired WHERE source = 'multi')
SELECT dataset, idx, CASE WHEN a.idx IS NULL THEN 'second' WHEN b.idx IS NULL THEN 'first' ELSE 'common' END AS side FROM a FULL JOIN b USING (dataset, idx)""")
def _(t):
    return S.disagreement(fired(t, "rocket"), fired(t, "multi"))


@query("tail_position_diagnostic", "test sizes", "SELECT s.dataset, idx FROM test s JOIN sizes USING (dataset) WHERE idx >= n - least(8, greatest(1, ceil(n * 0.1)))")
def _(t):
    return S.tail_position(test(t), 0.1, 1, 8)


@query("failure_mode_history", "detail", """
SELECT family, CASE WHEN tp + fp = 0 THEN 'no_prediction' ELSE 'all_fp' END AS mode, count(*) AS datasets FROM detail WHERE tp = 0 GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(t):
    return S.failure_modes(detail(t))


@query("zero_mode_routing", "detail fired", """
WITH m AS (SELECT family, max(CASE WHEN tp + fp = 0 THEN 1 ELSE 0 END) AS silent FROM (SELECT * FROM detail WHERE source = 'rocket') GROUP BY 1 HAVING count(CASE WHEN tp = 0 THEN 1 END) >= 3)
SELECT f.dataset, f.idx FROM fired f LEFT JOIN m USING (family) WHERE f.source = CASE WHEN m.family IS NOT NULL THEN 'multi' ELSE 'rocket' END""")
def _(t):
    rows = detail(t).filter("source = 'rocket'")
    hard = rows.filter("tp = 0").groupBy("family").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3").select("family", F.lit(1).alias("hard"))
    tagged = fired(t).join(hard, "family", "left")
    return tagged.filter(F.col("source") == F.when(F.col("hard") == 1, "multi").otherwise("rocket")).select("dataset", "idx")


@query("large_data_strategies", "support sizes scores fused_order fired", """
WITH big AS (SELECT dataset, n FROM sizes WHERE n >= 25), two AS (SELECT dataset, idx FROM support WHERE b >= 2)
SELECT 'union_fused' AS strategy, dataset, idx FROM (SELECT dataset, idx FROM two UNION SELECT dataset, idx FROM fused_order SEMI JOIN big USING (dataset) WHERE place <= 2)
UNION ALL SELECT 'switch_fused', dataset, idx FROM two ANTI JOIN big USING (dataset)
UNION ALL SELECT 'switch_fused', dataset, idx FROM fused_order SEMI JOIN big USING (dataset) WHERE place <= 2
UNION ALL SELECT 'guard_fused', dataset, idx FROM fused_order SEMI JOIN big USING (dataset) SEMI JOIN (SELECT * FROM fired WHERE source = 'rocket') r USING (dataset, idx) WHERE place <= 4
UNION ALL SELECT 'guard_fused', dataset, idx FROM two ANTI JOIN big USING (dataset)""")
def _(t):
    return S.large_data_strategies(test_all(t), fired(t), S.test_sizes(test(t)), 25)
