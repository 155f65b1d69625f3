"""Queries for reranking, review picks and lanes."""

from pyspark.sql import functions as F

from outlane.functions.columns import r6 as R6
from outlane.operators import fusion as U
from outlane.operators import rerank as R
from outlane.operators import selection as S
from outlane.plans.fusion import reliabilities
from outlane.plans.registry import fragment, query, r6
from outlane.plans.selection import exceed, fired, test, test_all

W = {"rocket": 0.36, "image_a": 0.22, "image_b": 0.22, "multi": 0.20}
WSQL = "CASE source WHEN 'rocket' THEN 0.36 WHEN 'multi' THEN 0.20 ELSE 0.22 END"

fragment("rank12", "base_ranks", "SELECT * FROM base_ranks WHERE rank <= 12")
fragment("hard", "fired", "SELECT dataset, idx FROM fired WHERE source = 'rocket' QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score, idx) = 1")
fragment("pool", "rank12 hard", "SELECT dataset, idx FROM rank12 WHERE rank <= 8 UNION SELECT dataset, idx FROM hard")
fragment("scored", "pool rank12", f"""
SELECT p.dataset, p.idx, round(coalesce(sum({WSQL} * (13 - rank) / 12), 0) + 0.08 * greatest(0, count(rank) - 1), 9) AS score, count(rank) AS support,
  coalesce(min(rank), 13) AS best_rank, coalesce(CAST(sum(rank) AS BIGINT), 999) AS rank_sum FROM pool p LEFT JOIN rank12 r ON r.dataset = p.dataset AND r.idx = p.idx GROUP BY 1, 2""")
BEST = "score DESC, support DESC, best_rank, rank_sum, idx"


def hard(t):
    """A deliberately thin base: per dataset the weakest fired row."""
    rows = fired(t, "rocket")
    return rows.groupBy("dataset").agg(F.min_by("idx", F.struct("score", "idx")).alias("idx"))


def ranks(t):
    return t.once("ranks", lambda: R.rank_map(test_all(t)))


def scored(t):
    r = ranks(t)
    return t.once("scored", lambda: R.score_candidates(S.union(r.filter("rank <= 8"), hard(t)), r, W))


@query("rank_map", "rank12", "SELECT dataset, source, idx, rank FROM rank12")
def _(t):
    return ranks(t).select("dataset", "source", "idx", "rank")


@query("candidate_scoring", "scored", f"SELECT dataset, idx, {r6('score')} AS score, support, best_rank, rank_sum FROM scored")
def _(t):
    return scored(t).withColumn("score", R6("score"))


@query("candidate_ordering", "scored", f"SELECT dataset, idx, row_number() OVER (PARTITION BY dataset ORDER BY {BEST}) AS place FROM scored")
def _(t):
    return R.candidate_order(scored(t)).select("dataset", "idx", "place")


fragment("weak", "hard scored", "SELECT h.dataset, h.idx FROM hard h LEFT JOIN scored s USING (dataset, idx) WHERE coalesce(support, 0) <= 1 AND coalesce(best_rank, 99) > 5")


@query("weak_base_alerts", "weak", "SELECT dataset, idx FROM weak")
def _(t):
    return R.weak_base(hard(t), scored(t))


@query("weak_index_filter", "hard scored", """
SELECT h.dataset, h.idx FROM hard h LEFT JOIN scored s USING (dataset, idx) WHERE coalesce(support, 0) <= 2 AND coalesce(best_rank, 99) >= 3 AND coalesce(score, 0) <= 0.5""")
def _(t):
    return R.weak_base(hard(t), scored(t), 2, 3, 0.5)


fragment("outside", "scored hard", f"""
SELECT s.*, round(score - coalesce(base_best, 0), 9) AS gain FROM scored s ANTI JOIN hard h ON h.dataset = s.dataset AND h.idx = s.idx
LEFT JOIN (SELECT dataset AS d, max(score) AS base_best FROM scored SEMI JOIN hard USING (dataset, idx) GROUP BY 1) b ON b.d = s.dataset""")


@query("consensus_top_candidate", "outside", f"""
SELECT dataset, idx, {r6('score')} AS score, support, best_rank, {r6('gain')} AS gain FROM outside WHERE support >= 2 AND best_rank <= 3 AND gain >= 0.04
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {BEST}) = 1""")
def _(t):
    got = R.best_outside(scored(t), hard(t), 2, 3, 0.04)
    return got.withColumn("score", R6("score")).withColumn("gain", R6("gain"))


fragment("decision", "outside hard weak sizes train", f"""
WITH o AS (SELECT * FROM outside QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {BEST}) = 1)
SELECT z.dataset, o.idx AS top_candidate, support, best_rank, gain, CASE WHEN n_train > 10 AND base_n <= 1 AND weak_n > 0 AND support >= 2 AND best_rank <= 3 AND gain >= 0.04 THEN 1 ELSE 0 END AS replaced
FROM sizes z LEFT JOIN o ON o.dataset = z.dataset
LEFT JOIN (SELECT dataset, count(*) AS n_train FROM train GROUP BY 1) n ON n.dataset = z.dataset
LEFT JOIN (SELECT dataset, count(*) AS base_n FROM hard GROUP BY 1) b ON b.dataset = z.dataset
LEFT JOIN (SELECT dataset, count(*) AS weak_n FROM weak GROUP BY 1) w ON w.dataset = z.dataset""")


def decision(t):
    counts = t.score().filter("split = 'TRAIN'").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_train"))
    names = S.test_sizes(test(t)).select("dataset")
    return t.once("decision", lambda: R.replace_weak(hard(t), scored(t), counts, names))


@query("replacement_decision", "decision", f"SELECT dataset, top_candidate, support, best_rank, {r6('gain')} AS gain, replaced FROM decision")
def _(t):
    return decision(t).withColumn("gain", R6("gain"))


@query("weak_alert_replacement", "decision hard weak", """
SELECT dataset, idx FROM hard h WHERE NOT (EXISTS (SELECT 1 FROM weak w WHERE w.dataset = h.dataset AND w.idx = h.idx) AND dataset IN (SELECT dataset FROM decision WHERE replaced = 1))
UNION SELECT dataset, top_candidate FROM decision WHERE replaced = 1""")
def _(t):
    return R.apply_replacement(hard(t), scored(t), decision(t))


@query("source_guarded_orders", "rank12 exceed", """
SELECT r.dataset, r.source, idx, rank FROM rank12 r JOIN exceed e ON e.dataset = r.dataset AND e.source = r.source
WHERE r.source NOT IN ('multi', 'image_b') OR (r.source = 'multi' AND exceed_rate <= 0.09) OR (r.source = 'image_b' AND exceed_rate <= 0.095)""")
def _(t):
    return R.guard_orders(ranks(t), exceed(t), {"multi": 0.09, "image_b": 0.095}).select("dataset", "source", "idx", "rank")


@query("review_pick", "outside", f"""
SELECT dataset, idx, row_number() OVER (PARTITION BY dataset ORDER BY {BEST}) AS place FROM outside WHERE support >= 2 AND best_rank <= 4 AND score >= 0.3 QUALIFY place <= 2""")
def _(t):
    return R.pick_review(scored(t), hard(t), 2, 2, 4, 0.3).select("dataset", "idx", "place")


@query("reliability_weighted_top1", "reliability base_ranks", f"""
WITH w AS (SELECT dataset, source, raw / sum(raw) OVER (PARTITION BY dataset) AS weight FROM (SELECT *, CASE source WHEN 'rocket' THEN 0.45 ELSE 0.275 END * (0.25 + reliability) AS raw FROM reliability)),
c AS (SELECT r.dataset, idx, round(sum(weight * (13 - rank) / 12), 9) AS score, count(*) AS support, min(rank) AS best_rank, sum(rank) AS rank_sum FROM base_ranks r JOIN w ON w.dataset = r.dataset AND w.source = r.source WHERE rank <= 12 GROUP BY 1, 2)
SELECT dataset, idx, {r6('score')} AS score, support FROM c WHERE support >= 2 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {BEST}) = 1""")
def _(t):
    weights = U.adaptive_weights(reliabilities(t))
    got = R.weighted_candidates(ranks(t), weights).filter("support >= 2")
    return R.candidate_order(got).filter("place = 1").select("dataset", "idx", R6("score").alias("score"), "support")


@query("budgeted_consensus", "outside hard sizes", f"""
SELECT dataset, idx FROM hard UNION SELECT dataset, idx FROM (SELECT o.dataset, o.idx FROM outside o JOIN sizes USING (dataset) WHERE support >= 2
  QUALIFY row_number() OVER (PARTITION BY o.dataset ORDER BY {BEST}) <= CASE WHEN n >= 25 THEN 2 ELSE 1 END)""")
def _(t):
    budget = S.test_sizes(test(t)).select("dataset", F.when(F.col("n") >= 25, 2).otherwise(1).alias("budget"))
    return R.budgeted_consensus(scored(t), hard(t), budget)


@query("independent_support_review", "rank12 hard", """
WITH g AS (SELECT dataset, idx, min(CASE WHEN source = 'rocket' THEN rank END) AS own, count(CASE WHEN source <> 'rocket' AND rank <= 6 THEN 1 END) AS other
  FROM rank12 ANTI JOIN hard USING (dataset, idx) GROUP BY 1, 2)
SELECT dataset, idx FROM g WHERE own <= 5 AND other >= 2 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY own, idx) = 1""")
def _(t):
    return R.independent_review(ranks(t), hard(t), "rocket", 5, 6, 2)


fragment("block_review", "fired hard train", """
SELECT b.dataset, b.idx FROM (SELECT * FROM fired WHERE source = 'image_b') b SEMI JOIN (SELECT * FROM fired WHERE source = 'rocket') a USING (dataset, idx)
ANTI JOIN hard USING (dataset, idx) SEMI JOIN (SELECT dataset FROM train GROUP BY 1 HAVING count(*) > 10) c USING (dataset)
QUALIFY row_number() OVER (PARTITION BY b.dataset ORDER BY b.score DESC, b.idx) = 1""")


def calibrated(t):
    return t.score().filter("split = 'TRAIN'").groupBy("dataset").agg(F.count(F.lit(1)).alias("c")).filter("c > 10").select("dataset")


def block_review(t):
    return R.block_review(fired(t, "rocket"), fired(t, "image_b"), hard(t), calibrated(t))


@query("block_review_candidate", "block_review", "SELECT * FROM block_review")
def _(t):
    return block_review(t)


@query("two_block_alert", "fired", "SELECT dataset, idx FROM (SELECT * FROM fired WHERE source = 'rocket') SEMI JOIN (SELECT * FROM fired WHERE source = 'image_b') USING (dataset, idx)")
def _(t):
    return S.intersect(fired(t, "rocket"), fired(t, "image_b")).select("dataset", "idx")


@query("two_block_joint_exceed", "scores all_cap", """
WITH f AS (SELECT s.dataset, s.source, idx FROM scores s JOIN all_cap USING (dataset, source) WHERE split = 'TRAIN' AND score > threshold)
SELECT dataset, count(*) AS joint_exceed FROM (SELECT * FROM f WHERE source = 'rocket') SEMI JOIN (SELECT * FROM f WHERE source = 'image_b') USING (dataset, idx) GROUP BY 1""")
def _(t):
    from outlane.plans.selection import caps_all
    hits = S.above(t.scores().filter("split = 'TRAIN'"), caps_all(t), ["dataset", "source"])
    return R.joint_exceed(hits.filter("source = 'rocket'"), hits.filter("source = 'image_b'"))


fragment("tiers", "hard fired", """
SELECT h.dataset, h.idx, CASE WHEN b.idx IS NOT NULL THEN 'high' ELSE 'standard' END AS tier FROM hard h
LEFT JOIN (SELECT dataset, idx FROM fired WHERE source = 'image_b') b USING (dataset, idx)""")


def tiers(t):
    return R.confidence_tiers(hard(t), fired(t, "image_b"))


@query("confidence_tiers", "tiers", "SELECT * FROM tiers")
def _(t):
    return tiers(t)


fragment("priority", "block_review tiers fired", """
SELECT dataset, idx FROM block_review WHERE dataset NOT IN (SELECT dataset FROM tiers WHERE tier = 'high') AND dataset IN (SELECT dataset FROM tiers WHERE tier = 'standard')
  AND (dataset, idx) IN (SELECT (dataset, idx) FROM fired WHERE source = 'multi')""")


def priority(t):
    split = tiers(t)
    return R.confirm_priority(block_review(t), split.filter("tier = 'high'"), split.filter("tier = 'standard'"), fired(t, "multi"))


@query("review_then_priority", "priority", "SELECT dataset, idx FROM priority")
def _(t):
    return priority(t).select("dataset", "idx")


fragment("signals", "decision fired exceed", """
SELECT d.dataset, coalesce(predicted, 0) AS predicted, a.exceed_rate / 8 AS exceed_rate, m.mx / 8 AS max_exceed_rate, support, gain FROM decision d
LEFT JOIN (SELECT dataset, count(*) AS predicted FROM fired WHERE source = 'rocket' GROUP BY 1) f ON f.dataset = d.dataset
JOIN (SELECT * FROM exceed WHERE source = 'rocket') a ON a.dataset = d.dataset JOIN (SELECT dataset, max(exceed_rate) AS mx FROM exceed GROUP BY 1) m ON m.dataset = d.dataset""")
fragment("gate", "signals", "SELECT dataset FROM signals WHERE predicted <= 1 AND exceed_rate <= 0.015 AND max_exceed_rate <= 0.015 AND support >= 4 AND gain <= 0.30")


def gate(t):
    ex = exceed(t)
    rows = decision(t).select("dataset", "support", "gain").join(
        fired(t, "rocket").groupBy("dataset").agg(F.count(F.lit(1)).alias("predicted")), "dataset", "left").fillna(0, ["predicted"])
    own = ex.filter("source = 'rocket'").select("dataset", (F.col("exceed_rate") / 8).alias("exceed_rate"))
    worst = ex.groupBy("dataset").agg((F.max("exceed_rate") / 8).alias("max_exceed_rate"))
    return R.weak_signal(rows.join(own, "dataset").join(worst, "dataset")).select("dataset")


@query("weak_signal_gate", "gate", "SELECT dataset FROM gate")
def _(t):
    return gate(t)


@query("context_agreement_guard", "fired hard rank12", """
SELECT DISTINCT dataset FROM (SELECT * FROM fired WHERE source = 'image_a') WHERE (dataset, idx) IN (SELECT (dataset, idx) FROM hard UNION SELECT (dataset, idx) FROM rank12 WHERE source = 'rocket' AND rank = 1)""")
def _(t):
    return R.agreement_guard(fired(t, "image_a"), hard(t), ranks(t).filter("source = 'rocket' and rank = 1"))


def _gated_sql(sources, cap, gate_rel):
    parts = " UNION ALL ".join(
        f"""SELECT dataset, idx, {i} AS l, rank FROM rank12 WHERE source = '{s}' AND rank <= 3 AND dataset IN (SELECT dataset FROM {gate_rel})
  AND dataset IN (SELECT dataset FROM rank12 WHERE source = '{s}' AND rank <= 3 AND (dataset, idx) IN (SELECT (dataset, idx) FROM pool_top))""" for i, s in enumerate(sources))
    return f"""WITH pool_top AS (SELECT dataset, idx FROM hard UNION SELECT dataset, idx FROM rank12 WHERE source = 'rocket' AND rank <= 2),
u AS (SELECT dataset, idx, min(l * 100 + rank) AS o FROM ({parts}) GROUP BY 1, 2)
SELECT dataset, idx, row_number() OVER (PARTITION BY dataset ORDER BY o, idx) AS place FROM u QUALIFY place <= {cap}"""


def _gated(t, sources, cap, allowed):
    r = ranks(t)
    context = S.union(hard(t), r.filter("source = 'rocket' and rank <= 2"))
    lists = [r.filter((F.col("source") == s) & (F.col("rank") <= 3)) for s in sources]
    return R.gated_review(lists, allowed, context, cap).select("dataset", "idx", "place")


@query("higher_dimension_review", "gate rank12 hard", _gated_sql(["multi", "image_b", "image_a"], 3, "gate"))
def _(t):
    return _gated(t, ["multi", "image_b", "image_a"], 3, gate(t))


fragment("calm_sets", "exceed", "SELECT dataset FROM exceed WHERE source = 'multi' AND exceed_rate / 8 <= 0.0115")


@query("gated_combination_review", "calm_sets rank12 hard", _gated_sql(["image_b", "multi"], 4, "calm_sets"))
def _(t):
    calm = exceed(t).filter("source = 'multi' and exceed_rate / 8 <= 0.0115").select("dataset")
    return _gated(t, ["image_b", "multi"], 4, calm)


@query("feature_source_review", "gate rank12 hard", _gated_sql(["image_a", "multi"], 3, "gate"))
def _(t):
    return _gated(t, ["image_a", "multi"], 3, gate(t))


@query("review_lane_policies", "hard outside", f"""
WITH r AS (SELECT dataset, idx, row_number() OVER (PARTITION BY dataset ORDER BY {BEST}) AS place FROM outside WHERE support >= 2 AND best_rank <= 4 AND score >= 0.3 QUALIFY place <= 3),
p AS (SELECT unnest(['hard_only', 'top1', 'top2', 'top3']) AS policy, unnest([0, 1, 2, 3]) AS k)
SELECT policy, dataset, idx, 0 AS review FROM hard, p UNION ALL SELECT policy, dataset, idx, 1 FROM r, p WHERE place <= k""")
def _(t):
    return R.review_policies(hard(t), R.pick_review(scored(t), hard(t), 3, 2, 4, 0.3))


fragment("lanes", "tiers priority outside", f"""
SELECT dataset, idx, lane FROM (
  SELECT dataset, idx, 0 AS o, 'hard' AS lane FROM tiers WHERE tier = 'high'
  UNION ALL SELECT dataset, idx, 1, 'standard_review' FROM tiers WHERE tier = 'standard'
  UNION ALL SELECT dataset, idx, 1, 'standard_review' FROM outside WHERE support >= 3 AND best_rank <= 2
  UNION ALL SELECT dataset, idx, 2, 'priority_review' FROM priority) QUALIFY row_number() OVER (PARTITION BY dataset, idx ORDER BY o) = 1""")


def lanes(t):
    split = tiers(t)
    extra = S.minus(scored(t), hard(t)).filter("support >= 3 and best_rank <= 2")
    return R.route(split.filter("tier = 'high'"), S.union(split.filter("tier = 'standard'"), extra), priority(t), S.test_sizes(test(t)))


@query("lane_routing", "lanes", "SELECT * FROM lanes")
def _(t):
    return lanes(t)


fragment("evidence_lanes", "test support fired", """
SELECT t.dataset, t.idx, CASE WHEN s.idx IS NULL OR s.b < 2 THEN 'none' WHEN m.idx IS NOT NULL THEN 'hard' WHEN a.idx IS NOT NULL THEN 'priority_review' ELSE 'standard_review' END AS lane
FROM test t LEFT JOIN support s USING (dataset, idx) LEFT JOIN (SELECT dataset, idx FROM fired WHERE source = 'multi') m USING (dataset, idx)
LEFT JOIN (SELECT dataset, idx FROM fired WHERE source = 'image_a') a USING (dataset, idx)""")


def evidence_lanes(t):
    return R.route_by_evidence(S.at_least(fired(t), 2, list(S.BASE)), fired(t, "multi"), fired(t, "image_a"), test(t))


@query("lane_routing_by_evidence", "evidence_lanes", "SELECT * FROM evidence_lanes")
def _(t):
    return evidence_lanes(t)


@query("policy_chain", "decision hard weak fired test", """
WITH f AS (SELECT dataset, idx FROM hard h WHERE NOT (EXISTS (SELECT 1 FROM weak w WHERE w.dataset = h.dataset AND w.idx = h.idx) AND dataset IN (SELECT dataset FROM decision WHERE replaced = 1))
           UNION SELECT dataset, top_candidate FROM decision WHERE replaced = 1),
r AS (SELECT * FROM f UNION ALL SELECT dataset, idx FROM (SELECT dataset, idx FROM test QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, idx) = 1) WHERE dataset NOT IN (SELECT dataset FROM f))
SELECT dataset, idx, CASE WHEN b.idx IS NOT NULL THEN 'high' ELSE 'standard' END AS tier FROM r LEFT JOIN (SELECT dataset, idx FROM fired WHERE source = 'image_b') b USING (dataset, idx)""")
def _(t):
    replaced = R.apply_replacement(hard(t), scored(t), decision(t))
    top = S.top_k(test(t), 1, later_first=False).select("dataset", "idx", F.lit(0).alias("priority"))
    repaired = S.repair_silent(replaced, top, S.test_sizes(test(t)).select("dataset"))
    return R.confidence_tiers(repaired, fired(t, "image_b"))


@query("family_fold", "test", "SELECT DISTINCT family, CAST(CAST('0x' || substr(sha256(family), 1, 16) AS UBIGINT) % 5 AS INTEGER) AS fold FROM test")
def _(t):
    return test(t).select("family").distinct().select("family", R.family_fold("family").alias("fold"))
