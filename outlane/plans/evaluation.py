"""Queries for metrics, comparisons, report tables and logs."""

from pyspark.sql import functions as F

from outlane.functions.columns import r6 as R6
from outlane.operators import evaluate as E
from outlane.operators import reports as P
from outlane.operators import selection as S
from outlane.operators import thresholds as T
from outlane.plans.registry import fragment, query, r6
from outlane.plans.review import evidence_lanes, hard, lanes, scored
from outlane.plans.selection import detail, exceed, fired, test, test_all

DSS = ["dataset", "source"]
F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END"
PREC = "tp / greatest(1, tp + fp)"
REC = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"
CONF = "count(CASE WHEN pred = 1 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN pred = 1 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN pred = 0 AND y = 1 THEN 1 END) AS fn"


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, R6(c))
    return df


def labelled(t):
    return test_all(t).join(t.truth().drop("family"), ["dataset", "idx"])


fragment("labelled", "scores truth", "SELECT s.dataset, s.family, s.source, s.idx, score, y FROM scores s JOIN truth t ON t.dataset = s.dataset AND t.idx = s.idx WHERE split = 'TEST'")


@query("confusion_per_dataset", "truth hard", f"""
SELECT dataset, tp, fp, fn, {r6(PREC)} AS precision, {r6(REC)} AS recall, {r6(F1)} AS f1 FROM (
  SELECT dataset, {CONF} FROM (SELECT t.dataset, y, CASE WHEN h.idx IS NULL THEN 0 ELSE 1 END AS pred FROM truth t LEFT JOIN hard h ON h.dataset = t.dataset AND h.idx = t.idx) GROUP BY 1)""")
def _(t):
    return rounded(E.confusion(E.index_flags(t.truth(), hard(t))), "precision", "recall", "f1")


@query("threshold_evaluation", "detail", f"SELECT dataset, source, tp, fp, fn, {r6(PREC)} AS precision, {r6('f1')} AS f1 FROM detail")
def _(t):
    return rounded(detail(t), "precision", "f1").drop("family", "recall")


@query("index_set_evaluation", "truth fired", f"""
SELECT dataset, source, tp, fp, fn, {r6(F1)} AS f1 FROM (SELECT dataset, source, {CONF} FROM (
  SELECT t.dataset, s.source, y, CASE WHEN f.idx IS NULL THEN 0 ELSE 1 END AS pred FROM truth t CROSS JOIN (SELECT unnest(['rocket', 'multi']) AS source) s
  LEFT JOIN fired f ON f.dataset = t.dataset AND f.idx = t.idx AND f.source = s.source) GROUP BY 1, 2)""")
def _(t):
    rows = t.truth().withColumn("source", F.explode(F.array(F.lit("rocket"), F.lit("multi"))))
    return rounded(E.confusion(E.index_flags(rows, fired(t), ["source"]), DSS), "f1").drop("precision", "recall")


@query("auc_roc", "labelled", f"""
SELECT dataset, source, {r6('CASE WHEN np > 0 AND nq > 0 THEN (rs - np * (np + 1) / 2) / (np * nq) ELSE 0.5 END')} AS auc_roc FROM (
  SELECT dataset, source, sum(CASE WHEN y = 1 THEN r END) AS rs, sum(y) AS np, sum(1 - y) AS nq FROM (
    SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY dataset, source, score) - 1) / 2 AS r FROM labelled WINDOW w AS (PARTITION BY dataset, source ORDER BY score)) GROUP BY 1, 2)""")
def _(t):
    return rounded(E.auc_roc(labelled(t), DSS), "auc_roc")


@query("auc_pr", "labelled", f"""
WITH c AS (SELECT dataset, source, score, sum(sum(y)) OVER w AS tp, sum(count(*)) OVER w AS k FROM labelled GROUP BY 1, 2, 3 WINDOW w AS (PARTITION BY dataset, source ORDER BY score DESC)),
p AS (SELECT *, tp / k AS pr, coalesce(lag(tp / k) OVER w, 1) AS pr0, coalesce(lag(tp) OVER w, 0) AS tp0 FROM c WINDOW w AS (PARTITION BY dataset, source ORDER BY score DESC))
SELECT dataset, source, {r6('coalesce(sum(CASE WHEN pos > 0 THEN (tp - tp0) / pos * (pr + pr0) / 2 END), 0)')} AS auc_pr
FROM p JOIN (SELECT dataset, source, sum(y) AS pos FROM labelled GROUP BY 1, 2) USING (dataset, source) GROUP BY 1, 2""")
def _(t):
    return rounded(E.auc_pr(labelled(t), DSS), "auc_pr")


@query("best_k_f1", "labelled", f"""
SELECT dataset, source, {r6('max(CASE WHEN pos > 0 THEN 2 * tp / (k + pos) ELSE 0 END)')} AS best_f1 FROM (
  SELECT *, sum(y) OVER w AS tp, row_number() OVER w AS k, sum(y) OVER (PARTITION BY dataset, source) AS pos FROM labelled WINDOW w AS (PARTITION BY dataset, source ORDER BY score DESC, idx DESC)) GROUP BY 1, 2""")
def _(t):
    return rounded(E.best_k_f1(labelled(t), DSS), "best_f1")


fragment("diagnostics", "labelled", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY dataset, source ORDER BY score DESC, idx) AS rank FROM labelled)
SELECT dataset, source, count(*) AS n, coalesce(min(CASE WHEN y = 1 THEN rank END), count(*)) AS best_rank,
  coalesce(quantile_cont(CASE WHEN y = 1 THEN rank END, 0.5), count(*)) AS median_rank, max(score) AS top_score, coalesce(max(CASE WHEN y = 1 THEN score END), 0) AS best_anomaly_score FROM r GROUP BY 1, 2""")
DIAG = ("median_rank", "best_rank_pct", "top_score", "best_anomaly_score", "top_gap")


@query("rank_diagnostics", "diagnostics", f"""
SELECT dataset, source, n, best_rank, {r6('median_rank')} AS median_rank, {r6('best_rank / n')} AS best_rank_pct, {', '.join(f'CASE WHEN best_rank <= {k} THEN 1 ELSE 0 END AS in_top{k}' for k in (1, 2, 3, 5))},
  CASE WHEN best_rank <= greatest(1, ceil(n * 0.1)) THEN 1 ELSE 0 END AS in_top10pct, {r6('top_score')} AS top_score, {r6('best_anomaly_score')} AS best_anomaly_score, {r6('top_score - best_anomaly_score')} AS top_gap FROM diagnostics""")
def _(t):
    return rounded(E.rank_diagnostics(labelled(t), DSS), *DIAG)


@query("rank_bucket", "diagnostics", """
SELECT dataset, source, CASE WHEN best_rank <= 1 THEN 'top1' WHEN best_rank <= 3 THEN 'top3' WHEN best_rank <= 10 THEN 'top10' WHEN best_rank <= 20 THEN 'top20' ELSE 'beyond20' END AS bucket FROM diagnostics""")
def _(t):
    return E.rank_diagnostics(labelled(t), DSS).select(*DSS, P.rank_bucket("best_rank").alias("bucket"))


fragment("review_set", "outside", "SELECT dataset, idx FROM outside WHERE support >= 3 AND best_rank <= 2")


def review_set(t):
    return S.minus(scored(t), hard(t)).filter("support >= 3 and best_rank <= 2").select("dataset", "idx")


fragment("review_metrics", "truth hard review_set", """
SELECT dataset, CAST(sum(h * y) AS BIGINT) AS hard_tp, CAST(sum(h * (1 - y)) AS BIGINT) AS hard_fp, CAST(sum(r * y) AS BIGINT) AS review_tp, CAST(sum(r * (1 - y)) AS BIGINT) AS review_fp,
  CAST(sum(greatest(h, r) * y) AS BIGINT) AS combined_tp, CAST(sum(greatest(h, r) * (1 - y)) AS BIGINT) AS combined_fp, CAST(sum(y) AS BIGINT) AS pos FROM (
  SELECT t.dataset, y, CASE WHEN h.idx IS NULL THEN 0 ELSE 1 END AS h, CASE WHEN v.idx IS NULL THEN 0 ELSE 1 END AS r FROM truth t
  LEFT JOIN hard h ON h.dataset = t.dataset AND h.idx = t.idx LEFT JOIN review_set v ON v.dataset = t.dataset AND v.idx = t.idx) GROUP BY 1""")


@query("review_metrics", "review_metrics", f"""
SELECT *, {r6('CASE WHEN combined_tp + combined_fp + pos > 0 THEN 2 * combined_tp / (combined_tp + combined_fp + pos) ELSE 0 END')} AS combined_f1, CASE WHEN hard_tp = 0 AND review_tp > 0 THEN 1 ELSE 0 END AS rescued FROM review_metrics""")
def _(t):
    return rounded(P.review_metrics(hard(t), review_set(t), t.truth()), "combined_f1")


@query("lane_metrics", "lanes truth", f"""
WITH h AS (SELECT l.dataset, lane, y FROM lanes l JOIN truth t ON t.dataset = l.dataset AND t.idx = l.idx),
g AS (SELECT dataset, coalesce(lane, 'combined') AS lane, CAST(sum(y) AS BIGINT) AS tp, CAST(sum(1 - y) AS BIGINT) AS fp FROM h GROUP BY GROUPING SETS ((dataset, lane), (dataset))),
a AS (SELECT g.*, pos - tp AS fn FROM g JOIN (SELECT dataset, CAST(sum(y) AS BIGINT) AS pos FROM truth GROUP BY 1) USING (dataset))
SELECT dataset, lane, tp, fp, fn, {r6(PREC)} AS precision, {r6(F1)} AS f1 FROM a""")
def _(t):
    return rounded(P.lane_metrics(lanes(t), t.truth()), "precision", "f1")


@query("config_summary", "detail", f"""
SELECT *, {r6('(SELECT avg(m) FROM (SELECT avg(f1) AS m FROM detail d WHERE d.source = s.source GROUP BY family))')} AS family_macro_f1 FROM (
  SELECT source, count(*) AS datasets, {r6('avg(f1)')} AS mean_f1, count(CASE WHEN f1 = 0 THEN 1 END) AS zero_f1, count(CASE WHEN f1 >= 0.5 THEN 1 END) AS f1_ge_half,
    {r6('avg(fp)')} AS mean_fp, {r6('quantile_cont(f1, 0.5)')} AS median_f1, {r6('quantile_cont(f1, 0.25)')} AS p25_f1 FROM detail GROUP BY 1) s""")
def _(t):
    return rounded(E.config_summary(detail(t), ["source"]), "mean_f1", "mean_fp", "median_f1", "p25_f1", "family_macro_f1")


@query("family_macro", "detail", f"SELECT source, {r6('avg(m)')} AS family_macro_f1 FROM (SELECT source, family, avg(f1) AS m FROM detail GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return rounded(E.family_macro(detail(t), ["source"]), "family_macro_f1")


QS = ("micro_precision", "macro_f1", "mean_fp", "alerts_per_100")


@query("micro_macro_summary", "detail", f"""
SELECT source, count(*) AS datasets, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {r6('sum(tp) / greatest(1, sum(tp + fp))')} AS micro_precision,
  {r6('avg(f1)')} AS macro_f1, count(CASE WHEN f1 = 0 THEN 1 END) AS zero_f1, {r6('avg(fp)')} AS mean_fp, {r6('100 * sum(tp + fp) / count(*)')} AS alerts_per_100 FROM detail GROUP BY 1""")
def _(t):
    return rounded(E.quality_summary(detail(t), ["source"]), *QS)


WL = ("mean", "median", "p90", "p95")


@query("workload_summary", "detail", f"""
SELECT source, {r6('avg(n)')} AS mean, max(n) AS max, count(CASE WHEN n = 0 THEN 1 END) AS zero, count(CASE WHEN n >= 5 THEN 1 END) AS ge5, count(CASE WHEN n >= 10 THEN 1 END) AS ge10,
  {r6('quantile_cont(n, 0.5)')} AS median, {r6('quantile_cont(n, 0.9)')} AS p90, {r6('quantile_cont(n, 0.95)')} AS p95 FROM (SELECT source, tp + fp AS n FROM detail) GROUP BY 1""")
def _(t):
    return rounded(E.workload_summary(detail(t).withColumn("n", F.col("tp") + F.col("fp")), ["source"]), *WL)


ALPHAS = (0.05, 0.1, 0.2)


@query("conformal_alpha_summary", "pvalues truth", f"""
WITH c AS (SELECT p.dataset, p.idx, alpha, count(CASE WHEN p <= alpha THEN 1 END) >= 2 AS sel, any_value(n) AS n FROM pvalues p, (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS alpha) WHERE split = 'TEST' GROUP BY 1, 2, 3),
d AS (SELECT c.dataset, alpha, count(CASE WHEN sel AND y = 1 THEN 1 END) AS tp, count(CASE WHEN sel AND y = 0 THEN 1 END) AS fp, count(CASE WHEN NOT sel AND y = 1 THEN 1 END) AS fn,
        max(CASE WHEN 1 / (n + 1) > alpha THEN 1 ELSE 0 END) AS blocked FROM c JOIN truth t ON t.dataset = c.dataset AND t.idx = c.idx GROUP BY 1, 2)
SELECT alpha, count(*) AS datasets, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, {r6('sum(tp) / greatest(1, sum(tp + fp))')} AS micro_precision, {r6(f'avg({F1})')} AS macro_f1, CAST(sum(blocked) AS BIGINT) AS blocked FROM d GROUP BY 1""")
def _(t):
    from outlane.plans.fusion import pvalues
    alpha = F.explode(F.array(*[F.lit(a) for a in ALPHAS]))
    train = t.score().filter("split = 'TRAIN'").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    rows = pvalues(t).withColumn("alpha", alpha).groupBy("dataset", "idx", "alpha").agg(
        (F.count_if(F.col("p") <= F.col("alpha")) >= 2).cast("int").alias("pred"))
    per = E.confusion(rows.join(t.truth().drop("family"), ["dataset", "idx"]), ["dataset", "alpha"]).join(train, "dataset")
    per = per.withColumn("blocked", (1 / (F.col("n") + 1) > F.col("alpha")).cast("int"))
    got = per.groupBy("alpha").agg(F.count(F.lit(1)).alias("datasets"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                   (F.sum("tp") / F.greatest(F.lit(1), F.sum(F.col("tp") + F.col("fp")))).alias("micro_precision"),
                                   F.avg("f1").alias("macro_f1"), F.sum("blocked").alias("blocked"))
    return rounded(got, "micro_precision", "macro_f1")


@query("family_fold_audit", "detail", f"""
WITH f AS (SELECT source, CAST(CAST('0x' || substr(sha256(family), 1, 16) AS UBIGINT) % 5 AS INTEGER) AS fold, sum(tp) / greatest(1, sum(tp + fp)) AS p, avg(f1) AS f FROM detail GROUP BY 1, 2)
SELECT source, count(*) AS folds, {r6('min(p)')} AS min_precision, {r6('max(p)')} AS max_precision, {r6('min(f)')} AS min_f1, {r6('max(f)')} AS max_f1 FROM f GROUP BY 1""")
def _(t):
    from outlane.operators.rerank import family_fold
    folds = E.quality_summary(detail(t).withColumn("fold", family_fold("family")), ["source", "fold"])
    got = folds.groupBy("source").agg(F.count(F.lit(1)).alias("folds"), F.min("micro_precision").alias("min_precision"), F.max("micro_precision").alias("max_precision"),
                                      F.min("macro_f1").alias("min_f1"), F.max("macro_f1").alias("max_f1"))
    return rounded(got, "min_precision", "max_precision", "min_f1", "max_f1")


@query("binding_budget_audit", "fired_rocket sizes", """
SELECT dataset, before, after, before - after AS removed FROM (SELECT dataset, count(*) AS before, least(count(*), CAST(any_value(b) AS BIGINT)) AS after FROM
  (SELECT f.dataset, greatest(1, least(3, ceil(n * 0.05))) AS b FROM fired_rocket f JOIN sizes USING (dataset)) GROUP BY 1)""")
def _(t):
    rows, sizes = fired(t, "rocket"), S.test_sizes(test(t))
    before = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("before"))
    after = S.cap_rate_max(rows, sizes, 0.05, 3).groupBy("dataset").agg(F.count(F.lit(1)).alias("after"))
    return before.join(after, "dataset").withColumn("removed", F.col("before") - F.col("after"))


NAMES = ("hard", "standard_review", "priority_review")
fragment("grid", "sizes", "SELECT dataset, lane FROM sizes, (SELECT unnest(['hard', 'standard_review', 'priority_review']) AS lane)")
fragment("both_lanes", "lanes evidence_lanes", """
SELECT dataset, idx, a.lane AS a, b.lane AS b FROM lanes a FULL JOIN (SELECT * FROM evidence_lanes WHERE lane <> 'none') b USING (dataset, idx)""")


def named(t):
    return S.test_sizes(test(t)).select("dataset")


def second_lanes(t):
    return evidence_lanes(t).filter("lane <> 'none'")


@query("lane_diff", "grid both_lanes", f"""
WITH c AS (SELECT g.dataset, g.lane, count(CASE WHEN a = g.lane AND b = g.lane THEN 1 END) AS shared, count(CASE WHEN a = g.lane OR b = g.lane THEN 1 END) AS either FROM grid g LEFT JOIN both_lanes l USING (dataset) GROUP BY 1, 2)
SELECT dataset, lane, CASE WHEN shared = either THEN 1 ELSE 0 END AS exact, {r6('CASE WHEN either = 0 THEN 1 ELSE shared / either END')} AS jaccard FROM c""")
def _(t):
    return rounded(P.lane_diff(lanes(t), second_lanes(t), list(NAMES), named(t)), "jaccard")


@query("lane_jaccard", "sizes fired", f"""
WITH a AS (SELECT dataset, idx FROM fired WHERE source = 'rocket' AND score > 150), b AS (SELECT dataset, idx FROM fired WHERE source = 'multi' AND score > 100),
f AS (SELECT dataset, count(*) AS either, count(CASE WHEN a.idx IS NOT NULL AND b.idx IS NOT NULL THEN 1 END) AS shared FROM a FULL JOIN b USING (dataset, idx) GROUP BY 1)
SELECT dataset, {r6('CASE WHEN either IS NULL THEN 1 ELSE shared / either END')} AS jaccard FROM sizes LEFT JOIN f USING (dataset)""")
def _(t):
    return rounded(P.jaccard(fired(t, "rocket").filter("score > 150"), fired(t, "multi").filter("score > 100"), named(t)), "jaccard")


@query("top_set_jaccard", "sizes base_ranks", f"""
WITH f AS (SELECT dataset, count(*) AS either, count(CASE WHEN c = 2 THEN 1 END) AS shared FROM (SELECT dataset, idx, count(*) AS c FROM base_ranks WHERE rank <= 5 AND source IN ('rocket', 'multi') GROUP BY 1, 2) GROUP BY 1)
SELECT dataset, {r6('shared / either')} AS jaccard FROM sizes JOIN f USING (dataset)""")
def _(t):
    tops = S.source_ranks(test_all(t)).filter("rank <= 5")
    return rounded(P.jaccard(tops.filter("source = 'rocket'"), tops.filter("source = 'multi'"), named(t)), "jaccard")


fragment("chain", "support", "SELECT 'base' AS stage, dataset, idx FROM support WHERE b >= 2 UNION ALL SELECT 'wide', dataset, idx FROM support WHERE b >= 2 OR s >= 2 UNION ALL SELECT 'strict', dataset, idx FROM support WHERE b >= 3")


@query("source_chain_diff", "chain sizes", """
WITH d AS (SELECT 'wide' AS stage, dataset FROM ((SELECT dataset, idx FROM chain WHERE stage = 'base' EXCEPT SELECT dataset, idx FROM chain WHERE stage = 'wide') UNION ALL
             (SELECT dataset, idx FROM chain WHERE stage = 'wide' EXCEPT SELECT dataset, idx FROM chain WHERE stage = 'base'))
  UNION ALL SELECT 'strict', dataset FROM ((SELECT dataset, idx FROM chain WHERE stage = 'strict' EXCEPT SELECT dataset, idx FROM chain WHERE stage = 'wide') UNION ALL
             (SELECT dataset, idx FROM chain WHERE stage = 'wide' EXCEPT SELECT dataset, idx FROM chain WHERE stage = 'strict')))
SELECT stage, (SELECT count(*) FROM sizes) AS datasets, count(DISTINCT dataset) AS changed FROM d GROUP BY 1""")
def _(t):
    rows = fired(t)
    chain = [("base", S.at_least(rows, 2, list(S.BASE))), ("wide", S.threshold_candidates(rows)), ("strict", S.at_least(rows, 3, list(S.BASE)))]
    return P.stage_diff(chain, named(t))


@query("rule_substitution_audit", "test train sizes", f"""
WITH q AS (SELECT dataset, quantile_cont(score, 0.95) AS q5, quantile_cont(score, 0.9) AS q10 FROM train GROUP BY 1),
f AS (SELECT dataset, count(CASE WHEN score > q5 THEN 1 END) AS shared, count(CASE WHEN score > q10 THEN 1 END) AS either FROM test JOIN q USING (dataset) GROUP BY 1)
SELECT dataset, {r6('CASE WHEN either = 0 THEN 1 ELSE shared / either END')} AS jaccard, CASE WHEN shared = either THEN 1 ELSE 0 END AS exact FROM f""")
def _(t):
    train = t.score().filter("split = 'TRAIN'")
    limits = T.sweep(train, ["dataset"], (("quantile_5", "quantile", 0.05), ("quantile_10", "quantile", 0.1)))
    return rounded(P.rule_substitution(S.above(test(t), limits), "quantile_5", "quantile_10", named(t)), "jaccard")


@query("common_support_comparison", "detail", """
SELECT count(*) AS shared, count(CASE WHEN a.tp = b.tp THEN 1 END) AS same_tp, count(CASE WHEN a.fp = b.fp THEN 1 END) AS same_fp
FROM (SELECT * FROM detail WHERE source = 'rocket' AND tp > 0) a JOIN (SELECT * FROM detail WHERE source = 'multi') b USING (dataset)""")
def _(t):
    rows = detail(t)
    return P.shared_comparison(rows.filter("source = 'rocket' and tp > 0"), rows.filter("source = 'multi'"), ["tp", "fp"])


TEXT = "SELECT dataset, lane, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY idx) AS text FROM {0} WHERE lane <> 'none' GROUP BY 1, 2"


@query("index_list_text", "lanes", f"SELECT *, 0 AS part FROM ({TEXT.format('lanes')})")
def _(t):
    return P.lanes_as_text(lanes(t))


@query("index_list_parse", "lanes", "SELECT dataset, lane, idx FROM lanes")
def _(t):
    return P.text_to_rows(P.lanes_as_text(lanes(t)))


@query("selector_replay", "lanes evidence_lanes", f"""
SELECT dataset, lane, CASE WHEN a.text IS NOT DISTINCT FROM b.text THEN 1 ELSE 0 END AS same FROM ({TEXT.format('lanes')}) a FULL JOIN ({TEXT.format('evidence_lanes')}) b USING (dataset, lane)""")
def _(t):
    return P.replay_check(P.lanes_as_text(lanes(t)), second_lanes(t))


@query("replay_diff", "lanes", """
SELECT dataset, lane, CASE WHEN min(idx) = any_value(low) THEN 0 ELSE 1 END AS same FROM lanes JOIN (SELECT dataset, min(idx) AS low FROM lanes GROUP BY 1) USING (dataset) GROUP BY 1, 2""")
def _(t):
    """The replay misses each dataset's first row, so its lane differs."""
    stored = lanes(t)
    first = stored.groupBy("dataset").agg(F.min("idx").alias("idx"))
    return P.replay_check(P.lanes_as_text(stored), stored.join(first, ["dataset", "idx"], "left_anti"))


@query("lane_transitions", "both_lanes", """
SELECT dataset, idx, coalesce(a, 'no_alert') || '->' || coalesce(b, 'no_alert') AS transition FROM both_lanes WHERE a IS DISTINCT FROM b""")
def _(t):
    return P.lane_transitions(lanes(t), second_lanes(t))


@query("candidate_diff", "fired", """
WITH a AS (SELECT dataset, idx FROM fired WHERE source = 'rocket'), b AS (SELECT dataset, idx FROM fired WHERE source = 'multi')
SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _(t):
    return P.candidate_diff(fired(t, "rocket"), fired(t, "multi"))


@query("consistency_check", "fired sizes", """
WITH l AS (SELECT dataset, idx FROM fired WHERE source IN ('rocket', 'image_b')), c AS (SELECT dataset, count(*) AS c FROM l GROUP BY 1)
SELECT DISTINCT dataset, 'overlap' AS rule FROM (SELECT dataset, idx FROM l GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT DISTINCT l.dataset, 'bounds' FROM l JOIN sizes USING (dataset) WHERE idx >= n - 2
UNION ALL SELECT dataset, 'count' FROM sizes LEFT JOIN c USING (dataset) WHERE coalesce(c, 0) <> 5""")
def _(t):
    rows = fired(t).filter("source in ('rocket', 'image_b')")
    sizes = S.test_sizes(test(t))
    shrunk = sizes.withColumn("n", F.col("n") - 2)
    return P.consistency(rows, shrunk, sizes.select("dataset", F.lit(5).alias("count")))


@query("independent_reaggregation", "detail", "SELECT source, CASE WHEN source = 'image_a' THEN 0 ELSE 1 END AS consistent FROM detail GROUP BY 1")
def _(t):
    """One source's stored summary is off by one."""
    rows = detail(t)
    summary = E.quality_summary(rows, ["source"]).select("source", (F.col("tp") + (F.col("source") == "image_a").cast("int")).alias("tp"), "fp", "fn")
    return P.reaggregate(rows, summary, ["source"], ["tp", "fp", "fn"])


@query("tolerance_match", "fired", """WITH RECURSIVE l AS (SELECT dataset, idx, row_number() OVER (PARTITION BY dataset ORDER BY idx) AS i FROM (SELECT DISTINCT dataset, idx FROM fired WHERE source = 'rocket')),
r AS (SELECT dataset, list(DISTINCT idx) AS rs FROM fired WHERE source = 'multi' GROUP BY 1),
g AS (SELECT dataset, CAST(0 AS BIGINT) AS i, coalesce(rs, []) AS free, CAST(0 AS BIGINT) AS matched FROM (SELECT DISTINCT dataset FROM fired WHERE source IN ('rocket', 'multi')) LEFT JOIN r USING (dataset)
  UNION ALL SELECT dataset, i, CASE WHEN best IS NULL THEN free ELSE list_filter(free, lambda v: v <> best.v) END, matched + CASE WHEN best IS NULL THEN 0 ELSE 1 END FROM (
    SELECT g.dataset, l.i, free, matched, list_min(list_transform(list_filter(free, lambda v: abs(v - l.idx) <= 1), lambda v: {'d': abs(v - l.idx), 'v': v})) AS best
    FROM g JOIN l ON l.dataset = g.dataset AND l.i = g.i + 1)),
n AS (SELECT dataset, max(i) AS n FROM l GROUP BY 1)
SELECT g.dataset, matched, i - matched AS left_only, CAST(len(free) AS BIGINT) AS right_only FROM g LEFT JOIN n ON n.dataset = g.dataset WHERE i = coalesce(n, 0)""")
def _(t):
    return P.tolerance_match(fired(t, "rocket"), fired(t, "multi"), 1)


METHODS = ("rocket", "image_a", "image_b", "multi")
fragment("best", "detail", f"""
SELECT *, greatest({', '.join(METHODS)}) AS best, concat_ws(' ', {', '.join(f"CASE WHEN {m} = greatest({', '.join(METHODS)}) THEN '{m}' END" for m in METHODS)}) AS winners,
  {' + '.join(f"CASE WHEN {m} = greatest({', '.join(METHODS)}) THEN 1 ELSE 0 END" for m in METHODS)} AS n_winners FROM (
  SELECT dataset, {', '.join(f"max(CASE WHEN source = '{m}' THEN f1 END) AS {m}" for m in METHODS)} FROM detail GROUP BY 1)""")


@query("best_performer_table", "best", f"SELECT dataset, {', '.join(f'{r6(m)} AS {m}' for m in METHODS)}, {r6('best')} AS best, winners, n_winners FROM best")
def _(t):
    return rounded(P.best_performers(detail(t), list(METHODS)), *METHODS, "best")


@query("method_win_counts", "best", """
SELECT source, count(*) AS wins, count(CASE WHEN n_winners = 1 THEN 1 END) AS sole_wins FROM (SELECT unnest(string_split(winners, ' ')) AS source, n_winners FROM best) GROUP BY 1""")
def _(t):
    return P.win_counts(P.best_performers(detail(t), list(METHODS)))


fragment("counts", "event_rows", "SELECT dataset, family, count(CASE WHEN split = 'TRAIN' THEN 1 END) AS train_count, count(CASE WHEN split = 'TEST' THEN 1 END) AS n_test FROM event_rows GROUP BY 1, 2")


def counts(t):
    is_ = lambda s: F.count_if(F.col("split") == s)
    return t.event_rows().groupBy("dataset", "family").agg(is_("TRAIN").alias("train_count"), is_("TEST").alias("n_test"))


@query("success_failure_profile", "detail counts", f"""
SELECT CASE WHEN f1 = 0 THEN 1 ELSE 0 END AS failed, count(*) AS datasets, {r6('avg(train_count)')} AS mean_train, {r6('avg(n_test)')} AS mean_test, min(train_count) AS min_train, max(train_count) AS max_train
FROM detail d JOIN counts c ON c.dataset = d.dataset WHERE source = 'rocket' GROUP BY 1""")
def _(t):
    return rounded(P.outcome_profile(detail(t).filter("source = 'rocket'").drop("family"), counts(t)), "mean_train", "mean_test")


@query("failure_need_classes", "diagnostics counts labelled", f"""
WITH r AS (SELECT d.dataset, train_count, n, best_rank, best_rank / n AS depth, y AS anomalies FROM diagnostics d JOIN counts c ON c.dataset = d.dataset
  JOIN (SELECT dataset, sum(y) AS y FROM labelled WHERE source = 'rocket' GROUP BY 1) l ON l.dataset = d.dataset WHERE source = 'rocket')
SELECT dataset, CASE WHEN depth > 0.5 THEN 'ranked_low' WHEN best_rank BETWEEN 2 AND 5 THEN 'near_miss' WHEN 50 * anomalies <= n THEN 'rare_event' WHEN train_count < n THEN 'thin_reference' ELSE 'as_expected' END AS primary,
  concat_ws(';', CASE WHEN 50 * anomalies <= n THEN anomalies || ' of ' || n END, CASE WHEN train_count < n THEN 'reference ' || train_count END,
    'first hit ' || CASE WHEN best_rank <= 1 THEN 'top1' WHEN best_rank <= 3 THEN 'top3' WHEN best_rank <= 10 THEN 'top10' WHEN best_rank <= 20 THEN 'top20' ELSE 'beyond20' END) AS reasons FROM r""")
def _(t):
    """Rules of our own over rank, rarity and size; the operator takes any list."""
    rows = labelled(t).filter("source = 'rocket'")
    diag = E.rank_diagnostics(rows, ["dataset"]).select("dataset", "n", "best_rank")
    anomalies = rows.groupBy("dataset").agg(F.sum("y").alias("anomalies"))
    full = diag.join(anomalies, "dataset").join(counts(t), "dataset")
    rare, thin = 50 * F.col("anomalies") <= F.col("n"), F.col("train_count") < F.col("n")
    rules = [("ranked_low", F.col("best_rank") / F.col("n") > 0.5), ("near_miss", F.col("best_rank").between(2, 5)), ("rare_event", rare), ("thin_reference", thin), ("as_expected", F.lit(True))]
    notes = [F.when(rare, F.concat("anomalies", F.lit(" of "), "n")), F.when(thin, F.concat(F.lit("reference "), "train_count")), F.concat(F.lit("first hit "), P.rank_bucket("best_rank"))]
    return P.failure_classes(full, rules, notes)


fragment("detail_exceed", "detail exceed", "SELECT d.*, exceed_rate / 8 AS exceed_rate FROM detail d JOIN exceed e ON e.dataset = d.dataset AND e.source = d.source")


def detail_exceed(t):
    return detail(t).join(exceed(t).select(*DSS, (F.col("exceed_rate") / 8).alias("exceed_rate")), DSS)


TIER = """CASE WHEN mean_f1 >= 0.5 AND mean_fp <= 2 AND mean_exceed <= 0.01 AND coalesce(alert_precision, 1) >= 0.5 THEN 'operational'
  WHEN mean_f1 >= 0.5 AND mean_fp <= 2.5 AND mean_exceed <= 0.015 THEN 'sensitive' WHEN mean_f1 >= 0.5 THEN 'research' ELSE 'hold' END"""
SS = ("mean_f1", "mean_predicted", "mean_tp", "mean_fp", "mean_fn", "mean_exceed", "alert_precision")


def _summary_sql(keys):
    return f"""SELECT {keys}, {', '.join(f'{r6(c)} AS {c}' for c in SS)}, zero_f1, {TIER} AS tier FROM (SELECT *, mean_tp / (mean_tp + mean_fp) AS alert_precision FROM (
  SELECT {keys}, avg(f1) AS mean_f1, count(CASE WHEN f1 = 0 THEN 1 END) AS zero_f1, avg(tp + fp) AS mean_predicted, avg(tp) AS mean_tp, avg(fp) AS mean_fp, avg(fn) AS mean_fn, avg(exceed_rate) AS mean_exceed
  FROM detail_exceed GROUP BY {keys}))"""


@query("strategy_summary", "detail_exceed", _summary_sql("source"))
def _(t):
    return rounded(P.strategy_summary(detail_exceed(t), ["source"]), *SS)


@query("operational_tier", "detail_exceed", f"""
SELECT source, family, CASE WHEN source = 'image_b' THEN 'excluded' WHEN source = 'multi' AND family = 'f0' THEN 'operational' ELSE tier END AS tier FROM ({_summary_sql('source, family')})""")
def _(t):
    marks = F.col("source") == "image_b", (F.col("source") == "multi") & (F.col("family") == "f0")
    return P.strategy_summary(detail_exceed(t), ["source", "family"], *marks).select("source", "family", "tier")


@query("result_file_summary", "detail", f"SELECT source, count(*) AS rows, count(DISTINCT dataset) AS datasets, {r6('avg(f1)')} AS mean_f1, {r6('quantile_cont(f1, 0.5)')} AS median_f1 FROM detail GROUP BY 1")
def _(t):
    from outlane.functions.order import exact_quantiles
    rows = detail(t)
    main = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("dataset").alias("datasets"), F.avg("f1").alias("mean_f1"))
    return rounded(main.join(exact_quantiles(rows, ["source"], "f1", {"median_f1": 0.5}), "source"), "mean_f1", "median_f1")


@query("strategy_grid_evaluation", "labelled", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY dataset, source ORDER BY score DESC, idx DESC) AS rank, count(*) OVER (PARTITION BY dataset, source) AS n FROM labelled),
f AS (SELECT source, strategy, dataset, y, CASE WHEN rank <= CASE strategy WHEN 'top_1' THEN 1 ELSE ceil(sqrt(n)) END THEN 1 ELSE 0 END AS pred FROM r, (SELECT unnest(['top_1', 'sqrt_n_tail']) AS strategy)),
d AS (SELECT source, strategy, dataset, {CONF} FROM f GROUP BY 1, 2, 3)
SELECT source, strategy, {r6(f'avg({F1})')} AS mean_f1, {r6(f'quantile_cont({F1}, 0.5)')} AS median_f1, count(CASE WHEN tp = 0 THEN 1 END) AS zero_f1 FROM d GROUP BY 1, 2""")
def _(t):
    from outlane.functions.order import exact_quantiles, with_position
    rows = labelled(t)
    placed = with_position(rows, DSS, [("score", "desc"), ("idx", "desc")], "rank").join(rows.groupBy(*DSS).agg(F.count(F.lit(1)).alias("n")), DSS)
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), (F.col("rank") <= S.strategy_k(s, F.col("n"))).cast("int").alias("pred")) for s in ("top_1", "sqrt_n_tail")]))
    per = E.confusion(placed.select("source", "dataset", "y", grid.alias("g")).select("source", "dataset", "y", "g.*"), ["source", "strategy", "dataset"])
    keys = ["source", "strategy"]
    main = per.groupBy(*keys).agg(F.avg("f1").alias("mean_f1"), F.count_if(F.col("f1") == 0).alias("zero_f1"))
    return rounded(main.join(exact_quantiles(per, keys, "f1", {"median_f1": 0.5}), keys), "mean_f1", "median_f1")


@query("family_trouble_spots", "detail", f"""
SELECT family, count(DISTINCT dataset) AS datasets, {r6('avg(f1)')} AS mean_f1, count(CASE WHEN f1 = 0 THEN 1 END) AS zero_f1, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
FROM detail WHERE source = 'rocket' GROUP BY 1 ORDER BY sum(fp) DESC, count(CASE WHEN f1 = 0 THEN 1 END) DESC, sum(fn) DESC, avg(f1), family LIMIT 4""")
def _(t):
    return rounded(P.family_trouble(detail(t).filter("source = 'rocket'"), 4), "mean_f1")


@query("top_false_alert_detail", "detail", """
SELECT source, dataset, tp, fp, fn FROM detail QUALIFY row_number() OVER (PARTITION BY source ORDER BY fp DESC, tp + fp DESC, dataset) <= 10""")
def _(t):
    return P.strategy_detail(detail(t)).select("source", "dataset", "tp", "fp", "fn")


@query("run_comparison", "detail", f"""
WITH s AS (SELECT source, avg(f1) AS m FROM detail GROUP BY 1) SELECT source, {r6('m')} AS mean_f1, {r6("m - (SELECT max(m) FROM s WHERE source <> 'multi')")} AS delta FROM s""")
def _(t):
    rows = detail(t).groupBy("source").agg(F.avg("f1").alias("mean_f1")).withColumn("excluded", (F.col("source") == "multi").cast("int"))
    return rounded(P.run_comparison(rows), "mean_f1", "delta")


@query("catalog_snapshot", "counts", f"""
SELECT count(*) AS datasets, CAST(sum(train_count) AS BIGINT) AS train_rows, CAST(sum(n_test) AS BIGINT) AS test_rows, min(train_count) AS min_train, max(train_count) AS max_train, count(CASE WHEN train_count < 30 THEN 1 END) AS small,
  {r6('quantile_cont(train_count, 0.5)')} AS p50, {r6('quantile_cont(train_count, 0.9)')} AS p90, {r6('quantile_cont(train_count, 0.95)')} AS p95 FROM counts""")
def _(t):
    return rounded(P.catalog_snapshot(counts(t), 30), "p50", "p90", "p95")


# ---- logs rendered from events ----------------------------------------------

fragment("log_lines", "", """
SELECT event_id AS seq, ts, CASE event_type
  WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ',000 [INFO] Progress: [ ' || event_id || '/20000] rows=' || user_id
  WHEN 'view' THEN 'Progress: [' || event_id || '/20000] rows=' || user_id
  WHEN 'click' THEN 'worker progress ' || event_id || '/20000 last=u' || user_id
  WHEN 'error' THEN 'Error evaluating u' || user_id || '_normal_' || (event_id % 3) || ': ' || CASE event_id % 4 WHEN 0 THEN 'out of memory' WHEN 1 THEN 'input contains NaN' WHEN 2 THEN 'inhomogeneous shape after 1 dimensions' ELSE 'bad key' END
  ELSE 'x.py:3: RuntimeWarning: overflow at ' || (user_id % 13) END AS line FROM events""")


def log_lines(t):
    e = F.col("event_type")
    s = lambda c: F.col(c).cast("string")
    kind = F.pmod("event_id", F.lit(4))
    message = F.when(kind == 0, "out of memory").when(kind == 1, "input contains NaN").when(kind == 2, "inhomogeneous shape after 1 dimensions").otherwise("bad key")
    line = (F.when(e == "purchase", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 [INFO] Progress: [ "), s("event_id"), F.lit("/20000] rows="), s("user_id")))
            .when(e == "view", F.concat(F.lit("Progress: ["), s("event_id"), F.lit("/20000] rows="), s("user_id")))
            .when(e == "click", F.concat(F.lit("worker progress "), s("event_id"), F.lit("/20000 last=u"), s("user_id")))
            .when(e == "error", F.concat(F.lit("Error evaluating u"), s("user_id"), F.lit("_normal_"), F.pmod("event_id", F.lit(3)).cast("string"), F.lit(": "), message))
            .otherwise(F.concat(F.lit("x.py:3: RuntimeWarning: overflow at "), F.pmod("user_id", F.lit(13)).cast("string"))))
    return t.table("events").select(F.col("event_id").alias("seq"), "ts", line.alias("line"))


@query("progress_log_parse", "", """
SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'canonical' WHEN 'view' THEN 'plain' ELSE 'compact' END AS format,
  CASE WHEN event_type = 'purchase' THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) ELSE -1 END AS at, event_id AS done, CAST(20000 AS BIGINT) AS expected,
  CASE WHEN event_type = 'click' THEN -1 ELSE user_id END AS rows FROM events WHERE event_type IN ('purchase', 'view', 'click')""")
def _(t):
    got = P.progress_events(log_lines(t).drop("ts"))
    return got.select("seq", "format", F.coalesce(F.unix_timestamp("at"), F.lit(-1)).alias("at"), "done", "expected", F.coalesce("rows", F.lit(-1)).alias("rows"))


fragment("log_errors", "", """
SELECT event_id AS seq, 'u' || user_id || '_normal_' || (event_id % 3) AS dataset, 'u' || user_id AS family,
  CASE event_id % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'nan_or_inf' WHEN 2 THEN 'variable_length_inhomogeneous_shape' ELSE 'other_exception' END AS reason FROM events WHERE event_type = 'error'""")


@query("log_error_classes", "log_errors", "SELECT * FROM log_errors")
def _(t):
    return P.error_events(log_lines(t)).select("seq", "dataset", "family", "reason")


@query("error_summary", "log_errors", """
SELECT CASE WHEN reason IS NULL THEN 'family' ELSE 'reason' END AS kind, coalesce(reason, family) AS value, count(*) AS errors, count(DISTINCT dataset) AS datasets
FROM log_errors GROUP BY GROUPING SETS ((reason), (family))""")
def _(t):
    return P.error_summary(P.error_events(log_lines(t)))


@query("warning_summary", "", """
SELECT 'RuntimeWarning' AS category, 'overflow at ' || (user_id % 13) AS message, count(*) AS times, max(event_id) AS last_seen FROM events WHERE event_type = 'signup' GROUP BY 1, 2""")
def _(t):
    return P.warning_summary(log_lines(t))


@query("coverage_snapshot", "", f"""
WITH d AS (SELECT count(DISTINCT user_id) AS done FROM events WHERE event_type = 'click' AND value > 120), e AS (SELECT count(DISTINCT user_id) AS errors FROM events WHERE event_type = 'error' AND value > 150)
SELECT done, errors, 200 AS expected, greatest(0, 200 - done - errors) AS remaining, {r6('100.0 * done / 200')} AS percent FROM d, e""")
def _(t):
    events = t.table("events").withColumn("dataset", F.col("user_id"))
    return rounded(P.coverage(events.filter("event_type = 'click' and value > 120"), events.filter("event_type = 'error' and value > 150"), 200), "percent")


@query("recent_unique_rows", "event_rows", "SELECT dataset, max(event_id) AS event_id FROM event_rows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def _(t):
    return P.recent_unique(t.event_rows(), "event_id")


@query("progress_throughput", "", f"""
WITH e AS (SELECT event_id AS done, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec, date_trunc('hour', ts) AS h FROM events WHERE event_type = 'purchase'),
k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY sec DESC, done DESC) AS r FROM e),
g AS (SELECT h, count(*) AS lines, min(done) AS first, max(done) AS last, max(CASE WHEN r = 1 THEN done END) AS d1, max(CASE WHEN r = 2 THEN done END) AS d2, max(CASE WHEN r = 1 THEN sec END) AS t1, max(CASE WHEN r = 2 THEN sec END) AS t2 FROM k GROUP BY 1),
s AS (SELECT *, CASE WHEN t1 > t2 AND d1 >= d2 THEN (d1 - d2) / ((t1 - t2) / 60.0) END AS recent, CASE WHEN t1 > t0 THEN d1 / ((t1 - t0) / 60.0) END AS mean, greatest(0, 20000 - d1) AS todo FROM g, (SELECT min(sec) AS t0 FROM e))
SELECT strftime(h, '%Y-%m-%d %H:%M') AS start, lines, first, last, 20000 - last AS remaining, {r6('recent')} AS recent_speed, {r6('mean')} AS mean_speed,
  {r6('CASE WHEN recent > 0 THEN todo / recent * 60 WHEN mean > 0 THEN todo / mean * 60 END')} AS eta_seconds, CASE WHEN recent > 0 THEN 'recent' WHEN mean > 0 THEN 'average' ELSE 'waiting' END AS eta_basis FROM s""")
def _(t):
    got = P.throughput(P.progress_events(log_lines(t)), "1 hour")
    return rounded(got.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")), "recent_speed", "mean_speed", "eta_seconds")
