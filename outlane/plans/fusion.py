"""Queries for rank fusion and conformal p-values."""

from pyspark.sql import functions as F

from outlane.functions.columns import r6 as R6
from outlane.operators import fusion as U
from outlane.operators import thresholds as T
from outlane.plans.registry import fragment, query, r6
from outlane.plans.thresholds import cap_sql

DSS = ["dataset", "source"]
ID = "dataset, split, idx"
BASE = ("rocket", "image_a", "image_b")

fragment("base", "scores", "SELECT * FROM scores WHERE source <> 'multi'")
fragment("train_counts", "base", "SELECT dataset, source, count(*) AS n FROM base WHERE split = 'TRAIN' GROUP BY 1, 2")
fragment("ranks", "base train_counts", """
SELECT b.dataset, family, split, idx, b.source, score,
  sum(CASE WHEN split = 'TRAIN' THEN 1 ELSE 0 END) OVER (PARTITION BY b.dataset, b.source ORDER BY score) / n AS rank
FROM base b JOIN train_counts t ON b.dataset = t.dataset AND b.source = t.source""")


def base(t):
    return t.scores().filter("source <> 'multi'")


def ranks(t):
    return U.train_rank(base(t), DSS)


@query("percentile_ranks", "test", f"""
SELECT dataset, idx, {r6('CASE WHEN n > 1 THEN (r - 1) / (n - 1) ELSE 0 END')} AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score, idx) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM test)""")
def _(t):
    got = U.percentile_ranks(t.score().filter("split = 'TEST'"), ["dataset"])
    return got.select("dataset", "idx", R6("rank").alias("rank"))


@query("train_reference_rank", "ranks", f"SELECT {ID}, source, {r6('rank')} AS rank FROM ranks")
def _(t):
    return ranks(t).select(*U.ID, "source", R6("rank").alias("rank"))


@query("train_reference_rank_nan_safe", "base", f"""
WITH b AS (SELECT dataset, split, idx, source, CASE WHEN idx % 11 = 3 THEN 'nan' WHEN idx % 11 = 5 THEN 'inf' WHEN idx % 11 = 7 THEN 'ninf' ELSE 'ok' END AS kind, score FROM base),
f AS (SELECT dataset, source, quantile_cont(score, 0.5) AS mid, min(score) AS lo, max(score) AS hi, count(*) AS n FROM b WHERE split = 'TRAIN' AND kind = 'ok' GROUP BY 1, 2),
s AS (SELECT b.dataset, b.split, b.idx, b.source, CASE kind WHEN 'nan' THEN mid WHEN 'inf' THEN hi WHEN 'ninf' THEN lo ELSE score END AS score, n,
        CASE WHEN split = 'TRAIN' AND kind = 'ok' THEN 1 ELSE 0 END AS w FROM b JOIN f USING (dataset, source))
SELECT {ID}, source, {r6('rank')} AS rank FROM (SELECT *, sum(w) OVER (PARTITION BY dataset, source ORDER BY score) / n AS rank FROM s)""")
def _(t):
    kind = F.pmod("idx", F.lit(11))
    broken = base(t).withColumn("score", F.when(kind == 3, float("nan")).when(kind == 5, float("inf")).when(kind == 7, float("-inf")).otherwise(F.col("score")))
    return U.train_rank_finite(broken, DSS).select(*U.ID, "source", R6("rank").alias("rank"))


@query("reference_percentile", "ranks", f"SELECT dataset, idx, {r6('rank')} AS rank FROM ranks WHERE split = 'TEST' AND source = 'image_a'")
def _(t):
    one = base(t).filter("source = 'image_a'")
    return U.train_rank(one, ["dataset"]).filter("split = 'TEST'").select("dataset", "idx", R6("rank").alias("rank"))


WSUM = "sum(CASE source WHEN 'rocket' THEN 0.5 ELSE 0.25 END * rank)"


@query("weighted_rank_ensemble", "base", f"""
SELECT dataset, idx, {r6(WSUM)} AS score FROM (
  SELECT *, (row_number() OVER (PARTITION BY dataset, source ORDER BY score, idx) - 1) / (count(*) OVER (PARTITION BY dataset, source) - 1) AS rank
  FROM base WHERE split = 'TEST') GROUP BY 1, 2""")
def _(t):
    got = U.percentile_ranks(base(t).filter("split = 'TEST'"), DSS)
    return U.weighted_ranks(got, U.RANK_WEIGHTS, ["dataset", "idx"]).withColumn("score", R6("score"))


@query("weighted_reference_ensemble", "ranks", f"SELECT {ID}, {r6(WSUM)} AS score FROM ranks GROUP BY 1, 2, 3")
def _(t):
    return U.weighted_ranks(ranks(t), U.RANK_WEIGHTS).withColumn("score", R6("score"))


@query("mean_rank_combination", "ranks", f"SELECT {ID}, {r6('avg(rank)')} AS score FROM ranks GROUP BY 1, 2, 3")
def _(t):
    return U.mean_rank(ranks(t)).withColumn("score", R6("score"))


fragment("source_cap", "base", cap_sql("(SELECT * FROM base WHERE split = 'TRAIN')", "0.1", "dataset, source"))


def source_caps(t, rate=0.1):
    return T.count_cap(base(t).filter("split = 'TRAIN'"), DSS, rate).select(*DSS, "threshold")


NAMES = ("rank_mean", "rank_max", "rank_min", "weighted_50_35_15", "weighted_20_30_50", "agreement")


@query("score_combination_family", "ranks source_cap", f"""
SELECT {ID}, {', '.join(f'{r6(n)} AS {n}' for n in NAMES)}, CASE WHEN agreement > 1.5 THEN 1 ELSE 0 END AS agree_2of3, CASE WHEN agreement > 2.5 THEN 1 ELSE 0 END AS agree_3of3 FROM (
  SELECT {ID}, avg(rank) AS rank_mean, max(rank) AS rank_max, min(rank) AS rank_min,
    sum(CASE source WHEN 'rocket' THEN 0.5 WHEN 'image_a' THEN 0.35 ELSE 0.15 END * rank) AS weighted_50_35_15,
    sum(CASE source WHEN 'rocket' THEN 0.2 WHEN 'image_a' THEN 0.3 ELSE 0.5 END * rank) AS weighted_20_30_50,
    sum(CASE WHEN score > threshold THEN 1 ELSE 0 END) + 0.01 * avg(rank) AS agreement
  FROM ranks JOIN source_cap USING (dataset, source) GROUP BY 1, 2, 3)""")
def _(t):
    rows = ranks(t).join(source_caps(t), DSS)
    got = U.combine(rows, F.col("score") > F.col("threshold"), BASE)
    return got.select(*U.ID, *[R6(n).alias(n) for n in NAMES], "agree_2of3", "agree_3of3")


@query("dimension_sweep_mean_rank", "ranks", f"""
SELECT {ID}, level, {r6('avg(rank)')} AS score FROM (
  SELECT {ID}, CASE WHEN source LIKE 'image%' THEN 'image' ELSE 'rocket' END AS level, rank FROM ranks
  UNION ALL SELECT {ID}, 'all', rank FROM ranks) GROUP BY 1, 2, 3, 4""")
def _(t):
    grouped = ranks(t).withColumn("source", F.when(F.col("source").startswith("image"), "image").otherwise("rocket"))
    return U.rank_levels(grouped).withColumn("score", R6("score"))


@query("combination_grid", "ranks", f"""
SELECT key_set, {ID}, {r6('avg(rank)')} AS rank_mean, {r6('max(rank)')} AS rank_max, {r6('min(rank)')} AS rank_min FROM (
  SELECT *, 'images' AS key_set FROM ranks WHERE source LIKE 'image%' UNION ALL SELECT *, 'all' FROM ranks) GROUP BY 1, 2, 3, 4""")
def _(t):
    got = U.combination_grid(ranks(t), {"images": ["image_a", "image_b"], "all": list(BASE)})
    return got.select("key_set", *U.ID, *[R6(c).alias(c) for c in ("rank_mean", "rank_max", "rank_min")])


@query("length_routed_score", "panel", f"""
SELECT dataset, idx, {r6('CASE WHEN len(values) < 80 THEN list_avg(values) ELSE list_max(values) END')} AS score FROM panel""")
def _(t):
    from outlane.functions.columns import array_mean
    got = U.length_routed(t.panel(), F.size("values"), array_mean("values"), F.array_max("values"), 80)
    return got.select("dataset", "idx", R6("score").alias("score"))


@query("length_routed_results", "panel", f"""
WITH a AS (SELECT dataset, quantile_cont(len(values), 0.5) AS length, avg(list_avg(values)) AS s FROM panel GROUP BY 1),
b AS (SELECT dataset, avg(list_max(values)) AS s FROM panel WHERE region <> 2 GROUP BY 1)
SELECT dataset, {r6('CASE WHEN length < 80 THEN a.s ELSE b.s END')} AS score FROM a JOIN b USING (dataset)""")
def _(t):
    from outlane.functions.columns import array_mean
    rows = t.panel()
    a = rows.groupBy("dataset").agg(F.percentile(F.size("values"), 0.5).alias("length"), F.avg(array_mean("values")).alias("s_short"))
    b = rows.filter("region <> 2").groupBy("dataset").agg(F.avg(F.array_max("values")).alias("s_long"))
    got = U.length_routed(a.join(b, "dataset"), F.col("length"), F.col("s_short"), F.col("s_long"), 80)
    return got.select("dataset", R6("score").alias("score"))


GE = "sum(CASE WHEN split = 'TRAIN' THEN 1 ELSE 0 END) OVER (PARTITION BY b.dataset, b.source ORDER BY score DESC)"
fragment("pvalues", "base train_counts", f"""
SELECT b.dataset, family, split, idx, b.source, score, n, (1 + {GE}) / (n + 1) AS p FROM base b JOIN train_counts t ON b.dataset = t.dataset AND b.source = t.source""")


def pvalues(t):
    return U.conformal_p(base(t), DSS).filter("split = 'TEST'")


@query("conformal_p_value", "pvalues", f"SELECT dataset, idx, {r6('p')} AS p FROM pvalues WHERE split = 'TEST' AND source = 'rocket'")
def _(t):
    return U.conformal_p(base(t).filter("source = 'rocket'"), ["dataset"]).filter("split = 'TEST'").select("dataset", "idx", R6("p").alias("p"))


@query("conformal_p_by_source", "pvalues", f"SELECT dataset, source, idx, {r6('p')} AS p FROM pvalues WHERE split = 'TEST'")
def _(t):
    return pvalues(t).select("dataset", "source", "idx", R6("p").alias("p"))


@query("leave_self_out_p", "base train_counts", f"""
SELECT {ID}, source, {r6("least(1.0, greatest(1 / (n + 1), (1 + greatest(0, ge - CASE WHEN split = 'TRAIN' THEN 1 ELSE 0 END)) / (n + 1)))")} AS p FROM (
  SELECT b.dataset, split, idx, b.source, n, {GE} AS ge FROM base b JOIN train_counts t ON b.dataset = t.dataset AND b.source = t.source)""")
def _(t):
    return U.leave_self_out_p(base(t), DSS).select(*U.ID, "source", R6("p").alias("p"))


fragment("fused", "pvalues", """
SELECT dataset, idx, least(1.0, 3 * min(p)) AS bonferroni_p, least(1.0, greatest(1e-10, 0.5 - atan(avg(tan((0.5 - greatest(1e-10, least(1 - 1e-10, p))) * pi()))) / pi())) AS cauchy_p,
  exp(sum(ln(p))) * (1 - sum(ln(p)) + pow(sum(ln(p)), 2) / 2) AS fisher_p, count(CASE WHEN p <= 0.1 THEN 1 END) AS agree
FROM pvalues WHERE split = 'TEST' GROUP BY 1, 2""")
PS = ("bonferroni_p", "cauchy_p", "fisher_p")


@query("p_value_fusion", "fused", f"SELECT dataset, idx, {', '.join(f'{r6(p)} AS {p}' for p in PS)}, agree FROM fused")
def _(t):
    return U.fuse_p(pvalues(t), 3, 0.1).select("dataset", "idx", *[R6(p).alias(p) for p in PS], "agree")


@query("p_value_selection", "fused", """
SELECT 'cauchy' AS method, dataset, idx FROM fused WHERE cauchy_p <= 0.1 UNION ALL
SELECT 'fisher', dataset, idx FROM fused WHERE fisher_p <= 0.1 UNION ALL SELECT 'agreement', dataset, idx FROM fused WHERE agree >= 2""")
def _(t):
    fused = U.fuse_p(pvalues(t), 3, 0.1)
    parts = [U.select_by_p(fused, m, 0.1).select(F.lit(m).alias("method"), "dataset", "idx") for m in ("cauchy", "fisher", "agreement")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("calibration_status", "train", """
SELECT dataset, count(*) AS n_train, CASE WHEN count(*) < 30 THEN 'insufficient_calibration_n_train_lt30' ELSE 'calibrated' END AS status,
  CASE WHEN count(*) < 30 THEN 1 ELSE 0 END AS abstain FROM train GROUP BY 1""")
def _(t):
    return U.calibration_status(t.score().filter("split = 'TRAIN'"), 30)


@query("resolution_status", "base", """
WITH m AS (SELECT dataset, source, 1 / (count(*) + 1) AS min_p FROM base WHERE split = 'TRAIN' AND (source <> 'image_b' OR score > 5) GROUP BY 1, 2)
SELECT dataset, count(CASE WHEN min_p <= 0.03 THEN 1 END) AS eligible, coalesce(string_agg(CASE WHEN min_p <= 0.03 THEN source END, ' ' ORDER BY source), '') AS eligible_sources,
  CASE WHEN count(CASE WHEN min_p <= 0.03 THEN 1 END) < 2 THEN 1 ELSE 0 END AS blocked FROM m GROUP BY 1""")
def _(t):
    rows = base(t).filter("split = 'TRAIN' and (source <> 'image_b' or score > 5)")
    return U.resolution_status(rows.groupBy(*DSS).agg((1 / (F.count(F.lit(1)) + 1)).alias("min_p")), 0.03)


BOOT_U = "CAST('0x' || substr(sha256('boot|' || dataset || '|' || source || '|' || rep || '|' || i), 1, 8) AS BIGINT) / 4294967296.0"
fragment("reliability", "base source_cap", f"""
WITH p AS (SELECT dataset, source, score, row_number() OVER (PARTITION BY dataset, source ORDER BY score, idx) AS i, count(*) OVER (PARTITION BY dataset, source) AS n
           FROM base WHERE split = 'TRAIN'),
d AS (SELECT dataset, source, rep, CAST(floor({BOOT_U} * n) AS BIGINT) + 1 AS i FROM (SELECT *, unnest(range(1, 17)) AS rep FROM p)),
b AS (SELECT dataset, source, stddev_pop(b) AS boot_std FROM (
        SELECT d.dataset, d.source, rep, quantile_cont(score, 0.95) AS b FROM d JOIN p USING (dataset, source, i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
q AS (SELECT dataset, source, count(*) AS n, greatest(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 1e-8) AS iqr,
        greatest(0, quantile_cont(score, 0.95) - quantile_cont(score, 0.9)) AS tail FROM p GROUP BY 1, 2),
e AS (SELECT b.dataset, b.source, avg(CASE WHEN score > threshold THEN 1 ELSE 0 END) AS ex FROM base b JOIN source_cap USING (dataset, source) WHERE split = 'TRAIN' GROUP BY 1, 2)
SELECT dataset, source, CASE WHEN n < 8 THEN 0 ELSE 1 / (1 + tail / iqr + boot_std / iqr + least(2.0, 25 * ex)) END AS reliability
FROM q JOIN b USING (dataset, source) JOIN e USING (dataset, source)""")


def reliabilities(t):
    train = base(t).filter("split = 'TRAIN'")
    exceed = T.train_exceed(train, source_caps(t), DSS).select(*DSS, "exceed_rate")
    return U.reliability(train, exceed)


@query("source_reliability", "reliability", f"SELECT dataset, source, {r6('reliability')} AS reliability FROM reliability")
def _(t):
    return reliabilities(t).withColumn("reliability", R6("reliability"))


PRIOR = "(CASE source WHEN 'rocket' THEN 0.45 ELSE 0.275 END * (0.25 + reliability))"


@query("adaptive_weights", "reliability", f"SELECT dataset, source, {r6(f'{PRIOR} / sum({PRIOR}) OVER (PARTITION BY dataset)')} AS weight FROM reliability")
def _(t):
    return U.adaptive_weights(reliabilities(t)).withColumn("weight", R6("weight"))


@query("stability_weighted_ensemble", "ranks", f"""
WITH q AS (SELECT dataset, source, 1 / (1e-6 + greatest(0.05, quantile_cont(rank, 0.95) - quantile_cont(rank, 0.5)) + 0.5 * greatest(0.05, quantile_cont(rank, 0.75) - quantile_cont(rank, 0.25))) AS raw
           FROM ranks WHERE split = 'TRAIN' GROUP BY 1, 2),
w AS (SELECT dataset, source, raw / sum(raw) OVER (PARTITION BY dataset) AS weight FROM q)
SELECT {ID}, {r6('sum(weight * rank)')} AS score FROM ranks JOIN w USING (dataset, source) GROUP BY 1, 2, 3""")
def _(t):
    got = ranks(t)
    weights = U.stability_weights(got.withColumn("score", F.col("rank")))
    mixed = got.join(weights, DSS).groupBy(*U.ID).agg(F.sum(F.col("weight") * F.col("rank")).alias("score"))
    return mixed.withColumn("score", R6("score"))
