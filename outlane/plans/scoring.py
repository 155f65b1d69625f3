"""Queries for neighbour, centroid and cross-fitted scores."""

from pyspark.sql import functions as F

from outlane.functions.columns import r6 as R6
from outlane.functions.columns import z_norm
from outlane.operators import evaluate as E
from outlane.operators import scoring as K
from outlane.operators import thresholds as T
from outlane.plans.registry import fragment, query, r6
from outlane.session import stage

fragment("points", "archive", """
SELECT dataset, split, idx, pos, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END AS v
FROM (SELECT dataset, split, idx, unnest(range(64)) AS pos, unnest(values) AS v FROM archive)
WINDOW w AS (PARTITION BY dataset, split, idx)""")
fragment("robust_fit", "points", """
SELECT dataset, pos, quantile_cont(v, 0.5) AS mid, CASE WHEN quantile_cont(v, 0.9) = quantile_cont(v, 0.1) THEN 1
  ELSE quantile_cont(v, 0.9) - quantile_cont(v, 0.1) END AS width FROM points WHERE split = 'TRAIN' GROUP BY 1, 2""")
fragment("scaled", "points robust_fit", """
SELECT dataset, split, idx, pos, (v - mid) / width AS v FROM points JOIN robust_fit USING (dataset, pos)""")
fragment("vectors", "scaled", "SELECT dataset, split, idx, list(v ORDER BY pos) AS vec FROM scaled GROUP BY 1, 2, 3")
fragment("pairs", "vectors", """
SELECT a.dataset, a.split, a.idx, b.idx AS rid, list_distance(a.vec, b.vec) AS d,
       row_number() OVER (PARTITION BY a.dataset, a.split, a.idx ORDER BY list_distance(a.vec, b.vec), b.idx) AS r
FROM vectors a JOIN vectors b ON a.dataset = b.dataset AND b.split = 'TRAIN' AND NOT (a.split = 'TRAIN' AND a.idx = b.idx)""")
fragment("near3", "pairs", "SELECT dataset, split, idx, rid, d FROM pairs WHERE r <= 3")
fragment("knn3", "near3", "SELECT dataset, split, idx, avg(d) AS score FROM near3 GROUP BY 1, 2, 3")
fragment("local3", "near3 knn3", """
SELECT n.dataset, n.split, n.idx, avg(k.score + 1e-9) + 1e-9 AS loc FROM near3 n
JOIN knn3 k ON k.dataset = n.dataset AND k.split = 'TRAIN' AND k.idx = n.rid GROUP BY 1, 2, 3""")
fragment("gap3", "knn3 local3", """
SELECT k.dataset, k.split, k.idx, (k.score - loc) / typical AS score, k.score / loc AS ratio FROM knn3 k
JOIN local3 USING (dataset, split, idx)
JOIN (SELECT dataset, quantile_cont(score + 1e-9, 0.5) + 1e-9 AS typical FROM knn3 WHERE split = 'TRAIN' GROUP BY 1) USING (dataset)""")


def vectors(t):
    """z-normalised archive series as vectors, without labels."""
    return t.once("vectors", lambda: t.scored_series().select("dataset", "split", "idx", z_norm("values").alias("vec")))


def scaled(t):
    rows = vectors(t)
    return stage(K.robust_scale(rows, rows.filter("split = 'TRAIN'")))


def near(t, k=3):
    rows = scaled(t)
    return K.neighbours(rows, rows.filter("split = 'TRAIN'"), k)


def rounded(df):
    return df.withColumn("score", R6("score"))


KEY = "dataset, split, idx"


@query("feature_robust_scale", "scaled", f"SELECT {KEY}, pos, {r6('v')} AS v FROM scaled")
def _(t):
    return scaled(t).select("dataset", "split", "idx", F.posexplode("vec").alias("pos", "v")).select(
        "dataset", "split", "idx", F.col("pos").cast("bigint").alias("pos"), R6("v").alias("v"))


@query("knn_score", "knn3", f"SELECT {KEY}, {r6('score')} AS score FROM knn3")
def _(t):
    return rounded(K.knn_scores(near(t)))


@query("density_ratio_knn", "gap3", f"SELECT {KEY}, {r6('ratio')} AS score FROM gap3")
def _(t):
    return rounded(K.density_scores(near(t), "ratio"))


@query("local_gap_knn", "gap3", f"SELECT {KEY}, {r6('score')} AS score FROM gap3")
def _(t):
    return rounded(K.local_gap(vectors(t)))


fragment("dev", "scaled", """
SELECT s.dataset, s.split, s.idx, s.pos, abs(s.v - c) / (mad + 1e-6) AS dev FROM scaled s JOIN (
  SELECT dataset, pos, any_value(c) AS c, quantile_cont(abs(v - c), 0.5) AS mad FROM (
    SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY dataset, pos) AS c FROM scaled WHERE split = 'TRAIN') GROUP BY 1, 2) USING (dataset, pos)""")


@query("robust_deviation_topk", "dev", f"""
SELECT {KEY}, {r6('avg(dev)')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY dev DESC, pos) AS r FROM dev)
WHERE r <= 16 GROUP BY 1, 2, 3""")
def _(t):
    rows = vectors(t)
    return rounded(K.robust_deviation(rows, rows.filter("split = 'TRAIN'"), 16))


@query("robust_deviation_mean", "dev", f"SELECT {KEY}, {r6('avg(dev)')} AS score FROM dev GROUP BY 1, 2, 3")
def _(t):
    rows = vectors(t)
    return rounded(K.robust_deviation(rows, rows.filter("split = 'TRAIN'"), None))


@query("centroid_distance", "scaled", f"""
SELECT {KEY}, {r6('sqrt(sum((v - c) * (v - c)))')} AS score FROM scaled
JOIN (SELECT dataset, pos, avg(v) AS c FROM scaled WHERE split = 'TRAIN' GROUP BY 1, 2) USING (dataset, pos) GROUP BY 1, 2, 3""")
def _(t):
    return rounded(K.centroid_scores(scaled(t)))


@query("query_knn_vs_reference", "pairs", f"""
SELECT dataset, idx, {r6('avg(d)')} AS score FROM pairs WHERE split = 'TEST' AND r <= 5 GROUP BY 1, 2""")
def _(t):
    rows = vectors(t)
    reference = rows.filter("split = 'TRAIN'")
    test = K.robust_scale(rows.filter("split = 'TEST'"), reference)
    near_ = K.neighbours(test, K.robust_scale(reference, reference), 5)
    return rounded(K.knn_scores(near_)).drop("split")


fragment("cap3", "gap3", """
SELECT dataset, score AS threshold FROM (
  SELECT dataset, score, row_number() OVER (PARTITION BY dataset ORDER BY score DESC) AS r,
         least(CAST(floor(0.03 * count(*) OVER (PARTITION BY dataset)) AS BIGINT), count(*) OVER (PARTITION BY dataset) - 1) AS cap
  FROM gap3 WHERE split = 'TRAIN') WHERE r = cap + 1""")


@query("knn_local_gap_report", "gap3 cap3 archive", f"""
WITH f AS (SELECT dataset, y, CASE WHEN score > threshold THEN 1 ELSE 0 END AS pred FROM gap3 JOIN cap3 USING (dataset)
           JOIN archive USING (dataset, split, idx) WHERE split = 'TEST'),
c AS (SELECT dataset, count(CASE WHEN pred = 1 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN pred = 1 AND y = 0 THEN 1 END) AS fp,
             count(CASE WHEN pred = 0 AND y = 1 THEN 1 END) AS fn FROM f GROUP BY 1)
SELECT dataset, tp, fp, fn, {r6('tp / greatest(1, tp + fp)')} AS precision,
  {r6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END')} AS recall,
  {r6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END')} AS f1 FROM c""")
def _(t):
    """The whole chain: one-class sets, z-norm, local gap, 3 % cap, report."""
    scores = K.local_gap(vectors(t))
    limits = T.count_cap(scores.filter("split = 'TRAIN'"), ["dataset"], 0.03).select("dataset", "threshold")
    flags = E.threshold_flags(scores.filter("split = 'TEST'"), limits)
    truth = t.archive().filter("split = 'TEST'").select("dataset", "idx", "y")
    report = E.confusion(flags.join(truth, ["dataset", "idx"]))
    return report.select("dataset", "tp", "fp", "fn", *[R6(c).alias(c) for c in ("precision", "recall", "f1")])
