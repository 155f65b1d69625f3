"""Queries for series preparation."""

from pyspark.sql import functions as F

from outlane.functions import columns as C
from outlane.functions.columns import r6 as R6
from outlane.operators import prep as P
from outlane.plans.registry import fragment, query, r6

fragment("raw", "", "SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS values FROM embeddings")
fragment("pts", "raw", "SELECT id, label, unnest(range(len(values))) AS pos, unnest(values) AS v FROM raw")
fragment("zpts", "pts", """
SELECT id, label, pos, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END AS v FROM pts WINDOW w AS (PARTITION BY id)""")


def raw(t):
    return t.labelled().select("id", F.col("cls").cast("int").alias("label"), "values")


def long(df, *keys, col="values"):
    got = df.select(*keys, F.posexplode(col).alias("pos", "v"))
    return got.select(*keys, F.col("pos").cast("bigint").alias("pos"), R6("v").alias("v"))


def sql(expr: str, rel: str, keys: str = "id") -> str:
    return f"SELECT {keys}, pos, {r6(expr)} AS v FROM {rel}"


@query("interpolate_missing", "pts", """
WITH m AS (SELECT id, pos, CASE WHEN (id * 7 + pos * 13) % 5 < 2 OR id % 50 = 0 THEN NULL ELSE v END AS v FROM pts),
s AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS l, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS lp,
  first_value(v IGNORE NULLS) OVER b AS r, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS rp FROM m
  WINDOW a AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
""" + sql("CASE WHEN l IS NULL AND r IS NULL THEN 0 WHEN l IS NULL THEN r WHEN r IS NULL OR lp = rp THEN l ELSE l + (r - l) * (pos - lp) / (rp - lp) END", "s"))
def _(t):
    bad = lambda i: (F.pmod(F.col("id") * 7 + i * 13, F.lit(5)) < 2) | (F.col("id") % 50 == 0)
    holes = raw(t).withColumn("values", F.transform("values", lambda x, i: F.when(bad(i), F.lit(float("nan"))).otherwise(x)))
    return long(holes.withColumn("values", P.interpolate_missing("values")), "id")


def _resample_sql(rel, keys, target):
    return f"""WITH g AS (SELECT {keys}, values, {target} AS target, len(values) AS n, unnest(range(CAST({target} AS BIGINT))) AS pos FROM {rel}),
p AS (SELECT *, pos * (n - 1) / greatest(target - 1, 1) AS x FROM g)
SELECT {keys}, pos, {r6('values[CAST(floor(x) AS INT) + 1] + (values[CAST(least(floor(x) + 1, n - 1) AS INT) + 1] - values[CAST(floor(x) AS INT) + 1]) * (x - floor(x))')} AS v FROM p"""


@query("resample_to_length", "panel", _resample_sql("panel", "idx", "40"))
def _(t):
    return long(t.panel().withColumn("values", C.resample("values", 40)), "idx")


fragment("aligned", "panel", "SELECT p.*, target FROM panel p JOIN (SELECT dataset, greatest(8, CAST(round_even(quantile_cont(len(values), 0.5), 0) AS INT)) AS target FROM panel GROUP BY 1) USING (dataset)")


@query("align_collection", "aligned", _resample_sql("aligned", "dataset, idx", "target"))
def _(t):
    rows = t.panel()
    return long(P.align(rows, P.target_lengths(rows)), "dataset", "idx")


@query("target_length_policy", "panel", """
SELECT dataset, greatest(8, CAST(round_even(quantile_cont(len(values), 0.5), 0) AS INT)) AS median_len, greatest(8, CAST(least(2048, max(len(values))) AS INT)) AS max_len FROM panel GROUP BY 1""")
def _(t):
    rows = t.panel()
    return P.target_lengths(rows).withColumnRenamed("target_len", "median_len").join(
        P.target_lengths(rows, "actual_max_cap2048").withColumnRenamed("target_len", "max_len"), "dataset")


@query("series_z_norm", "zpts", sql("v", "zpts"))
def _(t):
    return long(raw(t).withColumn("values", C.z_norm("values")), "id")


@query("min_zero_transform", "pts", sql("v - min(v) OVER (PARTITION BY id)", "pts"))
def _(t):
    return long(raw(t).withColumn("values", C.min_zero("values")), "id")


@query("first_difference", "pts", sql("v - coalesce(lag(v) OVER (PARTITION BY id ORDER BY pos), v)", "pts"))
def _(t):
    return long(raw(t).withColumn("values", C.first_difference("values")), "id")


@query("space_selector", "pts", """
WITH s AS (SELECT id, pos, CASE label % 3 WHEN 0 THEN v WHEN 1 THEN v - min(v) OVER (PARTITION BY id) ELSE v - coalesce(lag(v) OVER (PARTITION BY id ORDER BY pos), v) END AS v FROM pts)
""" + sql("(v - avg(v) OVER (PARTITION BY id)) / stddev_pop(v) OVER (PARTITION BY id)", "s"))
def _(t):
    space = F.when(F.col("label") % 3 == 0, "time_z").when(F.col("label") % 3 == 1, "minzero_z").otherwise("difference_z")
    return long(raw(t).withColumn("values", P.in_space(space)), "id")


fragment("apts", "archive", "SELECT dataset, split, idx, unnest(range(64)) AS pos, unnest(values) AS v FROM archive")
KEYS = "dataset, split, idx"
AK = ("dataset", "split", "idx")


@query("train_robust_scale", "apts", f"""
WITH f AS (SELECT dataset, pos, quantile_cont(v, 0.5) AS mid, CASE WHEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) > 1e-6 THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25)
  WHEN stddev_pop(v) > 1e-6 THEN stddev_pop(v) ELSE 1 END AS w FROM apts WHERE split = 'TRAIN' GROUP BY 1, 2)
SELECT {KEYS}, pos, {r6('least(5.0, greatest(-5.0, (v - mid) / w))')} AS v FROM apts JOIN f USING (dataset, pos)""")
def _(t):
    return long(P.scaled(t.series(), "train_robust"), *AK)


UNIT = "least(1.0, greatest(0.0, (v - lo) / CASE WHEN hi - lo > 1e-6 THEN hi - lo ELSE 1 END)) * 2 - 1"


@query("quantile_scale_by_point", "apts", f"""
SELECT {KEYS}, pos, {r6(UNIT)} AS v FROM apts JOIN (SELECT dataset, pos, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM apts WHERE split = 'TRAIN' GROUP BY 1, 2) USING (dataset, pos)""")
def _(t):
    return long(P.scaled(t.series(), "train_point_quantile_05_95"), *AK)


@query("quantile_scale_by_series", "apts", f"""
SELECT {KEYS}, pos, {r6(UNIT)} AS v FROM (SELECT *, quantile_cont(v, 0.05) OVER w AS lo, quantile_cont(v, 0.95) OVER w AS hi FROM apts WINDOW w AS (PARTITION BY {KEYS}))""")
def _(t):
    return long(P.scaled(t.series(), "per_series_quantile_05_95"), *AK)


@query("quantile_scale_global", "apts", f"""
SELECT {KEYS}, pos, {r6(UNIT)} AS v FROM apts JOIN (SELECT dataset, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM apts WHERE split = 'TRAIN' GROUP BY 1) USING (dataset)""")
def _(t):
    return long(P.scaled(t.series(), "train_global_quantile_01_99"), *AK)


@query("global_minmax_scale", "apts", f"""
SELECT {KEYS}, pos, {r6(UNIT)} AS v FROM apts JOIN (SELECT dataset, min(v) AS lo, max(v) AS hi FROM apts WHERE split = 'TRAIN' GROUP BY 1) USING (dataset)""")
def _(t):
    return long(P.scaled(t.series(), "train_global_minmax_clip"), *AK)


@query("scale_mode_clip3", "zpts", sql("least(3.0, greatest(-3.0, v))", "zpts"))
def _(t):
    return long(P.scaled(raw(t), "per_series_z_clip3"), "id")


@query("fixed_width_pad", "pts", f"""
SELECT id, pos, {r6('coalesce(v, 0)')} AS v FROM (SELECT DISTINCT id, unnest(range(80)) AS pos FROM raw) LEFT JOIN pts USING (id, pos)""".replace("FROM raw", "FROM pts"))
def _(t):
    return long(raw(t).withColumn("values", C.fixed_width("values", 80)), "id")


@query("crop_window", "pts", f"SELECT id, pos - 16 AS pos, {r6('v')} AS v FROM pts WHERE pos BETWEEN 16 AND 47")
def _(t):
    return long(raw(t).withColumn("values", C.crop("values", 0.5, 0.5)), "id")


fragment("dft", "pts", """
SELECT id, label, k, sum(v * cos(2 * pi() * k * pos / 64)) AS re, -sum(v * sin(2 * pi() * k * pos / 64)) AS im FROM pts, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2, 3""")


@query("band_pass_filter", "dft", f"""
SELECT id, pos, {r6('sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * pos / 64) - im * sin(2 * pi() * k * pos / 64))) / 64')} AS v
FROM dft, (SELECT unnest(range(64)) AS pos) WHERE k >= 3 AND k < 17 GROUP BY 1, 2""")
def _(t):
    return long(raw(t).withColumn("values", P.band_pass("values", 0.1, 0.5)), "id")
