"""Queries for experiments whose settings are rows."""

from pyspark.sql import functions as F

from outlane.functions.columns import r6 as R6
from outlane.operators import experiments as E
from outlane.operators import selection as S
from outlane.plans.registry import fragment, query, r6
from outlane.plans.selection import caps_all, exceed, test, test_all

#: Caps of the given scores are passed by a tenth of TRAIN, so budgets take a tenth.
FACTOR = 0.15


def _literal(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else repr(value)


_TABLE = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in E.strategy_rows(E.STRATEGIES))


@query("strategy_table_selections", "support scores sizes exceed", f"""
WITH m AS (SELECT dataset, idx, b, r, images, max(CASE WHEN source = 'image_a' THEN 1 ELSE 0 END) AS a, max(CASE WHEN source = 'image_b' THEN 1 ELSE 0 END) AS c
  FROM support JOIN fired USING (dataset, idx) WHERE b > 0 GROUP BY ALL),
f AS (SELECT dataset, n, sum(r) AS nr, sum(a) AS na, sum(c) AS nb, count(CASE WHEN b >= 2 THEN 1 END) AS n2, max(CASE WHEN r = 1 AND images > 0 THEN 1 ELSE 0 END) AS lap FROM m JOIN sizes USING (dataset) GROUP BY 1, 2),
e AS (SELECT dataset, least(0.03, greatest(0.005, avg(exceed_rate) * {FACTOR})) AS rate FROM exceed WHERE source <> 'multi' GROUP BY 1),
g AS (SELECT f.*, rate AS train_rate, greatest(nr, na, nb) >= 2 * greatest(1, n2) AS apart, CASE WHEN nr >= 3 AND n2 = 0 THEN 3 WHEN least(nr, 1) + least(na, 1) + least(nb, 1) >= 2 THEN 2 ELSE 1 END AS adaptive FROM f JOIN e USING (dataset)),
ro AS (SELECT dataset, idx, score FROM scores WHERE split = 'TEST' AND source = 'rocket'), im AS (SELECT dataset, idx, score FROM scores WHERE split = 'TEST' AND source = 'image_b'),
pools AS (SELECT 'two' AS pool, dataset, idx, score FROM m JOIN ro USING (dataset, idx) WHERE b >= 2 UNION ALL SELECT 'three', dataset, idx, score FROM m JOIN ro USING (dataset, idx) WHERE b >= 3
  UNION ALL SELECT 'rocket', dataset, idx, score FROM m JOIN ro USING (dataset, idx) WHERE r = 1 UNION ALL SELECT 'pair', dataset, idx, score FROM m JOIN im USING (dataset, idx) WHERE images = 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY pool, dataset ORDER BY score DESC, idx) AS place FROM pools),
tagged AS (SELECT strategy, tier, dataset, idx FROM placed JOIN g USING (dataset) JOIN (VALUES {_TABLE}) AS t(strategy, tier, pool, rate, most, budget, gate) USING (pool)
  WHERE place <= CASE WHEN rate IS NULL THEN n ELSE greatest(1, ceil(n * rate)) END AND place <= coalesce(most, n) AND place <= CASE budget WHEN 'auto' THEN greatest(1, ceil(n * train_rate)) WHEN 'adaptive' THEN adaptive ELSE n END
  AND CASE gate WHEN 'overlap' THEN lap = 1 WHEN 'few' THEN nr > 0 AND nr <= greatest(1, ceil(n * 0.03)) WHEN 'no_rocket' THEN nr = 0 WHEN 'disagree' THEN apart WHEN 'agree' THEN NOT apart ELSE true END)
SELECT strategy, dataset, idx FROM tagged QUALIFY tier = min(tier) OVER (PARTITION BY strategy, dataset)""")
def _(t):
    return E.strategy_selections(test_all(t), caps_all(t), S.test_sizes(test(t)), exceed(t), E.strategy_table(t.spark), FACTOR)


CONFIGS = [("z_centroid", "z", "none", 0, "centroid", 0), ("diff_knn", "z_diff", "none", 0, "knn", 3), ("pca_knn", "z", "pca", 4, "knn", 3)]
RULES = [("strict", 0.01), ("middle", 0.03), ("wide", 0.1)]

fragment("zdiff", "points", """SELECT dataset, split, idx, list(v ORDER BY pos) AS vec FROM (
  SELECT dataset, split, idx, pos, v - coalesce(lag(v) OVER (PARTITION BY dataset, split, idx ORDER BY pos), v) AS v FROM points) GROUP BY 1, 2, 3""")


def _knn(rel: str) -> str:
    return f"""SELECT dataset, split, idx, avg(d) AS score FROM (SELECT a.dataset, a.split, a.idx, list_distance(a.vec, b.vec) AS d FROM {rel} a JOIN {rel} b ON a.dataset = b.dataset AND b.split = 'TRAIN' AND NOT (a.split = 'TRAIN' AND a.idx = b.idx)
  QUALIFY row_number() OVER (PARTITION BY a.dataset, a.split, a.idx ORDER BY list_distance(a.vec, b.vec), b.idx) <= 3) GROUP BY 1, 2, 3"""


def _config_sql() -> str:
    from outlane.plans.features import axes_sql
    taken = ", ".join(f"list_dot_product(list_transform(range(1, 65), lambda i: vec[i] - mean[i]), a{c})" for c in range(1, 5))
    rules = ", ".join(f"('{n}', {r!r})" for n, r in RULES)
    return f"""WITH RECURSIVE {axes_sql('tpts', 4, True)}, flat AS MATERIALIZED (SELECT dataset, split, idx, [{taken}] AS vec FROM vectors_z JOIN axes USING (dataset)),
mid AS (SELECT dataset, list(m ORDER BY pos) AS center FROM (SELECT dataset, pos, avg(v) AS m FROM points WHERE split = 'TRAIN' GROUP BY 1, 2) GROUP BY 1),
s AS MATERIALIZED (SELECT config, dataset, split, idx, round(score, 9) AS score FROM (SELECT 'z_centroid' AS config, dataset, split, idx, list_distance(vec, center) AS score FROM vectors_z JOIN mid USING (dataset) UNION ALL SELECT 'diff_knn', * FROM ({_knn('zdiff')}) UNION ALL SELECT 'pca_knn', * FROM ({_knn('flat')}))),
o AS (SELECT config, dataset, score, row_number() OVER (PARTITION BY config, dataset ORDER BY score DESC, idx) AS p, count(*) OVER (PARTITION BY config, dataset) AS n FROM s WHERE split = 'TRAIN'),
l AS (SELECT config, dataset, rule, score AS threshold FROM o JOIN (VALUES {rules}) AS r(rule, rate) ON p = CAST(floor(rate * n) AS BIGINT) + 1),
c AS (SELECT config, dataset, rule, threshold, count(CASE WHEN score > threshold AND y = 1 THEN 1 END) AS tp, count(CASE WHEN score > threshold AND y = 0 THEN 1 END) AS fp, count(CASE WHEN score <= threshold AND y = 1 THEN 1 END) AS fn
  FROM s JOIN l USING (config, dataset) JOIN (SELECT dataset, idx, y FROM archive WHERE split = 'TEST') y USING (dataset, idx) WHERE split = 'TEST' GROUP BY 1, 2, 3, 4)
SELECT config, dataset, rule, {r6('threshold')} AS threshold, tp, fp, fn, {r6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END')} AS f1 FROM c"""


@query("config_sweep", "points vectors_z tpts zdiff archive", _config_sql())
def _(t):
    """Three configurations under three rules, all given as rows."""
    configs = t.spark.createDataFrame(CONFIGS, "config string, feature string, compression string, width int, score string, k int")
    rules = t.spark.createDataFrame(RULES, "rule string, rate double")
    truth = t.archive().filter("split = 'TEST'").select("dataset", "idx", "y")
    got = E.config_sweep(stage_scores(t, configs), rules, truth)
    return got.withColumn("threshold", R6("threshold")).withColumn("f1", R6("f1"))


def stage_scores(t, configs):
    from outlane.session import stage
    rows = t.scored_series().select("dataset", "split", "idx", "values")
    scores = E.config_scores(rows, configs)
    # equal scores on both sides of a threshold must stay equal
    return stage(scores.withColumn("score", F.round("score", 9)))


@query("sql_series_functions", "points", f"""
WITH w AS (SELECT dataset, idx, s * 8 AS start, pos - s * 8 AS place, v FROM points, range(7) r(s) WHERE split = 'TEST' AND pos BETWEEN s * 8 AND s * 8 + 15),
m AS (SELECT dataset, idx, start, avg(v) AS mean, stddev_pop(v) AS deviation, sum((place - 7.5) * v) / 340 AS slope FROM w GROUP BY 1, 2, 3),
g AS (SELECT dataset, idx, min(v) AS low, max(v) AS high FROM points WHERE split = 'TEST' GROUP BY 1, 2)
SELECT dataset, idx, start, {r6('mean')} AS mean, {r6('deviation')} AS deviation, {r6('slope')} AS slope, {r6('high - low')} AS range FROM m JOIN g USING (dataset, idx)""")
def _(t):
    """The table function and an array function, called from SQL."""
    from outlane.functions import tables
    from outlane.functions.columns import z_norm
    tables.install(t.spark)
    t.scored_series().filter("split = 'TEST'").select("dataset", "idx", z_norm("values").alias("values")).createOrReplaceTempView("outlane_series")
    got = t.spark.sql("""
        SELECT w.dataset, w.idx, w.start, w.mean, w.deviation, w.slope, r.r[1] - r.r[0] AS range
        FROM series_windows(TABLE(SELECT dataset, idx, values FROM outlane_series) PARTITION BY (dataset, idx), 16, 8) w
        JOIN (SELECT dataset, idx, series_feature('range', values) AS r FROM outlane_series) r ON r.dataset = w.dataset AND r.idx = w.idx""")
    return got.withColumns({c: R6(c) for c in ("mean", "deviation", "slope", "range")})
