"""Queries for thresholds."""

from pyspark.sql import functions as F

from outlane.functions.columns import ERF, normal_quantile_value
from outlane.functions.columns import r6 as R6
from outlane.operators import thresholds as T
from outlane.plans.registry import fragment, query, r6

DS = ["dataset"]
fragment("train", "score", "SELECT * FROM score WHERE split = 'TRAIN'")
fragment("test", "score", "SELECT * FROM score WHERE split = 'TEST'")


def train(t):
    return t.score().filter("split = 'TRAIN'")


def train_once(t):
    """For thresholds that read the scores several times."""
    return t.score_once().filter("split = 'TRAIN'")


def test(t):
    return t.score().filter("split = 'TEST'")


def out(df, *cols):
    cols = cols or ("threshold",)
    return df.select("dataset", *[R6(c).alias(c) for c in cols])


def cap_sql(source: str, rate: str, keys: str = "dataset") -> str:
    """Count cap over a relation with (keys, idx, score)."""
    return f"""SELECT {keys}, score AS threshold, cap, n FROM (
  SELECT {keys}, score, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, idx) AS r, count(*) OVER (PARTITION BY {keys}) AS n,
    greatest(0, least(CAST(floor({rate} * count(*) OVER (PARTITION BY {keys})) AS BIGINT), count(*) OVER (PARTITION BY {keys}) - 1)) AS cap
  FROM {source}) WHERE r = cap + 1"""


@query("empirical_quantile", "train", f"SELECT dataset, {r6('quantile_cont(score, 0.98)')} AS threshold FROM train GROUP BY 1")
def _(t):
    return out(T.empirical(train(t), DS, 0.02))


@query("count_cap", "train", f"SELECT dataset, {r6('threshold')} AS threshold, cap, {r6('cap / greatest(1, n)')} AS q_effective FROM ({cap_sql('train', '0.1')})")
def _(t):
    got = T.count_cap(train(t), DS, 0.1)
    return got.select("dataset", R6("threshold").alias("threshold"), "cap", R6("q_effective").alias("q_effective"))


def _sweep_sql():
    parts = []
    for name, kind, v in T.SWEEP_RULES:
        if kind == "quantile":
            parts.append(f"SELECT dataset, '{name}' AS rule, quantile_cont(score, {1 - v}) AS threshold FROM train GROUP BY 1")
        else:
            n = "count(*) OVER (PARTITION BY dataset)"
            inner = cap_sql("train", v) if kind == "rate" else cap_sql("train", "1").replace(f"CAST(floor(1 * {n}) AS BIGINT)", str(v))
            parts.append(f"SELECT dataset, '{name}', threshold FROM ({inner})")
    return f"SELECT dataset, rule, {r6('threshold')} AS threshold FROM ({' UNION ALL '.join(parts)})"


@query("threshold_rule_sweep", "train", _sweep_sql())
def _(t):
    return T.sweep(train(t), DS).select("dataset", "rule", R6("threshold").alias("threshold"))


WEAK = ("f1", "f4")
METHODS = ("count_cap_3pct", "dynamic_1_over_n", "adaptive_v0", "family_guard_v1")


@query("rate_policy", "event_rows", f"""
WITH c AS (SELECT dataset, family, count(CASE WHEN split = 'TEST' THEN 1 END) AS n_test, quantile_cont(value * 10, 0.5) AS median_len FROM event_rows GROUP BY 1, 2)
SELECT dataset, {r6('0.03')} AS count_cap_3pct, {r6('greatest(0.001, 1.0 / greatest(1, n_test))')} AS dynamic_1_over_n,
  CASE WHEN n_test > 50 AND NOT median_len BETWEEN 513 AND 1024 THEN 0.03::DOUBLE ELSE 0.02::DOUBLE END AS adaptive_v0,
  CASE WHEN family IN {WEAK} OR median_len >= 512 THEN 0.03::DOUBLE ELSE 0.02::DOUBLE END AS family_guard_v1 FROM c""")
def _(t):
    rows = t.event_rows().groupBy("dataset", "family").agg(
        F.count_if(F.col("split") == "TEST").alias("n_test"), F.percentile(F.col("value") * 10, 0.5).alias("median_len"))
    return rows.select("dataset", *[R6(T.rate_policy(m, weak_families=WEAK)).alias(m) for m in METHODS])


@query("dynamic_rate_cap", "score", f"""
WITH q AS (SELECT dataset, greatest(0.001, 1.0 / greatest(1, count(*))) AS rate FROM score WHERE split = 'TEST' GROUP BY 1),
s AS (SELECT s.*, rate FROM score s JOIN q USING (dataset) WHERE split = 'TRAIN')
SELECT dataset, {r6('threshold')} AS threshold, cap FROM ({cap_sql('s', 'rate')})""")
def _(t):
    rates = test(t).groupBy("dataset").agg(T.dynamic_q(F.count(F.lit(1))).alias("rate"))
    got = T.count_cap(train(t).join(rates, "dataset"), ["dataset", "rate"], F.col("rate"))
    return got.select("dataset", R6("threshold").alias("threshold"), "cap")


Z98 = normal_quantile_value(0.98)
fragment("train_moments", "train", """
SELECT dataset, any_value(low) AS low, any_value(mean) AS mean, any_value(std) AS std, avg(pow(score - mean, 3)) / pow(any_value(std), 3) AS skew,
  avg(ln(score - low + 1e-6)) AS ln_mean, stddev_pop(ln(score - low + 1e-6)) AS ln_std, avg(score - low + 1e-6) AS shift_mean,
  quantile_cont(score, 0.98) AS fallback, count(*) AS n
FROM (SELECT *, min(score) OVER w AS low, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS std FROM train WINDOW w AS (PARTITION BY dataset)) GROUP BY 1""")
ADAPTIVE = f"""
SELECT dataset, skew, n, CASE WHEN std = 0 THEN fallback WHEN skew > 1.2 THEN exp(ln_mean + {Z98!r} * ln_std) + low - 1e-6
  WHEN skew < 0.2 THEN mean + {Z98!r} * std
  ELSE shift_mean * pow(1 - 1 / (9 * shape) + {Z98!r} / (3 * sqrt(shape)), 3) + low - 1e-6 END AS threshold
FROM (SELECT *, (3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) AS shape FROM (SELECT *, ln(shift_mean) - ln_mean AS s FROM MOMENTS))"""
fragment("adaptive", "train_moments", ADAPTIVE.replace("MOMENTS", "train_moments"))


@query("skew_adaptive_threshold", "adaptive", f"SELECT dataset, {r6('threshold')} AS threshold, {r6('skew')} AS skew FROM adaptive")
def _(t):
    return out(T.skew_adaptive(train(t), DS, 0.02), "threshold", "skew")


def tail_sql(tail: float) -> str:
    return f"""SELECT dataset, any_value(base) AS base, any_value(n) AS n, any_value(nt) AS nt, avg(x) AS b0, avg(x * (nt - i) / greatest(1, nt - 1)) AS a1
FROM (SELECT *, score - base AS x, count(*) OVER (PARTITION BY dataset) AS nt, row_number() OVER (PARTITION BY dataset ORDER BY score, idx) AS i
      FROM (SELECT *, quantile_cont(score, {tail}) OVER (PARTITION BY dataset) AS base, count(*) OVER (PARTITION BY dataset) AS n FROM wide_train)
      WHERE score > base) GROUP BY 1"""


# a wider grouping, so that tails hold more than ten excesses
fragment("wide_train", "train", "SELECT family AS dataset, row_number() OVER (PARTITION BY family ORDER BY dataset, idx) AS idx, score FROM train")
fragment("wide_moments", "wide_train", """
SELECT dataset, any_value(low) AS low, any_value(mean) AS mean, any_value(std) AS std, avg(pow(score - mean, 3)) / pow(any_value(std), 3) AS skew,
  avg(ln(score - low + 1e-6)) AS ln_mean, stddev_pop(ln(score - low + 1e-6)) AS ln_std, avg(score - low + 1e-6) AS shift_mean,
  quantile_cont(score, 0.98) AS fallback, count(*) AS n
FROM (SELECT *, min(score) OVER w AS low, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS std FROM wide_train WINDOW w AS (PARTITION BY dataset)) GROUP BY 1""")
fragment("wide_adaptive", "wide_moments", ADAPTIVE.replace("MOMENTS", "wide_moments"))
fragment("tail90", "wide_train", tail_sql(0.9))
TAIL = """CASE WHEN abs(k) < 1e-9 THEN -sigma * ln(1 - p) ELSE sigma / k * (1 - pow(1 - p, k)) END"""


def wide(t):
    from outlane.functions.order import with_position
    placed = with_position(train(t), ["family"], [("dataset", "asc"), ("idx", "asc")], "_i")
    return placed.select(F.col("family").alias("dataset"), F.col("_i").alias("idx"), "score")


@query("peaks_over_threshold", "tail90 wide_adaptive", f"""
WITH t AS (SELECT *, least(0.9999, greatest(0.9, 1 - 0.02 * n / nt)) AS p, b0 / (b0 - 2 * a1) - 2 AS k, 2 * b0 * a1 / (b0 - 2 * a1) AS sigma FROM tail90 WHERE nt > 10)
SELECT a.dataset, {r6('coalesce(base + ' + TAIL + ', a.threshold)')} AS threshold, coalesce((SELECT nt FROM tail90 x WHERE x.dataset = a.dataset), 0) AS excesses
FROM wide_adaptive a LEFT JOIN t ON t.dataset = a.dataset""")
def _(t):
    got = T.peaks_over_threshold(wide(t), DS, 0.02)
    return got.select("dataset", R6("threshold").alias("threshold"), "excesses")


@query("fixed_rate_tail", "tail90 wide_adaptive", f"""
WITH t AS (SELECT *, CASE WHEN 1 - 0.02 * n / nt < 0 THEN 0.98 WHEN 1 - 0.02 * n / nt >= 1 THEN 0.999 ELSE 1 - 0.02 * n / nt END AS p,
  b0 / (b0 - 2 * a1) - 2 AS k, 2 * b0 * a1 / (b0 - 2 * a1) AS sigma FROM tail90 WHERE nt > 10)
SELECT a.dataset, {r6('coalesce(base + ' + TAIL + ', a.threshold)')} AS threshold, CASE WHEN t.dataset IS NULL THEN 'adaptive_fallback' ELSE 'evt_gpd' END AS method
FROM wide_adaptive a LEFT JOIN t ON t.dataset = a.dataset""")
def _(t):
    got = T.fixed_tail(wide(t), DS, 0.02)
    return got.select("dataset", R6("threshold").alias("threshold"), "method")


@query("block_maxima_tail", "wide_train", f"""
WITH b AS (SELECT dataset, CASE WHEN count(*) OVER (PARTITION BY dataset) // 20 >= 5 THEN idx // 20 ELSE idx END AS block, score FROM wide_train),
m AS (SELECT dataset, block, max(score) AS m FROM b GROUP BY 1, 2),
f AS (SELECT dataset, avg(m) AS mean, stddev_pop(m) * sqrt(6) / pi() AS scale, avg(ln(m)) AS lm, pi() / (stddev_pop(ln(m)) * sqrt(6)) AS shape FROM m GROUP BY 1)
SELECT dataset, {r6(f'mean - {T.EULER} * scale - scale * ln(-ln(0.98))')} AS gumbel,
  {r6(f'exp(lm + {T.EULER} / shape) * pow(-ln(0.02), 1 / shape)')} AS weibull FROM f""")
def _(t):
    return out(T.block_tail(wide(t), DS, 0.98), "gumbel", "weibull")


fragment("lognormal", "train", f"""
SELECT dataset, exp(avg(ln(score)) + {Z98!r} * stddev_pop(ln(score))) AS threshold FROM train WHERE score > 0 GROUP BY 1""")


@query("lognormal_threshold", "lognormal", f"SELECT dataset, {r6('threshold')} AS threshold FROM lognormal")
def _(t):
    return out(T.lognormal(train(t), DS))


def cdf_sql(z: str) -> str:
    p, a1, a2, a3, a4, a5 = ERF
    x = f"(abs({z}) / sqrt(2.0))"
    u = f"(1 / (1 + {p} * {x}))"
    tail = f"((((({a5} * {u} + {a4}) * {u} + {a3}) * {u} + {a2}) * {u} + {a1}) * {u} * exp(-{x} * {x}))"
    return f"(0.5 + sign({z}) * (0.5 - {tail} / 2))"


fragment("kde", "train", f"""
SELECT dataset, coalesce(min(CASE WHEN mass >= 0.98 THEN x END), any_value(fallback)) AS threshold FROM (
  SELECT f.dataset, f.x, any_value(fallback) AS fallback, avg({cdf_sql('(f.x - s.score) / f.h')} - {cdf_sql('(f.lo - s.score) / f.h')}) AS mass
  FROM (SELECT *, lo + (2 * hi - lo) * unnest(range(1000)) / 999 AS x FROM (
    SELECT dataset, min(score) AS lo, max(score) AS hi, stddev_samp(score) * pow(count(*), -0.2) AS h, quantile_cont(score, 0.98) AS fallback FROM train GROUP BY 1)) f
  JOIN train s ON s.dataset = f.dataset GROUP BY 1, 2) GROUP BY 1""")


@query("kde_threshold", "kde", f"SELECT dataset, {r6('threshold')} AS threshold FROM kde")
def _(t):
    return out(T.kde(train_once(t), DS))


fragment("ks", "train", f"""
SELECT dataset, n, d, least(1.0, greatest(0.0, 2 * ({' + '.join(f'{(-1) ** (k - 1)} * exp({-2.0 * k * k} * n * d * d)' for k in range(1, 9))}))) AS p FROM (
  SELECT dataset, any_value(n) AS n, max(greatest(i / n - c, c - (i - 1) / n)) AS d FROM (
    SELECT dataset, n, i, {cdf_sql('((ln(score) - m) / s)')} AS c FROM (
      SELECT *, avg(ln(score)) OVER w AS m, stddev_pop(ln(score)) OVER w AS s, count(*) OVER w AS n,
        row_number() OVER (PARTITION BY dataset ORDER BY score, idx) AS i FROM train WHERE score > 0 WINDOW w AS (PARTITION BY dataset))) GROUP BY 1)""")


@query("ks_statistic", "ks", f"SELECT dataset, n, {r6('d')} AS d, {r6('p')} AS p FROM ks")
def _(t):
    return T.ks_statistic(train(t), DS).select("dataset", "n", R6("d").alias("d"), R6("p").alias("p"))


@query("ks_gated_threshold", "ks kde lognormal", f"""
SELECT dataset, {r6('CASE WHEN n >= 10 AND p >= 0.05 THEN l.threshold ELSE k.threshold END')} AS threshold,
  CASE WHEN n >= 10 AND p >= 0.05 THEN 'lognormal' ELSE 'kde' END AS method FROM ks JOIN kde k USING (dataset) JOIN lognormal l USING (dataset)""")
def _(t):
    return T.ks_gated(train_once(t), DS).select("dataset", R6("threshold").alias("threshold"), "method")


@query("size_hybrid_threshold", "train kde lognormal", f"""
SELECT dataset, {r6('CASE WHEN n < 34 THEN k.threshold ELSE l.threshold END')} AS threshold
FROM (SELECT dataset, count(*) AS n FROM train GROUP BY 1) JOIN kde k USING (dataset) JOIN lognormal l USING (dataset)""")
def _(t):
    return out(T.size_hybrid(train_once(t), DS, small=34))


fragment("pool_plain", "train", """
SELECT dataset, family, threshold FROM (SELECT DISTINCT dataset, family FROM train) JOIN
  (SELECT family, quantile_cont(score, 0.97) AS threshold FROM train GROUP BY 1) USING (family)""")


@query("family_pooled_threshold", "pool_plain", f"SELECT dataset, family, {r6('threshold')} AS threshold FROM pool_plain")
def _(t):
    return T.family_pooled(train(t), 0.97).withColumn("threshold", R6("threshold"))


@query("family_pooled_own_weight", "train", f"""
WITH s AS (SELECT family, dataset, count(*) AS n FROM train GROUP BY 1, 2), p AS (SELECT family, count(*) AS pool_n FROM train GROUP BY 1),
w AS (SELECT s.*, greatest(1, CAST(floor(pool_n * 0.5 / n) AS BIGINT)) AS times FROM s JOIN p USING (family)),
u AS (SELECT w.dataset, w.family, t.score FROM w JOIN train t USING (family)
      UNION ALL SELECT dataset, family, score FROM (SELECT w.dataset, w.family, t.score, unnest(range(times)) FROM w JOIN train t USING (dataset)))
SELECT dataset, family, {r6('quantile_cont(score, 0.97)')} AS threshold FROM u GROUP BY 1, 2""")
def _(t):
    return T.family_pooled(train(t), 0.97, 0.5).withColumn("threshold", R6("threshold"))


@query("pooled_select_with_cap", "pool_plain test", """
SELECT s.dataset, idx FROM test s JOIN pool_plain p USING (dataset) WHERE score > threshold
QUALIFY row_number() OVER (PARTITION BY s.dataset ORDER BY score DESC, idx) <= 2""")
def _(t):
    from outlane.operators.selection import above, cap_count
    limits = T.family_pooled(train(t), 0.97).select("dataset", "threshold")
    return cap_count(above(test(t), limits), ["dataset"], F.lit(2)).select("dataset", "idx")


fragment("cap10", "train", cap_sql("train", "0.1"))


@query("train_exceed_stats", "cap10 train", f"""
SELECT dataset, count(CASE WHEN score > threshold THEN 1 END) AS exceed_count, {r6('avg(CASE WHEN score > threshold THEN 1 ELSE 0 END)')} AS exceed_rate
FROM train JOIN cap10 USING (dataset) GROUP BY 1""")
def _(t):
    limits = T.count_cap(train(t), DS, 0.1).select("dataset", "threshold")
    return T.train_exceed(train(t), limits, DS).withColumn("exceed_rate", R6("exceed_rate"))


@query("margin_diagnostics", "cap10 test", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, idx DESC) AS r FROM test),
p AS (SELECT dataset, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY r) AS top_order, max(CASE WHEN r = 1 THEN score END) AS a, max(CASE WHEN r = 2 THEN score END) AS b
      FROM r WHERE r <= 10 GROUP BY 1)
SELECT dataset, selected, top_order, {r6('most')} AS most_selected, {r6('least')} AS least_selected, {r6('b')} AS top2_score, {r6('a')} AS top1_score, {r6('a - b')} AS top_gap, {r6('a - threshold')} AS threshold_margin
FROM p JOIN cap10 USING (dataset) JOIN (SELECT dataset, count(CASE WHEN score > threshold THEN 1 END) AS selected, max(CASE WHEN score > threshold THEN score END) AS most, min(CASE WHEN score > threshold THEN score END) AS least
  FROM test JOIN cap10 USING (dataset) GROUP BY 1) USING (dataset)""")
def _(t):
    limits = T.count_cap(train(t), DS, 0.1).select("dataset", "threshold")
    got = T.margins(test(t), limits, DS)
    return got.select("dataset", "selected", "top_order", *[R6(c).alias(c) for c in ("most_selected", "least_selected", "top2_score", "top1_score", "top_gap", "threshold_margin")])
