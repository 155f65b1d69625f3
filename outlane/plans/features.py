"""Queries for features of single series and feature selection."""

import math

from pyspark.sql import functions as F

from outlane.functions import columns as C
from outlane.functions.columns import r6 as R6
from outlane.operators import features as X
from outlane.operators import kernels as N
from outlane.plans.prep import raw
from outlane.plans.registry import fragment, query, r6
from outlane.plans.scoring import vectors

L = 64
AK = ("dataset", "split", "idx")
KEY = "dataset, split, idx"


def zraw(t):
    return t.once("zraw", lambda: raw(t).withColumn("values", C.z_norm("values")))


def zarch(t):
    return t.once("zarch", lambda: t.scored_series().withColumn("values", C.z_norm("values")))


def long(df, *keys, col="vec", name="feature"):
    got = df.select(*keys, F.posexplode(col).alias(name, "v"))
    return got.select(*keys, F.col(name).cast("bigint").alias(name), R6("v").alias("v"))


def bank_sql(bank, extra=(), length=L):
    """A kernel bank as VALUES (k, j, w, dilation, padding, extras)."""
    rows = []
    for k, kernel in enumerate(bank):
        span = (len(kernel["weights"]) - 1) * kernel["dilation"] + 1
        pad = span // 2 if kernel["padding"] else 0
        size = length + 2 * pad - span + 1
        for j, w in enumerate(kernel["weights"]):
            rows.append(f"({k}, {j}, {w!r}::DOUBLE, {kernel['dilation']}, {pad}, {size}{''.join(', ' + repr(float(kernel[e])) + '::DOUBLE' for e in extra)})")
    cols = ", ".join(("k", "j", "w", "d", "pad", "size") + tuple(extra))
    return f"(VALUES {', '.join(rows)}) AS bank({cols})"


def conv_sql(bank, rel, keys, extra=(), length=L):
    """Outputs (keys, k, p, c): sum over taps; positions outside are zero."""
    more = "".join(f", any_value({e}) AS {e}" for e in extra)
    return f"""SELECT {keys}, k, p, sum(CASE WHEN p + j * d - pad BETWEEN 0 AND {length - 1} THEN w * values[p + j * d - pad + 1] ELSE 0 END) AS c{more}
FROM {rel}, (SELECT *, unnest(range(size)) AS p FROM {bank_sql(bank, extra, length)}) GROUP BY {keys}, k, p"""


fragment("zraw", "zpts", "SELECT id, label, list(v ORDER BY pos) AS values FROM zpts GROUP BY 1, 2")
fragment("zarch", "points", "SELECT dataset, split, idx, list(v ORDER BY pos) AS values FROM points GROUP BY 1, 2, 3")

COUNT = 64
BANK = N.random_kernels(L, COUNT)


@query("dilated_convolution", "zraw", f"SELECT id, p, {r6(f'c + {BANK[1]['bias']!r}')} AS v FROM ({conv_sql([BANK[1]], 'zraw', 'id')})")
def _(t):
    return long(zraw(t).withColumn("vec", N.convolution("values", BANK[1])), "id", name="p")


ROCKET = f"SELECT {KEY}, 2 * k + s AS feature, CASE s WHEN 0 THEN max(c + bias) ELSE avg(CASE WHEN c + bias > 0 THEN 1 ELSE 0 END) END AS v FROM conv, (SELECT unnest([0, 1]) AS s) GROUP BY {KEY}, k, s"
fragment("conv", "zarch", conv_sql(BANK, "zarch", KEY, ("bias",)))


@query("random_kernel_bank", "conv", f"SELECT k, CAST(len AS BIGINT) AS taps, d AS dilation, padded, {r6('bias')} AS bias, {r6('avg(c)')} AS response FROM conv JOIN (SELECT k AS kk, count(*) AS len, any_value(d) AS d, CASE WHEN any_value(pad) > 0 THEN 1 ELSE 0 END AS padded FROM {bank_sql(BANK, ('bias',))} GROUP BY 1) ON kk = k GROUP BY ALL")
def _(t):
    """The bank, and each kernel's mean output over all places of all series."""
    rows = zarch(t).select(F.posexplode(N.mean_responses("values", COUNT)).alias("k", "v")).groupBy("k").agg(R6(F.avg("v")).alias("response"))
    bank = t.spark.createDataFrame([(k, len(b["weights"]), b["dilation"], int(b["padding"]), b["bias"]) for k, b in enumerate(BANK)], "k int, taps bigint, dilation int, padded int, bias double")
    return bank.withColumn("bias", R6("bias")).join(rows, "k")


@query("rocket_features", "conv", f"SELECT {KEY}, feature, {r6('v')} AS v FROM ({ROCKET})")
def _(t):
    return long(zarch(t).withColumn("vec", N.rocket_features("values", COUNT)), *AK)


@query("kernel_block_features", "zraw", f"""
SELECT id, 2 * k AS feature, {r6('max(c + bias)')} AS v FROM ({conv_sql(N.random_kernels(L, COUNT, first=COUNT), 'zraw', 'id', ('bias',))}) GROUP BY 1, 2
UNION ALL SELECT id, 2 * k + 1, {r6('avg(CASE WHEN c + bias > 0 THEN 1 ELSE 0 END)')} FROM ({conv_sql(N.random_kernels(L, COUNT, first=COUNT), 'zraw', 'id', ('bias',))}) GROUP BY 1, 2""")
def _(t):
    return long(zraw(t).withColumn("vec", N.block_features("values", 1, COUNT)), "id")


@query("dictionary_kernel_bank", "pts", f"""
WITH c AS (SELECT i, j, k FROM range(9) a(i), range(9) b(j), range(9) c(k) WHERE i < j AND j < k)
SELECT i * 100 + j * 10 + k AS kernel, {r6('3 * (s[1 + i] + s[1 + j] + s[1 + k]) - list_sum(s)')} AS total FROM c, (
  SELECT list(s ORDER BY tap) AS s FROM (SELECT tap, round(sum(v), 6) AS s FROM pts, range(9) t(tap) WHERE pos BETWEEN tap AND 55 + tap GROUP BY 1))""")
def _(t):
    """Each kernel's outputs summed over all series and places."""
    points = raw(t).select(F.posexplode("values").alias("pos", "v"))
    sums = points.agg(F.array(*[F.round(F.sum(F.when(F.col("pos").between(tap, L - 9 + tap), F.col("v"))), 6) for tap in range(9)]).alias("s"))
    bank = F.explode(F.array(*[F.struct(F.lit(int("".join(str(i) for i, w in enumerate(k) if w > 0))).cast("bigint").alias("kernel"), F.array(*[F.lit(w) for w in k]).alias("w"))
                               for k in N.dictionary_kernels()]))
    return sums.select("s", bank.alias("b")).select("b.kernel", R6(C.array_sum(F.zip_with("b.w", "s", lambda a, b: a * b))).alias("total"))


#: The bias fit is registered for a whole bank, pooling for its first part.
BIASES = 256
PARAMS = N.dictionary_params(L, COUNT)
fragment("dconv", "zarch", conv_sql(PARAMS, "zarch", KEY, ("quantile",)))


def bias_sql(params) -> str:
    return " UNION ALL ".join(f"SELECT dataset, k, quantile_cont(c, {p['quantile']!r}) AS bias FROM {{0}} WHERE split = 'TRAIN' AND k = {i} GROUP BY 1, 2" for i, p in enumerate(params))


BIAS = bias_sql(PARAMS)
fragment("biases", "dconv", BIAS.format("dconv"))


fragment("dconv_all", "zarch", conv_sql(N.dictionary_params(L, BIASES), "zarch", KEY, ("quantile",)))


def biases(t, count=COUNT):
    return N.fit_biases(zarch(t).filter("split = 'TRAIN'"), L, count)


@query("fitted_bias", "dconv_all", f"SELECT dataset, CAST(k AS BIGINT) AS feature, {r6('bias')} AS v FROM ({bias_sql(N.dictionary_params(L, BIASES)).format('dconv_all')})")
def _(t):
    return long(biases(t, BIASES).withColumnRenamed("biases", "vec"), "dataset")


@query("share_above_bias", "dconv biases", f"SELECT {KEY}, k AS feature, {r6('avg(CASE WHEN c > bias THEN 1 ELSE 0 END)')} AS v FROM dconv JOIN biases USING (dataset, k) GROUP BY {KEY}, k")
def _(t):
    return long(N.pooled_features(zarch(t), biases(t), L, COUNT, all_pools=False), *AK)


POOLS = f"""
WITH e AS (SELECT {KEY}, k, p, c - bias AS x, c > bias AS a, count(*) OVER (PARTITION BY {KEY}, k) AS n FROM CONV JOIN BIAS USING (dataset, k)),
i AS (SELECT {KEY}, k, max(len) AS longest FROM (SELECT {KEY}, k, g, count(*) AS len FROM (SELECT *, p - row_number() OVER (PARTITION BY {KEY}, k ORDER BY p) AS g FROM e WHERE a) GROUP BY ALL) GROUP BY ALL)
SELECT {KEY}, k, s, CASE s WHEN 0 THEN avg(CASE WHEN a THEN 1 ELSE 0 END) WHEN 1 THEN coalesce(avg(CASE WHEN a THEN x END), 0) WHEN 2 THEN coalesce(avg(CASE WHEN a THEN p / greatest(1, n - 1) END), 0)
  ELSE coalesce(any_value(longest), 0) / any_value(n) END AS v FROM e LEFT JOIN i USING ({KEY}, k), (SELECT unnest(range(4)) AS s) GROUP BY {KEY}, k, s"""
fragment("pools", "dconv biases", POOLS.replace("CONV", "dconv").replace("BIAS", "biases"))


@query("multi_pool_features", "pools", f"SELECT {KEY}, 4 * k + s AS feature, {r6('v')} AS v FROM pools")
def _(t):
    return long(N.pooled_features(zarch(t), biases(t), L, COUNT), *AK)


fragment("zarch_diff", "points", """SELECT dataset, split, idx, list(v ORDER BY pos) AS values FROM (
  SELECT dataset, split, idx, pos, v - coalesce(lag(v) OVER (PARTITION BY dataset, split, idx ORDER BY pos), v) AS v FROM points) GROUP BY 1, 2, 3""")
fragment("dconv_diff", "zarch_diff", conv_sql(PARAMS, "zarch_diff", KEY, ("quantile",)))
fragment("biases_diff", "dconv_diff", BIAS.format("dconv_diff"))
fragment("pools_diff", "dconv_diff biases_diff", POOLS.replace("CONV", "dconv_diff").replace("BIAS", "biases_diff"))


@query("raw_and_diff_pool_features", "pools pools_diff", f"""
SELECT 'raw' AS representation, {KEY}, 4 * k + s AS feature, {r6('v')} AS v FROM pools UNION ALL SELECT 'diff', {KEY}, 4 * k + s, {r6('v')} FROM pools_diff""")
def _(t):
    """The pooled set on the series and on its change, side by side."""
    rows = zarch(t)
    diff = rows.withColumn("values", C.first_difference("values"))
    parts = [N.pooled_features(r, N.fit_biases(r.filter("split = 'TRAIN'"), L, COUNT), L, COUNT).withColumn("representation", F.lit(n)) for n, r in (("raw", rows), ("diff", diff))]
    return long(parts[0].unionByName(parts[1]), "representation", *AK)


# ---- intervals ---------------------------------------------------------------

def spans_sql(spans):
    return "(VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(spans)) + ") AS sp(span, a, b)"


RANDOM = X.random_intervals(L, 6)
EVEN = X.even_intervals(L, 4)


@query("random_intervals", "zpts", f"SELECT id, span, count(*) AS points, {r6('sum(v)')} AS total FROM zpts, {spans_sql(RANDOM)} WHERE pos >= a AND pos < b GROUP BY 1, 2")
def _(t):
    got = zraw(t).withColumn("vec", X.over_spans("values", RANDOM, lambda s: F.array(F.struct(F.size(s).cast("bigint").alias("points"), R6(C.array_sum(s)).alias("total")))))
    return got.select("id", F.posexplode("vec").alias("span", "s")).select("id", "span", "s.points", "s.total")


@query("representation_sets", "pts dft", f"""
WITH d AS (SELECT id, pos, v, v - coalesce(lag(v) OVER (PARTITION BY id ORDER BY pos), v) AS d1 FROM pts)
SELECT id, 'raw' AS representation, pos AS feature, {r6('v')} AS v FROM d UNION ALL SELECT id, 'diff1', pos, {r6('d1')} FROM d
UNION ALL SELECT id, 'diff2', pos, {r6('d1 - coalesce(lag(d1) OVER (PARTITION BY id ORDER BY pos), d1)')} FROM d UNION ALL SELECT id, 'fft', k, {r6('sqrt(re * re + im * im)')} FROM dft""")
def _(t):
    return long(X.representations(raw(t).drop("label")), "id", "representation", col="values")


STATS = ("avg(v)", "stddev_pop(v)", "min(v)", "max(v)", "quantile_cont(v, 0.5)", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)", "regr_slope(v, pos)",
         "avg(pow(v - m, 3)) / pow(stddev_pop(v), 3)", "avg(pow(v - m, 4)) / pow(stddev_pop(v), 4) - 3")


@query("interval_moments", "zpts", f"""
WITH s AS (SELECT id, span, pos, v, avg(v) OVER (PARTITION BY id, span) AS m FROM zpts, {spans_sql(RANDOM)} WHERE pos >= a AND pos < b)
{' UNION ALL '.join(f'SELECT id, span * 9 + {i} AS feature, {r6(e)} AS v FROM s GROUP BY id, span' for i, e in enumerate(STATS))}""")
def _(t):
    return long(zraw(t).withColumn("vec", X.over_spans("values", RANDOM, X.span_moments)), "id")


@query("even_interval_grid", "zpts", f"SELECT id, span, {r6('avg(v)')} AS v FROM zpts, {spans_sql(EVEN)} WHERE pos >= a AND pos < b GROUP BY 1, 2")
def _(t):
    got = zraw(t).withColumn("vec", X.over_spans("values", EVEN, lambda s: F.array(C.array_mean(s))))
    return long(got, "id", name="span")


SUMMARY = ("avg(v)", "stddev_pop(v)", "min(v)", "max(v)", *[f"quantile_cont(v, {q})" for q in (0.05, 0.25, 0.5, 0.75, 0.95)], "sum((v - m) * x) / (sum(x * x) + 1e-9)")


def summary_sql(rel, spans, offset=0):
    inner = f"(SELECT *, avg(v) OVER (PARTITION BY id, span) AS m, -1 + 2.0 * (pos - a) / greatest(1, b - a - 1) AS x FROM {rel}, {spans_sql(spans)} WHERE pos >= a AND pos < b)"
    return " UNION ALL ".join(f"SELECT id, {offset} + span * 10 + {i} AS feature, {e} AS v FROM {inner} GROUP BY id, span" for i, e in enumerate(SUMMARY))


@query("segment_summary", "zpts", f"SELECT id, feature, {r6('v')} AS v FROM ({summary_sql('zpts', EVEN)})")
def _(t):
    return long(zraw(t).withColumn("vec", X.over_spans("values", EVEN, X.span_summary)), "id")


fragment("zdiff", "zpts", "SELECT id, pos, v - coalesce(lag(v) OVER (PARTITION BY id ORDER BY pos), v) AS v FROM zpts")
fragment("zdft", "zpts", "SELECT id, k, sqrt(pow(sum(v * cos(2 * pi() * k * pos / 64)), 2) + pow(sum(v * sin(2 * pi() * k * pos / 64)), 2)) AS m FROM zpts, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2")
BANDS = X.band_edges(L // 2, 24)
N_EVEN = len(EVEN) * 10


@query("interval_quantile_features", "zpts zdiff", f"SELECT id, feature, {r6('v')} AS v FROM ({summary_sql('zpts', EVEN)} UNION ALL {summary_sql('zdiff', EVEN, N_EVEN)})")
def _(t):
    wide = zraw(t).withColumn("d", C.first_difference("values"))
    return long(wide.withColumn("vec", F.concat(X.over_spans("values", EVEN, X.span_summary), X.over_spans("d", EVEN, X.span_summary))), "id")


def band_sql(offset=0):
    return f"SELECT id, {offset} + span AS feature, avg(ln(1 + m)) AS v FROM zdft, {spans_sql(BANDS)} WHERE k - 1 >= a AND k - 1 < b GROUP BY 1, 2"


@query("interval_frequency_embedding", "zpts zdiff zdft", f"SELECT id, feature, {r6('v')} AS v FROM ({summary_sql('zpts', X.even_intervals(L, 3))} UNION ALL {summary_sql('zdiff', X.even_intervals(L, 3), 40)} UNION ALL {band_sql(80)})")
def _(t):
    return long(X.interval_frequency(zraw(t), L, 3, 24), "id")


@query("spectral_magnitude", "zdft", f"SELECT id, k - 1 AS feature, {r6('ln(1 + m)')} AS v FROM zdft WHERE k BETWEEN 1 AND 20")
def _(t):
    return long(zraw(t).withColumn("vec", C.fixed_width(X.log_spectrum("values"), 20)), "id")


@query("spectral_bands", "zdft", f"SELECT id, feature, {r6('v')} AS v FROM ({band_sql()})")
def _(t):
    return long(zraw(t).withColumn("f", X.log_spectrum("values")).withColumn("vec", X.band_means("f", L // 2, 24)), "id")


EDGES = [int(i * 33 / 8) for i in range(9)]
PROFILE = ("avg(v)", "stddev_pop(v)", "quantile_cont(v, 0.5)", "quantile_cont(v, 0.9) - quantile_cont(v, 0.1)", "max(abs(v))")


@query("spectral_derivative_profile", "zpts zdiff zdft", f"""
WITH d2 AS (SELECT id, pos, v - coalesce(lag(v) OVER (PARTITION BY id ORDER BY pos), v) AS v FROM zdiff),
p AS (SELECT id, k, CASE WHEN k = 0 THEN 0 ELSE m END / (sum(CASE WHEN k = 0 THEN 0 ELSE m END) OVER (PARTITION BY id) + 1e-9) AS p FROM zdft),
f AS ({' UNION ALL '.join(f'SELECT id, {5 * r + i} AS feature, {e} AS v FROM {rel} GROUP BY id' for r, rel in enumerate(('zpts', 'zdiff', 'd2')) for i, e in enumerate(PROFILE))}
  {' '.join(f'UNION ALL SELECT id, {15 + i}, sum(p) FROM p WHERE k >= {a} AND k < {b} GROUP BY id' for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))}
  UNION ALL SELECT id, 23, sum(p * k) / 32 FROM p GROUP BY id UNION ALL SELECT id, 24, -sum(p * ln(p + 1e-12)) / ln(33) FROM p GROUP BY id UNION ALL SELECT id, 25, max(p) FROM p GROUP BY id)
SELECT id, feature, {r6('v')} AS v FROM f""")
def _(t):
    return long(X.spectral_profile(zraw(t), 33), "id")


def _haar_sql():
    parts, heads, prev = [], [], "zpts"
    offset = 0
    for level in range(6):
        heads.append(f"h{level} AS (SELECT id, pos // 2 AS pos, (max(CASE WHEN pos % 2 = 0 THEN v END) - max(CASE WHEN pos % 2 = 1 THEN v END)) / sqrt(2) AS d, sum(v) / sqrt(2) AS v FROM {prev} GROUP BY 1, 2)")
        parts.append(f"SELECT id, {offset} + pos AS feature, d AS v FROM h{level}")
        offset += 32 >> level
        prev = f"h{level}"
    parts.append(f"SELECT id, {offset} + pos, v FROM h5")
    return f"WITH {', '.join(heads)} SELECT id, feature, {r6('v')} AS v FROM ({' UNION ALL '.join(parts)}) WHERE feature < 64"


@query("haar_wavelet", "zpts", _haar_sql())
def _(t):
    return long(zraw(t).withColumn("vec", X.haar("values", L, L)), "id")


# ---- shapelets ----------------------------------------------------------------

fragment("shapes", "zarch", """
WITH p AS (SELECT dataset, s, CASE s % 2 WHEN 0 THEN 8 ELSE 16 END AS w, arg_min(values, sha256('shape|' || dataset || '|' || s || '|' || idx)) AS values
           FROM zarch, (SELECT unnest(range(4)) AS s) WHERE split = 'TRAIN' GROUP BY 1, 2, 3),
c AS (SELECT *, CAST(floor(CAST('0x' || substr(sha256('shape|' || dataset || '|' || s || '|start'), 1, 8) AS BIGINT) / 4294967296.0 * (64 - w + 1)) AS BIGINT) AS start FROM p)
SELECT dataset, s, w, j, (x - avg(x) OVER q) / (stddev_pop(x) OVER q + 1e-6) AS x FROM (SELECT dataset, s, w, unnest(range(w)) AS j, unnest(values[start + 1 : start + w]) AS x FROM c) WINDOW q AS (PARTITION BY dataset, s)""")


def shapelets(t):
    return X.choose_shapelets(zarch(t).filter("split = 'TRAIN'"), L, 4, [8, 16])


@query("shapelet_pick", "shapes", f"SELECT dataset, s, j, {r6('x')} AS v FROM shapes")
def _(t):
    got = shapelets(t).select("dataset", F.posexplode("shapelets").alias("s", "shape")).select("dataset", "s", F.posexplode("shape").alias("j", "x"))
    return got.select("dataset", F.col("s").cast("bigint").alias("s"), F.col("j").cast("bigint").alias("j"), R6("x").alias("v"))


@query("shapelet_distance", "shapes zarch", f"""
WITH w AS (SELECT z.dataset, split, idx, s, st, j, z.values[st + j + 1] AS v, x FROM zarch z JOIN shapes sh ON sh.dataset = z.dataset, range(57) r(st) WHERE st + w <= 64),
d AS (SELECT {KEY}, s, st, sqrt(avg(pow((v - m) / (sd + 1e-6) - x, 2))) AS d FROM (SELECT *, avg(v) OVER q AS m, stddev_pop(v) OVER q AS sd FROM w WINDOW q AS (PARTITION BY {KEY}, s, st)) GROUP BY {KEY}, s, st)
SELECT {KEY}, s AS feature, {r6('min(d)')} AS v FROM d GROUP BY {KEY}, s""")
def _(t):
    return long(X.shapelet_distances(zarch(t), shapelets(t)), *AK)


# ---- selection and projection ---------------------------------------------------

fragment("tpts", "points", "SELECT dataset, pos, v, idx FROM points WHERE split = 'TRAIN'")


@query("stable_tail_pruning", "tpts", """
WITH q AS (SELECT *, quantile_cont(v, 0.25) OVER w AS q25, quantile_cont(v, 0.5) OVER w AS q50, quantile_cont(v, 0.75) OVER w AS q75 FROM tpts WINDOW w AS (PARTITION BY dataset, pos)),
s AS (SELECT dataset, pos, round(quantile_cont(r, 0.95) / (quantile_cont(r, 0.75) + 1e-6) + 0.25 * abs(avg(CASE WHEN abs(v) > 1e-8 THEN 1 ELSE 0 END) - 0.5), 9) AS score FROM (SELECT *, abs((v - q50) / (q75 - q25 + 1e-6)) AS r FROM q) GROUP BY 1, 2)
SELECT dataset, CAST(pos AS BIGINT) AS feature FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score, pos) <= 20""")
def _(t):
    rows = vectors(t).filter("split = 'TRAIN'")
    return X.stable_tail(rows, 20).select("dataset", F.col("feature").cast("bigint").alias("feature"))


@query("feature_stability_selection", "tpts", """
WITH q AS (SELECT *, quantile_cont(v, 0.5) OVER w AS q50, quantile_cont(v, 0.9) OVER w - quantile_cont(v, 0.1) OVER w AS spread FROM tpts WINDOW w AS (PARTITION BY dataset, pos)),
s AS (SELECT dataset, pos, round(any_value(spread) / (quantile_cont(abs(v - q50), 0.5) + 1e-6), 9) AS score FROM q GROUP BY 1, 2)
SELECT dataset, CAST(pos AS BIGINT) AS feature FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, pos DESC) <= 16""")
def _(t):
    return X.widest_spread(vectors(t).filter("split = 'TRAIN'"), 16).select("dataset", F.col("feature").cast("bigint").alias("feature"))


def _projection(t, method):
    return long(X.compressed(vectors(t), method, L, 4), *AK)


def axes_sql(train: str, count: int, centred: bool) -> str:
    """CTEs ``axes`` (dataset, mean, a1, a2, ...) of TRAIN points (dataset, idx, pos, v).

    The product matrix is squared 24 times, which leaves the product of its first
    axis with itself; that axis is taken out of the matrix for the next.
    """
    parts = [f"""tp AS MATERIALIZED (SELECT dataset, idx, pos, v, {'avg(v) OVER (PARTITION BY dataset, pos)' if centred else 'CAST(0 AS DOUBLE)'} AS m FROM {train}),
means AS MATERIALIZED (SELECT dataset, list(m ORDER BY pos) AS mean FROM (SELECT dataset, pos, any_value(m) AS m FROM tp GROUP BY 1, 2) GROUP BY 1),
g1 AS MATERIALIZED (SELECT dataset, list(r ORDER BY i) AS g FROM (SELECT dataset, i, list(s ORDER BY j) AS r FROM (
  SELECT a.dataset, a.pos AS i, b.pos AS j, sum((a.v - a.m) * (b.v - b.m)) AS s FROM tp a JOIN tp b ON a.dataset = b.dataset AND a.idx = b.idx GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)"""]
    trace = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i][i]))"
    for c in range(1, count + 1):
        parts.append(f"""s{c} AS (SELECT dataset, 0 AS step, list_transform(g, lambda r: list_transform(r, lambda x: x / t)) AS m FROM (SELECT *, {trace.format('g')} AS t FROM g{c})
  UNION ALL SELECT dataset, step + 1, list_transform(q, lambda r: list_transform(r, lambda x: x / t)) FROM (SELECT *, {trace.format('q')} AS t FROM (
    SELECT dataset, step, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS q FROM s{c} WHERE step < 24))),
v{c} AS MATERIALIZED (SELECT dataset, list_transform(u, lambda x: x * CASE WHEN u[list_position(list_transform(u, lambda y: abs(y)), list_max(list_transform(u, lambda y: abs(y))))] < 0 THEN -1 ELSE 1 END / sqrt(list_dot_product(u, u))) AS a{c} FROM (
  SELECT dataset, m[list_position(d, list_max(d))] AS u FROM (SELECT *, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM s{c} WHERE step = 24)))""")
        if c < count:
            parts.append(f"""g{c + 1} AS MATERIALIZED (SELECT dataset, list_transform(range(1, len(g) + 1), lambda i: list_transform(range(1, len(g) + 1), lambda j: g[i][j] - l * a{c}[i] * a{c}[j])) AS g FROM (
  SELECT g{c}.dataset, g, a{c}, list_dot_product(a{c}, list_transform(g, lambda r: list_dot_product(r, a{c}))) AS l FROM g{c} JOIN v{c} USING (dataset)))""")
    parts.append(f"axes AS MATERIALIZED (SELECT * FROM means {' '.join(f'JOIN v{c} USING (dataset)' for c in range(1, count + 1))})")
    return ", ".join(parts)


def projected_sql(centred: bool) -> str:
    taken = ", ".join(f"list_dot_product(x, a{c})" for c in range(1, 5))
    return f"""WITH RECURSIVE {axes_sql('tpts', 4, centred)},
r AS (SELECT {KEY}, list_transform(range(1, 65), lambda i: vec[i] - mean[i]) AS x, axes.* EXCLUDE (dataset) FROM (SELECT {KEY}, list(v ORDER BY pos) AS vec FROM points GROUP BY 1, 2, 3) JOIN axes USING (dataset))
SELECT {KEY}, f AS feature, {r6('z')} AS v FROM (SELECT {KEY}, unnest(range(4)) AS f, unnest([{taken}]) AS z FROM r)"""


@query("pca_projection", "points tpts", projected_sql(True))
def _(t):
    return _projection(t, "pca")


@query("truncated_svd", "points tpts", projected_sql(False))
def _(t):
    return _projection(t, "svd")


def _rp_sql(sparse):
    density = 1 / math.sqrt(L)
    u = lambda tag: f"(CAST('0x' || substr(sha256('92|' || c || '|' || pos || '|{tag}'), 1, 8) AS BIGINT) / 4294967296.0)"
    w = f"CASE WHEN {u('u')} >= {density!r} THEN 0 ELSE CASE WHEN {u('v')} < 0.5 THEN 1 ELSE -1 END * sqrt({1 / density / 4!r}) END" if sparse else f"sqrt(-2 * ln(1 - {u('u')})) * cos(2 * pi() * {u('v')}) / 2"
    return f"""WITH m AS (SELECT c, pos, {w} AS w FROM range(4) a(c), range(64) b(pos))
SELECT {KEY}, c AS feature, {r6('sum(v * w)')} AS v FROM points JOIN m USING (pos) GROUP BY {KEY}, c"""


@query("gaussian_random_projection", "points", _rp_sql(False))
def _(t):
    return _projection(t, "gaussian_rp")


@query("sparse_random_projection", "points", _rp_sql(True))
def _(t):
    return _projection(t, "sparse_rp")


@query("compression_dispatch", "points tpts", f"""
WITH q AS (SELECT *, quantile_cont(v, 0.5) OVER w AS q50, quantile_cont(v, 0.9) OVER w - quantile_cont(v, 0.1) OVER w AS spread FROM tpts WINDOW w AS (PARTITION BY dataset, pos)),
s AS (SELECT dataset, pos, round(any_value(spread) / (quantile_cont(abs(v - q50), 0.5) + 1e-6), 9) AS score FROM q GROUP BY 1, 2),
k AS (SELECT dataset, pos FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, pos DESC) <= 4)
SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY pos) - 1 AS feature, {r6('v')} AS v FROM points JOIN k USING (dataset, pos)""")
def _(t):
    return _projection(t, "stability_select")
