"""Queries for image textures of series."""

from outlane.operators import images as I
from outlane.plans.features import long, zraw
from outlane.plans.registry import fragment, query, r6

S = 32

fragment("res", "zraw", f"""
SELECT id, i, values[CAST(floor(x) AS INT) + 1] + (values[CAST(least(floor(x) + 1, 63) AS INT) + 1] - values[CAST(floor(x) AS INT) + 1]) * (x - floor(x)) AS v
FROM (SELECT *, i * 63 / {S - 1} AS x FROM (SELECT id, values, unnest(range({S})) AS i FROM zraw))""")
fragment("phi", "res", "SELECT id, i, acos(least(1.0, greatest(-1.0, 2 * (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-6) - 1))) AS phi FROM res WINDOW w AS (PARTITION BY id)")
fragment("gasf", "phi", f"SELECT a.id, a.i * {S} + b.i AS px, cos(a.phi + b.phi) AS v FROM phi a JOIN phi b ON a.id = b.id")
fragment("dist", "res", f"SELECT a.id, a.i * {S} + b.i AS px, abs(a.v - b.v) AS d FROM res a JOIN res b ON a.id = b.id")
fragment("rp", "dist", "SELECT id, px, exp(-d / s) AS v FROM dist JOIN (SELECT id, quantile_cont(d, 0.75) + 1e-6 AS s FROM dist GROUP BY 1) USING (id)")


def pixels(t, kind, size=S):
    return long(zraw(t).withColumn("vec", I.KINDS[kind]("values", size)), "id", name="px")


@query("gasf_image", "gasf", f"SELECT id, px, {r6('v')} AS v FROM gasf")
def _(t):
    return pixels(t, "gasf")


@query("gadf_image", "phi", f"SELECT a.id, a.i * {S} + b.i AS px, {r6('sin(a.phi - b.phi)')} AS v FROM phi a JOIN phi b ON a.id = b.id")
def _(t):
    return pixels(t, "gadf")


@query("transition_field_image", "res", f"""
WITH q AS (SELECT id, {', '.join(f'quantile_cont(v, {k / 8}) AS e{k}' for k in range(1, 8))} FROM res GROUP BY 1),
s AS (SELECT id, i, {' + '.join(f'CASE WHEN e{k} <= v THEN 1 ELSE 0 END' for k in range(1, 8))} AS s FROM res JOIN q USING (id)),
m AS (SELECT a.id, a.s AS a, b.s AS b, count(*) AS c FROM s a JOIN s b ON a.id = b.id AND b.i = a.i + 1 GROUP BY 1, 2, 3),
g AS (SELECT id, a, b, coalesce(c, 0) + 0.001 AS c FROM (SELECT id, a, unnest(range(8)) AS b FROM (SELECT DISTINCT id, unnest(range(8)) AS a FROM s)) LEFT JOIN m USING (id, a, b)),
p AS (SELECT id, a, b, c / sum(c) OVER (PARTITION BY id, a) AS p FROM g)
SELECT x.id, x.i * {S} + y.i AS px, {r6('p')} AS v FROM s x JOIN s y ON x.id = y.id JOIN p ON p.id = x.id AND p.a = x.s AND p.b = y.s""")
def _(t):
    return pixels(t, "mtf")


@query("recurrence_image", "rp", f"SELECT id, px, {r6('v')} AS v FROM rp")
def _(t):
    return pixels(t, "rp")


@query("multiscale_recurrence_image", "dist", f"""
SELECT id, px, {r6('(exp(-d / a) + exp(-d / b) + exp(-d / c)) / 3')} AS v FROM dist JOIN (SELECT id, quantile_cont(d, 0.5) + 1e-6 AS a, quantile_cont(d, 0.75) + 1e-6 AS b, quantile_cont(d, 0.9) + 1e-6 AS c FROM dist GROUP BY 1) USING (id)""")
def _(t):
    return pixels(t, "multi_rp")


@query("spectrogram_image", "zraw", f"""
WITH f AS (SELECT id, values, unnest(range(7)) AS fr FROM zraw),
d AS (SELECT id, fr, r, sum(values[fr * 8 + j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 15)) * cos(2 * pi() * j * k / 16)) AS re, sum(values[fr * 8 + j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 15)) * sin(2 * pi() * j * k / 16)) AS im
  FROM f, range(16) j(j), (SELECT r, round_even(r * 8 / 7.0, 0) AS k FROM range(8) r(r)) GROUP BY 1, 2, 3),
h AS (SELECT id, fr, r, ln(1 + sqrt(re * re + im * im)) AS h FROM d),
g AS (SELECT a.id, a.r * 8 + c AS px, a.h * (1 - share) + b.h * share AS g FROM (SELECT c, least(CAST(floor(c * 6 / 7.0) AS INT), 5) AS lo, c * 6 / 7.0 - least(CAST(floor(c * 6 / 7.0) AS INT), 5) AS share FROM range(8) c(c))
  JOIN h a ON a.fr = lo JOIN h b ON b.id = a.id AND b.r = a.r AND b.fr = lo + 1)
SELECT id, px, {r6('(g - min(g) OVER w) / (max(g) OVER w - min(g) OVER w + 1e-6)')} AS v FROM g WINDOW w AS (PARTITION BY id)""")
def _(t):
    return pixels(t, "spectrogram", 8)


@query("scalogram_image", "zraw", f"""
WITH t AS (SELECT t, least(CAST(floor(t * 63 / 95.0) AS INT), 62) AS lo, t * 63 / 95.0 - least(CAST(floor(t * 63 / 95.0) AS INT), 62) AS share FROM range(96) t(t)),
y AS (SELECT id, t, y - avg(y) OVER (PARTITION BY id) AS y FROM (SELECT id, t, values[lo + 1] * (1 - share) + values[lo + 2] * share AS y FROM zraw, t)),
s AS (SELECT i, scale, least(48, greatest(4, ceil(6 * scale))) AS reach FROM (SELECT i, 2 * pow(4, i / 15.0) AS scale FROM range(16) i(i))),
w AS (SELECT i, o, reach, exp(-pow(o / scale, 2) / 2) * cos(5 * o / scale) AS w FROM s, (SELECT unnest(range(-48, 49)) AS o) WHERE abs(o) <= reach),
e AS (SELECT i, o, (w - m) / (sqrt(sum((w - m) * (w - m)) OVER (PARTITION BY i)) + 1e-6) AS w FROM (SELECT *, avg(w) OVER (PARTITION BY i) AS m FROM w)),
c AS (SELECT c, side, least(CAST(floor(c * 95 / 15.0) AS INT), 94) + side AS at, c * 95 / 15.0 - least(CAST(floor(c * 95 / 15.0) AS INT), 94) AS share FROM range(16) c(c), range(2) s(side)),
r AS (SELECT id, i, c, side, any_value(share) AS share, abs(sum(y * w)) AS r FROM c, e JOIN y ON true WHERE y.t = c.at - e.o GROUP BY 1, 2, 3, 4),
g AS (SELECT id, i * 16 + c AS px, ln(1 + sum(CASE side WHEN 0 THEN r * (1 - share) ELSE r * share END)) AS g FROM r GROUP BY 1, 2)
SELECT id, px, {r6('(g - min(g) OVER w) / (max(g) OVER w - min(g) OVER w + 1e-6)')} AS v FROM g WINDOW w AS (PARTITION BY id)""")
def _(t):
    return pixels(t, "scalogram", 16)


def texture(t, kinds, name):
    return long(I.image_features(zraw(t), kinds, S, name), "id")


def hog_sql(rel: str) -> str:
    return f"""WITH g AS (SELECT p.id, p.px % {S} AS x, p.px // {S} AS y, CASE WHEN p.px % {S} > 0 THEN p.v - l.v ELSE 0 END AS gx, CASE WHEN p.px // {S} > 0 THEN p.v - u.v ELSE 0 END AS gy
  FROM {rel} p LEFT JOIN {rel} l ON l.id = p.id AND l.px = p.px - 1 LEFT JOIN {rel} u ON u.id = p.id AND u.px = p.px - {S}),
a AS (SELECT id, (y // {S // 4}) * 4 + x // {S // 4} AS cell, sqrt(gx * gx + gy * gy) AS m, atan2(gy, gx) - floor(atan2(gy, gx) / pi()) * pi() AS ang FROM g),
h AS (SELECT id, cell * 8 + CAST(greatest(0, least(7, floor(ang / pi() * 8))) AS INT) AS feature, sum(m) AS v FROM a GROUP BY 1, 2),
f AS (SELECT id, feature, coalesce(v, 0) AS v FROM (SELECT DISTINCT id, unnest(range(128)) AS feature FROM {rel}) LEFT JOIN h USING (id, feature))
SELECT id, feature, {r6('v / (sqrt(sum(v * v) OVER (PARTITION BY id)) + 1e-6)')} AS v FROM f"""


@query("hog_texture", "rp", hog_sql("rp"))
def _(t):
    return texture(t, ["rp"], "hog")


CODE = " + ".join(f"CASE WHEN n{b}.v >= p.v THEN {1 << b} ELSE 0 END" for b in range(8))
JOINS = " ".join(f"JOIN rp n{b} ON n{b}.id = p.id AND n{b}.px = p.px + ({dy * S + dx})" for b, (dy, dx) in enumerate(I.NEIGHBOURS))
INNER = (S - 2) * (S - 2)


@query("lbp_texture", "rp", f"""
WITH c AS (SELECT p.id, {CODE} AS feature FROM rp p {JOINS} WHERE p.px % {S} BETWEEN 1 AND {S - 2} AND p.px // {S} BETWEEN 1 AND {S - 2}),
h AS (SELECT id, feature, count(*) AS n FROM c GROUP BY 1, 2)
SELECT id, feature, {r6(f'coalesce(n, 0) / ({INNER} + 1e-6)')} AS v FROM (SELECT DISTINCT id, unnest(range(256)) AS feature FROM rp) LEFT JOIN h USING (id, feature)""")
def _(t):
    return texture(t, ["rp"], "lbp")


def _glcm_sql():
    stats = ("sum(pow(i - j, 2) * p)", "sum(abs(i - j) * p)", "sum(p / (1 + abs(i - j)))", "sum(p * p)", "sqrt(sum(p * p))", "-sum(p * ln(p + 1e-6))",
             "sum((i - mi) * (j - mj) * p) / ((sqrt(sum(pow(i - mi, 2) * p)) + 1e-6) * (sqrt(sum(pow(j - mj, 2) * p)) + 1e-6))")
    parts = []
    for o, (dy, dx) in enumerate(I.OFFSETS):
        parts.append(f"""SELECT a.id, {o} AS o, a.q AS i, b.q AS j FROM q a JOIN q b ON a.id = b.id AND b.px = a.px + {dy * S + dx} AND b.px % {S} - a.px % {S} = {dx}""")
    return f"""WITH q AS (SELECT id, px, CAST(greatest(0, least(7, floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-6) * 8))) AS INT) AS q FROM rp WINDOW w AS (PARTITION BY id)),
e AS ({' UNION ALL '.join(parts)}), m AS (SELECT id, o, i, j, count(*) AS c FROM (SELECT * FROM e UNION ALL SELECT id, o, j, i FROM e) GROUP BY ALL),
p AS (SELECT *, c / (sum(c) OVER (PARTITION BY id, o) + 1e-6) AS p FROM m), s AS (SELECT *, sum(i * p) OVER (PARTITION BY id, o) AS mi, sum(j * p) OVER (PARTITION BY id, o) AS mj FROM p)
SELECT id, feature, {r6('v')} AS v FROM ({' UNION ALL '.join(f'SELECT id, o * 7 + {k} AS feature, {e} AS v FROM s GROUP BY id, o' for k, e in enumerate(stats))})"""


@query("glcm_texture", "rp", _glcm_sql())
def _(t):
    return texture(t, ["rp"], "glcm")


@query("image_feature_set", "gasf rp", f"SELECT * FROM ({hog_sql('gasf')}) UNION ALL SELECT id, feature + 128, v FROM ({hog_sql('rp')})")
def _(t):
    return texture(t, ["gasf", "rp"], "hog")
