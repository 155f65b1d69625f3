"""Queries for cross-fitted scores, ensembles, generated series, periodicity."""

from pyspark.sql import functions as F

from outlane.functions import columns as C
from outlane.functions.columns import r6 as R6
from outlane.operators import fusion as U
from outlane.operators import kernels as N
from outlane.operators import models as M
from outlane.operators import scoring as K
from outlane.operators import thresholds as T
from outlane.plans.features import AK, KEY, L, axes_sql, conv_sql, long, zarch
from outlane.plans.prep import raw
from outlane.plans.registry import fragment, query, r6
from outlane.plans.scoring import rounded, scaled, vectors
from outlane.session import stage

fragment("folds", "archive", """
SELECT dataset, idx, CASE WHEN n < 20 THEN r - 1 ELSE (r - 1) % 5 END AS fold, CASE WHEN n < 20 THEN n ELSE 5 END AS folds FROM (
  SELECT dataset, idx, row_number() OVER (PARTITION BY dataset ORDER BY sha256('fold|' || dataset || '|' || idx), idx) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM archive WHERE split = 'TRAIN') WHERE n >= 2""")


@query("fold_plan", "folds", "SELECT dataset, idx, CAST(fold AS BIGINT) AS fold, CAST(folds AS BIGINT) AS folds FROM folds")
def _(t):
    return M.fold_plan(t.series().filter("split = 'TRAIN'"))


fragment("folds5", "archive", """
SELECT dataset, idx, (r - 1) % least(5, n) AS fold, least(5, n) AS folds FROM (
  SELECT dataset, idx, row_number() OVER (PARTITION BY dataset ORDER BY sha256('fold|' || dataset || '|' || idx), idx) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM archive WHERE split = 'TRAIN') WHERE n >= 2""")
for _cross, _folds in (("cross_all", "folds"), ("cross5", "folds5")):
    fragment(_cross, f"vectors_z {_folds}", f"""
SELECT dataset, f, CASE WHEN f = fold THEN 'HELD' ELSE 'TRAIN' END AS split, idx, vec FROM (
  SELECT v.dataset, v.idx, vec, fold, unnest(range(CAST(folds AS BIGINT))) AS f FROM vectors_z v JOIN {_folds} p ON p.dataset = v.dataset AND p.idx = v.idx WHERE split = 'TRAIN')
UNION ALL SELECT v.dataset, unnest(range(CAST(folds AS BIGINT))), 'TEST', v.idx, vec FROM vectors_z v JOIN (SELECT DISTINCT dataset, folds FROM {_folds}) p ON p.dataset = v.dataset WHERE split = 'TEST'""")
fragment("vectors_z", "points", "SELECT dataset, split, idx, list(v ORDER BY pos) AS vec FROM points GROUP BY 1, 2, 3")
FINAL = f"SELECT dataset, CASE split WHEN 'HELD' THEN 'TRAIN' ELSE split END AS split, idx, {r6('quantile_cont(score, 0.5)')} AS score FROM cf WHERE split <> 'TRAIN' GROUP BY 1, 2, 3"
CENTER = """SELECT c.dataset, c.f, split, idx, list_distance(vec, center) AS score FROM cross_rows c JOIN (
  SELECT dataset, f, list(m ORDER BY pos) AS center FROM (SELECT dataset, f, pos, avg(v) AS m FROM (SELECT dataset, f, unnest(range(64)) AS pos, unnest(vec) AS v FROM cross_rows WHERE split = 'TRAIN') GROUP BY 1, 2, 3) GROUP BY 1, 2) m
  ON m.dataset = c.dataset AND m.f = c.f"""


@query("crossfit_centroid", "cross5", "WITH cross_rows AS (SELECT * FROM cross5), cf AS (" + CENTER + ") " + FINAL)
def _(t):
    return rounded(M.crossfit(vectors(t), M.centroid))


@query("crossfit_source_scores", "cross_all vectors_z folds", f"""WITH cross_rows AS (SELECT * FROM cross_all), cf AS ({CENTER}),
n AS (SELECT dataset, count(*) AS n FROM folds GROUP BY 1),
full_rows AS (SELECT v.dataset, split, idx, list_distance(vec, center) AS score FROM vectors_z v JOIN (
  SELECT dataset, list(m ORDER BY pos) AS center FROM (SELECT dataset, pos, avg(v) AS m FROM points WHERE split = 'TRAIN' GROUP BY 1, 2) GROUP BY 1) c USING (dataset) WHERE split = 'TEST')
SELECT s.*, {r6('1 / (n + 1)')} AS min_p FROM (SELECT dataset, 'TRAIN' AS split, idx, {r6('score')} AS score, 'out_of_fold' AS phase FROM cf WHERE split = 'HELD'
  UNION ALL SELECT dataset, split, idx, {r6('score')}, 'full_fit' FROM full_rows) s JOIN n USING (dataset)""")
def _(t):
    return rounded(M.crossfit_source(vectors(t), M.centroid)).withColumn("min_p", R6("min_p"))


def starts_sql(most: int) -> str:
    """Starts per (dataset, fold): nearest to the mean, then furthest rows."""
    picks = ["""p1 AS (SELECT dataset, f, vec AS c1 FROM fit JOIN fit_mean USING (dataset, f) QUALIFY row_number() OVER (PARTITION BY dataset, f ORDER BY list_distance(vec, center), idx) = 1)"""]
    for k in range(2, most + 1):
        gap = ", ".join(f"list_distance(vec, c{j})" for j in range(1, k))
        had = ", ".join(f"c{j}" for j in range(1, k))
        picks.append(f"p{k} AS (SELECT dataset, f, {had}, vec AS c{k} FROM fit JOIN p{k - 1} USING (dataset, f) QUALIFY row_number() OVER (PARTITION BY dataset, f ORDER BY least({gap}) DESC, idx) = 1)")
    return f"""fit AS MATERIALIZED (SELECT dataset, f, idx, vec FROM cross5 WHERE split = 'TRAIN'),
fit_mean AS MATERIALIZED (SELECT dataset, f, any_value(n) AS n, list(m ORDER BY pos) AS center, list(s ORDER BY pos) AS spread FROM (
  SELECT dataset, f, pos, count(*) AS n, avg(v) AS m, greatest(avg(v * v) - avg(v) * avg(v), 0) + 1e-4 AS s FROM (SELECT dataset, f, unnest(range(64)) AS pos, unnest(vec) AS v FROM fit) GROUP BY 1, 2, 3) GROUP BY 1, 2),
{", ".join(picks)},
starts AS MATERIALIZED (SELECT dataset, f, n, list_slice([{", ".join(f"c{j}" for j in range(1, most + 1))}], 1, least({most}, n)) AS cs FROM p{most} JOIN fit_mean USING (dataset, f))"""


#: Recursion over (dataset, f, k, cs): 25 moves of the centres to the means of their rows.
LLOYD = """lloyd AS (SELECT dataset, f, k, 0 AS r, cs FROM begins UNION ALL
  SELECT dataset, f, k, r + 1, list(coalesce(fresh, c) ORDER BY j) FROM (SELECT dataset, f, k, r, unnest(range(1, len(cs) + 1)) AS j, unnest(cs) AS c FROM lloyd WHERE r < 25) AS o LEFT JOIN (
    SELECT dataset, f, k, j, list(m ORDER BY pos) AS fresh FROM (SELECT dataset, f, k, j, pos, avg(v) AS m FROM (
      SELECT dataset, f, k, j, unnest(range(64)) AS pos, unnest(vec) AS v FROM (
        SELECT dataset, f, k, vec, list_position(ds, list_min(ds)) AS j FROM (
          SELECT t.dataset, t.f, k, vec, list_transform(cs, lambda c: list_distance(vec, c)) AS ds FROM fit t JOIN lloyd l ON l.dataset = t.dataset AND l.f = t.f WHERE r < 25))) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) AS n USING (dataset, f, k, j)
  GROUP BY 1, 2, 3, 4)"""


@query("kmeans_crossfit", "cross5", f"""WITH RECURSIVE {starts_sql(3)}, begins AS (SELECT dataset, f, 3 AS k, cs FROM starts), {LLOYD},
cf AS (SELECT c.dataset, c.f, split, idx, list_min(list_transform(cs, lambda m: list_distance(vec, m))) AS score FROM cross5 c JOIN lloyd l ON l.dataset = c.dataset AND l.f = c.f WHERE r = 25) """ + FINAL)
def _(t):
    return rounded(M.crossfit(vectors(t), M.kmeans(3)))


LOGS = "list_transform(range(1, len(w) + 1), lambda j: ln(w[j]) - 0.5 * list_sum(list_transform(range(1, 65), lambda p: ln(2 * pi() * vs[j][p]) + (vec[p] - ms[j][p]) * (vec[p] - ms[j][p]) / vs[j][p])))"
TOTAL = "list_max(lp) + ln(list_sum(list_transform(lp, lambda x: exp(x - list_max(lp)))))"


@query("mixture_crossfit", "cross5", f"""WITH RECURSIVE {starts_sql(2)},
begins AS (SELECT dataset, f, k, list_slice(cs, 1, k) AS cs FROM starts, (SELECT unnest([1, 2]) AS k) WHERE k <= len(cs)), {LLOYD},
em AS (SELECT dataset, f, k, n, 0 AS r, false AS done, CAST('-infinity' AS DOUBLE) AS fit, list_transform(range(k), lambda x: 1.0 / k) AS w, cs AS ms, list_transform(range(k), lambda x: spread) AS vs
    FROM lloyd JOIN fit_mean USING (dataset, f) WHERE r = 25
  UNION ALL SELECT dataset, f, k, any_value(n), any_value(r) + 1, bool_or(stop), any_value(total), CASE WHEN bool_or(stop) THEN any_value(w) ELSE list(mass / all_mass ORDER BY j) END,
    CASE WHEN bool_or(stop) THEN any_value(ms) ELSE list(m ORDER BY j) END, CASE WHEN bool_or(stop) THEN any_value(vs) ELSE list(s ORDER BY j) END FROM (
    SELECT *, total - fit < 1e-3 * n OR r = 30 AS stop, sum(mass) OVER (PARTITION BY dataset, f, k) AS all_mass FROM (
      SELECT dataset, f, k, j, any_value(n) AS n, any_value(r) AS r, any_value(fit) AS fit, any_value(w) AS w, any_value(ms) AS ms, any_value(vs) AS vs, any_value(total) AS total, any_value(mass) AS mass,
        list(e ORDER BY pos) AS m, list(greatest(q - e * e, 0) + 1e-4 ORDER BY pos) AS s FROM (
        SELECT *, sx / mass AS e, sq / mass AS q FROM (
          SELECT dataset, f, k, j, pos, any_value(n) AS n, any_value(r) AS r, any_value(fit) AS fit, any_value(w) AS w, any_value(ms) AS ms, any_value(vs) AS vs, sum(t) AS total, sum(p) + 1e-9 AS mass, sum(p * x) AS sx, sum(p * x * x) AS sq FROM (
            SELECT dataset, f, k, n, r, fit, w, ms, vs, t, j, p, unnest(range(64)) AS pos, unnest(vec) AS x FROM (
              SELECT dataset, f, k, n, r, fit, w, ms, vs, vec, t, unnest(range(1, len(lp) + 1)) AS j, unnest(list_transform(lp, lambda x: exp(x - t))) AS p FROM (
                SELECT *, {TOTAL} AS t FROM (SELECT em.*, vec, {LOGS} AS lp FROM em JOIN fit USING (dataset, f) WHERE NOT done))))
          GROUP BY 1, 2, 3, 4, 5)) GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3),
best AS (SELECT * FROM em WHERE done QUALIFY row_number() OVER (PARTITION BY dataset, f ORDER BY -2 * fit + (2 * k * 64 + k - 1) * ln(n), k) = 1),
cf AS (SELECT dataset, f, split, idx, -({TOTAL}) AS score FROM (SELECT c.dataset, c.f, c.split, c.idx, {LOGS} AS lp FROM cross5 c JOIN best b ON b.dataset = c.dataset AND b.f = c.f)) """ + FINAL)
def _(t):
    return rounded(M.crossfit(vectors(t), M.gmm(2)))


@query("lof_crossfit", "cross5", f"""WITH cross_rows AS (SELECT * FROM cross5),
p AS (SELECT a.dataset, a.f, a.split, a.idx, b.idx AS rid, list_distance(a.vec, b.vec) AS d FROM cross_rows a JOIN cross_rows b ON a.dataset = b.dataset AND a.f = b.f AND b.split = 'TRAIN' AND NOT (a.split = 'TRAIN' AND a.idx = b.idx)
      QUALIFY row_number() OVER (PARTITION BY a.dataset, a.f, a.split, a.idx ORDER BY list_distance(a.vec, b.vec), b.idx) <= 5),
kd AS (SELECT dataset, f, idx AS rid, max(d) AS kd FROM p WHERE split = 'TRAIN' GROUP BY 1, 2, 3),
lr AS (SELECT p.dataset, p.f, split, idx, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM p JOIN kd ON kd.dataset = p.dataset AND kd.f = p.f AND kd.rid = p.rid GROUP BY 1, 2, 3, 4),
cf AS (SELECT p.dataset, p.f, p.split, p.idx, avg(o.lrd) / any_value(l.lrd) AS score FROM p JOIN lr o ON o.dataset = p.dataset AND o.f = p.f AND o.split = 'TRAIN' AND o.idx = p.rid
  JOIN lr l ON l.dataset = p.dataset AND l.f = p.f AND l.split = p.split AND l.idx = p.idx GROUP BY 1, 2, 3, 4) """ + FINAL)
def _(t):
    return rounded(M.crossfit(vectors(t), M.lof(5)))


# ---- kernel-feature scores and ensembles --------------------------------------

def knn_fragments(name: str, rel: str) -> None:
    """Register robust scaling, 3 neighbours and local gap over ``rel``
    (dataset, split, idx, pos, v)."""
    fragment(f"{name}_s", rel, f"""SELECT dataset, split, idx, list((v - mid) / w ORDER BY pos) AS vec FROM {rel} JOIN (
  SELECT dataset, pos, quantile_cont(v, 0.5) AS mid, CASE WHEN quantile_cont(v, 0.9) = quantile_cont(v, 0.1) THEN 1 ELSE quantile_cont(v, 0.9) - quantile_cont(v, 0.1) END AS w
  FROM {rel} WHERE split = 'TRAIN' GROUP BY 1, 2) USING (dataset, pos) GROUP BY 1, 2, 3""")
    fragment(f"{name}_n", f"{name}_s", f"""SELECT a.dataset, a.split, a.idx, b.idx AS rid, list_distance(a.vec, b.vec) AS d
FROM {name}_s a JOIN {name}_s b ON a.dataset = b.dataset AND b.split = 'TRAIN' AND NOT (a.split = 'TRAIN' AND a.idx = b.idx)
QUALIFY row_number() OVER (PARTITION BY a.dataset, a.split, a.idx ORDER BY list_distance(a.vec, b.vec), b.idx) <= 3""")
    fragment(f"{name}_knn", f"{name}_n", f"SELECT dataset, split, idx, avg(d) AS score FROM {name}_n GROUP BY 1, 2, 3")
    fragment(f"{name}_gap", f"{name}_n {name}_knn", f"""SELECT k.dataset, k.split, k.idx, (k.score - loc) / typical AS score FROM {name}_knn k JOIN (
  SELECT n.dataset, n.split, n.idx, avg(k.score + 1e-9) + 1e-9 AS loc FROM {name}_n n JOIN {name}_knn k ON k.dataset = n.dataset AND k.split = 'TRAIN' AND k.idx = n.rid GROUP BY 1, 2, 3) l USING (dataset, split, idx)
JOIN (SELECT dataset, quantile_cont(score + 1e-9, 0.5) + 1e-9 AS typical FROM {name}_knn WHERE split = 'TRAIN' GROUP BY 1) USING (dataset)""")
    fragment(f"{name}_rank", f"{name}_knn", f"""SELECT k.dataset, split, idx, sum(CASE WHEN split = 'TRAIN' THEN 1 ELSE 0 END) OVER (PARTITION BY k.dataset ORDER BY score) / n AS rank
FROM (SELECT dataset, split, idx, round(score, 9) AS score FROM {name}_knn) k JOIN (SELECT dataset, count(*) AS n FROM {name}_knn WHERE split = 'TRAIN' GROUP BY 1) c ON c.dataset = k.dataset""")


def rocket_fragment(name: str, rel: str, bank, length: int = L) -> None:
    fragment(f"{name}_c", rel, conv_sql(bank, rel, KEY, ("bias",), length))
    fragment(f"{name}_f", f"{name}_c", f"""SELECT {KEY}, 2 * k + s AS pos, CASE s WHEN 0 THEN max(c + bias) ELSE avg(CASE WHEN c + bias > 0 THEN 1 ELSE 0 END) END AS v
FROM {name}_c, (SELECT unnest([0, 1]) AS s) GROUP BY {KEY}, k, s""")
    knn_fragments(name, f"{name}_f")


SIZE = 8
for _block, _name in enumerate(("block_a", "block_b", "block_c")):
    rocket_fragment(_name, "zarch", N.random_kernels(L, SIZE, first=_block * SIZE))


def block(t, which: int):
    rows = zarch(t).withColumn("vec", N.block_features("values", which, SIZE)).drop("values")
    return K.local_gap(stage(rows.select(*AK, "vec")))


@query("kernel_block_local_gap", "block_b_gap", f"SELECT {KEY}, {r6('score')} AS score FROM block_b_gap")
def _(t):
    return rounded(block(t, 1))


@query("block_c_candidates", "block_c_gap", """
WITH c AS (SELECT dataset, score AS threshold FROM (SELECT dataset, score, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, idx) AS r,
  CAST(floor(0.05 * count(*) OVER (PARTITION BY dataset)) AS BIGINT) AS cap FROM block_c_gap WHERE split = 'TRAIN') WHERE r = cap + 1)
SELECT dataset, idx FROM block_c_gap JOIN c USING (dataset) WHERE split = 'TEST' AND score > threshold""")
def _(t):
    scores = stage(block(t, 2))
    limits = T.count_cap(scores.filter("split = 'TRAIN'"), ["dataset"], 0.05).select("dataset", "threshold")
    return scores.filter("split = 'TEST'").join(limits, "dataset").filter("score > threshold").select("dataset", "idx")


def knn_rank(rows):
    scaled_rows = stage(K.robust_scale(rows, rows.filter("split = 'TRAIN'")))
    scores = K.knn_scores(K.neighbours(scaled_rows, scaled_rows.filter("split = 'TRAIN'"), 3))
    return U.train_rank(stage(scores.withColumn("score", F.round("score", 9))), ["dataset"])


def aggregate(parts):
    """Mean, median and maximum of component ranks."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(*AK).agg(R6(F.avg("rank")).alias("mean"), R6(F.percentile("rank", 0.5)).alias("median"), R6(F.max("rank")).alias("max"))


def _aggregate_sql(names):
    union = " UNION ALL ".join(f"SELECT * FROM {n}_rank" for n in names)
    return f"SELECT {KEY}, {r6('avg(rank)')} AS mean, {r6('quantile_cont(rank, 0.5)')} AS median, {r6('max(rank)')} AS max FROM ({union}) GROUP BY 1, 2, 3"


SEEDS = (101, 102)
for _seed in SEEDS:
    rocket_fragment(f"bag{_seed}", "zarch", N.random_kernels(L, SIZE, _seed))


@query("bagged_kernel_ensemble", " ".join(f"bag{s}_rank" for s in SEEDS), _aggregate_sql([f"bag{s}" for s in SEEDS]))
def _(t):
    rows = zarch(t)
    return aggregate([knn_rank(rows.select(*AK, N.rocket_features("values", SIZE, s).alias("vec"))) for s in SEEDS])


PATCHES = ((0.0, 1.0), (0.0, 0.5), (0.5, 0.5), (1.0, 0.5))
for _i, (_start, _width) in enumerate(PATCHES):
    _n = int(L * _width)
    _from = int((L - _n) * _start)
    fragment(f"patch{_i}_p", "points", f"""SELECT dataset, split, idx, list((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY pos) AS values FROM (
  SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM points WHERE pos >= {_from} AND pos < {_from + _n} WINDOW w AS (PARTITION BY dataset, split, idx)) GROUP BY 1, 2, 3""")
    rocket_fragment(f"patch{_i}", f"patch{_i}_p", N.random_kernels(_n, SIZE, 500 + _i), _n)


@query("patch_kernel_ensemble", " ".join(f"patch{i}_rank" for i in range(4)), _aggregate_sql([f"patch{i}" for i in range(4)]))
def _(t):
    """Full window and three half windows, each scored and ranked."""
    rows = zarch(t)
    parts = []
    for i, (start, width) in enumerate(PATCHES):
        patch = rows.withColumn("values", C.z_norm(C.crop("values", start, width)))
        parts.append(knn_rank(patch.select(*AK, N.rocket_features("values", SIZE, 500 + i).alias("vec"))))
    return aggregate(parts)


# ---- generated series ---------------------------------------------------------

def train_series(t):
    return zarch(t).filter("split = 'TRAIN'").drop("split")


fragment("ztrain", "zarch", "SELECT dataset, idx, values FROM zarch WHERE split = 'TRAIN'")
U01 = lambda *p: "(CAST('0x' || substr(sha256(" + " || '|' || ".join(p) + "), 1, 8) AS BIGINT) / 4294967296.0)"


def _pseudo_sql():
    parts = []
    for kind, low, high, weak, strong in (("spike", 0.01, 0.04, 2.5, 4.0), ("step", 0.10, 0.30, 1.0, 2.0)):
        u = lambda tag: U01("'pseudo'", "dataset", "idx", f"'{kind}'", f"'{tag}'")
        parts.append(f"""SELECT dataset, idx, '{kind}' AS kind, pos, CASE WHEN pos >= a AND pos < a + w THEN v + m ELSE v END AS v FROM (
  SELECT dataset, idx, unnest(range(64)) AS pos, unnest(values) AS v, w, m, CAST(floor({u('s')} * greatest(1, 64 - w + 1)) AS INT) AS a FROM (
    SELECT *, greatest(1, CAST(round_even(64 * ({low} + {high - low} * {u('w')}), 0) AS INT)) AS w, CASE WHEN {u('sign')} < 0.5 THEN -1 ELSE 1 END * ({weak} + {strong - weak} * {u('amp')}) AS m FROM ztrain))""")
    return f"SELECT dataset, idx, kind, CAST(pos AS BIGINT) AS pos, {r6('v')} AS v FROM ({' UNION ALL '.join(parts)})"


@query("pseudo_series_generator", "ztrain", _pseudo_sql())
def _(t):
    got = M.pseudo_series(train_series(t)).filter("kind <> 'shuffle'")
    return long(got.withColumnRenamed("values", "vec"), "dataset", "idx", "kind", name="pos")


@query("pseudo_shuffle_generator", "ztrain", f"SELECT dataset, idx, {r6('list_sum(values)')} AS total, {r6('list_max(values)')} AS top, 64 AS points FROM ztrain")
def _(t):
    got = M.pseudo_series(train_series(t)).filter("kind = 'shuffle'")
    return got.select("dataset", "idx", R6(C.array_sum("values")).alias("total"), R6(F.array_max("values")).alias("top"), F.size("values").alias("points"))


_inject = lambda tag: U01("'inject'", "dataset", "idx", f"'{tag}'")
fragment("injected", "ztrain", f"""
SELECT dataset, idx, kind, pos, CASE WHEN pos < a OR pos >= a + w THEN x WHEN kind = 0 THEN x + m WHEN kind = 1 THEN x * m WHEN kind = 2 THEN x + m * (pos - a) / greatest(1, w - 1)
  WHEN kind = 3 THEN donor[b + pos - a + 1] ELSE values[a + w - (pos - a)] END AS v
FROM (SELECT *, unnest(range(64)) AS pos, unnest(values) AS x FROM (
  SELECT *, CAST(floor({_inject('s')} * greatest(1, 64 - w + 1)) AS INT) AS a, CAST(floor({_inject('d')} * greatest(1, 64 - w + 1)) AS INT) AS b,
    CASE kind WHEN 0 THEN sign * (2.5 + {_inject('amp')}) * (list_stddev_pop(values) + 1e-6) WHEN 1 THEN 0.2 + 2.6 * {_inject('amp')} ELSE 3.0 * sign END AS m FROM (
    SELECT p.*, d.values AS donor, CAST(floor({_inject('kind').replace('dataset', 'p.dataset').replace('idx', 'p.idx')} * 5) AS INT) AS kind,
      CAST(4 + floor({_inject('w').replace('dataset', 'p.dataset').replace('idx', 'p.idx')} * 5) AS INT) AS w,
      CASE WHEN {_inject('sign').replace('dataset', 'p.dataset').replace('idx', 'p.idx')} < 0.5 THEN -1.0 ELSE 1.0 END AS sign
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sha256('inject|' || dataset || '|' || idx), idx) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM ztrain) p
    JOIN (SELECT dataset, values, row_number() OVER (PARTITION BY dataset ORDER BY sha256('inject|' || dataset || '|' || idx), idx) AS r FROM ztrain) d
      ON d.dataset = p.dataset AND d.r = p.r % p.n + 1)))""")


@query("anomaly_injection", "injected", f"SELECT dataset, idx, kind, CAST(pos AS BIGINT) AS pos, {r6('v')} AS v FROM injected")
def _(t):
    return long(M.inject(train_series(t)).withColumnRenamed("values", "vec"), "dataset", "idx", "kind", name="pos")


@query("pseudo_anomaly_classifier")
def _(t):
    fakes = M.pseudo_series(train_series(t)).filter("kind <> 'shuffle'")
    return rounded(M.pseudo_classifier(vectors(t), stage(fakes.select("dataset", "idx", F.col("values").alias("vec")))))


@query("injection_centroid_score", "points injected", f"""
WITH c AS (SELECT dataset, pos, avg(v) AS c FROM points WHERE split = 'TRAIN' GROUP BY 1, 2), f AS (SELECT dataset, pos, avg(v) AS f FROM injected GROUP BY 1, 2)
SELECT dataset, split, idx, {r6('sqrt(sum((v - c) * (v - c))) - 0.25 * sqrt(sum((v - f) * (v - f)))')} AS score FROM points JOIN c USING (dataset, pos) JOIN f USING (dataset, pos) GROUP BY 1, 2, 3""")
def _(t):
    fakes = M.inject(train_series(t)).select("dataset", F.col("values").alias("vec"))
    return rounded(M.injection_centroid(vectors(t), fakes))


@query("small_train_density", "vectors_z", f"""WITH RECURSIVE v AS MATERIALIZED (
  SELECT dataset || '/' || idx % CASE WHEN dataset < 'emb_normal_5' THEN 12 ELSE 3 END AS dataset, split, idx, vec FROM vectors_z),
n AS MATERIALIZED (SELECT dataset, count(*) AS n FROM v WHERE split = 'TRAIN' GROUP BY 1),
pts AS MATERIALIZED (SELECT dataset, n, split, idx, unnest(range(64)) AS pos, unnest(vec) AS v FROM v JOIN n USING (dataset)),
mid AS (SELECT dataset, list(m ORDER BY pos) AS center FROM (SELECT dataset, pos, avg(v) AS m FROM pts WHERE split = 'TRAIN' GROUP BY 1, 2) GROUP BY 1),
small AS MATERIALIZED (SELECT dataset, idx, pos, v FROM pts WHERE split = 'TRAIN' AND n > 5 AND n < 30), {axes_sql('small', 5, True)},
z AS MATERIALIZED (SELECT dataset, split, idx, list_transform([a1, a2, a3, a4, a5], lambda a: list_dot_product(list_transform(range(1, 65), lambda i: vec[i] - mean[i]), a)) AS z FROM v JOIN axes USING (dataset)),
sd AS (SELECT dataset, list(greatest(s, 1e-12) ORDER BY f) AS s FROM (SELECT dataset, f, var_samp(z) AS s FROM (SELECT dataset, unnest(range(5)) AS f, unnest(z) AS z FROM z WHERE split = 'TRAIN') GROUP BY 1, 2) GROUP BY 1),
kd AS (SELECT q.dataset, q.split, q.idx, any_value(n) AS n, any_value(s) AS s, -0.5 * list_sum(list_transform(range(1, 6), lambda i: (q.z[i] - r.z[i]) * (q.z[i] - r.z[i]) / s[i])) / pow(n, -2.0 / 9) AS e
       FROM z q JOIN z r ON q.dataset = r.dataset AND r.split = 'TRAIN' JOIN sd ON sd.dataset = q.dataset JOIN n ON n.dataset = q.dataset GROUP BY q.dataset, q.split, q.idx, r.idx, q.z, r.z, s, n),
den AS (SELECT dataset, split, idx, ln(any_value(n)) + 0.5 * (5 * (ln(2 * pi()) + ln(pow(any_value(n), -2.0 / 9))) + list_sum(list_transform(any_value(s), lambda x: ln(x)))) - max(e) - ln(sum(exp(e - mx))) AS score
        FROM (SELECT *, max(e) OVER (PARTITION BY dataset, split, idx) AS mx FROM kd) GROUP BY 1, 2, 3)
SELECT dataset, split, idx, {r6('score')} AS score FROM (
  SELECT dataset, split, idx, list_distance(vec, center) AS score FROM v JOIN mid USING (dataset) JOIN n USING (dataset) WHERE n <= 5
  UNION ALL SELECT dataset, split, idx, score FROM den
  UNION ALL SELECT dataset, split, idx, avg(v * v) - avg(v) * avg(v) FROM pts WHERE n >= 30 GROUP BY 1, 2, 3)""")
def _(t):
    """Classes dealt over 12 or 3 datasets, so sizes differ; all rows are used.
    A stored score stands in for the large ones: the reconstruction error of
    the mean of a vector."""
    parts = F.when(F.col("dataset") < "emb_normal_5", 12).otherwise(3)
    rows = stage(vectors(t).withColumn("dataset", F.concat_ws("/", "dataset", F.pmod("idx", parts))))
    mean = F.transform("vec", lambda _: C.array_mean("vec"))
    stored = rows.select("dataset", "split", "idx", M.reconstruction_score("vec", mean, F.array(F.lit(0.0)), F.array(F.lit(0.0))).alias("score"))
    return rounded(M.small_train(rows, stored))


fragment("recon", "pts", """
SELECT id, pos, v AS x, avg(v) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS recon, v / 2 AS mu, -abs(v) AS logvar FROM pts""")


def recon(t):
    """A stored reconstruction stands in: the three-point mean of a series."""
    n = F.size("values")
    at = lambda i: F.slice("values", F.greatest(F.lit(1), i), F.least(n, i + 2) - F.greatest(F.lit(1), i) + 1)
    mean3 = F.transform("values", lambda _, i: F.aggregate(at(i), F.lit(0.0), lambda a, x: a + x) / F.size(at(i)))
    return raw(t).select("id", F.col("values").alias("x"), mean3.alias("recon"), F.transform("values", lambda v: v / 2).alias("mu"),
                         F.transform("values", lambda v: -F.abs(v)).alias("logvar"))


@query("reconstruction_score", "recon", f"SELECT id, {r6('avg(pow(x - recon, 2)) + 0.001 * -0.5 * sum(1 + logvar - mu * mu - exp(logvar))')} AS score FROM recon GROUP BY 1")
def _(t):
    return recon(t).select("id", R6(M.reconstruction_score()).alias("score"))


@query("gaussian_nll_score", "recon", f"""
SELECT id, {r6('avg(s)')} AS score FROM (SELECT id, d, avg(0.5 * logvar + 0.5 * ln(2 * pi()) + pow(x - (recon + d * 0.01), 2) / (2 * exp(logvar))) AS s FROM recon, (SELECT unnest(range(3)) AS d) GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    draws = recon(t).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("m", F.transform("recon", lambda v: v + F.col("d") * 0.01))
    per = draws.select("id", "d", M.gaussian_nll("x", "m", "logvar").alias("s"))
    return per.groupBy("id").agg(R6(F.avg("s")).alias("score"))


@query("spectral_reconstruction_loss", "recon", f"""
WITH w AS (SELECT unnest(range(9)) AS fr), j AS (SELECT fr, unnest(range(32)) AS j FROM w),
tap AS (SELECT fr, j, 0.5 - 0.5 * cos(2 * pi() * j / 32) AS h, CASE WHEN fr * 8 + j < 16 THEN 16 - fr * 8 - j WHEN fr * 8 + j > 79 THEN 142 - fr * 8 - j ELSE fr * 8 + j - 16 END AS pos FROM j),
d AS (SELECT id, fr, k, sum(x * h * cos(2 * pi() * k * j / 32)) AS xr, sum(x * h * sin(2 * pi() * k * j / 32)) AS xi, sum(recon * h * cos(2 * pi() * k * j / 32)) AS yr, sum(recon * h * sin(2 * pi() * k * j / 32)) AS yi
  FROM recon JOIN tap USING (pos), range(17) k(k) GROUP BY 1, 2, 3),
m AS (SELECT id, sqrt(xr * xr + xi * xi) AS a, sqrt(yr * yr + yi * yi) AS b FROM d)
SELECT id, {r6('sqrt(sum((a - b) * (a - b))) / CASE WHEN sum(a * a) = 0 THEN 1 ELSE sqrt(sum(a * a)) END + avg(abs(ln(a + 1e-5) - ln(b + 1e-5)))')} AS score FROM m GROUP BY 1""")
def _(t):
    return recon(t).select("id", R6(M.spectral_loss()).alias("score"))


@query("density_weights", "pairs", f"""
WITH r AS (SELECT dataset, idx, avg(d) AS r FROM pairs WHERE split = 'TRAIN' AND r <= 5 GROUP BY 1, 2), w AS (SELECT *, exp(r / quantile_cont(r, 0.5) OVER (PARTITION BY dataset)) AS w FROM r)
SELECT dataset, idx, {r6('w / avg(w) OVER (PARTITION BY dataset)')} AS weight FROM w""")
def _(t):
    """Of TRAIN rows among themselves: TEST rows have no weight, so they search nothing."""
    rows = scaled(t).filter("split = 'TRAIN'")
    return M.density_weights(K.neighbours(rows, rows, 5)).withColumn("weight", R6("weight"))


_aug = lambda *tag: U01("'aug'", "dataset", "idx", "copy", *tag)


@query("jitter_scale_augmentation", "ztrain", f"""
WITH p AS (SELECT dataset, idx, values, row_number() OVER (PARTITION BY dataset ORDER BY sha256('aug|' || dataset || '|' || idx), idx) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM ztrain),
c AS (SELECT * FROM (SELECT *, unnest(range(0, 10)) AS copy FROM p) WHERE copy = 0 OR (copy - 1) * n + r <= 100 - n),
k AS (SELECT *, floor({_aug("'kind'")} * 3) AS kind, 0.9 + 0.2 * {_aug("'scale'")} AS scale FROM c),
v AS (SELECT dataset, idx, copy, kind, scale, unnest(range(64)) AS i, unnest(values) AS x FROM k)
SELECT dataset, idx, copy, {r6(f"sum(CASE WHEN copy = 0 THEN x ELSE (x + CASE WHEN kind = 1 THEN 0 ELSE 0.03 * sqrt(-2 * ln(1 - {_aug('i', chr(39) + 'r' + chr(39))})) * cos(2 * pi() * {_aug('i', chr(39) + 'a' + chr(39))}) END) * CASE WHEN kind = 0 THEN 1 ELSE scale END END)")} AS total
FROM v GROUP BY 1, 2, 3""")
def _(t):
    return M.augment(train_series(t), 100).select("dataset", "idx", "copy", R6(C.array_sum("values")).alias("total"))


@query("oversample_tile", "ztrain", f"""
SELECT dataset, idx, copy, copy * n + idx AS place, {r6('list_sum(values)')} AS total FROM (SELECT dataset, idx, values, count(*) OVER (PARTITION BY dataset) AS n, unnest(range(0, 10)) AS copy FROM ztrain)
WHERE copy * n + idx < 100 OR (n >= 100 AND copy = 0)""")
def _(t):
    return M.tile(train_series(t), 100).select("dataset", "idx", "copy", "place", R6(C.array_sum("values")).alias("total"))


_warp = lambda *tag: U01("'multi'", "dataset", "idx", *tag)


@query("warp_permute_augmentation", "ztrain", f"""
WITH k AS (SELECT *, CASE WHEN {_warp("'kind'")} < 0.5 THEN 'warp' ELSE 'permute' END AS kind, 2 * pi() * {_warp("'phase'")} AS phase FROM ztrain),
s AS (SELECT dataset, idx, j, row_number() OVER (PARTITION BY dataset, idx ORDER BY sha256('multi|' || dataset || '|' || idx || '|seg|' || j), j) AS place FROM (SELECT dataset, idx, unnest(range(4)) AS j FROM ztrain)),
p AS (SELECT *, unnest(range(64)) AS pos FROM k)
SELECT p.dataset, p.idx, kind, CAST(pos AS BIGINT) AS pos, {r6("CASE WHEN kind = 'warp' THEN values[CAST(greatest(0, least(63, round_even(pos + 3.2 * sin(2 * pi() * pos / 64 + phase), 0))) AS INT) + 1] ELSE values[j * 16 + pos % 16 + 1] END")} AS v
FROM p JOIN s ON s.dataset = p.dataset AND s.idx = p.idx AND s.place = pos // 16 + 1""")
def _(t):
    return long(M.warp_permute(train_series(t)).withColumnRenamed("values", "vec"), "dataset", "idx", "kind", name="pos")


# ---- periodicity ---------------------------------------------------------------

@query("periodicity_acf", "pts", """
WITH c AS (SELECT id, label, pos, v - avg(v) OVER (PARTITION BY id) AS v FROM pts),
a AS (SELECT x.id, y.pos - x.pos AS lag, sum(x.v * y.v) / any_value(p) AS acf FROM c x JOIN c y ON x.id = y.id AND y.pos >= x.pos JOIN (SELECT id, sum(v * v) AS p FROM c GROUP BY 1) s ON s.id = x.id GROUP BY 1, 2),
k AS (SELECT id, lag, acf, lag(acf) OVER w AS b, lead(acf) OVER w AS n FROM a WINDOW w AS (PARTITION BY id ORDER BY lag))
SELECT r.id, CASE WHEN max(CASE WHEN lag >= 5 AND lag < 63 AND acf > b AND acf > n THEN acf END) > 0.4 THEN 1 ELSE 0 END AS periodic FROM raw r JOIN k ON k.id = r.id GROUP BY 1""")
def _(t):
    return raw(t).select("id", M.periodic_flag("values").alias("periodic"))


@query("periodicity_datasets", "panel", f"""
WITH p AS (SELECT dataset, idx, len(values) AS n, unnest(range(len(values))) AS pos, unnest(values) AS v FROM panel),
c AS (SELECT dataset, idx, n, pos, v - avg(v) OVER (PARTITION BY dataset, idx) AS v FROM p),
a AS (SELECT x.dataset, x.idx, any_value(x.n) AS n, y.pos - x.pos AS lag, sum(x.v * y.v) / any_value(s.p) AS acf FROM c x JOIN c y ON x.dataset = y.dataset AND x.idx = y.idx AND y.pos >= x.pos
  JOIN (SELECT dataset, idx, sum(v * v) AS p FROM c GROUP BY 1, 2) s ON s.dataset = x.dataset AND s.idx = x.idx GROUP BY x.dataset, x.idx, y.pos - x.pos),
k AS (SELECT *, lag(acf) OVER w AS b, lead(acf) OVER w AS nx FROM a WINDOW w AS (PARTITION BY dataset, idx ORDER BY lag)),
f AS (SELECT dataset, idx, CASE WHEN max(CASE WHEN n >= 15 AND lag >= 5 AND lag < n - 1 AND acf > b AND acf > nx THEN acf END) > 0.4 THEN 1 ELSE 0 END AS f FROM k GROUP BY 1, 2)
SELECT dataset, {r6('avg(f)')} AS share, CASE WHEN avg(f) >= 0.5 THEN 1 ELSE 0 END AS periodic FROM f GROUP BY 1""")
def _(t):
    return M.periodic_datasets(t.panel(), "acf").withColumn("share", R6("share"))


def detrended_sql(rel: str, key: str) -> str:
    """CTEs d (detrended points) and k (autocorrelations beside their neighbours)
    of points (key, n, pos, v)."""
    return f"""t AS (SELECT *, pos - (n - 1) / 2 AS place FROM {rel}),
d AS MATERIALIZED (SELECT {key}, n, pos, v - avg(v) OVER w - place * (sum(place * v) OVER w) / greatest(1e-12, sum(place * place) OVER w) AS v FROM t WINDOW w AS (PARTITION BY {key})),
c AS MATERIALIZED (SELECT {key}, n, pos, v - avg(v) OVER (PARTITION BY {key}) AS v FROM d),
a AS (SELECT {key}, any_value(x.n) AS n, y.pos - x.pos AS lag, sum(x.v * y.v) / any_value(s.p) AS acf FROM c x JOIN c y USING ({key}) JOIN (SELECT {key}, sum(v * v) AS p FROM c GROUP BY {key}) s USING ({key}) WHERE y.pos >= x.pos GROUP BY {key}, y.pos - x.pos),
k AS (SELECT {key}, max(CASE WHEN n >= 15 AND lag >= 5 AND lag < n - 1 AND acf > b AND acf > nx THEN acf END) AS peak FROM (
  SELECT *, lag(acf) OVER w AS b, lead(acf) OVER w AS nx FROM a WINDOW w AS (PARTITION BY {key} ORDER BY lag)) GROUP BY {key})"""


def entropy_sql(rel: str, key: str, size: str, double: bool = False) -> str:
    """Spectral entropy (key, e) of points (key, pos, v) on ``size`` places."""
    twice = f"CASE WHEN f = 0 OR 2 * f = z THEN 1 ELSE 2 END *" if double else ""  # noqa: F541
    return f"""SELECT {key}, -sum(p / total * log2(p / total + 1e-12)) / log2(any_value(bins)) AS e FROM (SELECT *, sum(p) OVER (PARTITION BY {key}) AS total, count(*) OVER (PARTITION BY {key}) AS bins FROM (
  SELECT {key}, f, {twice} (pow(sum(v * cos(2 * pi() * f * pos / z)), 2) + pow(sum(v * sin(2 * pi() * f * pos / z)), 2)) AS p FROM (SELECT *, unnest(range(z // 2 + 1)) AS f FROM (SELECT *, CAST({size} AS BIGINT) AS z FROM {rel})) GROUP BY {key}, f, z)) GROUP BY {key}"""


@query("periodicity_detrended", "panel", f"""
WITH p AS (SELECT dataset, idx, len(values) AS n, unnest(range(len(values))) AS pos, unnest(values) AS v FROM panel),
{detrended_sql('p', 'dataset, idx')}, h AS ({entropy_sql('d', 'dataset, idx', 'n')}),
f AS (SELECT dataset, idx, CASE WHEN n >= 15 AND s > 0 AND (peak > 0.45 OR e < 0.65) THEN 1 ELSE 0 END AS f FROM (SELECT dataset, idx, any_value(n) AS n, stddev_pop(v) AS s FROM d GROUP BY 1, 2) JOIN k USING (dataset, idx) JOIN h USING (dataset, idx))
SELECT dataset, {r6('avg(f)')} AS share, CASE WHEN avg(f) >= 0.5 THEN 1 ELSE 0 END AS periodic FROM f GROUP BY 1""")
def _(t):
    return M.periodic_datasets(t.panel(), "detrended").withColumn("share", R6("share"))


@query("periodicity_length_gated", "panel", f"""
WITH g AS (SELECT dataset, idx, values, len(values) AS n, unnest(range(160)) AS pos FROM panel),
q AS (SELECT dataset, pos, values[CAST(floor(x) AS INT) + 1] + (values[CAST(least(floor(x) + 1, n - 1) AS INT) + 1] - values[CAST(floor(x) AS INT) + 1]) * (x - floor(x)) AS v FROM (SELECT *, pos * (n - 1) / 159 AS x FROM g)),
p AS (SELECT dataset, 160 AS n, pos, avg(v) AS v FROM q GROUP BY 1, 3),
{detrended_sql('p', 'dataset')}, w AS (SELECT dataset, pos, v * (0.5 - 0.5 * cos(2 * pi() * pos / 160)) AS v FROM c), h AS ({entropy_sql('w', 'dataset', '256', True)})
SELECT dataset, 160 AS length, CASE WHEN peak > 0.45 OR e < 0.65 THEN 1 ELSE 0 END AS periodic FROM k JOIN h USING (dataset)""")
def _(t):
    """Each month series is drawn on 160 points, so the length gate opens."""
    rows = t.panel().withColumn("values", C.resample("values", 160))
    return M.periodic_by_mean(rows)
