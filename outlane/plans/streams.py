"""Queries for the batch twins of the streaming operators.

The operators run unchanged on static input; tests run them as streams.
"""

from pyspark.sql import functions as F

from outlane.functions.columns import r6 as R6
from outlane.operators import reports as P
from outlane.operators import thresholds as T
from outlane.plans.evaluation import log_lines
from outlane.plans.registry import fragment, query, r6
from outlane.session import stage
from outlane.streaming import online as O


def warm(t):
    train = t.score_once().filter("split = 'TRAIN'").select("dataset", "idx", "score")
    limits = T.empirical(train, ["dataset"], 0.02).withColumnRenamed("threshold", "limit")
    return stage(O.warm_start(train, limits))  # three readers


fragment("warm", "train", """
SELECT dataset, avg(score) AS mu, quantile_cont(score, 0.98) AS lim, list(score ORDER BY idx) AS tail FROM train GROUP BY 1""")
fragment("ema", "warm test", """
WITH RECURSIVE e AS (SELECT t.dataset, idx, score, mu, lim, 0.15 * score + 0.85 * mu AS ema FROM test t JOIN warm w ON w.dataset = t.dataset WHERE idx = 0
  UNION ALL SELECT t.dataset, t.idx, t.score, mu, lim, 0.15 * t.score + 0.85 * ema FROM e JOIN test t ON t.dataset = e.dataset AND t.idx = e.idx + 1)
SELECT * FROM e""")


@query("online_ema_threshold", "ema warm test", f"""
WITH r AS (SELECT dataset, CAST(idx AS BIGINT) AS idx, score FROM test
  UNION ALL SELECT dataset, unnest(range(-50, 0)), unnest(list_concat(list_resize(CAST([] AS DOUBLE[]), CAST(50 - least(50, len(tail)) AS BIGINT), mu), tail[-50:])) FROM warm),
f AS (SELECT *, avg(score) OVER w AS m, stddev_pop(score) OVER w AS s FROM r WINDOW w AS (PARTITION BY dataset ORDER BY idx ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
b AS (SELECT e.dataset, e.idx, ema, (lim + s) * (0.3 * m / mu + 0.7) AS bound FROM ema e JOIN f ON f.dataset = e.dataset AND f.idx = e.idx)
SELECT dataset, idx, {r6('ema')} AS ema, {r6('bound')} AS threshold, CASE WHEN ema > bound THEN 1 ELSE 0 END AS alert FROM b""")
def _(t):
    got = O.online_threshold_batch(t.score_once().filter("split = 'TEST'").select("dataset", "idx", "score"), warm(t))
    return got.select("dataset", "idx", R6("ema").alias("ema"), R6("threshold").alias("threshold"), "alert")


@query("frozen_conformal_scoring", "pvalues", f"SELECT dataset, idx, {r6('p')} AS p FROM pvalues WHERE split = 'TEST' AND source = 'rocket'")
def _(t):
    rows = t.score()
    got = O.conformal_stream(rows.filter("split = 'TEST'").select("dataset", "idx", "score"), O.frozen_reference(rows.filter("split = 'TRAIN'")))
    return got.select("dataset", "idx", R6("p").alias("p"))


@query("checkpoint_restore", "", "SELECT 'u' || user_id AS dataset, max(event_id) AS batch_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(t):
    log = t.table("events").select(F.concat(F.lit("u"), "user_id").alias("dataset"), F.col("event_id").alias("batch_id"), "value")
    return O.restore(log)


@query("resumable_skip_finished", "", """
SELECT event_id, user_id AS dataset FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 250)""")
def _(t):
    events = t.table("events").withColumn("dataset", F.col("user_id"))
    return O.skip_finished(events, events.filter("value > 250")).select("event_id", "dataset")


@query("live_progress_windows", "", f"""
WITH g AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS lines, min(event_id) AS first, max(event_id) AS last,
  CAST(epoch(date_trunc('second', max(ts))) AS BIGINT) - CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds FROM events WHERE event_type = 'purchase' GROUP BY 1),
s AS (SELECT *, CASE WHEN seconds > 0 THEN (last - first) / (seconds / 60.0) END AS s FROM g)
SELECT start, lines, first, last, last - first AS done_in_window, 20000 - last AS remaining, {r6('s')} AS speed, {r6('CASE WHEN s > 0 THEN greatest(0, 20000 - last) / s * 60 END')} AS eta_seconds FROM s""")
def _(t):
    got = O.live_progress(P.progress_events(log_lines(t)).filter("at is not null"), "1 hour")
    return (got.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))
            .withColumns({c: R6(c) for c in ("speed", "eta_seconds")}))


@query("event_time_series", "", f"""
SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, count(*) AS n, {r6('sum(value)')} AS v FROM events GROUP BY 1, 2""")
def _(t):
    got = O.event_series(t.table("events"), ["user_id"], "1 day", "1 hour")
    return got.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("start"), "n", R6("v").alias("v"))


@query("event_sessions", "", f"""
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, {r6('sum(value)')} AS v FROM s GROUP BY user_id, s""")
def _(t):
    got = O.event_series(t.table("events"), ["user_id"], "", "1 hour", "6 hours")
    return got.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", R6("v").alias("v"))
