"""Streams give the rows of their batch twins."""

import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from outlane.plans.streams import warm
from outlane.streaming import online as O


def stream_of(spark, df, tmp_path, files=3):
    """One micro-batch per file, in the order of idx."""
    path = str(tmp_path / "in")
    bounds = df.approxQuantile("idx", [k / files for k in range(1, files)], 0.0)
    for k, (low, high) in enumerate(zip([-1, *bounds], [*bounds, float("inf")])):
        time.sleep(1.1 if k else 0)  # files are taken in modification order
        df.filter((F.col("idx") > low) & (F.col("idx") <= high)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


@pytest.mark.parametrize("files, block", [(4, None), (3, 7)])
def test_online_threshold_stream_equals_batch(spark, tables, tmp_path, files, block):
    """State is carried over several micro-batches, the scan over several blocks."""
    some = ["u1", "u2", "u3"]
    test = tables.score().filter((F.col("split") == "TEST") & F.col("dataset").isin(some)).select("dataset", "idx", "score").cache()
    start = warm(tables).filter(F.col("dataset").isin(some)).cache()
    batch = O.online_threshold_batch(test, start, block=block)
    streamed = run(O.online_threshold_stream(stream_of(spark, test, tmp_path, files), start), f"online{files}")
    keep = ["dataset", "idx", F.round("ema", 9), F.round("threshold", 9), "alert"]
    assert rows(streamed.select(*keep)) == rows(batch.select(*keep)) != []


def test_an_early_term_is_never_forgotten(spark):
    """A score of 1e30 still shows after 400 steps; blocks of 16 composed by 4."""
    n = 401
    data = spark.range(n).selectExpr("'d' AS dataset", "id AS idx", "CASE WHEN id = 0 THEN 1e30D ELSE CAST(id % 7 AS DOUBLE) END AS score")
    begin = spark.createDataFrame([("d", 3.0)], "dataset string, x double")
    got = {r.idx: r.ema for r in O.smoothed(data, begin, 16).collect()}
    x = 3.0
    for i in range(n):
        x = O.ALPHA * (1e30 if i == 0 else i % 7) + (1 - O.ALPHA) * x
        assert got[i] == pytest.approx(x, rel=1e-9)
    assert got[300] > 20
    maps = spark.range(100).selectExpr("'d' AS dataset", "id AS place", "1D AS a", "CAST(id AS DOUBLE) AS b")
    sums = {r.place: r.x for r in O.scanned_maps(maps, begin, 4).collect()}
    assert sums == {k: 3.0 + k * (k - 1) / 2 for k in range(100)}


def test_heavy_tails_do_not_lengthen_a_node(spark):
    """2,000 scores and one of a million: a row meets at most one node of 16 a level."""
    train = spark.range(2000).selectExpr("'d' AS dataset", "CASE WHEN id = 7 THEN 1e6D ELSE id / 1000D END AS score")
    reference = O.frozen_reference(train, 16)
    assert len(reference) == 4 and all(level.selectExpr("max(size(highs))").first()[0] <= 16 for level in reference[1:])
    values = sorted(r.score for r in train.collect())
    test = spark.createDataFrame([("d", i, v) for i, v in enumerate([-5.0, 0.0, 0.0005, 0.5, 1.999, 1.9995, 1e6, 2e6, 0.007, *values[::97]])], "dataset string, idx bigint, score double")
    got = {r.idx: r.p for r in O.conformal_stream(test, reference, 16).collect()}
    assert got == {r.idx: (1 + sum(v >= r.score for v in values)) / 2001 for r in test.collect()}


def test_conformal_stream_equals_batch(spark, tables, tmp_path):
    from outlane.operators.fusion import conformal_p
    scores = tables.score()
    test = scores.filter("split = 'TEST'").select("dataset", "idx", "score")
    reference = tuple(part.cache() for part in O.frozen_reference(scores.filter("split = 'TRAIN'")))
    streamed = run(O.conformal_stream(stream_of(spark, test, tmp_path), reference), "conformal")
    batch = conformal_p(scores, ["dataset"]).filter("split = 'TEST'")
    assert rows(streamed.select("dataset", "idx", F.round("p", 9))) == rows(batch.select("dataset", "idx", F.round("p", 9)))


def test_resumable_sink_is_idempotent(spark, tables, tmp_path):
    test = tables.score().filter("split = 'TEST'").select("dataset", "idx", "score")
    source, target = stream_of(spark, test, tmp_path), str(tmp_path / "out")
    sink = O.append_once(target)

    def twice(batch, batch_id):
        sink(batch, batch_id)
        sink(batch, batch_id)

    q = source.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    log = spark.read.parquet(target).select("dataset", "idx", "score", "batch_id")
    assert log.count() == test.count()
    assert O.restore(log).count() == test.select("dataset").distinct().count()


def test_late_rows_are_dropped(spark, tmp_path):
    first = spark.createDataFrame([(0, 1, "2024-01-01 00:00:30", 1.0), (1, 1, "2024-01-01 02:00:00", 2.0)], "idx bigint, user_id int, t string, value double")
    middle = spark.createDataFrame([(4, 1, "2024-01-01 02:30:00", 3.0)], "idx bigint, user_id int, t string, value double")
    late = spark.createDataFrame([(2, 1, "2024-01-01 00:00:40", 5.0), (3, 1, "2024-01-01 05:00:00", 1.0)], "idx bigint, user_id int, t string, value double")
    path = str(tmp_path / "in")
    for i, part in enumerate((first, middle, late)):
        time.sleep(1.1 if i else 0)  # files are taken in modification order
        part.coalesce(1).withColumn("ts", F.col("t").cast("timestamp")).drop("t").write.mode("append").parquet(path)
    schema = "idx bigint, user_id int, value double, ts timestamp"
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(O.event_series(files, ["user_id"], "1 minute", "10 minutes"), "late")
    values = {r.v for r in got.collect()}
    assert 1.0 in values and 6.0 not in values and 5.0 not in values


@pytest.mark.parametrize("slide", [None, "30 seconds"])
def test_live_progress_stream(spark, tmp_path, slide):
    data = [(i, f"2024-01-01 00:{i:02d}:10", i * 3, 100) for i in range(20)]
    df = spark.createDataFrame(data, "idx bigint, t string, done bigint, expected bigint").withColumn("at", F.col("t").cast("timestamp")).drop("t")
    got = run(O.live_progress(stream_of(spark, df, tmp_path), "1 minute", slide), f"live{slide is None}")
    assert got.count() > 5
    assert got.filter(F.col("remaining") != 100 - F.col("last")).count() == 0


def test_speed_and_remaining_time(spark):
    from outlane.operators import reports
    data = [("2024-01-01 08:00:00", 10, 100), ("2024-01-01 08:05:00", 30, 100), ("2024-01-01 09:00:00", 30, 100)]
    df = spark.createDataFrame(data, "t string, done bigint, expected bigint").select(F.col("t").cast("timestamp").alias("at"), "done", "expected")
    first, second = reports.throughput(df, "1 hour").orderBy("start").collect()
    assert (first.recent_speed, first.mean_speed, first.eta_seconds, first.eta_basis) == (4.0, 6.0, 1050.0, "recent")
    assert (second.recent_speed, second.mean_speed, second.eta_basis) == (None, 0.5, "average")
