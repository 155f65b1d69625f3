"""Turning labelled collections into normal-only TRAIN/TEST datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlane.functions.columns import hash_key
from outlane.functions.order import with_position

# 80 % of the normals train, 49 normals per anomaly in TEST.
TRAIN_SHARE = 0.8
NORMALS_PER_ANOMALY = 49
SEED = 42


def one_class(labelled: DataFrame, at_least_one: bool = True) -> DataFrame:
    """One dataset per class: that class is normal, every other is anomalous.

    Input (archive, id, cls, values).  The order of rows is a hash order, so the
    result does not depend on partitions.  Short TEST sides borrow TRAIN rows
    cyclically along the hash order.
    """
    sizes = labelled.groupBy("archive", "cls").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("archive").agg(F.sum("n").alias("n_all"))
    quota = sizes.join(whole, "archive").select(
        "archive", "cls", "n", F.floor(F.col("n") * 8 / 10).alias("n_train"),
        F.least(F.col("n_all") - F.col("n"), _anomalies(F.col("n"), at_least_one)).alias("n_anom"))
    quota = quota.filter("n_anom > 0").withColumn("need", NORMALS_PER_ANOMALY * F.col("n_anom"))
    quota = quota.withColumn("unseen", F.least(F.col("n") - F.col("n_train"), F.col("need")))
    return _normals(labelled, quota).unionByName(_anomalous(labelled, quota))


def _anomalies(n, at_least_one: bool):
    share = F.floor(n / NORMALS_PER_ANOMALY)
    return F.greatest(F.lit(1), share) if at_least_one else share


def _name():
    return F.concat_ws("_normal_", "archive", "cls")


def _normals(labelled: DataFrame, quota: DataFrame) -> DataFrame:
    keyed = labelled.withColumn("h", hash_key(SEED, "normal", F.col("archive"), F.col("cls"), F.col("id")))
    placed = with_position(keyed, ["archive", "cls"], [("h", "asc")]).join(quota, ["archive", "cls"])
    rn, n_train, unseen, need = (F.col(c) for c in ("rn", "n_train", "unseen", "need"))
    borrow = need - unseen
    times = F.when((rn <= n_train) & (rn <= borrow), F.floor((borrow - rn) / n_train) + 1).otherwise(F.lit(0))
    own = F.when(rn <= n_train, F.array(F.struct(F.lit("TRAIN").alias("split"), (rn - 1).alias("idx")))).when(
        rn - n_train <= need, F.array(F.struct(F.lit("TEST").alias("split"), (rn - n_train - 1).alias("idx")))
    ).otherwise(F.array().cast("array<struct<split:string,idx:bigint>>"))
    lent = F.when(times > 0, F.transform(F.sequence(F.lit(0).cast("long"), times - 1), lambda k: F.struct(
        F.lit("TEST").alias("split"), (unseen + rn - 1 + k * n_train).alias("idx"))))
    lent = F.coalesce(lent, F.array().cast("array<struct<split:string,idx:bigint>>"))
    out = placed.select(_name().alias("dataset"), "id", "values", F.explode(F.concat(own, lent)).alias("s"))
    return out.select("dataset", "s.split", "s.idx", "id", F.lit(0).alias("y"), "values")


def _anomalous(labelled: DataFrame, quota: DataFrame) -> DataFrame:
    """The first ``n_anom`` rows of other classes in a hash order per dataset.

    Only rows early in the archive's own hash order can be needed by any class,
    so rows are fanned out to the classes that may still want them.
    """
    keyed = labelled.withColumn("h", hash_key(SEED, "anomaly", F.col("archive"), F.col("id")))
    placed = with_position(keyed, ["archive"], [("h", "asc")], "g").withColumnRenamed("cls", "own")
    wanted = placed.join(quota.select("archive", "cls", "n", "n_anom", "need"), "archive").filter(
        (F.col("own") != F.col("cls")) & (F.col("g") <= F.col("n") + F.col("n_anom")))
    ranked = with_position(wanted, ["archive", "cls"], [("g", "asc")], "r").filter("r <= n_anom")
    return ranked.select(_name().alias("dataset"), F.lit("TEST").alias("split"),
                         (F.col("need") + F.col("r") - 1).alias("idx"), "id", F.lit(1).alias("y"), "values")


def archive_lines(lines: DataFrame) -> DataFrame:
    """Data rows of text archives: ``v1,v2,...:label`` with ``?`` for missing.

    Input (path, line).  Comment lines (#) and header lines (@) are no data.
    """
    body = lines.filter((F.trim("line") != "") & ~F.trim("line").rlike("^[#@]"))
    return body.select(
        "path", F.trim(F.substring_index("line", ":", -1)).alias("label"),
        F.transform(F.split(F.element_at(F.split("line", ":"), 1), ","),
                    lambda x: F.when(F.trim(x) == "?", F.lit(float("nan"))).otherwise(F.trim(x).try_cast("double"))
                    ).alias("values"))


def archive_header(lines: DataFrame) -> DataFrame:
    """Header entries ``@key value`` with true/false and integers typed."""
    head = lines.filter(F.trim("line").rlike(r"^@\w+\s+\S"))
    key = F.lower(F.regexp_extract(F.trim("line"), r"^@(\w+)\s+(.+)$", 1))
    value = F.trim(F.regexp_extract(F.trim("line"), r"^@(\w+)\s+(.+)$", 2))
    return head.select("path", key.alias("key"), value.alias("value"),
                       F.when(F.lower(value).isin("true", "false"), "boolean")
                       .when(value.rlike(r"^-?\d+$"), "int").otherwise("string").alias("kind"))


def read_archive(spark, folder: str) -> DataFrame:
    lines = spark.read.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return archive_lines(lines)


# ---- single-series files ----------------------------------------------------

# Fixed pattern: the file name ends in train length, anomaly start, anomaly end.
INTERVAL_NAME = r"_(\d+)_(\d+)_(\d+)\.txt$"


def interval_named(files: DataFrame) -> DataFrame:
    """Split a long series by the numbers in its file name.

    Input (path, pos, v), one row per point.  TRAIN is the prefix of the given
    length; points of the TEST suffix between start and end are anomalous.
    """
    nums = [F.regexp_extract("path", INTERVAL_NAME, i).cast("long") for i in (1, 2, 3)]
    return (files.filter(F.col("path").rlike(INTERVAL_NAME))
            .withColumn("n_train", nums[0]).withColumn("a", nums[1]).withColumn("b", nums[2])
            .select("path", F.when(F.col("pos") < F.col("n_train"), "TRAIN").otherwise("TEST").alias("split"),
                    "pos", "v",
                    (F.col("pos").between(F.col("a"), F.col("b")) & (F.col("pos") >= F.col("n_train")))
                    .cast("int").alias("y")))


def label_by_windows(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Label points that fall into any [start, end] window of their path.

    A sweep instead of an interval join: window starts and ends travel in time
    order with the points, and a point is inside when more windows have opened
    than closed.  Cost is one sort, whatever the overlap.  ``points`` needs
    (path, id, ts); both window ends are inclusive.
    """
    edges = windows.select("path", "start", "end").distinct()
    uid = F.xxhash64("path", "start", "end")
    mark = lambda ts, kind, step: edges.select(
        "path", F.col(ts).alias("ts"), F.lit(kind).alias("kind"), uid.alias("id"), F.lit(step).alias("step"))
    rows = points.select("path", "ts", F.lit(1).alias("kind"), "id", F.lit(0).alias("step"))
    swept = with_position(rows.unionByName(mark("start", 0, 1)).unionByName(mark("end", 2, -1)),
                          ["path"], [("ts", "asc"), ("kind", "asc"), ("id", "asc")], "_p", {"open": F.col("step")})
    return swept.filter("kind = 1").select("path", "id", "ts", (F.col("open") > 0).cast("int").alias("y"))


def windows_from_json(rows: DataFrame) -> DataFrame:
    """Rows of JSON text ``{path: [[start, end], ...]}`` -> (path, start, end)."""
    parsed = rows.select(F.from_json("json", "map<string,array<array<string>>>").alias("m"))
    flat = parsed.select(F.explode("m").alias("path", "spans")).select("path", F.explode("spans").alias("w"))
    return flat.select("path", F.col("w")[0].cast("timestamp").alias("start"), F.col("w")[1].cast("timestamp").alias("end"))


# ---- catalog and upsert -----------------------------------------------------

def catalog(rows: DataFrame) -> DataFrame:
    """Counts per dataset, split and label, with length and missing flag."""
    is_ = lambda split, y: F.count_if((F.col("split") == split) & (F.col("y") == y))
    out = rows.groupBy("dataset").agg(
        F.max(F.size("values")).alias("series_length"),
        F.max(F.exists("values", lambda x: x.isNull() | F.isnan(x)).cast("int")).alias("has_missing"),
        is_("TRAIN", 0).alias("train_normal_count"), is_("TRAIN", 1).alias("train_anomaly_count"),
        is_("TEST", 0).alias("test_normal_count"), is_("TEST", 1).alias("test_anomaly_count"))
    return out.withColumn("total_count", F.col("train_normal_count") + F.col("train_anomaly_count")
                          + F.col("test_normal_count") + F.col("test_anomaly_count"))


def latest_per_key(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert semantics: per key, the row with the highest version stays."""
    payload = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(version)).alias("p"))
    return best.select(*keys, "p.*")
