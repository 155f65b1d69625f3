"""Data quality and leak-free evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlane.functions.columns import hash_key
from outlane.functions.order import with_position

NORMALS_PER_ANOMALY = 49
REFERENCE_ROWS = 1000


def content_hash(values="values") -> Column:
    """Hash of a series at four decimals."""
    text = F.concat_ws(",", F.transform(values, lambda x: F.round(x * 10000).cast("bigint").cast("string")))
    return F.sha2(text, 256)


def first_unique(rows: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """Keep the first row of equal content and count its copies.

    A grouped minimum combines copies before the shuffle, so a group of copies
    of any size is one small row per input partition.
    """
    payload = [order] + [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("p"), F.count(F.lit(1)).alias("copies"))
    return best.select(*keys, "p.*", "copies")


def drop_train_overlap(test: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """TEST rows whose content does not occur in TRAIN."""
    return test.join(train.select(*keys).distinct(), keys, "left_anti")


def count_train_overlap(test: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    return (test.join(train.select(*keys).distinct(), keys, "left_semi")
            .groupBy("dataset").agg(F.count(F.lit(1)).alias("removed")))


def stable_sample(rows: DataFrame, keys: list[str], quota: Column, seed: str, role: str, id_col: str = "id") -> DataFrame:
    """The first ``quota`` rows per group in a hash order."""
    keyed = rows.withColumn("h", hash_key(seed, *[F.col(k).cast("string") for k in keys], role, F.col(id_col).cast("string")))
    return with_position(keyed, keys, [("h", "asc"), (id_col, "asc")], "pick").filter(F.col("pick") <= quota)


def clean_test(rows: DataFrame) -> DataFrame:
    """TEST rows after overlap removal (normals) and exact-copy removal."""
    hashed = rows.withColumn("hash", content_hash())
    train = hashed.filter("split = 'TRAIN'")
    test = hashed.filter("split = 'TEST'")
    normals = drop_train_overlap(test.filter("y = 0"), train, ["dataset", "hash"])
    kept = normals.unionByName(test.filter("y = 1")).select("dataset", "y", "hash", "idx", "id")
    return first_unique(kept, ["dataset", "y", "hash"])


def balanced_manifest(cleaned: DataFrame, seed: str = "33") -> DataFrame:
    """At most one anomaly per 49 normals, as rows (dataset, y, idx, id)."""
    counts = cleaned.groupBy("dataset").agg(
        F.count_if(F.col("y") == 1).alias("n_a"), F.count_if(F.col("y") == 0).alias("n_n"))
    quota = counts.select("dataset", F.least("n_a", F.floor(F.col("n_n") / NORMALS_PER_ANOMALY)).alias("anoms"))
    rows = cleaned.join(quota, "dataset").withColumn("role", F.when(F.col("y") == 1, "anomaly").otherwise("normal"))
    limit = F.when(F.col("y") == 1, F.col("anoms")).otherwise(F.col("anoms") * NORMALS_PER_ANOMALY)
    return stable_sample(rows, ["dataset", "role"], limit, seed, "balanced", "idx").select("dataset", "y", "idx", "id")


def manifest_summary(rows: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Counts before and after cleaning, per dataset."""
    is_ = lambda c: F.count_if(c)
    before = rows.groupBy("dataset").agg(
        is_(F.col("split") == "TRAIN").alias("train_count"),
        is_((F.col("split") == "TEST") & (F.col("y") == 0)).alias("test_normal_count"),
        is_((F.col("split") == "TEST") & (F.col("y") == 1)).alias("test_anomaly_count"))
    after = cleaned.groupBy("dataset").agg(
        is_(F.col("y") == 0).alias("clean_normal_count"), is_(F.col("y") == 1).alias("clean_anomaly_count"),
        F.sum(F.when(F.col("y") == 0, F.col("copies") - 1).otherwise(0)).alias("removed_copies"))
    out = before.join(after, "dataset", "left").fillna(0)
    return out.withColumn(
        "removed_overlap", F.col("test_normal_count") - F.col("clean_normal_count") - F.col("removed_copies")
    ).withColumn("eligible", ((F.col("clean_normal_count") > 0) & (F.col("clean_anomaly_count") > 0)).cast("int"))


def read_id_list(manifest: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """Delimited id text -> (…, pos, id)."""
    rest = [c for c in manifest.columns if c != column]
    ids = F.transform(F.filter(F.split(column, sep), lambda x: x != ""), lambda x: x.cast("bigint"))
    return manifest.select(*rest, F.posexplode(ids).alias("pos", "id"))


def integrity_violations(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per broken rule and dataset."""
    per = rows.groupBy("dataset").agg(
        F.count_if((F.col("split") == "TRAIN") & (F.col("y") == 1)).alias("train_anomalies"),
        F.count_if((F.col("split") == "TEST") & (F.col("y") == 1)).alias("a"),
        F.count_if(F.col("split") == "TEST").alias("n"), F.count(F.lit(1)).alias("total"))
    joined = per.join(catalog.select("dataset", "total_count"), "dataset", "left")
    rules = F.array(
        F.when(F.col("train_anomalies") > 0, "train_has_anomalies"),
        F.when((F.col("n") - F.col("a") >= NORMALS_PER_ANOMALY) & (F.col("a") > 0.03 * F.col("n")), "test_share_above_3pct"),
        F.when(F.coalesce(F.col("total_count"), F.lit(-1)) != F.col("total"), "catalog_total_differs"))
    return joined.select("dataset", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def grain_audit(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Label domain, counts, catalog agreement, smallest attainable p-value."""
    per = rows.groupBy("dataset").agg(
        F.min("y").alias("min_label"), F.max("y").alias("max_label"),
        F.count_if(F.col("split") == "TRAIN").alias("n_train"), F.count_if(F.col("split") == "TEST").alias("n_test"),
        F.countDistinct("split", "idx").alias("distinct_keys"))
    out = per.join(catalog.select("dataset", "total_count"), "dataset", "left")
    return out.select(
        "dataset", "min_label", "max_label", "n_train", "n_test",
        (F.col("distinct_keys") == F.col("n_train") + F.col("n_test")).cast("int").alias("grain_ok"),
        (F.col("total_count") == F.col("n_train") + F.col("n_test")).cast("int").alias("catalog_ok"),
        (1 / (F.col("n_train") + 1)).alias("min_p"))


def missing_datasets(expected: DataFrame, done: DataFrame) -> DataFrame:
    """Coverage and resume: expected names without a result."""
    return expected.select("dataset").distinct().join(done.select("dataset").distinct(), "dataset", "left_anti")


def source_coverage(selections: DataFrame, names: DataFrame, sources: list[str]) -> DataFrame:
    """Which sources produced a row per dataset, and why one is missing."""
    have = selections.groupBy("dataset").pivot("source", sources).agg(F.count(F.lit(1)))
    out = names.join(have, "dataset", "left").fillna(0, sources)
    absent = F.array_compact(F.array(*[F.when(F.col(s) == 0, F.lit(s)) for s in sources]))
    return out.withColumn("missing", F.concat_ws(" ", absent)).withColumn(
        "status", F.when(F.size(absent) == 0, "complete").when(F.size(absent) == len(sources), "none").otherwise("partial"))


def common_support(rows: DataFrame, methods: int, key: str = "source") -> DataFrame:
    """Datasets present under every method."""
    seen = rows.select("dataset", key).distinct()
    return seen.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == methods).select("dataset")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def contract_check(rows: DataFrame, expected: DataFrame, allowed: list[str], required: dict[str, str]) -> DataFrame:
    """Names that break a manifest contract: coverage, settings, columns."""
    flags = rows.select("dataset", *[(F.col(c).cast("string") == v).alias(f"ok_{c}") for c, v in required.items()])
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(f"ok_{c}")
    both = expected.select("dataset", F.lit(1).alias("want")).join(
        flags.select("dataset", ok.alias("ok"), F.lit(1).alias("got")), "dataset", "full_outer")
    extra = sorted(set(rows.columns) - set(allowed))
    verdict = (F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected")
               .when(~F.col("ok"), "setting").when(F.lit(bool(extra)), "column"))
    return both.select("dataset", verdict.alias("problem")).filter("problem is not null")


# ---- choosing datasets ------------------------------------------------------

def family_round(rows: DataFrame, keys: list[str] = []) -> DataFrame:
    """Position of a dataset when families take turns (within ``keys``)."""
    turn = with_position(rows, [*keys, "family"], [("dataset", "asc")], "turn")
    if keys:
        return with_position(turn, keys, [("turn", "asc"), ("family", "asc"), ("dataset", "asc")], "pick")
    return with_position(turn.withColumn("_all", F.lit(1)), ["_all"],
                         [("turn", "asc"), ("family", "asc"), ("dataset", "asc")], "pick").drop("_all")


def round_robin_sample(rows: DataFrame, count: int) -> DataFrame:
    return family_round(rows).filter(F.col("pick") <= count)


def size_bin(n="train_count") -> Column:
    return F.when(F.col(n) <= 10, 0).when(F.col(n) <= 50, 1).otherwise(2)


def stratified_sample(rows: DataFrame, total: int) -> DataFrame:
    """Equal quotas over three TRAIN-size bins; gaps are refilled by turns."""
    total = max(3, total)
    third = total // 3
    quota = F.when(F.col("bin") < 2, third).otherwise(total - 2 * third)
    binned = family_round(rows.withColumn("bin", size_bin()), ["bin"])
    first = binned.withColumn("refill", (F.col("pick") > quota).cast("int")).drop("turn", "pick")
    # the refill round: rows already taken come first, the others in turn order
    again = family_round(first, ["refill"])
    placed = with_position(again.withColumn("_all", F.lit(1)), ["_all"],
                           [("refill", "asc"), ("pick", "asc")], "seat").drop("_all")
    return placed.filter(F.col("seat") <= total)


def strata_sample(rows: DataFrame, strata: list[tuple[int, int | None, int]]) -> DataFrame:
    """Disjoint (min, max, count) strata, each filled by turns of families."""
    which, limit = F.lit(None).cast("int"), F.lit(0)
    for i, (low, high, count) in reversed(list(enumerate(strata))):
        inside = (F.col("train_count") >= low) & (F.lit(True) if high is None else F.col("train_count") <= high)
        which, limit = F.when(inside, i).otherwise(which), F.when(inside, count).otherwise(limit)
    tagged = rows.withColumn("stratum", which).withColumn("quota", limit).filter("stratum is not null")
    return family_round(tagged, ["stratum"]).filter("pick <= quota")


def target_datasets(rows: DataFrame, kinds: list[str], min_train: int, max_auc_pr: float, limit: int) -> DataFrame:
    """The hardest datasets of the asked kinds (a top-k report)."""
    hard = rows.filter(F.col("kind").isin(kinds) & (F.col("train_count") >= min_train) & (F.col("auc_pr") < max_auc_pr))
    return hard.orderBy(F.col("difficulty").desc(), "dataset").limit(limit)


SALTS = 64


def reference_rows(train: DataFrame, rows: int = REFERENCE_ROWS, seed: str = "ref") -> DataFrame:
    """At most ``rows`` TRAIN series per dataset, the first in a hash order.

    Only ids are ranked, first per (dataset, salt) and then per dataset; both
    limits are constant, so Spark prunes before each shuffle and even a hot
    dataset sends its last task at most ``SALTS * rows`` ids.
    """
    h = hash_key(seed, F.col("dataset"), "reference", F.col("idx").cast("string"))
    ids = train.select("dataset", "idx", h.alias("_h"), F.pmod(F.xxhash64("idx"), F.lit(SALTS)).alias("_s"))
    for part in (["dataset", "_s"], ["dataset"]):
        window = Window.partitionBy(*part).orderBy("_h", "idx")
        ids = ids.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= rows).drop("_r")
    return train.join(ids.select("dataset", "idx"), ["dataset", "idx"], "left_semi")


def label_free(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Only allow-listed columns pass; a missing one is an error."""
    return rows.select(*allowed)
