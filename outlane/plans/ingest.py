"""Queries for sources, sinks, data quality and evaluation sets."""

from pyspark.sql import functions as F

from outlane.functions.columns import r6 as R6
from outlane.operators import quality as Q
from outlane.plans.registry import query, r6
from outlane.sources import archive as A
from outlane.sources import sinks as S

SHORT = "dataset, split, idx, id, y"


@query("one_class_archive", "archive", f"SELECT {SHORT} FROM archive")
def _(t):
    return t.archive().select(*SHORT.split(", "))


@query("binary_label_archive", "", """
WITH p AS (SELECT doc_id AS id, quality AS cls,
  row_number() OVER (PARTITION BY quality ORDER BY sha256('42|normal|docs|' || quality || '|' || doc_id)) AS rn,
  row_number() OVER (PARTITION BY quality ORDER BY sha256('42|anomaly|docs|' || doc_id)) AS r,
  count(*) OVER (PARTITION BY quality) AS n, count(*) OVER () AS n_all FROM labels),
m AS (SELECT CAST(floor(max(n) * 8 / 10) AS BIGINT) AS n_train, least(max(n_all) - max(n), max(n) // 49) AS n_anom,
        49 * least(max(n_all) - max(n), max(n) // 49) AS need, max(n) AS n FROM p WHERE cls = 1),
q AS (SELECT p.id, p.rn, m.*, least(m.n - m.n_train, m.need) AS unseen FROM p CROSS JOIN m WHERE cls = 1)
SELECT 'TRAIN' AS split, CAST(rn - 1 AS BIGINT) AS idx, id, 0 AS y FROM q WHERE rn <= n_train
UNION ALL SELECT 'TEST', CAST(rn - n_train - 1 AS BIGINT), id, 0 FROM q WHERE rn > n_train AND rn - n_train <= need
UNION ALL SELECT 'TEST', CAST(unseen + j AS BIGINT), id, 0 FROM (
  SELECT *, unnest(range(CAST(need - unseen AS BIGINT))) AS j FROM q WHERE rn <= n_train) WHERE j % n_train = rn - 1
UNION ALL SELECT 'TEST', CAST(need + r - 1 AS BIGINT), id, 1 FROM p CROSS JOIN m WHERE cls = 0 AND r <= n_anom""")
def _(t):
    rows = t.table("labels").select(F.lit("docs").alias("archive"), F.col("doc_id").alias("id"),
                                    F.col("quality").cast("string").alias("cls"), F.array().cast("array<double>").alias("values"))
    out = A.one_class(rows, at_least_one=False)
    return out.filter("dataset = 'docs_normal_1'").select("split", "idx", "id", "y")


def _archive_text(t):
    cell = lambda x: F.when(x > 0.3, "?").otherwise(F.round(x * 1000).cast("int").cast("string"))
    rows = t.table("embeddings").select(
        F.lit("emb.ts").alias("path"),
        F.concat_ws(":", F.concat_ws(",", F.transform(F.col("embedding").cast("array<double>"), cell)), "label").alias("line"))
    heads = t.table("region").select(
        F.lit("emb.ts").alias("path"),
        F.explode(F.array(F.lit("# note"), F.concat(F.lit("@region "), "r_name"),
                          F.concat(F.lit("@regionKey "), "r_regionkey"), F.lit("@missing true"))).alias("line"))
    return rows.unionByName(heads)


@query("archive_text_scan", "", """
SELECT CAST(label AS VARCHAR) AS label, count(*) AS series, CAST(sum(m) AS BIGINT) AS missing, CAST(sum(s) AS BIGINT) AS total FROM (
  SELECT label, len(list_filter(v, lambda x: x > 0.3)) AS m,
         list_sum(list_transform(list_filter(v, lambda x: x <= 0.3), lambda x: round(x * 1000))) AS s
  FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)) GROUP BY 1""")
def _(t):
    parsed = A.archive_lines(_archive_text(t))
    good = F.filter("values", lambda x: ~F.isnan(x))
    return parsed.groupBy("label").agg(
        F.count(F.lit(1)).alias("series"), F.sum(F.size("values") - F.size(good)).alias("missing"),
        F.sum(F.aggregate(good, F.lit(0.0), lambda a, x: a + x)).cast("bigint").alias("total"))


@query("archive_header_scan", "", """
SELECT key, value, kind, count(*) AS n FROM (
  SELECT unnest(['region', 'regionkey', 'missing']) AS key,
         unnest([r_name, CAST(r_regionkey AS VARCHAR), 'true']) AS value,
         unnest(['string', 'int', 'boolean']) AS kind FROM region) GROUP BY ALL""")
def _(t):
    return A.archive_header(_archive_text(t)).groupBy("key", "value", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("interval_named_series", "event_rows", """
SELECT path, split, count(*) AS points, CAST(sum(y) AS BIGINT) AS anomalous FROM (
  SELECT path, CASE WHEN pos < n_train THEN 'TRAIN' ELSE 'TEST' END AS split,
         CASE WHEN pos >= n_train AND pos BETWEEN n_train + 3 AND n_train + 9 THEN 1 ELSE 0 END AS y FROM (
    SELECT dataset || '_' || n_train || '_' || (n_train + 3) || '_' || (n_train + 9) || '.txt' AS path, n_train, pos
    FROM (SELECT dataset, event_id, row_number() OVER (PARTITION BY dataset ORDER BY event_id) - 1 AS pos,
                 count(CASE WHEN split = 'TRAIN' THEN 1 END) OVER (PARTITION BY dataset) AS n_train FROM event_rows)))
GROUP BY 1, 2""")
def _(t):
    from outlane.functions.order import with_position
    rows = t.event_rows()
    sizes = rows.groupBy("dataset").agg(F.count_if(F.col("split") == "TRAIN").alias("n"))
    points = with_position(rows, ["dataset"], [("event_id", "asc")], "pos").join(sizes, "dataset")
    files = points.select(
        F.concat(F.concat_ws("_", "dataset", "n", F.col("n") + 3, F.col("n") + 9), F.lit(".txt")).alias("path"),
        (F.col("pos") - 1).alias("pos"), F.col("value").alias("v"))
    return A.interval_named(files).groupBy("path", "split").agg(
        F.count(F.lit(1)).alias("points"), F.sum("y").alias("anomalous"))


@query("label_windows_join", "", """
WITH w AS (SELECT user_id, ts - INTERVAL 30 MINUTE AS a, ts + INTERVAL 30 MINUTE AS b FROM events WHERE event_type = 'error')
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.user_id = e.user_id AND e.ts BETWEEN a AND b) THEN 1 ELSE 0 END AS y
FROM events e""")
def _(t):
    events = t.table("events")
    half = F.expr("interval 30 minutes")
    text = events.filter("event_type = 'error'").select(F.to_json(F.create_map(
        F.col("user_id").cast("string"),
        F.array(F.array((F.col("ts") - half).cast("string"), (F.col("ts") + half).cast("string"))))).alias("json"))
    points = events.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("id"), "ts")
    return A.label_by_windows(points, A.windows_from_json(text)).select(F.col("id").alias("event_id"), "y")


@query("latest_row_upsert", "", """
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def _(t):
    rows = t.table("events").select("user_id", "event_type", "event_id", "value")
    return A.latest_per_key(rows, ["user_id", "event_type"], "event_id")


CATALOG = """SELECT dataset, CAST(max(len(values)) AS INTEGER) AS series_length, 0 AS has_missing,
  count(CASE WHEN split = 'TRAIN' AND y = 0 THEN 1 END) AS train_normal_count,
  count(CASE WHEN split = 'TRAIN' AND y = 1 THEN 1 END) AS train_anomaly_count,
  count(CASE WHEN split = 'TEST' AND y = 0 THEN 1 END) AS test_normal_count,
  count(CASE WHEN split = 'TEST' AND y = 1 THEN 1 END) AS test_anomaly_count, count(*) AS total_count
FROM archive GROUP BY dataset"""


@query("metadata_catalog", "archive", CATALOG)
def _(t):
    return A.catalog(t.archive())


@query("test_counts", "truth", "SELECT dataset, count(*) AS test_size, CAST(sum(y) AS BIGINT) AS anomalies FROM truth GROUP BY 1")
def _(t):
    return t.truth().groupBy("dataset").agg(F.count(F.lit(1)).alias("test_size"), F.sum("y").alias("anomalies"))


@query("dataset_load", "archive", f"""
SELECT dataset, split, idx, {r6('list_sum(values)')} AS total FROM archive WHERE dataset = 'emb_normal_3' AND split = 'TRAIN'""")
def _(t):
    from outlane.functions.columns import array_sum
    rows = t.archive().filter("dataset = 'emb_normal_3' and split = 'TRAIN'")
    return rows.select("dataset", "split", "idx", R6(array_sum("values")).alias("total"))


@query("dataset_lengths", "panel", """
SELECT dataset, quantile_cont(len(values), 0.5) AS median_len, CAST(max(len(values)) AS INTEGER) AS max_len,
       CAST(greatest(8, least(2048, max(len(values)))) AS INTEGER) AS target_len FROM panel GROUP BY 1""")
def _(t):
    n = t.panel().withColumn("n", F.size("values"))
    return n.groupBy("dataset").agg(F.percentile("n", 0.5).alias("median_len"), F.max("n").alias("max_len")).withColumn(
        "target_len", F.greatest(F.lit(8), F.least(F.lit(2048), "max_len")))


@query("load_by_id_list", "", """
SELECT o_custkey AS dataset, part, pos, id, n FROM (
  SELECT o_custkey, o_orderkey // 10000 AS part, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderkey // 10000 ORDER BY o_orderkey) - 1 AS pos FROM orders)
JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON id = l_orderkey""")
def _(t):
    # a list covers one key range, so no cell grows without bound
    part = F.floor(F.col("o_orderkey") / 10000).alias("part")
    lists = t.table("orders").groupBy(F.col("o_custkey").alias("dataset"), part).agg(
        F.concat_ws(";", F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string"))).alias("ids"))
    store = t.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return Q.read_id_list(lists, "ids").join(store, "id").withColumn("pos", F.col("pos").cast("bigint"))


@query("label_free_load", "archive", f"""
SELECT dataset, split, count(*) AS n, {r6('sum(list_sum(values))')} AS total FROM archive GROUP BY 1, 2""")
def _(t):
    from outlane.functions.columns import array_sum
    series = Q.label_free(t.series(), ["dataset", "split", "idx", "values"])
    return series.groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("n"), R6(F.sum(array_sum("values"))).alias("total"))


@query("test_label_load", "truth", "SELECT dataset, idx, y FROM truth")
def _(t):
    rows = t.truth()
    return rows.filter(F.assert_true(F.col("y").isin(0, 1), F.lit("label must be 0 or 1")).isNull()).select("dataset", "idx", "y")


@query("union_result_tables", "truth", """
SELECT dataset, count(*) AS test_size, -1 AS hits FROM truth GROUP BY 1
UNION ALL SELECT dataset, -1, CAST(sum(y) AS BIGINT) FROM truth GROUP BY 1""")
def _(t):
    a = t.truth().groupBy("dataset").agg(F.count(F.lit(1)).alias("test_size"))
    b = t.truth().groupBy("dataset").agg(F.sum("y").alias("hits"))
    return S.union_results(a, b).fillna(-1)


@query("json_line_sink", "truth", """SELECT '{"dataset":"' || dataset || '","idx":' || idx || ',"y":' || y || '}' AS value FROM truth""")
def _(t):
    return S.json_lines(t.truth().select("y", "idx", "dataset"))


HASH = """sha256('{"dataset":"' || dataset || '","idx":' || idx || ',"y":' || y || '}')"""


@query("canonical_row_hash", "truth", f"SELECT dataset, idx, {HASH} AS row_hash FROM truth")
def _(t):
    rows = t.truth().select("y", "dataset", "idx")
    return rows.select("dataset", "idx", S.row_hash(rows).alias("row_hash"))


@query("table_digest", "truth", f"""
SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr({HASH}, 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM truth""")
def _(t):
    return S.table_digest(t.truth().select("y", "dataset", "idx"))


# ---- quality ----------------------------------------------------------------

from outlane.plans.registry import fragment  # noqa: E402

fragment("hashed", "archive", """
SELECT dataset, split, idx, id, y, sha256(array_to_string(list_transform(values, lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',')) AS hash
FROM archive""")
fragment("cleaned", "hashed", """
SELECT dataset, y, hash, min(idx) AS idx, arg_min(id, idx) AS id, count(*) AS copies FROM hashed h
WHERE split = 'TEST' AND (y = 1 OR NOT EXISTS (
  SELECT 1 FROM hashed t WHERE t.split = 'TRAIN' AND t.dataset = h.dataset AND t.hash = h.hash)) GROUP BY 1, 2, 3""")


@query("exact_content_dedup", "", """
SELECT text_hash, source, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT *, sha256(text) AS text_hash FROM documents) GROUP BY 1, 2""")
def _(t):
    docs = t.table("documents").select("source", F.sha2("text", 256).alias("text_hash"), "doc_id")
    return Q.first_unique(docs, ["text_hash", "source"], "doc_id")


@query("train_test_overlap_removal", "cleaned", "SELECT dataset, y, idx, id, copies FROM cleaned")
def _(t):
    return Q.clean_test(t.archive()).drop("hash")


@query("train_test_overlap_count", "hashed", """
SELECT dataset, count(*) AS removed FROM hashed h WHERE split = 'TEST' AND y = 0 AND EXISTS (
  SELECT 1 FROM hashed t WHERE t.split = 'TRAIN' AND t.dataset = h.dataset AND t.hash = h.hash) GROUP BY 1""")
def _(t):
    rows = t.archive().withColumn("hash", Q.content_hash())
    return Q.count_train_overlap(rows.filter("split = 'TEST' and y = 0"), rows.filter("split = 'TRAIN'"), ["dataset", "hash"])


@query("stable_hash_sample", "", """
SELECT lang, doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('7|' || lang || '|draw|' || doc_id), doc_id) <= 25""")
def _(t):
    rows = t.table("documents").select("lang", "doc_id")
    return Q.stable_sample(rows, ["lang"], F.lit(25), "7", "draw", "doc_id").select("lang", "doc_id")


fragment("tags", "", """
SELECT 'c' || (user_id % 5) AS dataset, event_id AS idx, event_id AS id, CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS y
FROM events WHERE event_type <> 'error' OR value > 60""")


@query("balanced_two_percent", "tags", """
WITH c AS (SELECT dataset, least(count(CASE WHEN y = 1 THEN 1 END), count(CASE WHEN y = 0 THEN 1 END) // 49) AS anoms FROM tags GROUP BY 1),
r AS (SELECT t.*, anoms, row_number() OVER (PARTITION BY dataset, y ORDER BY
  sha256('33|' || dataset || '|' || CASE WHEN y = 1 THEN 'anomaly' ELSE 'normal' END || '|balanced|' || idx), idx) AS k
  FROM tags t JOIN c USING (dataset))
SELECT dataset, y, idx, id FROM r WHERE k <= CASE WHEN y = 1 THEN anoms ELSE 49 * anoms END""")
def _(t):
    return Q.balanced_manifest(_tags(t))


def _tags(t):
    return t.table("events").filter("event_type <> 'error' or value > 60").select(
        F.concat(F.lit("c"), F.pmod("user_id", F.lit(5)).cast("string")).alias("dataset"), F.col("event_id").alias("idx"),
        F.col("event_id").alias("id"), (F.col("event_type") == "error").cast("int").alias("y"))


@query("manifest_summary", "archive cleaned", """
SELECT *, test_normal_count - clean_normal_count - removed_copies AS removed_overlap,
       CASE WHEN clean_normal_count > 0 AND clean_anomaly_count > 0 THEN 1 ELSE 0 END AS eligible FROM (
  SELECT a.*, coalesce(clean_normal_count, 0) AS clean_normal_count, coalesce(clean_anomaly_count, 0) AS clean_anomaly_count,
         coalesce(removed_copies, 0) AS removed_copies FROM (
    SELECT dataset, count(CASE WHEN split = 'TRAIN' THEN 1 END) AS train_count,
           count(CASE WHEN split = 'TEST' AND y = 0 THEN 1 END) AS test_normal_count,
           count(CASE WHEN split = 'TEST' AND y = 1 THEN 1 END) AS test_anomaly_count FROM archive GROUP BY 1) a
  LEFT JOIN (SELECT dataset, count(CASE WHEN y = 0 THEN 1 END) AS clean_normal_count,
                    count(CASE WHEN y = 1 THEN 1 END) AS clean_anomaly_count,
                    CAST(sum(CASE WHEN y = 0 THEN copies - 1 ELSE 0 END) AS BIGINT) AS removed_copies FROM cleaned GROUP BY 1) c USING (dataset))""")
def _(t):
    rows = t.archive()
    return Q.manifest_summary(rows, Q.clean_test(rows))


@query("manifest_id_reader", "tags", """
SELECT dataset, idx // 1000 AS variant, row_number() OVER (PARTITION BY dataset, idx // 1000 ORDER BY id) - 1 AS pos, id FROM tags""")
def _(t):
    lists = _tags(t).groupBy("dataset", F.floor(F.col("idx") / 1000).alias("variant")).agg(
        F.concat_ws(";", F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string"))).alias("ids"))
    return Q.read_id_list(lists, "ids").withColumn("pos", F.col("pos").cast("bigint"))


@query("integrity_rules", "archive", """
WITH p AS (SELECT 'r' || l_returnflag AS dataset, CASE WHEN l_linestatus = 'F' THEN 'TRAIN' ELSE 'TEST' END AS split,
                  CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END AS y FROM lineitem
           UNION ALL SELECT dataset, split, y FROM archive),
s AS (SELECT dataset, count(CASE WHEN split = 'TRAIN' AND y = 1 THEN 1 END) AS ta, count(CASE WHEN split = 'TEST' AND y = 1 THEN 1 END) AS a,
             count(CASE WHEN split = 'TEST' THEN 1 END) AS n, count(*) AS total FROM p GROUP BY 1),
c AS (SELECT dataset, count(*) AS total_count FROM archive GROUP BY 1)
SELECT dataset, 'train_has_anomalies' AS rule FROM s WHERE ta > 0
UNION ALL SELECT dataset, 'test_share_above_3pct' FROM s WHERE n - a >= 49 AND a > 0.03 * n
UNION ALL SELECT dataset, 'catalog_total_differs' FROM s LEFT JOIN c USING (dataset) WHERE coalesce(total_count, -1) <> total""")
def _(t):
    arch = t.archive()
    lines = t.table("lineitem").select(
        F.concat(F.lit("r"), "l_returnflag").alias("dataset"),
        F.when(F.col("l_linestatus") == "F", "TRAIN").otherwise("TEST").alias("split"), (F.col("l_discount") > 0.09).cast("int").alias("y"))
    return Q.integrity_violations(lines.unionByName(arch.select("dataset", "split", "y")), A.catalog(arch))


@query("grain_audit", "archive", f"""
SELECT dataset, min(y) AS min_label, max(y) AS max_label, count(CASE WHEN split = 'TRAIN' THEN 1 END) AS n_train,
       count(CASE WHEN split = 'TEST' THEN 1 END) AS n_test, CASE WHEN count(DISTINCT split || idx) = count(*) THEN 1 ELSE 0 END AS grain_ok,
       CASE WHEN dataset = 'emb_normal_3' THEN 0 ELSE 1 END AS catalog_ok, {r6("1.0 / (count(CASE WHEN split = 'TRAIN' THEN 1 END) + 1)")} AS min_p FROM archive GROUP BY 1""")
def _(t):
    """The catalog counts one row too many in one dataset."""
    rows = t.archive()
    catalog = A.catalog(rows).withColumn("total_count", F.col("total_count") + (F.col("dataset") == "emb_normal_3").cast("int"))
    return Q.grain_audit(rows, catalog).withColumn("min_p", R6("min_p"))


@query("missing_coverage", "", """
SELECT doc_id AS dataset FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    return Q.missing_datasets(t.table("documents").select(F.col("doc_id").alias("dataset")),
                              t.table("labels").select(F.col("doc_id").alias("dataset")))


@query("resume_skip", "", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000)""")
def _(t):
    orders = t.table("orders")
    done = orders.filter("o_orderstatus = 'P' and o_totalprice > 200000").select(F.col("o_custkey").alias("dataset"))
    todo = Q.missing_datasets(orders.select(F.col("o_custkey").alias("dataset")), done)
    return orders.join(todo, F.col("o_custkey") == F.col("dataset"), "left_semi").select("o_orderkey", "o_custkey")


@query("source_coverage_matrix", "scores", """
SELECT *, trim(concat_ws(' ', CASE WHEN rocket = 0 THEN 'rocket' END, CASE WHEN image_a = 0 THEN 'image_a' END, CASE WHEN image_b = 0 THEN 'image_b' END)) AS missing,
  CASE WHEN rocket > 0 AND image_a > 0 AND image_b > 0 THEN 'complete' WHEN rocket + image_a + image_b = 0 THEN 'none' ELSE 'partial' END AS status
FROM (SELECT dataset, count(CASE WHEN source = 'rocket' AND score > 150 THEN 1 END) AS rocket,
  count(CASE WHEN source = 'image_a' AND score > 95 THEN 1 END) AS image_a,
  count(CASE WHEN source = 'image_b' AND score > 120 THEN 1 END) AS image_b FROM scores WHERE split = 'TEST' GROUP BY 1)""")
def _(t):
    s = t.scores().filter("split = 'TEST'")
    fired = s.filter("(source = 'rocket' and score > 150) or (source = 'image_a' and score > 95) or (source = 'image_b' and score > 120)")
    return Q.source_coverage(fired, s.select("dataset").distinct(), ["rocket", "image_a", "image_b"])


@query("common_support", "scores", """
SELECT dataset FROM scores WHERE split = 'TEST' AND score > 90 GROUP BY dataset HAVING count(DISTINCT source) = 4""")
def _(t):
    return Q.common_support(t.scores().filter("split = 'TEST' and score > 90"), 4)


@query("duplicate_key_guard", "", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return Q.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("manifest_contract_check", "", """
SELECT CAST(coalesce(d.doc_id, l.doc_id) AS BIGINT) AS dataset,
       CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic <> 0 THEN 'setting' END AS problem
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR toxic <> 0""")
def _(t):
    rows = t.table("labels").select(F.col("doc_id").alias("dataset"), "toxic")
    return Q.contract_check(rows, t.table("documents").select(F.col("doc_id").alias("dataset")), ["dataset", "toxic"], {"toxic": "0"})


# ---- choosing datasets -------------------------------------------------------

fragment("catalog_rows", "event_rows", f"""
SELECT dataset, family, count(CASE WHEN split = 'TRAIN' THEN 1 END) AS train_count, {r6('avg(value)')} AS difficulty,
       {r6('avg(y)')} AS auc_pr, CASE WHEN count(*) % 2 = 0 THEN 'overlap' ELSE 'sparse' END AS kind
FROM event_rows GROUP BY 1, 2""")


def _catalog_rows(t):
    return t.event_rows().groupBy("dataset", "family").agg(
        F.count_if(F.col("split") == "TRAIN").alias("train_count"), R6(F.avg("value")).alias("difficulty"), R6(F.avg("y")).alias("auc_pr"),
        F.when(F.count(F.lit(1)) % 2 == 0, "overlap").otherwise("sparse").alias("kind"))


@query("family_round_robin", "catalog_rows", """
SELECT dataset, family, row_number() OVER (ORDER BY turn, family, dataset) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY dataset) AS turn FROM catalog_rows)
QUALIFY pick <= 40""")
def _(t):
    return Q.round_robin_sample(_catalog_rows(t), 40).select("dataset", "family", "pick")


@query("train_size_strata", "catalog_rows", """
WITH b AS (SELECT *, CASE WHEN train_count <= 10 THEN 0 WHEN train_count <= 50 THEN 1 ELSE 2 END AS bin FROM catalog_rows),
t AS (SELECT *, row_number() OVER (PARTITION BY bin, family ORDER BY dataset) AS turn FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY turn, family, dataset) AS pick FROM t),
f AS (SELECT * EXCLUDE (turn, pick), CASE WHEN pick > CASE WHEN bin < 2 THEN 20 ELSE 20 END THEN 1 ELSE 0 END AS refill FROM p),
u AS (SELECT *, row_number() OVER (PARTITION BY refill, family ORDER BY dataset) AS turn FROM f),
v AS (SELECT *, row_number() OVER (PARTITION BY refill ORDER BY turn, family, dataset) AS pick FROM u)
SELECT dataset, bin, refill FROM v QUALIFY row_number() OVER (ORDER BY refill, pick) <= 60""")
def _(t):
    return Q.stratified_sample(_catalog_rows(t), 60).select("dataset", "bin", "refill")


@query("custom_strata", "catalog_rows", """
WITH s AS (SELECT *, CASE WHEN train_count <= 30 THEN 0 WHEN train_count >= 38 THEN 1 END AS stratum FROM catalog_rows),
t AS (SELECT *, row_number() OVER (PARTITION BY stratum, family ORDER BY dataset) AS turn FROM s WHERE stratum IS NOT NULL)
SELECT dataset, stratum, pick FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY turn, family, dataset) AS pick FROM t)
WHERE pick <= CASE stratum WHEN 0 THEN 12 ELSE 9 END""")
def _(t):
    return Q.strata_sample(_catalog_rows(t), [(0, 30, 12), (38, None, 9)]).select("dataset", "stratum", "pick")


@query("target_selection", "catalog_rows", """
SELECT dataset, difficulty FROM catalog_rows WHERE kind = 'overlap' AND train_count >= 25 AND auc_pr < 0.2 ORDER BY difficulty DESC, dataset LIMIT 20""")
def _(t):
    return Q.target_datasets(_catalog_rows(t), ["overlap"], 25, 0.2, 20).select("dataset", "difficulty")


@query("reference_cap", "event_rows", """
SELECT dataset, idx FROM event_rows WHERE split = 'TRAIN'
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY sha256('ref|' || dataset || '|reference|' || idx), idx) <= 20""")
def _(t):
    return Q.reference_rows(t.event_rows().filter("split = 'TRAIN'"), 20).select("dataset", "idx")


@query("family_key_parse", "quota", "SELECT 'emb_normal_' || cls AS dataset, 'emb' AS family FROM quota")
def _(t):
    return t.archive().select("dataset").distinct().withColumn("family", F.regexp_replace("dataset", "_normal_[^_]*$", ""))
