"""SQL fragments for the inputs that Spark assembles in sources/tables.py."""

from outlane.plans.registry import fragment, r6

fragment("quota", "", """
SELECT cls, n, n_train, n_anom, 49 * n_anom AS need, least(n - n_train, 49 * n_anom) AS unseen FROM (
  SELECT label AS cls, count(*) AS n, CAST(floor(count(*) * 8 / 10) AS BIGINT) AS n_train,
         least((SELECT count(*) FROM embeddings) - count(*), greatest(1, count(*) // 49)) AS n_anom
  FROM embeddings GROUP BY label) WHERE n_anom > 0""")

fragment("archive", "quota", """
SELECT 'emb_normal_' || cls AS dataset, split, CAST(idx AS BIGINT) AS idx, id, y, values FROM (
  WITH p AS (
    SELECT e.label AS cls, vec_id AS id, CAST(embedding AS DOUBLE[]) AS values,
           row_number() OVER (PARTITION BY label ORDER BY sha256('42|normal|emb|' || label || '|' || vec_id)) AS rn
    FROM embeddings e),
  q AS (SELECT p.*, n_train, need, unseen FROM p JOIN quota USING (cls)),
  g AS (SELECT vec_id AS id, label AS own, CAST(embedding AS DOUBLE[]) AS values,
               row_number() OVER (ORDER BY sha256('42|anomaly|emb|' || vec_id)) AS g FROM embeddings),
  a AS (SELECT g.*, quota.cls, n_anom, need,
               row_number() OVER (PARTITION BY quota.cls ORDER BY g) AS r
        FROM g JOIN quota ON g.own <> quota.cls)
  SELECT cls, 'TRAIN' AS split, rn - 1 AS idx, id, 0 AS y, values FROM q WHERE rn <= n_train
  UNION ALL
  SELECT cls, 'TEST', rn - n_train - 1, id, 0, values FROM q WHERE rn > n_train AND rn - n_train <= need
  UNION ALL
  SELECT cls, 'TEST', unseen + j, id, 0, values FROM (
    SELECT q.*, unnest(range(CAST(need - unseen AS BIGINT))) AS j FROM q WHERE rn <= n_train) WHERE j % n_train = rn - 1
  UNION ALL
  SELECT cls, 'TEST', need + r - 1, id, 1, values FROM a WHERE r <= n_anom)""")

fragment("event_rows", "", """
SELECT *, row_number() OVER (PARTITION BY dataset, split ORDER BY event_id) - 1 AS idx FROM (
  SELECT event_id, 'u' || user_id AS dataset, 'f' || (user_id % 7) AS family, ts, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
         CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'TRAIN' ELSE 'TEST' END AS split
  FROM events) WHERE split = 'TEST' OR y = 0""")

fragment("scores", "event_rows", f"""
SELECT dataset, family, split, idx, 'rocket' AS source, value AS score FROM event_rows
UNION ALL SELECT dataset, family, split, idx, 'image_a', k FROM event_rows
UNION ALL SELECT dataset, family, split, idx, 'image_b', {r6('value * k / 100')} FROM event_rows
UNION ALL SELECT dataset, family, split, idx, 'multi', {r6('abs(value - 50) + k / 10')} FROM event_rows""")

fragment("score", "scores", "SELECT dataset, family, split, idx, score FROM scores WHERE source = 'rocket'")

fragment("truth", "event_rows", "SELECT dataset, family, idx, y FROM event_rows WHERE split = 'TEST'")

fragment("panel", "", """
SELECT n_name AS dataset, l_suppkey AS idx, n_regionkey AS region, values FROM (
  SELECT l_suppkey, list(v ORDER BY month) AS values FROM (
    SELECT l_suppkey, date_trunc('month', l_shipdate) AS month, sum(l_quantity) AS v
    FROM lineitem GROUP BY 1, 2) GROUP BY 1)
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
