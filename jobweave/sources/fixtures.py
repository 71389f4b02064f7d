"""Job tables projected from the TPC-H-like test tables, written once as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "2001-08-01 00:00:00"
SOURCES = {
    "fx_jobs": ["orders", "customer"], "fx_wait": ["fx_jobs"], "fx_chapters": ["fx_jobs", "lineitem"], "fx_stories": ["conversations"],
    "fx_story_chapters": ["conversations"], "fx_runs": ["events"], "fx_bodies": ["fx_chapters"], "fx_schemas": ["nation"], "fx_schedule_log": ["events"],
    "fx_metadata": ["fx_jobs"], "fx_commands": ["events"],
    "fx_lease_log": ["events"], "fx_chain_runs": ["fx_runs"], "fx_workers": ["supplier"], "fx_story_log": ["conversations"], "fx_story_artifacts": ["fx_story_log"], "fx_chain": ["orders"], "fx_chain_chapters": ["fx_chain"],
}


def braces(sql: str) -> str:
    """JSON braces inside SQL strings, written as guillemets, since braces name inputs here."""
    return sql.replace("«", "' || chr(123) || '").replace("»", "' || chr(125) || '")


SQL = {
    "fx_jobs": f"""
SELECT tenant_id, job_id, k, job_type,
  CASE WHEN st = 'P' AND k % 2 = 0 THEN job_type || ':review' ELSE job_type END AS next_need,
  chr(123) || '"app":' || chr(123) || '"rank":' || CAST(k % 10 AS STRING) || ',"team":"t' || CAST(k % 4 AS STRING) || '"' || chr(125) || chr(125) AS metadata,
  CASE WHEN k % 10 IN (1, 5) THEN 'job-' || lpad(CAST(k - k % 10 AS STRING), 9, '0') END AS parent_job_id,
  created_at, created_at + (k % 400) * INTERVAL '1' DAY AS available_at,
  CASE WHEN st = 'F' THEN created_at + INTERVAL '1' DAY END AS archived_at,
  (st = 'F' AND k % 7 = 0) OR (st = 'O' AND k % 11 = 0) AS cancel_requested,
  CASE WHEN st <> 'F' THEN NULL WHEN k % 7 = 0 THEN 'cancelled' WHEN k % 3 = 0 THEN 'failed_app' ELSE 'success' END AS completion_status,
  CASE WHEN st = 'O' THEN 'lease-' || CAST(k AS STRING) END AS lease_id,
  CASE WHEN st = 'O' THEN CAST('{NOW}' AS {{ts}}) + (k % 5 - 2) * INTERVAL '1' HOUR END AS lease_expires_at,
  CASE WHEN st = 'P' AND k % 2 = 0 THEN job_type END AS alternate_need,
  CASE WHEN st = 'P' AND k % 2 = 0 THEN created_at + (k % 900) * INTERVAL '1' DAY END AS alternate_at
FROM (SELECT c.c_mktsegment AS tenant_id, o.o_orderkey AS k, 'job-' || lpad(CAST(o.o_orderkey AS STRING), 9, '0') AS job_id,
    replace(lower(substr(o.o_orderpriority, 3)), ' ', '_') AS job_type, o.o_orderstatus AS st, o.o_orderdate AS created_at
  FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey) t""",
    "fx_wait": """
SELECT tenant_id, job_id, 'job-' || lpad(CAST(k - 1 AS STRING), 9, '0') AS dep_job_id FROM {fx_jobs} WHERE archived_at IS NULL AND k % 5 = 0 AND k >= 3
UNION ALL
SELECT tenant_id, job_id, 'job-' || lpad(CAST(k - 3 AS STRING), 9, '0') AS dep_job_id FROM {fx_jobs} WHERE archived_at IS NULL AND k % 5 = 0 AND k >= 3""",
    "fx_chapters": """
SELECT j.tenant_id, j.job_id, CAST(0 AS BIGINT) AS ordinal, 'JobStart' AS chapter_type, j.job_type AS task_type, 1 AS attempt, 'App' AS payload_kind, j.created_at
FROM {fx_jobs} j
UNION ALL
SELECT j.tenant_id, j.job_id,
  CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_quantity, l.l_extendedprice) AS BIGINT) AS ordinal,
  CASE WHEN l.l_linestatus = 'F' AND l.l_linenumber >= 5 THEN 'JobAttemptOutcome' ELSE 'TaskAttemptOutcome' END AS chapter_type,
  CASE WHEN l.l_linestatus = 'F' AND l.l_linenumber >= 5 THEN j.job_type ELSE 'task_' || lower(l.l_returnflag) END AS task_type,
  CAST(1 + l.l_partkey % 3 AS INT) AS attempt,
  CASE WHEN l.l_quantity < 35 THEN 'App' WHEN l.l_quantity < 42 THEN 'AppError' WHEN l.l_quantity < 47 THEN 'SystemError' ELSE 'Timeout' END AS payload_kind,
  l.l_shipdate AS created_at
FROM {lineitem} l JOIN {fx_jobs} j ON l.l_orderkey = j.k""",
    "fx_stories": """
SELECT 'anth' AS anthology_id, conv_id AS story_id, max(turn) AS own_latest, CASE WHEN conv_id % 5 <> 0 THEN conv_id - 1 END AS base_story_id,
  CASE WHEN conv_id % 5 <> 0 THEN CAST(0 AS BIGINT) END AS fork_ordinal, conv_id % 17 = 0 AS deleted
FROM {conversations} GROUP BY conv_id""",
    "fx_story_chapters": "SELECT 'anth' AS anthology_id, conv_id AS story_id, turn AS ordinal, role AS task_type, text AS body FROM {conversations}",
    "fx_runs": "SELECT 't' || CAST(user_id % 2 AS STRING) AS tenant_id, 'sched-' || CAST(CAST(floor(user_id / 2) AS BIGINT) AS STRING) AS schedule_id, ts AS scheduled_at, event_id, event_type <> 'error' AS success FROM {events}",
    "fx_bodies": braces("""
SELECT tenant_id, job_id, ordinal, chapter_type, task_type, attempt, payload_kind, created_at, 'h' || CAST(ordinal AS STRING) AS input_hash,
  CASE payload_kind WHEN 'App' THEN '«"value":' || CAST(ordinal AS STRING) || '»'
    WHEN 'AppError' THEN '«"message":"bad ' || CAST(ordinal AS STRING) || '","level":"warn"»'
    WHEN 'SystemError' THEN '«"message":"down","component":"db","code":"E' || CAST(attempt AS STRING) || '","retryable":' || CASE WHEN attempt < 3 THEN 'true' ELSE 'false' END || '»'
    ELSE '«"message":"late","scope":"total","after":"30m0s","retryable":false»' END AS data
FROM {fx_chapters}"""),
    "fx_schemas": braces("""
SELECT n, CASE n % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS tenant_id,
  CASE WHEN n % 10 = 9 AND copy = 2 THEN '["no object"]' WHEN n % 10 = 8 AND copy = 2 THEN '«"shape":true»' WHEN copy = 1 THEN
    '« "description": "' || name || '", "chapterShape": «"type": "object", "required": ["ordinal", "body"], "properties": «"ordinal": «"maximum": ' || CAST(n AS STRING) || '.0, "type": "integer"»»»'
    || CASE WHEN n % 2 = 0 THEN ', "lastChapterShape": «"properties": «"body": «"properties": «"outcome": «"properties": «"kind": «"enum": ["success"]»»»»»»»' ELSE '' END || ' »'
  ELSE '«' || CASE WHEN n % 2 = 0 THEN '"lastChapterShape":«"properties":«"body":«"properties":«"outcome":«"properties":«"kind":«"enum":["success"]»»»»»»»,' ELSE '' END
    || '"chapterShape":«"required":["ordinal","body"],"properties":«"ordinal":«"type":"integer","maximum":' || CAST(n AS STRING) || '.0»»,"type":"object"»,"description":"' || name || '"»' END AS schema,
  CAST('2001-01-01 00:00:00' AS {ts}) + (n * 10 - copy) * INTERVAL '1' HOUR AS created_at
FROM (SELECT n_nationkey AS n, n_name AS name, 1 AS copy FROM {nation} UNION ALL SELECT n_nationkey, n_name, 2 FROM {nation}) t"""),
    "fx_schedule_log": """
SELECT 't' || CAST(user_id % 2 AS STRING) AS tenant_id, 'sched-' || CAST(CAST(floor(user_id / 2) AS BIGINT) AS STRING) AS schedule_id, ts, event_id, CASE event_type WHEN 'view' THEN 'upsert' WHEN 'click' THEN 'pause' WHEN 'purchase' THEN 'resume'
  WHEN 'signup' THEN 'trigger' ELSE CASE WHEN event_id % 9 = 0 THEN 'archive' ELSE 'upsert' END END AS command,
  CASE WHEN event_id % 4 = 0 THEN event_id % 40 END AS expected_generation
FROM {events}""",
    "fx_metadata": braces("""
SELECT tenant_id, job_id, k, CASE WHEN k % 5 = 0 THEN parent_job_id END AS parent_job_id, CASE k % 9
  WHEN 0 THEN '«"app":«"a":' || CAST(k AS STRING) || '»,"internal":«"parentJobId":" job-' || CAST(k - 1 AS STRING) || ' "»»'
  WHEN 1 THEN '«"app":null,"internal":«"schemaHash":"s' || CAST(k AS STRING) || '"»»' WHEN 2 THEN '«"internal":«"parentJobId":""»»' WHEN 3 THEN '«"internal":«"other":1»»'
  WHEN 4 THEN '«"schema_hash":7,"app":«"schemaHash":"h' || CAST(k AS STRING) || '"»»' WHEN 5 THEN '[1]' WHEN 6 THEN '«bad' WHEN 7 THEN '  '
  ELSE '«"app":«"b":1»,"internal":«"schedule":«"scheduleId":"sched-' || CAST(k % 40 AS STRING) || '","generation":' || CASE WHEN k % 5 = 0 THEN '1.5' ELSE CAST(k % 3 AS STRING) END || ',"specHash":"sha256:x","scheduledAt":"2001-07-0' || CAST(1 + k % 9 AS STRING)
    || CASE k % 7 WHEN 2 THEN 'T10:00:00+02:00' WHEN 3 THEN 'T10:00:00-05:30' WHEN 4 THEN 'T10:00:00.25Z' WHEN 5 THEN 'T10:00:00.250+00:00' WHEN 6 THEN ' 10:00' ELSE 'T10:00:00Z' END || '"»»»' END AS metadata
FROM {fx_jobs}"""),
    "fx_workers": """
SELECT CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS tenant_id, 'w' || CAST(s_suppkey AS STRING) AS worker,
  x.need || CASE WHEN s_suppkey % 3 = 0 THEN ':review' ELSE '' END AS need, CAST((s_suppkey + x.k) % 11 AS BIGINT) AS free
FROM {supplier} JOIN (SELECT 0 AS k, 'high' AS need UNION ALL SELECT 1, 'low' UNION ALL SELECT 2, 'urgent' UNION ALL SELECT 3, 'medium') x ON x.k <= s_suppkey % 4""",
    "fx_chain_runs": """
SELECT tenant_id, schedule_id, row_number() OVER (PARTITION BY tenant_id, schedule_id ORDER BY scheduled_at, event_id) - 1 AS step, scheduled_at, CAST(event_id % 50 * 60 AS BIGINT) AS delay_s, CAST(event_id % 200 * 60 AS BIGINT) AS duration_s,
  success OR event_id % 3 > 0 AS success, 1 + CAST(substr(schedule_id, 7) AS BIGINT) % 2 AS generation
FROM {fx_runs}""",
    "fx_lease_log": """
SELECT 'job-' || CAST(u AS STRING) AS job, CAST('2024-01-01 00:00:00' AS {ts}) + (n * 13 + e % 11) * INTERVAL '1' SECOND AS ts, e AS event_id, command,
  CASE WHEN command = 'cancel' THEN NULL ELSE 'l' || CAST(n {div} 7 - CASE WHEN e % 19 = 0 THEN 1 ELSE 0 END AS STRING) END AS lease_id, 'w' || CAST(CASE WHEN e % 23 = 0 THEN 9 ELSE n {div} 7 % 3 END AS STRING) AS worker,
  CASE WHEN command = 'lease' THEN CASE WHEN e % 4 = 0 THEN 'low' ELSE 'high' END WHEN command = 'reschedule' THEN CASE e % 5 WHEN 0 THEN '' WHEN 1 THEN 'low' ELSE 'high' END END AS need,
  CASE WHEN command = 'lease' AND e % 3 > 0 OR command = 'keepalive' AND e % 2 = 0 THEN CAST(60 + e % 3 AS DOUBLE) END AS seconds,
  CASE WHEN command IN ('append', 'complete') THEN CASE WHEN e % 6 = 0 THEN n % 9 ELSE -1 END END AS ordinal, CASE WHEN command IN ('append', 'complete') THEN 'd' || CAST(e % 2 AS STRING) END AS digest,
  CASE WHEN command = 'reschedule' AND e % 7 = 1 THEN CAST(1704067200 + n * 13 + 60 AS DOUBLE) END AS wait_until, CASE WHEN command = 'reschedule' AND e % 5 = 1 THEN 'high' END AS alternate_need,
  CASE WHEN command = 'reschedule' AND e % 5 = 1 THEN CAST(20 AS DOUBLE) WHEN command = 'reschedule' AND e % 11 = 3 THEN CAST(5 AS DOUBLE) END AS alternate_after,
  CASE WHEN command = 'complete' THEN CASE e % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failed_app' ELSE 'cancelled' END END AS outcome
FROM (SELECT u, e, n, CASE WHEN e % 211 = 0 THEN 'cancel' WHEN n % 7 = 0 THEN 'lease' WHEN n % 7 = 2 OR n % 7 = 4 AND e % 3 = 0 THEN 'keepalive' WHEN n % 7 = 5 THEN CASE WHEN e % 14 = 0 THEN 'complete' ELSE 'reschedule' END WHEN n % 7 = 6 AND e % 2 = 0 THEN 'lease' ELSE 'append' END AS command
  FROM (SELECT user_id AS u, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}) t) t2""",
    "fx_story_log": """
SELECT seq, 'anth-' || CAST(c % 2 AS STRING) AS anthology_id, 's' || CAST(h AS STRING) AS story_id, command, ordinal,
  CASE WHEN command = 'clone' THEN 'anth-' || CAST((c + 1 + c % 2) % 2 AS STRING) END AS base_anthology_id,
  CASE WHEN command = 'clone' THEN 's' || CAST(CASE WHEN c % 23 = 1 THEN h + 1000000 ELSE h - 1 + c % 2 END AS STRING) END AS base_story_id,
  CASE WHEN command = 'clone' THEN fork END AS last_ordinal, body
FROM (
  SELECT c * 100 AS seq, c, h, fork, CASE WHEN c % 5 = 0 THEN 'create' ELSE 'clone' END AS command, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS STRING) AS body FROM (
    SELECT c, h, c % 4 - 1 AS fork, CASE WHEN c % 5 = 0 THEN 0 WHEN c % 4 = 0 THEN 3 ELSE c % 4 END AS low FROM (SELECT DISTINCT conv_id AS c, (conv_id - conv_id % 2) {div} 2 AS h FROM {conversations}) a) b
  UNION ALL
  SELECT c * 100 + 10 + turn * 3 + x.k, c, h, fork, 'append', low + turn + CASE WHEN x.k = 2 THEN 5 ELSE 0 END, text FROM (
    SELECT conv_id AS c, (conv_id - conv_id % 2) {div} 2 AS h, conv_id % 4 - 1 AS fork, CASE WHEN conv_id % 5 = 0 THEN 0 WHEN conv_id % 4 = 0 THEN 3 ELSE conv_id % 4 END AS low, turn, text FROM {conversations}) b
    JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x ON x.k = 0 OR turn % 4 = x.k
  UNION ALL
  SELECT CASE WHEN x.k = 9 THEN 900095 + c * 100 ELSE c * 100 + 50 + x.k END, c, h, 0, CASE WHEN x.k IN (0, 2) THEN 'publish' WHEN x.k = 1 THEN 'append' WHEN x.k = 3 THEN 'tombstone' WHEN x.k = 5 THEN 'create' ELSE 'delete' END,
    CASE WHEN x.k = 1 THEN 8 END, CASE WHEN x.k = 1 THEN 'too late' END
  FROM (SELECT DISTINCT conv_id AS c, (conv_id - conv_id % 2) {div} 2 AS h FROM {conversations}) b
    JOIN (SELECT 0 AS k, 3 AS d, 0 AS r UNION ALL SELECT 1, 3, 0 UNION ALL SELECT 2, 6, 0 UNION ALL SELECT 3, 4, 1 UNION ALL SELECT 4, 17, 0 UNION ALL SELECT 5, 17, 0 UNION ALL SELECT 9, 7, 3) x ON c % x.d = x.r) t""",
    "fx_story_artifacts": """
SELECT anthology_id, story_id, ordinal, seq * 10 + x.k AS artifact_seq, seq, CAST((x.k + seq) % 3 AS INT) AS position, 'a' || CAST(x.k AS STRING) AS name, 'text/plain' AS content_type, CAST(length(body) AS BIGINT) AS size_bytes,
  md5(body) || md5('a' || CAST(x.k AS STRING)) AS sha256, CASE WHEN length(body) <= 256 THEN body END AS inline_data, CASE WHEN length(body) > 256 THEN 'blobs/' || md5(body) END AS blob_path
FROM {fx_story_log} JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x ON seq % 4 <> 0 AND x.k <= seq % 3 WHERE command = 'append'""",
    "fx_chain": """
SELECT 'anth-' || CAST(k % 2 AS STRING) AS anthology_id, 's' || lpad(CAST(h AS STRING), 7, '0') AS story_id, CAST(4 AS BIGINT) AS latest_ordinal, k % 17 = 3 AS deleted,
  CASE WHEN p > 0 THEN 'anth-' || CAST(k % 2 AS STRING) END AS base_anthology_id, CASE WHEN p > 0 THEN 's' || lpad(CAST(h - 1 AS STRING), 7, '0') END AS base_story_id, CASE WHEN p > 0 THEN p * 7 % 4 END AS fork_ordinal
FROM (SELECT o_orderkey AS k, (o_orderkey - o_orderkey % 2) {div} 2 AS h, (o_orderkey - o_orderkey % 2) {div} 2 % 1000 AS p FROM {orders}) t""",
    "fx_chain_chapters": """
SELECT anthology_id, story_id, x.k AS ordinal, anthology_id || '/' || story_id || '/' || CAST(x.k AS STRING) AS body
FROM {fx_chain} JOIN (SELECT CAST(0 AS BIGINT) AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) x ON x.k > coalesce(fork_ordinal, -1)""",
    "fx_commands": """
SELECT 'job-' || CAST(user_id AS STRING) AS job, ts, event_id, CASE event_type WHEN 'view' THEN 'append' WHEN 'click' THEN 'lease' WHEN 'purchase' THEN CASE WHEN event_id % 6 = 0 THEN 'complete' ELSE 'reschedule' END
  WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'cancel' ELSE 'fail' END ELSE 'keepalive' END AS command, 'w' || CAST(event_id % 3 AS STRING) AS worker
FROM {events}""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture or test table as a DataFrame."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return projected(spark, name, **{x: fixture(spark, sf_dir, x) for x in SOURCES[name]})


def projected(spark: SparkSession, name: str, **inputs: DataFrame) -> DataFrame:
    return spark.sql(SQL[name].replace("{ts}", "TIMESTAMP_NTZ").replace("{div}", "DIV"), **inputs)


def ctes(*names: str) -> str:
    """A WITH clause that defines fixtures for DuckDB, without its last comma-free end."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in SQL and not any(x.startswith(f"{name} AS") for x in out):
            for x in SOURCES[name]:
                add(x)
            out.append(f"{name} AS ({SQL[name].format(ts='TIMESTAMP', div='//', **{x: x for x in SOURCES[name]})})")

    for n in names:
        add(n)
    return ",\n".join(out)
