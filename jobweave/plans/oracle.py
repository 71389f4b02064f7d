"""SQL of the job queries for DuckDB, on the same test tables."""

from __future__ import annotations

from jobweave.sources.fixtures import NOW, ctes

CURSOR_TIME, CURSOR_JOB = "2000-06-15 00:00:00", "job-000000777"
T = f"TIMESTAMP '{NOW}'"
ALL = "('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"

STATUS = f"""blocked AS (SELECT DISTINCT w.tenant_id, w.job_id FROM fx_wait w JOIN fx_jobs d ON d.tenant_id = w.tenant_id AND d.job_id = w.dep_job_id WHERE d.archived_at IS NULL),
st AS (SELECT j.*, b.job_id IS NOT NULL AS blocked,
  CASE WHEN archived_at IS NOT NULL THEN CASE WHEN cancel_requested OR completion_status = 'cancelled' THEN 'CANCELLED' ELSE 'COMPLETED' END
    WHEN cancel_requested THEN 'CANCELLED'
    WHEN lease_id IS NOT NULL THEN CASE WHEN lease_expires_at > {T} THEN 'ACTIVE' ELSE 'CRASH_CONCERN' END
    WHEN b.job_id IS NOT NULL THEN 'PENDING_JOBS' WHEN available_at > {T} THEN 'AWAITING_FUTURE' ELSE 'READY' END AS status,
  CASE WHEN alternate_need IS NOT NULL AND alternate_at <= {T} THEN alternate_need ELSE next_need END AS need
  FROM fx_jobs j LEFT JOIN blocked b ON j.tenant_id = b.tenant_id AND j.job_id = b.job_id)"""
OUTCOME = """outcome AS (SELECT tenant_id, job_id, attempt, ordinal, payload_kind FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id
  ORDER BY attempt DESC, ordinal DESC) AS rn FROM fx_chapters WHERE chapter_type = 'JobAttemptOutcome') x WHERE rn = 1)"""
SEGMENTS = """seg AS (SELECT *,
  coalesce(last_value(CASE WHEN chapter_type = 'JobAttemptOutcome' THEN attempt END IGNORE NULLS) OVER w, 0) + 1 AS job_attempt,
  coalesce(max(CASE WHEN chapter_type = 'JobAttemptOutcome' THEN ordinal END) OVER w, -1) AS segment
  FROM fx_chapters WINDOW w AS (PARTITION BY tenant_id, job_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, CASE WHEN lag(task_type) OVER v IS NULL OR attempt <= 1 OR lag(task_type) OVER v <> task_type THEN 1 ELSE 0 END AS begins
  FROM seg WHERE chapter_type = 'TaskAttemptOutcome' WINDOW v AS (PARTITION BY tenant_id, job_id, segment ORDER BY ordinal)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY tenant_id, job_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT tenant_id, job_id, run, min(job_attempt) AS job_attempt, arg_min(task_type, ordinal) AS task_type, min(ordinal) AS first_ordinal,
  count(*) AS n_attempts, arg_max(payload_kind, attempt * 1000000 + ordinal) AS latest_kind FROM numbered GROUP BY 1, 2, 3)"""
WINDOWED = """bits AS (SELECT *, string_agg(CASE WHEN success THEN '1' ELSE '0' END, '') OVER (PARTITION BY tenant_id, schedule_id ORDER BY scheduled_at, event_id
  ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS bits FROM fx_runs),
bad AS (SELECT *, (length(bits) - length(rtrim(bits, '0')) >= 2) OR (length(replace(bits, '0', '')) * 100 < 70 * length(bits)) AS violated FROM bits)"""


J = "tenant_id, job_id"
ERRORS = """e AS (SELECT *, CASE payload_kind WHEN 'AppError' THEN 'app' WHEN 'SystemError' THEN 'system' WHEN 'Timeout' THEN 'timeout' END AS kind,
  CASE payload_kind WHEN 'AppError' THEN 'bad ' || ordinal WHEN 'SystemError' THEN 'down' WHEN 'Timeout' THEN 'late' END AS message,
  CASE WHEN payload_kind = 'SystemError' THEN 'E' || attempt END AS code,
  CASE payload_kind WHEN 'SystemError' THEN attempt < 3 WHEN 'Timeout' THEN false END AS retryable FROM fx_bodies)"""
LAST = "last AS (SELECT tenant_id, job_id, max(ordinal) AS last FROM fx_chapters GROUP BY ALL)"
OUTPUTS = """ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY attempt DESC, ordinal DESC) AS rn FROM e WHERE chapter_type = 'JobAttemptOutcome') x WHERE rn = 1),
outputs AS (SELECT st.*, CASE WHEN status = 'CANCELLED' THEN 'CANCELLED' WHEN status <> 'COMPLETED' OR payload_kind IS NULL THEN 'NOT_COMPLETE' WHEN payload_kind <> 'App' THEN 'FAILED' ELSE 'OK' END AS state,
  data, kind, message FROM st LEFT JOIN ends USING (tenant_id, job_id))"""
LAST_SHAPE = '{"properties":{"body":{"properties":{"outcome":{"properties":{"kind":{"enum":["success"]}}}}}}}'
SCHEMAS = f"""s AS (SELECT n, tenant_id, created_at, schema, CASE WHEN schema LIKE '[%' THEN NULL WHEN schema LIKE '%"shape"%' THEN schema ELSE
  '{{"chapterShape":{{"properties":{{"ordinal":{{"maximum":' || n || '.0,"type":"integer"}}}},"required":["ordinal","body"],"type":"object"}},"description":"' || n_name || '"'
  || CASE WHEN n % 2 = 0 THEN ',"lastChapterShape":{LAST_SHAPE}' ELSE '' END || '}}' END AS canonical FROM fx_schemas JOIN nation ON n = n_nationkey),
hashed AS (SELECT *, 'sha256:' || sha256(canonical) AS schema_hash FROM s),
registry AS (SELECT tenant_id, schema_hash, canonical AS schema, min(created_at) AS created_at, CASE WHEN min(n) IN (5, 6, 7) THEN 'ARCHIVED' ELSE 'ACTIVE' END AS state,
  CASE WHEN min(n) IN (5, 6, 7) THEN {T} END AS archived_at FROM hashed WHERE canonical LIKE '%chapterShape%' GROUP BY 1, 2, 3)"""
BODY = """CASE payload_kind WHEN 'App' THEN '{"kind":"success","output":{"value":' || ordinal || '}}'
  WHEN 'AppError' THEN '{"error":{"level":"warn","message":"bad ' || ordinal || '"},"kind":"appError"}'
  WHEN 'SystemError' THEN '{"error":{"code":"E' || attempt || '","component":"db","message":"down"' || CASE WHEN attempt < 3 THEN ',"retryable":true' ELSE '' END || '},"kind":"systemError"}'
  ELSE '{"kind":"timeout","timeout":{"after":"30m0s","message":"late","retryable":false,"scope":"total"}}' END"""

REASON = """CASE WHEN event_id % 4 = 0 THEN 'OK' WHEN n % 13 = 0 AND tenant_id <> 't1' THEN 'MISSING' WHEN n % 5 = 0 THEN 'PAUSED' WHEN n % 7 = 0 THEN 'ARCHIVED' WHEN n % 2 <> event_id % 2 THEN 'GENERATION'
WHEN event_id % 11 = 0 THEN 'SPEC' WHEN n % 3 = 0 AND scheduled_at > TIMESTAMP '2024-01-20' THEN 'ENDED' WHEN violated THEN 'FAILURE_POLICY' ELSE 'OK' END"""
FOLD = """e AS (SELECT *, epoch(ts) AS s, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n FROM fx_commands),
f AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, 'READY' AS status, CAST(0 AS DOUBLE) AS lease_until, CAST(NULL AS VARCHAR) AS holder, CAST(NULL AS DOUBLE) AS last_at, CAST(0 AS BIGINT) AS latest_ordinal,
    CAST(0 AS BIGINT) AS n_done, CAST(0 AS BIGINT) AS n_conflicts FROM e
  UNION ALL
  SELECT job, n, CASE WHEN move = 'cancel' THEN 'CANCELLED' WHEN move = 'lease' THEN 'ACTIVE' WHEN move = 'reschedule' THEN 'READY' WHEN move IN ('complete', 'fail') THEN 'COMPLETED' ELSE status END,
    CASE WHEN move IN ('lease', 'keepalive') THEN s + 43200 WHEN move IN ('cancel', 'reschedule', 'complete', 'fail') THEN 0 ELSE lease_until END,
    CASE WHEN move = 'lease' THEN worker WHEN move IN ('cancel', 'reschedule', 'complete', 'fail') THEN NULL ELSE holder END, s,
    latest_ordinal + CASE WHEN move IN ('append', 'complete', 'fail') THEN 1 ELSE 0 END, n_done + CASE WHEN move = 'complete' THEN 1 ELSE 0 END, n_conflicts + CASE WHEN move = '' THEN 1 ELSE 0 END
  FROM (SELECT e.job, e.n, e.s, e.worker, f.status, f.lease_until, f.holder, f.latest_ordinal, f.n_done, f.n_conflicts,
      CASE WHEN command = 'cancel' THEN 'cancel' WHEN command = 'lease' AND (f.status = 'READY' OR f.status = 'ACTIVE' AND f.lease_until <= e.s) THEN 'lease'
        WHEN command <> 'lease' AND f.status = 'ACTIVE' AND f.lease_until > e.s AND f.holder = e.worker THEN command ELSE '' END AS move
    FROM f JOIN e ON e.job = f.job AND e.n = f.n + 1) x)"""
FOLDED = "SELECT job, status, lease_until, holder, last_at, latest_ordinal, n_done, n_conflicts FROM f JOIN (SELECT job, max(n) AS n FROM e GROUP BY job) l USING (job, n)"
SCHEDULE_LOG = """e AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, schedule_id ORDER BY ts, event_id) AS n FROM fx_schedule_log),
f AS (SELECT DISTINCT tenant_id, schedule_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, '' AS command, '' AS result,
    CAST(NULL AS VARCHAR) AS state, CAST(NULL AS BIGINT) AS generation, CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS TIMESTAMP) AS fire_at FROM e
  UNION ALL
  SELECT tenant_id, schedule_id, n, event_id, ts, command, result, CASE WHEN NOT changes THEN state WHEN command = 'pause' THEN 'PAUSED' WHEN command = 'archive' THEN 'ARCHIVED' ELSE 'ACTIVE' END,
    CASE WHEN changes THEN coalesce(generation, 0) + 1 ELSE generation END, CASE WHEN changes THEN coalesce(created_at, ts) ELSE created_at END, CASE WHEN changes THEN ts ELSE updated_at END,
    CASE WHEN NOT changes THEN fire_at WHEN command IN ('upsert', 'resume') THEN ts END
  FROM (SELECT *, result = 'OK' AND command <> 'trigger' AS changes FROM (
    SELECT e.tenant_id, e.schedule_id, e.n, e.event_id, e.ts, e.command, f.state, f.generation, f.created_at, f.updated_at, f.fire_at,
      CASE WHEN e.command = 'upsert' THEN CASE WHEN f.state = 'ARCHIVED' THEN 'ARCHIVED' WHEN expected_generation IS NOT NULL AND (f.state IS NULL OR expected_generation <> f.generation) THEN 'GENERATION' ELSE 'OK' END
        WHEN f.state IS NULL THEN 'NOT_FOUND' WHEN e.command = 'trigger' THEN CASE WHEN f.state = 'ARCHIVED' THEN 'ARCHIVED' ELSE 'OK' END
        WHEN expected_generation <> f.generation THEN 'GENERATION' WHEN f.state = 'ARCHIVED' AND e.command <> 'archive' THEN 'ARCHIVED' ELSE 'OK' END AS result
    FROM f JOIN e ON e.tenant_id = f.tenant_id AND e.schedule_id = f.schedule_id AND e.n = f.n + 1) x) y)"""


def with_(names: tuple[str, ...], *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(x for x in (ctes(*names), *more) if x) + "\n"


def listed(where: str, size: int = 100) -> str:
    return with_(("fx_jobs", "fx_wait"), STATUS) + f"SELECT tenant_id, job_id, status, created_at FROM st WHERE {where} ORDER BY created_at DESC, tenant_id || '/' || job_id DESC LIMIT {size}"


def sql() -> dict[str, str]:
    one, jobs = "tenant_id = 'BUILDING'", ("fx_jobs", "fx_wait")
    chapters, runs = with_(("fx_chapters",)), ("fx_runs",)
    rank, team = "json_extract(metadata, '$.app.rank')", "json_extract_string(metadata, '$.app.team')"
    free = f"NOT cancel_requested AND archived_at IS NULL AND (lease_id IS NULL OR lease_expires_at <= {T}) AND available_at <= {T} AND NOT blocked"
    polled = f"SELECT tenant_id, job_id, need, created_at FROM st WHERE {one} AND {free} AND need IN ('high', 'low', 'urgent', 'medium:review')"
    number = "CAST(regexp_extract(schedule_id, '([0-9]+)$', 1) AS INT)"
    return {
        "q_status": with_(jobs, STATUS) + "SELECT tenant_id, job_id, status FROM st",
        "q_list_ready": listed(f"{one} AND status = 'READY'"),
        "q_list_status_in": listed(f"{one} AND status IN ('ACTIVE', 'CANCELLED', 'CRASH_CONCERN')", 200),
        "q_list_store_active": listed(f"{one} AND archived_at IS NULL", 200),
        "q_list_store_archived": listed(f"{one} AND archived_at IS NOT NULL"),
        "q_list_type": listed("job_type IN ('urgent', 'high')", 200),
        "q_list_task": listed(f"{one} AND next_need IN ('low:review', 'high:review')", 150),
        "q_list_keys": listed("(tenant_id, job_id) IN (SELECT (tenant_id, parent_job_id) FROM fx_jobs WHERE parent_job_id IS NOT NULL)", 200),
        "q_list_parent": listed("parent_job_id IN ('job-000000010', 'job-000000100', 'job-000000200')"),
        "q_list_root": listed(f"{one} AND parent_job_id IS NULL", 60),
        "q_list_created_range": listed("created_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-03-01'", 200),
        "q_list_meta_eq": listed(f"{one} AND CAST({rank} AS INT) = 1"),
        "q_list_meta_or": listed(f"{one} AND CAST({rank} AS INT) IN (1, 2, 7)"),
        "q_list_meta_and": listed(f"{one} AND CAST({rank} AS INT) IN (1, 3, 5) AND {team} IN ('t1', 't3')"),
        "q_page_1": listed(f"tenant_id IN {ALL}", 50),
        "q_page_2": listed(f"created_at < TIMESTAMP '{CURSOR_TIME}' OR (created_at = TIMESTAMP '{CURSOR_TIME}' AND tenant_id || '/' || job_id < 'FURNITURE/{CURSOR_JOB}')", 50),
        "q_summary": with_(jobs, STATUS) + f"""SELECT tenant_id, job_id, status, tenant_id || '/' || job_id AS job_key, need, split_part(next_need, ':', 1) AS need_job_type,
CASE WHEN instr(next_need, ':') > 0 THEN substr(next_need, instr(next_need, ':') + 1) ELSE next_need END AS need_task_type, coalesce(parent_job_id, '') AS parent,
CAST({rank} AS VARCHAR) AS rank, '"' || {team} || '"' AS team, '' AS schema_hash FROM st""",
        "q_poll_candidates": with_(jobs, STATUS) + f"SELECT tenant_id, job_id, need FROM ({polled}) x",
        "q_poll_lease_plan": with_(jobs, STATUS) + f"""SELECT tenant_id, job_id, need AS next_need, CAST(row_number() OVER (ORDER BY created_at, job_id) AS INT) AS place,
{T} + INTERVAL '30' SECOND AS expires_at FROM ({polled}) x ORDER BY created_at, job_id LIMIT 20""",
        "q_poll_meta": with_(jobs, STATUS) + f"SELECT tenant_id, job_id, need FROM st WHERE {one} AND {free} AND need IN ('high', 'low') AND {team} IN ('t1', 't3')",
        "q_waiting_tasks": with_(jobs) + f"SELECT tenant_id, job_id, job_type, split_part(next_need, ':', 2) AS task_type FROM fx_jobs WHERE archived_at IS NULL AND instr(next_need, ':') > 0",
        "q_children_count": with_(jobs) + "SELECT tenant_id, parent_job_id, count(*) AS n_children FROM fx_jobs WHERE parent_job_id IS NOT NULL GROUP BY 1, 2",
        "q_prereq_check": with_(jobs) + """SELECT w.tenant_id, w.job_id, w.dep_job_id, CASE WHEN d.job_id IS NULL THEN 'missing' WHEN d.archived_at IS NULL THEN 'open'
WHEN d.completion_status = 'success' THEN 'success' ELSE 'failed' END AS state FROM fx_wait w LEFT JOIN fx_jobs d ON d.tenant_id = w.tenant_id AND d.job_id = w.dep_job_id""",
        "q_get_job": with_((*jobs, "fx_chapters"), STATUS, OUTCOME) + """SELECT s.tenant_id, s.job_id, status, CASE WHEN archived_at IS NOT NULL THEN payload_kind END AS outcome
FROM st s LEFT JOIN outcome o ON o.tenant_id = s.tenant_id AND o.job_id = s.job_id""",
        "q_last_chapter": chapters + "SELECT tenant_id, job_id, ordinal, chapter_type, task_type, attempt, payload_kind, created_at FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY ordinal DESC) AS rn FROM fx_chapters) x WHERE rn = 1",
        "q_attempts": with_(("fx_chapters",), SEGMENTS) + "SELECT tenant_id, job_id, ordinal, job_attempt, segment FROM seg",
        "q_task_runs": with_(("fx_chapters",), SEGMENTS) + "SELECT tenant_id, job_id, job_attempt, task_type, first_ordinal, n_attempts, latest_kind, task_type || ':' || first_ordinal AS run_id FROM runs",
        "q_run_nested": with_(("fx_chapters",), SEGMENTS) + """SELECT tenant_id, job_id, job_attempt, CAST(row_number() OVER (PARTITION BY tenant_id, job_id, job_attempt ORDER BY first_ordinal) - 1 AS INT) AS place,
task_type || ':' || first_ordinal AS run_id, n_attempts FROM runs""",
        "q_latest_attempt": with_(("fx_chapters",), OUTCOME) + "SELECT tenant_id, job_id, attempt, ordinal, payload_kind FROM outcome",
        "q_next_attempt": with_(("fx_bodies",), OUTCOME) + "SELECT tenant_id, job_id, attempt + 1 AS next_attempt FROM outcome WHERE payload_kind = 'AppError' AND attempt < 4 OR payload_kind = 'SystemError' AND attempt < 3",  # attempt 3 says that it may not be retried
        "q_runtime_row": with_((*jobs, "fx_chapters"), STATUS, "c AS (SELECT tenant_id, job_id, max(ordinal) AS last FROM fx_chapters WHERE job_id NOT LIKE '%7' GROUP BY 1, 2)") + """SELECT tenant_id, job_id, coalesce(last + 1, 0) AS ordinal, next_need,
CASE status WHEN 'READY' THEN 'READY' WHEN 'ACTIVE' THEN 'LEASED' ELSE 'WAITING' END AS state, next_need || ':' || coalesce(last + 1, 0) AS run_id, last AS input_ordinal
FROM st LEFT JOIN c USING (tenant_id, job_id) WHERE status IN ('READY', 'ACTIVE', 'AWAITING_FUTURE', 'PENDING_JOBS')""",
        "q_chapter_range": chapters + f"SELECT tenant_id, job_id, ordinal, chapter_type FROM fx_chapters WHERE ordinal BETWEEN 1 AND 2",
        "q_task_deadline": chapters + """SELECT tenant_id, job_id, ordinal, deadline FROM (SELECT *, coalesce(lag(created_at) OVER (PARTITION BY tenant_id, job_id ORDER BY ordinal), created_at)
+ INTERVAL '30' MINUTE AS deadline FROM fx_chapters) x WHERE ordinal > 0""",
        "q_restart_diff": with_(("fx_jobs", "fx_chapters"), "c AS MATERIALIZED (SELECT c.*, k, k // 2 AS pair FROM fx_chapters c JOIN fx_jobs j ON j.tenant_id = c.tenant_id AND j.job_id = c.job_id)") + """
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.ordinal, b.ordinal) AS ordinal, CASE WHEN a.pair IS NULL THEN 'extra' WHEN b.pair IS NULL THEN 'missing' ELSE 'differs' END AS kind
FROM (SELECT * FROM c WHERE k % 2 = 0) a FULL OUTER JOIN (SELECT * FROM c WHERE k % 2 = 1) b ON a.pair = b.pair AND a.ordinal = b.ordinal
WHERE a.pair IS NULL OR b.pair IS NULL OR a.chapter_type <> b.chapter_type OR a.task_type <> b.task_type OR a.attempt <> b.attempt OR a.payload_kind <> b.payload_kind""",
        "q_story_page": with_(("fx_stories",)) + "SELECT story_id, own_latest FROM fx_stories WHERE NOT deleted AND story_id > 10 ORDER BY story_id LIMIT 26",
        "q_fork_resolve": with_(("fx_stories", "fx_story_chapters"), """reach(story_id, owner, upto, depth) AS (
  SELECT story_id, story_id, CAST(NULL AS BIGINT), 0 FROM fx_stories WHERE NOT deleted
  UNION ALL SELECT r.story_id, s.base_story_id, least(coalesce(r.upto, s.fork_ordinal), s.fork_ordinal), r.depth + 1
  FROM reach r JOIN fx_stories s ON s.story_id = r.owner WHERE s.base_story_id IS NOT NULL)""") + """SELECT r.story_id, c.ordinal, r.owner, r.depth, c.task_type, length(c.body) AS n_chars
FROM reach r JOIN fx_stories s ON s.story_id = r.owner JOIN fx_story_chapters c ON c.story_id = r.owner
WHERE (s.fork_ordinal IS NULL OR c.ordinal > s.fork_ordinal) AND (r.upto IS NULL OR c.ordinal <= r.upto)""",
        "q_artifact_hash": "SELECT doc_id, 'doc-' || doc_id || '.txt' AS name, strlen(text) AS size_bytes, sha256(text) AS sha256, strlen(text) <= 256 AS inline FROM documents",
        "q_input_hash": """SELECT job, sha256('job-' || job || string_agg(part, '' ORDER BY part)) AS input_hash
FROM (SELECT doc_id % 50 AS job, 'doc-' || doc_id || '.txt|' || sha256(text) AS part FROM documents) x GROUP BY job""",
        "q_cron_match": with_(runs) + """SELECT event_id, schedule_id, scheduled_at FROM fx_runs WHERE minute(scheduled_at) < 30 AND minute(scheduled_at) % 2 = 0
AND hour(scheduled_at) BETWEEN 8 AND 20 AND day(scheduled_at) IN (1, 15, 20, 21, 22, 23, 24, 25)""",
        "q_cron_next": with_(runs, "minutes AS (SELECT m FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-12', INTERVAL '1' MINUTE)) AS m) x WHERE minute(m) % 15 = 0 AND hour(m) BETWEEN 9 AND 17 AND dayofweek(m) BETWEEN 1 AND 5)")
        + "SELECT event_id, min(m) AS next_fire FROM fx_runs JOIN minutes ON m > date_trunc('minute', scheduled_at) AND m < scheduled_at + INTERVAL '8' DAY GROUP BY event_id",
        "q_interval_next": with_(runs) + """SELECT event_id, CASE WHEN f <= TIMESTAMP '2024-01-25' THEN f END AS next_fire
FROM (SELECT event_id, greatest(scheduled_at + INTERVAL '90' MINUTE, TIMESTAMP '2024-01-05') AS f FROM fx_runs) x""",
        "q_sched_job_id": with_(runs) + "SELECT event_id, 'jobdbsched_' || schedule_id || '_g3_run_' || strftime(scheduled_at, '%Y%m%dT%H%M%S%f') || '000Z' AS job_id FROM fx_runs",
        "q_sched_runs": with_(runs) + """SELECT tenant_id, schedule_id, scheduled_at, event_id, success FROM fx_runs ORDER BY scheduled_at DESC, event_id DESC LIMIT 101""",
        "q_failure_bits": with_(runs, WINDOWED) + "SELECT event_id, tenant_id, schedule_id, bits FROM bits",
        "q_failure_violated": with_(runs, WINDOWED) + "SELECT event_id, violated FROM bad",
        "q_preflight": with_(runs, WINDOWED, f"numbers AS (SELECT *, {number} AS n FROM bad)") + f"SELECT event_id, {REASON} AS reason FROM numbers",
        "q_preflight_cancel": with_(runs, WINDOWED, f"numbers AS (SELECT *, {number} AS n FROM bad), r AS (SELECT *, {REASON} AS reason FROM numbers)") + """SELECT tenant_id, schedule_id, event_id, 1 AS ordinal, 'cancelled' AS completion_status,
'jobdb.schedule_preflight' AS component, CASE reason WHEN 'FAILURE_POLICY' THEN 'failure_policy' WHEN 'GENERATION' THEN 'schedule_generation_mismatch' WHEN 'SPEC' THEN 'schedule_spec_mismatch' ELSE 'schedule_' || lower(reason) END AS code,
CASE reason WHEN 'FAILURE_POLICY' THEN 'schedule failure policy blocked this occurrence' WHEN 'GENERATION' THEN 'schedule generation changed before app start' WHEN 'SPEC' THEN 'schedule spec changed before app start'
ELSE 'schedule ' || lower(reason) || ' before app start' END AS message FROM r WHERE reason <> 'OK'""",
        "q_successors": with_(runs, WINDOWED, f"numbers AS (SELECT *, {number} AS n FROM bad), r AS (SELECT *, {REASON} AS reason, greatest(scheduled_at + to_minutes(event_id % 50) + INTERVAL '90' MINUTE, TIMESTAMP '2024-01-05') AS fire FROM numbers)") + """SELECT event_id, tenant_id,
'jobdbsched_' || schedule_id || '_g' || (1 + n % 2) || '_run_' || strftime(fire, '%Y%m%dT%H%M%S%f') || '000Z' AS job_id, fire AS scheduled_at,
CASE WHEN event_id % 6 <> 1 THEN 'jobdbsched_' || schedule_id || '_g' || (1 + n % 2) || '_run_' || strftime(scheduled_at, '%Y%m%dT%H%M%S%f') || '000Z' END AS waits_for, bits FROM r WHERE reason = 'OK' AND event_id % 4 <> 0 AND fire <= TIMESTAMP '2024-01-25'""",
        "q_app_metadata": with_(("fx_metadata",)) + """SELECT tenant_id, job_id, coalesce(parent_job_id, CASE WHEN k % 9 = 0 THEN 'job-' || (k - 1) END, '') AS parent,
CASE k % 9 WHEN 0 THEN '{"a":' || k || '}' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 4 THEN '{"schemaHash":"h' || k || '"}' WHEN 7 THEN NULL WHEN 8 THEN '{"b":1}' ELSE metadata END AS app,
CASE k % 9 WHEN 1 THEN 's' || k WHEN 4 THEN 'h' || k ELSE '' END AS schema_hash FROM fx_metadata""",
        "q_occurrence": with_(("fx_metadata",)) + """SELECT tenant_id, job_id, 'sched-' || (k % 40) AS schedule_id, CASE WHEN k % 5 > 0 THEN k % 3 END AS generation, 'sha256:x' AS spec_hash, at_ AS scheduled_at,
strftime(at_, '%Y%m%dT%H%M%S%f') || '000Z' AS run_id, CASE WHEN k % 5 = 0 OR k % 7 = 6 THEN 'INVALID' WHEN k % 3 = 0 THEN 'MISSING_FIELDS' END AS error
FROM (SELECT *, CASE WHEN k % 7 < 2 THEN TIMESTAMP '2001-07-09 10:00:00' WHEN k % 7 = 2 THEN TIMESTAMP '2001-07-09 08:00:00' WHEN k % 7 = 3 THEN TIMESTAMP '2001-07-09 15:30:00' WHEN k % 7 < 6 THEN TIMESTAMP '2001-07-09 10:00:00.25' END AS at_ FROM fx_metadata) m WHERE k % 9 = 8""",
        "q_policy_merge": with_(("fx_jobs",)) + """SELECT tenant_id, job_id, CASE WHEN k % 3 = 0 THEN 100 ELSE k % 3 * 100 END AS initial_ms, CASE WHEN k % 2 = 1 THEN 2.0 ELSE 1.0 END AS coefficient, 30000 AS max_ms,
CASE k % 4 WHEN 1 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS max_attempts, CASE WHEN k % 5 = 0 THEN 'A' ELSE 'B' END AS non_retryable,
CASE WHEN k % 7 = 6 THEN 600000 WHEN k % 7 >= 2 THEN k % 7 * 1000 - 2000 END AS invocation_ms, 1800000 AS total_ms FROM fx_jobs""",
        "q_input_chapter": with_(("fx_bodies",)) + """SELECT a.tenant_id, a.job_id, a.ordinal, CASE WHEN a.ordinal = 0 THEN 'NONE' WHEN b.job_id IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS input_state, b.data AS input_data
FROM fx_bodies a LEFT JOIN fx_bodies b ON a.tenant_id = b.tenant_id AND a.job_id = b.job_id AND a.ordinal > 0 AND b.ordinal = a.ordinal - 1 - a.ordinal % 3""",
        "q_event_times": with_(("fx_chapters",), """own AS (SELECT *, CASE WHEN ordinal % 2 = 1 THEN created_at - INTERVAL '2' HOUR ELSE created_at END AS started, CASE WHEN ordinal % 3 = 1 THEN created_at - INTERVAL '1' HOUR ELSE created_at END AS ended FROM fx_chapters)""") + """SELECT tenant_id, job_id, ordinal,
CASE chapter_type WHEN 'JobStart' THEN created_at WHEN 'JobAttemptOutcome' THEN coalesce(last_value(CASE chapter_type WHEN 'JobAttemptOutcome' THEN ended WHEN 'JobStart' THEN created_at END IGNORE NULLS) OVER w, started) ELSE started END AS began, ended
FROM own WINDOW w AS (PARTITION BY tenant_id, job_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "q_fold_final_state": with_(("fx_commands",), FOLD) + FOLDED,
        "q_stream_fold": with_(("fx_commands",), FOLD) + FOLDED,
        "q_backoff": chapters + """SELECT tenant_id, job_id, ordinal, least(100.0 * pow(2.0, attempt - 1), 350.0) AS backoff_ms, payload_kind IN ('AppError', 'SystemError') AS retryable
FROM fx_chapters WHERE chapter_type = 'TaskAttemptOutcome'""",
        "q_schedule_log": with_(("fx_schedule_log",), SCHEDULE_LOG) + """SELECT tenant_id, schedule_id, event_id, ts, command, result, state, generation, created_at, updated_at, fire_at,
CASE WHEN fire_at IS NOT NULL THEN 'jobdbsched_' || schedule_id || '_g' || generation || '_run_' || strftime(fire_at, '%Y%m%dT%H%M%S%f') || '000Z' END AS next_job_id FROM f WHERE n > 0""",
        "q_schedule_list": with_(("fx_schedule_log",), SCHEDULE_LOG, "ends AS (SELECT tenant_id, schedule_id, arg_max(state, n) AS state, max(generation) AS generation, max(updated_at) AS updated_at FROM f GROUP BY 1, 2)")
        + "SELECT schedule_id, state, generation, updated_at FROM ends WHERE tenant_id = 't1' AND state IN ('ACTIVE', 'PAUSED') ORDER BY updated_at DESC, schedule_id DESC LIMIT 100",
        "q_cron_first": with_(runs, "minutes AS (SELECT m FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-12', INTERVAL '1' MINUTE)) AS m) x WHERE minute(m) % 15 = 0 AND hour(m) BETWEEN 9 AND 17 AND dayofweek(m) BETWEEN 1 AND 5)")
        + "SELECT event_id, min(m) AS next_fire FROM fx_runs JOIN minutes ON m >= date_trunc('minute', scheduled_at) AND m < scheduled_at + INTERVAL '8' DAY GROUP BY event_id",
        "q_artifact_lookup": """WITH made AS (SELECT doc_id, doc_id % 50 AS job_id, doc_id // 50 % 3 AS ordinal, doc_id // 150 AS position, 'n' || doc_id % 7 AS name, sha256(text) AS digest, strlen(text) AS size FROM documents),
refs AS (SELECT DISTINCT job_id, ordinal, name, CASE WHEN doc_id % 3 = 0 THEN digest WHEN doc_id % 3 = 1 THEN '' ELSE 'none' END AS digest FROM made)
SELECT r.job_id, r.ordinal, r.name, r.digest, min(m.position) IS NOT NULL AS found, min(m.position) AS position, arg_min(m.size, m.position) AS size
FROM refs r LEFT JOIN made m ON r.job_id = m.job_id AND r.ordinal = m.ordinal AND r.name = m.name AND (r.digest = '' OR r.digest = m.digest) GROUP BY ALL""",
        "q_poll_groups": with_(("fx_jobs",)) + """SELECT signature, string_agg(capability, ',' ORDER BY capability) AS capabilities
FROM (SELECT DISTINCT CASE WHEN job_type LIKE '%h' THEN 'team=t1' ELSE '' END AS signature, CASE WHEN c = 1 THEN job_type ELSE next_need END AS capability FROM fx_jobs, (VALUES (1), (2)) v(c)) x GROUP BY signature""",
        "q_blob_round_trip": "SELECT doc_id, sha256(text) AS digest, strlen(text) AS size, sha256(text) AS read_digest FROM documents WHERE strlen(text) > 256",
        "q_outcomes": with_(("fx_bodies",), ERRORS) + f"""SELECT {J}, ordinal, CASE WHEN kind IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, kind AS error_kind, message, code, retryable,
CASE WHEN kind IS NULL THEN data END AS output FROM e WHERE ordinal > 0""",
        "q_chapter_document": with_(("fx_bodies",)) + f"""SELECT {J}, ordinal, '{{"artifacts":[],"attempt":' || attempt || ',"body":' || CASE WHEN ordinal = 0 THEN '{{"input":{{"value":0}},"kind":"jobStart"}}'
  ELSE '{{"kind":"' || lower(chapter_type[1]) || chapter_type[2:] || '","outcome":' || {BODY} || '}}' END || ',"createdAt":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '","inputHash":"' || input_hash
  || '","ordinal":' || ordinal || ',"taskType":"' || task_type || '"}}' AS document FROM fx_bodies""",
        "q_get_output": with_((*jobs, "fx_bodies"), STATUS, ERRORS, OUTPUTS) + f"""SELECT {J}, state, CASE WHEN state = 'OK' THEN data END AS output, CASE WHEN state = 'FAILED' THEN kind END AS error_kind,
CASE WHEN state = 'FAILED' THEN message END AS message FROM outputs""",
        "q_completion_status": with_(("fx_bodies",), ERRORS) + f"""SELECT {J}, ordinal, CASE WHEN ordinal % 5 = 0 THEN 'cancelled' WHEN kind IS NULL THEN 'success' ELSE 'failed_' || kind END AS status,
coalesce(message, '') AS detail FROM e WHERE chapter_type = 'JobAttemptOutcome'""",
        "q_failed_round_trip": with_(("fx_bodies",), ERRORS) + f"""SELECT {J}, ordinal, CASE WHEN kind = 'app' THEN 'warn' ELSE 'error' END AS outer_level, CASE kind WHEN 'app' THEN 2 WHEN 'system' THEN 5 ELSE 4 END AS n_attrs,
kind, message, CASE WHEN kind = 'app' THEN 'warn' END AS level, CASE WHEN kind = 'system' THEN 'db' END AS component, code, CASE WHEN kind = 'timeout' THEN 'total' END AS scope, retryable FROM e WHERE kind IS NOT NULL""",
        "q_submit": with_(("fx_jobs",)) + f"""SELECT {J}, seq, CASE WHEN k % 3 = 0 THEN CASE WHEN seq = 0 THEN 'NEW' WHEN k % 17 = 5 AND k % 5 <> 1 THEN 'JOB_TYPE' ELSE 'SAME' END
WHEN k % 5 = 1 OR (seq = 1 AND k % 17 = 5) THEN 'JOB_TYPE' WHEN k % 7 = 2 THEN 'INPUT' WHEN k % 11 <> 3 AND k % 13 = 4 THEN 'METADATA' ELSE 'SAME' END AS result
FROM fx_jobs, (SELECT unnest([0, 1]) AS seq) x""",
        "q_restart": with_(("fx_chapters",), LAST) + """SELECT j.tenant_id, j.job_id AS prior_job_id, j.job_id || '-again' AS job_id, k % 6 - 1 AS last_step,
CASE WHEN k % 6 = 0 THEN 'NEGATIVE_STEP' WHEN c.ordinal IS NULL THEN 'NO_NEXT_CHAPTER' WHEN c.attempt > 1 THEN 'CUTS_RETRIES' ELSE 'OK' END AS result,
CASE WHEN k % 6 > 0 AND c.attempt = 1 THEN job_type END AS job_type, CASE WHEN k % 6 > 0 AND c.attempt = 1 THEN k % 6 - 1 END AS fork_ordinal, CASE WHEN k % 6 > 0 AND c.attempt = 1 THEN k % 6 END AS next_ordinal
FROM fx_jobs j LEFT JOIN fx_chapters c ON j.tenant_id = c.tenant_id AND j.job_id = c.job_id AND c.ordinal = k % 6""",
        "q_child_submit": with_(("fx_jobs",)) + f"""SELECT c.tenant_id, c.parent_job_id, c.job_id || '-child' AS child_id, CASE WHEN p.job_id IS NULL THEN 'NOT_FOUND'
WHEN p.archived_at IS NULL AND p.lease_id IS NOT NULL AND p.lease_expires_at > {T} AND (c.k % 3 <> 0 OR p.k = 0) THEN 'OK' ELSE 'LEASE_LOST' END AS result
FROM fx_jobs c LEFT JOIN fx_jobs p ON p.tenant_id = c.tenant_id AND p.job_id = c.parent_job_id WHERE c.parent_job_id IS NOT NULL""",
        "q_job_lease": with_(jobs, STATUS, f"""r AS (SELECT tenant_id, CASE WHEN k % 50 = 7 THEN 'none' ELSE job_id END AS job_id, need,
CASE WHEN k % 50 = 7 THEN 'NOT_FOUND' WHEN status NOT IN ('READY', 'CRASH_CONCERN') THEN 'NOT_LEASEABLE' WHEN need NOT IN ('high', 'low', 'urgent') THEN 'NO_CAPABILITY' ELSE 'LEASED' END AS result FROM st)""")
        + f"SELECT {J}, result, CASE WHEN result = 'LEASED' THEN need END AS need, CASE WHEN result = 'LEASED' THEN {T} + INTERVAL '30' SECOND END AS expires_at FROM r",
        "q_run_result": with_((*jobs, "fx_bodies"), STATUS, ERRORS, OUTPUTS, """m AS (SELECT *, CASE WHEN status NOT IN ('COMPLETED', 'CANCELLED') AND next_need NOT IN ('high', 'low', 'urgent', 'medium:review') THEN next_need END AS missing FROM outputs)""")
        + f"""SELECT {J}, missing, CASE WHEN state = 'OK' THEN 'COMPLETED' WHEN status IN ('COMPLETED', 'CANCELLED') THEN 'FAILED' WHEN status IN ('PENDING_JOBS', 'AWAITING_FUTURE') OR missing IS NOT NULL THEN 'SUSPENDED'
ELSE 'NOT_LEASEABLE' END AS result FROM m""",
        "q_complete_task": with_(("fx_chapters",), """r AS (SELECT *, CASE WHEN instr(next_need, ':') = 0 THEN 'NOT_WAITING' WHEN k % 7 = 0 THEN 'OTHER_CAPABILITY' WHEN k % 8 = 0 THEN 'OTHER_RESUME' WHEN k % 10 = 0 THEN 'OTHER_INPUT'
WHEN k % 26 = 0 THEN 'OTHER_OUTPUT' WHEN k % 22 = 0 THEN 'OTHER_HASH' WHEN k % 9 = 0 THEN 'NOT_NEXT_CHAPTER' ELSE 'OK' END AS result FROM fx_jobs)""")
        + f"SELECT {J}, result, CASE WHEN result = 'OK' THEN 'review' END AS task_type, CASE WHEN result = 'OK' THEN job_type END AS resume_need FROM r",
        "q_await_jobs": with_(jobs) + """SELECT w.tenant_id, w.job_id, count(*) FILTER (d.archived_at IS NULL AND NOT d.cancel_requested) = 0 AS done, count(*) AS n_awaited,
count(*) FILTER (d.archived_at IS NULL AND NOT d.cancel_requested) AS n_pending, min(d.job_id) FILTER (d.archived_at IS NULL AND NOT d.cancel_requested) AS first_pending
FROM fx_wait w LEFT JOIN fx_jobs d ON d.tenant_id = w.tenant_id AND d.job_id = w.dep_job_id GROUP BY 1, 2""",
        "q_await_until": with_(runs, """a AS (SELECT event_id, TIMESTAMP '2024-01-15 12:00:00' AS now, scheduled_at + to_minutes(event_id % 600) AS wake, CASE WHEN event_id % 3 = 0 THEN scheduled_at + INTERVAL '1' HOUR END AS inv,
CASE WHEN event_id % 4 = 0 THEN scheduled_at + INTERVAL '2' HOUR END AS total FROM fx_runs),
b AS (SELECT *, least(wake, inv, total) AS stop FROM a), c AS (SELECT *, CASE WHEN total < now THEN 'TIMEOUT_TOTAL' WHEN inv < now THEN 'TIMEOUT_INVOCATION' WHEN stop <= now THEN 'CONTINUE'
WHEN stop > now + INTERVAL '5' MINUTE THEN 'RESCHEDULE' ELSE 'SLEEP' END AS action FROM b)""") + "SELECT event_id, action, CASE WHEN action IN ('RESCHEDULE', 'SLEEP') THEN stop END AS until FROM c",
        "q_attempt_step": with_(("fx_bodies",), ERRORS, f"""a AS (SELECT *, CASE WHEN created_at + INTERVAL '2000' DAY < {T} THEN 'TIMEOUT' WHEN kind IS NULL THEN 'RETURN' WHEN attempt >= 3 OR kind = 'timeout' THEN 'FAIL'
ELSE 'RETRY' END AS action FROM e WHERE chapter_type = 'TaskAttemptOutcome')""") + f"""SELECT {J}, ordinal, action, CASE WHEN action = 'RETRY' THEN attempt + 1 END AS next_attempt,
CASE WHEN action = 'RETRY' THEN created_at + to_milliseconds(CASE attempt WHEN 1 THEN 100 ELSE 200 END) END AS wake_at FROM a""",
        "q_replay_misses": with_(("fx_bodies",), """x AS (SELECT tenant_id, job_id, k, unnest([1, 2, 3, 4]) AS ordinal FROM fx_jobs),
r AS (SELECT x.*, CASE WHEN x.ordinal = 4 THEN 'job' ELSE 'task' END AS kind, CASE WHEN x.ordinal = 4 THEN '' ELSE 'task_a' END AS task_type, CASE WHEN k % 10 = 0 THEN 'other' ELSE 'h' || x.ordinal END AS input_hash,
c.chapter_type, c.task_type AS stored FROM x LEFT JOIN fx_bodies c ON x.tenant_id = c.tenant_id AND x.job_id = c.job_id AND x.ordinal = c.ordinal)""") + f"""SELECT {J}, CAST(ordinal AS BIGINT) AS ordinal, kind, task_type, input_hash,
CASE WHEN chapter_type IS NULL THEN kind || '_result_missing' ELSE 'NOT_DETERMINISTIC' END AS reason FROM r WHERE chapter_type IS NULL OR input_hash = 'other'
OR (kind = 'job' AND chapter_type <> 'JobAttemptOutcome') OR (kind = 'task' AND (chapter_type <> 'TaskAttemptOutcome' OR stored <> 'task_a'))""",
        "q_schema_hash": with_(("fx_schemas",), SCHEMAS) + "SELECT n, created_at, canonical, schema_hash FROM hashed",
        "q_schema_registry": with_(("fx_schemas",), SCHEMAS) + "SELECT tenant_id, schema_hash, schema, created_at, state, archived_at FROM registry",
        "q_schema_refused": with_(("fx_schemas",), SCHEMAS) + """SELECT n, created_at, CASE WHEN canonical IS NULL THEN 'schema must be a JSON object' ELSE 'unknown schema field shape' END AS error
FROM hashed WHERE canonical IS NULL OR canonical NOT LIKE '%chapterShape%'""",
        "q_schema_list": with_(("fx_schemas",), SCHEMAS) + f"SELECT schema_hash, created_at, state FROM registry WHERE {one} AND state = 'ACTIVE'",
        "q_schema_resolve": with_(("fx_schemas",), SCHEMAS, """r AS (SELECT h.n, h.created_at, schema_hash, n % 3 = 0 AS inline, CASE n % 4 WHEN 0 THEN schema_hash WHEN 1 THEN '' WHEN 2 THEN 'zero' ELSE 'bad' END AS wanted FROM hashed h WHERE n % 10 < 8),
q AS (SELECT *, CASE WHEN wanted = 'bad' THEN 'MALFORMED_HASH' WHEN inline AND wanted = 'zero' THEN 'HASH_MISMATCH' WHEN NOT inline AND wanted = '' THEN '' WHEN NOT inline AND wanted = 'zero' THEN 'NOT_FOUND'
WHEN n IN (5, 6, 7) THEN 'ARCHIVED' ELSE '' END AS error FROM r)""") + "SELECT n, created_at, CASE WHEN error = '' THEN CASE WHEN inline OR wanted <> '' THEN schema_hash ELSE '' END END AS resolved, error FROM q",
        "q_schema_rejected": with_(("fx_bodies", "fx_schemas"), SCHEMAS, LAST, """r AS (SELECT b.tenant_id, b.job_id, b.ordinal, payload_kind, h.n, h.schema_hash, CASE WHEN b.ordinal = 0 THEN 'first'
WHEN j.archived_at IS NOT NULL AND b.ordinal = last.last AND chapter_type = 'JobAttemptOutcome' THEN 'last' ELSE 'chapter' END AS role
FROM fx_bodies b JOIN fx_jobs j ON b.tenant_id = j.tenant_id AND b.job_id = j.job_id JOIN last ON last.tenant_id = b.tenant_id AND last.job_id = b.job_id
JOIN (SELECT DISTINCT n, tenant_id, schema_hash FROM hashed WHERE n % 10 < 8) h ON h.tenant_id = b.tenant_id AND h.n // 5 = j.k % 5),
p AS (SELECT *, CASE WHEN role = 'last' AND n % 2 = 0 THEN CASE WHEN payload_kind <> 'App' THEN '/body/outcome/kind enum' ELSE '' END WHEN ordinal > n THEN '/ordinal maximum' ELSE '' END AS problem FROM r)""")
        + f"SELECT {J}, ordinal, role, schema_hash, problem FROM p WHERE problem <> ''",
    }
