"""Queries of dispatch and attempt loops, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions import expr
from jobweave.operators import listing, worker
from jobweave.plans.oracle import STATUS, with_
from jobweave.sources.fixtures import NOW

POLICY = {"total_s": 40_000_000, "invocation_s": 86_400, "initial_ms": 100.0, "coefficient": 2.0, "max_ms": 350.0, "max_attempts": 3}
TASK = ["tenant_id", "job_id", "task_type"]


def dispatched(t) -> DataFrame:
    """Ready jobs of all tenants, and suppliers as workers with up to ten jobs of a need."""
    jobs = listing.with_status(t.fx_jobs, t.fx_wait, NOW).where("status in ('READY', 'CRASH_CONCERN')").withColumn("need", expr.effective_need(NOW))
    return worker.dispatch(jobs, t.fx_workers)


def loops(t) -> DataFrame:
    """The outcomes of each job's tasks of one type; some took two days."""
    rows = t.fx_bodies.where("chapter_type = 'TaskAttemptOutcome'").withColumn("retry_flag", F.get_json_object("data", "$.retryable").cast("boolean"))
    rows = rows.withColumn("started_at", F.expr("if(ordinal % 4 = 1, created_at - interval 2 days, created_at - interval 1 hour)"))
    return worker.attempt_loop(rows, TASK, POLICY, "1998-12-01 00:00:00")


BUILT = {"q_dispatch": dispatched, "q_attempt_loop": loops}


def sql() -> dict[str, str]:
    return {
        "q_dispatch": with_(("fx_jobs", "fx_wait", "fx_workers"), STATUS, """w AS (SELECT tenant_id, need, worker, sum(free) AS free FROM fx_workers WHERE free > 0 GROUP BY ALL),
s AS (SELECT *, sum(free) OVER (PARTITION BY tenant_id, need ORDER BY worker) AS last FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, need ORDER BY created_at, job_id) AS rank FROM st WHERE status IN ('READY', 'CRASH_CONCERN'))""")
        + "SELECT r.tenant_id, r.job_id, r.need, worker, CAST(rank - (last - free) AS BIGINT) AS place FROM r JOIN s ON r.tenant_id = s.tenant_id AND r.need = s.need AND rank > last - free AND rank <= last",
        "q_attempt_loop": with_(("fx_bodies",), f"""o AS (SELECT *, CAST(json_extract_string(data, '$.retryable') AS BOOLEAN) AS flag, created_at - CASE WHEN ordinal % 4 = 1 THEN INTERVAL '2' DAY ELSE INTERVAL '1' HOUR END AS started_at FROM fx_bodies WHERE chapter_type = 'TaskAttemptOutcome'),
p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id, task_type ORDER BY ordinal) AS n, first_value(started_at) OVER (PARTITION BY tenant_id, job_id, task_type ORDER BY ordinal) + to_seconds({POLICY["total_s"]}) AS deadline,
  ordinal % 4 = 1 AS late, created_at + to_milliseconds(CAST(least(100 * pow(2, attempt - 1), 350) AS BIGINT)) AS wake FROM o),
d AS (SELECT *, CASE WHEN payload_kind = 'App' AND NOT late THEN 'RETURN' WHEN created_at > deadline THEN 'TIMEOUT_TOTAL'
  WHEN NOT (late OR payload_kind = 'AppError' OR payload_kind = 'SystemError' AND coalesce(flag, true) OR payload_kind = 'Timeout' AND coalesce(flag, false)) THEN 'FAIL' WHEN attempt >= 3 THEN 'FAIL' WHEN wake > deadline THEN 'TIMEOUT_TOTAL' ELSE 'RETRY' END AS action FROM p),
e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY tenant_id, job_id, task_type ORDER BY action = 'RETRY', CASE WHEN action = 'RETRY' THEN -n ELSE n END) = 1)""")
        + """SELECT tenant_id, job_id, task_type, CASE WHEN action = 'RETRY' AND deadline < TIMESTAMP '1998-12-01' THEN 'TIMEOUT_TOTAL' ELSE action END AS action, CAST(CASE WHEN action = 'RETRY' THEN attempt + 1 ELSE attempt END AS INTEGER) AS attempt,
CASE WHEN action = 'RETRY' AND deadline >= TIMESTAMP '1998-12-01' THEN wake END AS wake_at FROM e""",
    }
