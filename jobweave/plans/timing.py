"""Queries of calendars, chains of occurrences, schedule hashes and number encodings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions import expr
from jobweave.operators import calendar, listing, schedules
from jobweave.plans.oracle import ALL, STATUS, with_
from jobweave.sources.fixtures import NOW

#: Noon of 29 February.
LEAP, WINDOW, MAX_SEQUENTIAL, MIN_PERCENT = "0 12 29 2 *", 8, 3, 50
TENANTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def horizon(t) -> DataFrame:
    """Leap days from every run on; every third run's schedule starts later, every fourth one's ends."""
    start, end = F.expr("case when event_id % 3 = 0 then scheduled_at + make_dt_interval(cast(event_id % 1500 as int)) end"), F.expr("case when event_id % 4 = 0 then timestamp_ntz'2028-02-29 12:00:00' - make_dt_interval(0, 0, 0, event_id % 2) end")
    return calendar.cron_next(t.fx_runs, LEAP, F.col("scheduled_at"), "UTC", start, end).select("event_id", "next_fire", "exhausted")


def never(t) -> DataFrame:
    """A date that doesn't come: the search ends, or the schedule does before."""
    end = F.expr("case when event_id % 2 = 0 then timestamp_ntz'2026-01-01' end")
    return calendar.cron_next(t.fx_runs, "0 0 30 2 *", F.col("scheduled_at"), "UTC", None, end).select("event_id", "next_fire", "exhausted")


def chained(t) -> DataFrame:
    runs = t.fx_chain_runs
    first = runs.where("step = 0").select("tenant_id", "schedule_id", "generation", F.col("scheduled_at").alias("first_at"), F.lit(5400).alias("seconds"), F.expr("timestamp_ntz'2024-01-03'").alias("start_at"), F.expr("case when generation > 1 then timestamp_ntz'2024-01-05' end").alias("end_at"))
    return calendar.chains(first, runs, WINDOW, MAX_SEQUENTIAL, MIN_PERCENT)


RANKS = ["1e3", "1000", "1000.0", "9007199254740993", "0.10", "1E-7", '"a<b"', "1.5e300", "5", '"1000"']


def numbers(t) -> DataFrame:
    """Ranks in all spellings, asked for by numbers and by JSON text."""
    texts = F.array(*(F.lit('{"app":{"it\'s":' + r + "}}") for r in RANKS))
    jobs = t.fx_jobs.withColumn("metadata", F.element_at(texts, (F.col("k") % 10 + 1).cast("int")))
    asked = listing.ListRequest(tenants=TENANTS, page_size=200, metadata={("it's",): [1000, 0.1, 1e-7, listing.RawJson("9007199254740992"), "a<b", listing.RawJson("1e3"), 1.5e300]})
    found = listing.list_jobs(jobs, t.fx_wait, NOW, asked)
    return found.select("tenant_id", "job_id", "created_at", expr.app_value("metadata", "it's").alias("rank"))


def hashed(t) -> DataFrame:
    """A schedule's spec for each job: names with quotes, data with spaces and marks, artifacts out of order, policies with and without values."""
    empty = F.lit(None).cast("string")
    trigger = schedules.spec_trigger(F.expr("if(k % 2 = 0, 'cron', 'interval')"), F.expr("if(k % 2 = 0, '0 0 * * *', '')"), F.expr("if(k % 4 = 0, 'Europe/Berlin', '')"), empty, F.expr("if(k % 3 = 0, '2030-01-01T00:00:00Z', null)"), F.expr("if(k % 2 = 0, 0L, k * 1000000000L)"))
    policy = F.expr("""named_struct('initial_ns', if(k % 3 = 0, 0L, 100000000L), 'coefficient', if(k % 3 = 0, 0D, 2.5D), 'max_ns', 0L, 'max_attempts', k % 4, 'non_retryable', if(k % 3 = 0, cast(null as array<string>), array('A')),
      'invocation_ns', cast(null as bigint), 'total_ns', if(k % 5 = 0, 60000000000L, null))""")
    files = F.expr("if(k % 7 = 0, array(named_struct('name', 'b', 'sha256', 'y', 'size', k), named_struct('name', 'a', 'sha256', '', 'size', 0L)), cast(array() as array<struct<name:string,sha256:string,size:bigint>>))")
    target = schedules.spec_target(F.concat("job_type", F.lit('"<'), F.lit("&")), F.concat(F.lit('{ "v" : '), F.col("k").cast("string"), F.lit(',\n "t": "a  <b>" }')), files, schedules.spec_policy(policy), F.expr("if(k % 6 = 0, '{\"m\":1}', '')"))
    failure = schedules.spec_failure(F.expr("k % 2 * 50"), F.expr("k % 3"), F.lit(0))
    return t.fx_jobs.select("tenant_id", "job_id", schedules.spec_hash(trigger, target, F.expr("if(k % 2 = 0, '', 'serial')"), failure).alias("spec_hash"))


BUILT = {"q_cron_horizon": horizon, "q_cron_never": never, "q_successor_chain": chained, "q_list_meta_numbers": numbers, "q_spec_hash": hashed}

CHAIN = f"""c AS (
  SELECT tenant_id, schedule_id, generation, CAST(0 AS BIGINT) AS step, scheduled_at, CAST(NULL AS TIMESTAMP) AS previous_at, scheduled_at + to_seconds(delay_s) AS leased_at, '' AS bits, duration_s, success FROM fx_chain_runs WHERE step = 0
  UNION ALL
  SELECT tenant_id, schedule_id, generation, step, due, before, greatest(due, free_at) + to_seconds(delay_s), own, duration_s, success FROM (
    SELECT c.tenant_id, c.schedule_id, c.generation, r.step, greatest(c.leased_at + INTERVAL '90' MINUTE, TIMESTAMP '2024-01-03') AS due, c.scheduled_at AS before, c.leased_at + to_seconds(c.duration_s) AS free_at, r.delay_s, c.bits AS bits,
      right(c.bits || CASE WHEN c.success THEN '1' ELSE '0' END, {WINDOW}) AS own, r.duration_s, r.success FROM c JOIN fx_chain_runs r ON r.tenant_id = c.tenant_id AND r.schedule_id = c.schedule_id AND r.step = c.step + 1) x
  WHERE (generation = 1 OR due <= TIMESTAMP '2024-01-05') AND NOT {calendar.violated_sql("bits", MAX_SEQUENTIAL, MIN_PERCENT)})"""


def sql() -> dict[str, str]:
    runs = ("fx_runs",)
    job = "'jobdbsched_' || schedule_id || '_g' || generation || '_run_' || strftime({0}, '%Y%m%dT%H%M%S%f') || '000Z'"
    leap = "days AS (SELECT unnest([TIMESTAMP '2024-02-29 12:00:00', TIMESTAMP '2028-02-29 12:00:00', TIMESTAMP '2032-02-29 12:00:00']) AS m)"
    ranks = ", ".join(f"({k}, '{v}')" for k, v in enumerate(["1000", "1000", "1000", "9007199254740992", "0.1", "1e-7", '"a\\u003cb"', "1.5e+300"]))
    return {
        "q_cron_horizon": with_(runs, leap, """r AS (SELECT event_id, date_trunc('minute', scheduled_at) + INTERVAL '1' MINUTE AS a, CASE WHEN event_id % 3 = 0 THEN scheduled_at + to_days(CAST(event_id % 1500 AS INT)) END AS s,
CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2028-02-29 12:00:00' - to_seconds(event_id % 2) END AS e FROM fx_runs), q AS (SELECT event_id, CASE WHEN a < s THEN date_trunc('minute', s) ELSE a END AS a, e FROM r)""")
        + "SELECT event_id, CASE WHEN min(m) <= coalesce(any_value(e), min(m)) THEN min(m) END AS next_fire, false AS exhausted FROM q LEFT JOIN days ON m >= a GROUP BY event_id",
        "q_cron_never": with_(runs) + "SELECT event_id, CAST(NULL AS TIMESTAMP) AS next_fire, event_id % 2 = 1 AS exhausted FROM fx_runs",
        "q_successor_chain": with_(("fx_chain_runs",), CHAIN) + f"""SELECT tenant_id, schedule_id, step, {job.format("scheduled_at")} AS job_id, scheduled_at, leased_at, CASE WHEN previous_at IS NOT NULL THEN {job.format("previous_at")} END AS waits_for, bits,
CASE WHEN {calendar.violated_sql("bits", MAX_SEQUENTIAL, MIN_PERCENT)} THEN 'failure_policy' END AS cancelled FROM c""",
        "q_list_meta_numbers": with_(("fx_jobs", "fx_wait"), STATUS, f"ranks(r, rank) AS (VALUES {ranks})") + f"SELECT tenant_id, job_id, created_at, rank FROM st JOIN ranks ON k % 10 = r WHERE tenant_id IN {ALL} ORDER BY created_at DESC, tenant_id || '/' || job_id DESC LIMIT 200",
        "q_spec_hash": with_(("fx_jobs",)) + r"""SELECT tenant_id, job_id, 'sha256:' || sha256('{"trigger":{"kind":"' || CASE WHEN k % 2 = 0 THEN 'cron","expression":"0 0 * * *"' ELSE 'interval"' END || CASE WHEN k % 4 = 0 THEN ',"timezone":"Europe/Berlin"' ELSE '' END
|| CASE WHEN k % 3 = 0 THEN ',"endAt":"2030-01-01T00:00:00Z"' ELSE '' END || CASE WHEN k % 2 = 1 THEN ',"interval":' || k || '000000000' ELSE '' END || '},"target":{"jobType":"' || job_type || '\"\u003c\u0026","data":{"v":' || k || ',"t":"a  \u003cb\u003e"}'
|| CASE WHEN k % 7 = 0 THEN ',"artifacts":[{"name":"a"},{"name":"b","sha256":"y"' || CASE WHEN k > 0 THEN ',"size":' || k ELSE '' END || '}]' ELSE '' END
|| ',"runPolicy":{"Retry":{"InitialInterval":' || CASE WHEN k % 3 = 0 THEN '0,"BackoffCoefficient":0' ELSE '100000000,"BackoffCoefficient":2.5' END || ',"MaximumInterval":0,"MaximumAttempts":' || k % 4 || ',"NonRetryableErrorTypes":' || CASE WHEN k % 3 = 0 THEN 'null' ELSE '["A"]' END
|| '},"InvocationTimeout":null,"TotalTimeout":' || CASE WHEN k % 5 = 0 THEN '60000000000' ELSE 'null' END || '}' || CASE WHEN k % 6 = 0 THEN ',"metadata":{"m":1}' ELSE '' END || '},"overlapPolicy":"serial","failurePolicy":{'
|| concat_ws(',', CASE WHEN k % 2 = 1 THEN '"minSuccessPercent":50' END, CASE WHEN k % 3 > 0 THEN '"windowSize":' || k % 3 END) || '}}') AS spec_hash FROM fx_jobs""",
    }
