"""Queries of single operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions import expr
from jobweave.operators import listing, payloads, quality, schedules
from jobweave.operators.listing import Filter, ListRequest
from jobweave.plans.oracle import ALL, STATUS, with_
from jobweave.sources.fixtures import NOW

JOB = ["tenant_id", "job_id"]
TENANTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def cancel_reasons(t) -> DataFrame:
    detail = F.expr("""case k % 5 when 0 then '{"reason":"r' || k || '","code":1}' when 1 then '{"code":"x"}' when 2 then 'not json' when 3 then '{"reason":""}' end""")
    return t.fx_jobs.select(*JOB, payloads.cancel_reason(detail).alias("reason"))


def filtered(t) -> DataFrame:
    """Jobs that a filter names, by the filter and by its predicates and back."""
    made = Filter.equal("rank", 1).or_(Filter.equal("rank", 3.0)).and_(Filter.equal("team", "t1").or_(Filter.equal("team", "t3")))
    back = Filter.of({(field,): values for field, values in made.predicates()})
    return t.fx_jobs.select(*JOB, made.column().alias("by_filter"), back.column().alias("by_predicates"), Filter().column().alias("by_none"))


def requests(t) -> DataFrame:
    """Schedule requests that get this or that wrong, some several things."""
    col = F.expr
    said = schedules.request_error(
        col("if(k % 13 = 0, '', job_type)"), col("if(k % 11 = 0, null, '{}')"), col("case k % 7 when 0 then 'cron' when 1 then 'never' when 2 then null else 'interval' end"), col("if(k % 2 = 0, ' ', '* * * * *')"), col("k % 6"),
        col("case k % 5 when 0 then 'serial' when 1 then 'parallel' end"), col("if(k % 17 = 0, -1, 8)"), col("k % 103"), col("if(k % 19 = 0, -1, null)"),
    )
    return t.fx_jobs.select(*JOB, said.alias("error"))


def previous(t) -> DataFrame:
    """Jobs as occurrences after the job numbered one less; some have none before, some one that isn't there."""
    rows = t.fx_jobs.select("tenant_id", "job_id", F.expr("case when k % 4 = 0 then null when k % 9 = 1 then 'job-none' else 'job-' || lpad(cast(k - 1 as string), 9, '0') end").alias("previous_job_id"))
    return schedules.with_previous(rows, t.fx_jobs).select(*JOB, "previous_job_id", "previous_success")


def pages(t) -> DataFrame:
    """Three pages of archived and of waiting jobs, with the tokens that lead from one to the next."""
    out = []
    for name, request in (("archived", ListRequest(tenants=TENANTS, stores=["ARCHIVED"], page_size=150)), ("future", ListRequest(tenants=TENANTS, statuses=["AWAITING_FUTURE"], page_size=20))):
        token = None
        for page in range(3):
            rows, token = listing.list_page(t.fx_jobs, t.fx_wait, NOW, ListRequest(**{**request.__dict__, "token": token}))
            out.append((name, page, len(rows), rows[0]["job_id"] if rows else None, rows[-1]["job_id"] if rows else None, token))
            if token is None:
                break
    return t.spark.createDataFrame(out, "request string, page int, n_rows int, first_job string, last_job string, next_token string")


def retries(t) -> DataFrame:
    flag = payloads.field(F.col("data"), "retryable").cast("boolean")
    again = expr.retryable_under(F.col("payload_kind"), flag, F.expr("ordinal % 5 = 0"), F.expr("case ordinal % 3 when 0 then array('A', 'B') when 1 then array('C') end"), F.array(F.lit("A"), F.lit("D")))
    return t.fx_bodies.select(*JOB, "ordinal", again.alias("again"))


def keys(t) -> DataFrame:
    text = F.expr("case k % 6 when 0 then tenant_id || '/' || job_id when 1 then job_id when 2 then '/' || job_id when 3 then tenant_id || '/' when 4 then tenant_id || '/x/' || job_id else tenant_id || '/' || job_id end")
    return t.fx_jobs.select(*JOB, expr.job_key().alias("job_key"), expr.key_parts(text).alias("p")).select(*JOB, "job_key", F.col("p.tenant_id").alias("key_tenant"), F.col("p.job_id").alias("key_job"))


def instants(t) -> DataFrame:
    """Times to nanoseconds, with some more of these, and back."""
    ns = expr.ns_of_time(F.col("ts")) + F.col("event_id") % 1000
    return t.events.select("event_id", ns.alias("ns"), expr.time_of_ns(ns).alias("back"))


def found(t) -> DataFrame:
    """Point reads of every second job, under its own tenant and under another."""
    asked = t.fx_jobs.where("k % 2 = 0").select(F.expr("if(k % 6 = 0, 'NOBODY', tenant_id)").alias("tenant_id"), "job_id")
    return listing.point_reads(asked, t.fx_jobs).select(*JOB, "found", "job_type", "created_at")


def envelopes(t) -> DataFrame:
    """Stored metadata of applications' metadata in any spelling, with the runtime's own."""
    app = F.expr("""case k % 4 when 0 then '{ "b" : [1, 2], "a": "<x>" }' when 1 then '  ' when 2 then '{"n": null}' end""")
    schedule = F.expr("case when k % 5 = 0 then '{\"scheduleId\":\"s' || k || '\"}' end")
    return t.fx_jobs.select(*JOB, expr.metadata_envelope(app, schedule, F.expr("if(k % 3 = 0, 'sha256:x', '')"), F.expr("coalesce(parent_job_id, '')")).alias("metadata"))


def unstarted(t) -> DataFrame:
    """Jobs by id, less those whose second chapter is there, rows of one kind taken off one for one."""
    begun = t.fx_chapters.where("ordinal = 1").select(*JOB)
    twice = t.fx_jobs.select(*JOB).unionByName(t.fx_jobs.where("k % 3 = 0").select(*JOB))
    return twice.exceptAll(begun)


def broken(t) -> DataFrame:
    """Histories that lack a chapter, have one twice, or begin late."""
    rows = t.fx_chapters.where("not (job_id like '%3' and ordinal = 2) and not (job_id like '%8' and ordinal = 0)")
    return quality.broken_histories(rows.unionByName(t.fx_chapters.where("job_id like '%5' and ordinal = 1")))


def links(t) -> DataFrame:
    """Stories of which some are forked from themselves, before the first chapter, or beyond the latest."""
    rows = t.fx_stories.withColumn("base_story_id", F.expr("if(story_id % 11 = 3, story_id, base_story_id)")).withColumn("fork_ordinal", F.expr("case when story_id % 7 = 2 then -1 when story_id % 7 = 3 then 99 when story_id % 11 = 3 then 0 else fork_ordinal end"))
    return quality.bad_links(rows).select("story_id")


def shared_leases(t) -> DataFrame:
    rows = t.fx_jobs.withColumn("lease_id", F.expr("case when lease_id is not null then 'lease-' || (k - k % 8) end"))
    return quality.double_leases(rows).select(*JOB)


BUILT = {
    "q_cancel_reason": cancel_reasons, "q_filter_algebra": filtered, "q_schedule_request": requests, "q_previous_success": previous, "q_page_tokens": pages, "q_retry_under_policy": retries,
    "q_job_keys": keys, "q_instants": instants, "q_point_reads": found, "q_metadata_envelope": envelopes, "q_unstarted": unstarted,
    "q_quality_ordinals": broken, "q_quality_links": links, "q_quality_leases": shared_leases,
}


def sql() -> dict[str, str]:
    jobs, J = with_(("fx_jobs",)), "tenant_id, job_id"
    token = "replace(replace(rtrim(to_base64(encode('{\"created_at\":\"' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '\",\"tenant\":\"' || tenant_id || '\",\"job\":\"' || job_id || '\"}')), '='), '+', '-'), '/', '_')"
    return {
        "q_cancel_reason": jobs + f"SELECT {J}, CASE WHEN k % 5 = 0 THEN 'r' || k ELSE '' END AS reason FROM fx_jobs",
        "q_filter_algebra": jobs + f"SELECT {J}, k % 10 IN (1, 3) AND k % 4 IN (1, 3) AS by_filter, k % 10 IN (1, 3) AND k % 4 IN (1, 3) AS by_predicates, true AS by_none FROM fx_jobs",
        "q_schedule_request": jobs + f"""SELECT {J}, CASE WHEN k % 13 = 0 THEN 'JOB_TYPE_REQUIRED' WHEN k % 11 = 0 THEN 'DATA_REQUIRED' WHEN k % 5 = 1 THEN 'OVERLAP_POLICY' WHEN k % 7 = 0 AND k % 2 = 0 THEN 'CRON_REQUIRED'
WHEN k % 7 > 2 AND k % 6 = 0 THEN 'INTERVAL_REQUIRED' WHEN k % 7 IN (1, 2) THEN 'TRIGGER_KIND' WHEN k % 17 = 0 OR k % 103 > 100 OR k % 19 = 0 THEN 'FAILURE_POLICY' ELSE '' END AS error FROM fx_jobs""",
        "q_previous_success": jobs + """SELECT a.tenant_id, a.job_id, a.p AS previous_job_id, CASE WHEN a.p IS NOT NULL THEN coalesce(b.archived_at IS NOT NULL AND b.completion_status = 'success', false) END AS previous_success
FROM (SELECT *, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 9 = 1 THEN 'job-none' ELSE 'job-' || lpad(CAST(k - 1 AS VARCHAR), 9, '0') END AS p FROM fx_jobs) a LEFT JOIN fx_jobs b ON a.tenant_id = b.tenant_id AND a.p = b.job_id""",
        "q_page_tokens": with_(("fx_jobs", "fx_wait"), STATUS, f"""asked AS (SELECT *, CASE WHEN archived_at IS NOT NULL THEN 'archived' ELSE 'future' END AS request, CASE WHEN archived_at IS NOT NULL THEN 150 ELSE 20 END AS size FROM st WHERE tenant_id IN {ALL} AND (archived_at IS NOT NULL OR status = 'AWAITING_FUTURE')),
r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY created_at DESC, tenant_id || '/' || job_id DESC) AS n, count(*) OVER (PARTITION BY request) AS total FROM asked), p AS (SELECT *, (n - 1) // size AS page FROM r WHERE n <= 3 * size)""")
        + f"SELECT request, CAST(page AS INTEGER) AS page, CAST(count(*) AS INTEGER) AS n_rows, arg_min(job_id, n) AS first_job, arg_max(job_id, n) AS last_job, nullif(arg_max(CASE WHEN n < total AND n % size = 0 THEN {token} ELSE '' END, n), '') AS next_token FROM p GROUP BY request, page",
        "q_retry_under_policy": with_(("fx_bodies",)) + f"""SELECT {J}, ordinal, CASE WHEN payload_kind = 'Timeout' THEN coalesce(CAST(json_extract_string(data, '$.retryable') AS BOOLEAN), false)
ELSE payload_kind <> 'App' AND ordinal % 5 <> 0 AND ordinal % 3 <> 0 END AS again FROM fx_bodies""",
        "q_job_keys": jobs + f"SELECT {J}, tenant_id || '/' || job_id AS job_key, CASE WHEN k % 6 IN (0, 5) THEN tenant_id END AS key_tenant, CASE WHEN k % 6 IN (0, 5) THEN job_id END AS key_job FROM fx_jobs",
        "q_instants": "SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS ns, CAST(ts AS TIMESTAMP) AS back FROM events",
        "q_point_reads": jobs + """SELECT CASE WHEN k % 6 = 0 THEN 'NOBODY' ELSE tenant_id END AS tenant_id, job_id, k % 6 <> 0 AS found, CASE WHEN k % 6 <> 0 THEN job_type END AS job_type, CASE WHEN k % 6 <> 0 THEN created_at END AS created_at FROM fx_jobs WHERE k % 2 = 0""",
        "q_metadata_envelope": jobs + rf"""SELECT {J}, CASE WHEN app <> '' OR own <> '' THEN '{{' || concat_ws(',', nullif(app, ''), CASE WHEN own <> '' THEN '"internal":{{' || own || '}}' END) || '}}' END AS metadata FROM (
SELECT *, CASE k % 4 WHEN 0 THEN '"app":{{"a":"\u003cx\u003e","b":[1,2]}}' WHEN 2 THEN '"app":{{"n":null}}' ELSE '' END AS app,
concat_ws(',', CASE WHEN k % 5 = 0 THEN '"schedule":{{"scheduleId":"s' || k || '"}}' END, CASE WHEN k % 3 = 0 THEN '"schemaHash":"sha256:x"' END, CASE WHEN parent_job_id IS NOT NULL THEN '"parentJobId":"' || parent_job_id || '"' END) AS own FROM fx_jobs) x""",
        "q_unstarted": with_(("fx_jobs", "fx_chapters")) + f"(SELECT {J} FROM fx_jobs UNION ALL SELECT {J} FROM fx_jobs WHERE k % 3 = 0) EXCEPT ALL SELECT {J} FROM fx_chapters WHERE ordinal = 1",
        "q_quality_ordinals": with_(("fx_chapters",), "c AS (SELECT * FROM fx_chapters WHERE NOT (job_id LIKE '%3' AND ordinal = 2) AND NOT (job_id LIKE '%8' AND ordinal = 0) UNION ALL SELECT * FROM fx_chapters WHERE job_id LIKE '%5' AND ordinal = 1)")
        + f"SELECT {J}, count(*) AS n, count(DISTINCT ordinal) AS d, min(ordinal) AS lo, max(ordinal) AS hi FROM c GROUP BY 1, 2 HAVING count(*) <> count(DISTINCT ordinal) OR min(ordinal) <> 0 OR max(ordinal) <> count(*) - 1",
        "q_quality_links": with_(("fx_stories",), "s AS (SELECT story_id, own_latest, CASE WHEN story_id % 11 = 3 THEN story_id ELSE base_story_id END AS base, CASE WHEN story_id % 7 = 2 THEN -1 WHEN story_id % 7 = 3 THEN 99 WHEN story_id % 11 = 3 THEN 0 ELSE fork_ordinal END AS fork FROM fx_stories)")
        + "SELECT s.story_id FROM s JOIN s b ON s.base = b.story_id WHERE s.base = s.story_id OR s.fork < 0 OR s.fork > b.own_latest",
        "q_quality_leases": jobs + f"SELECT {J} FROM fx_jobs WHERE lease_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k - k % 8) > 1",
    }
