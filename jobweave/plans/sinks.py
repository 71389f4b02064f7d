"""Queries that write tables in batches and read them back, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.plans.oracle import with_
from jobweave.sources import blobs, tables


def twice(t, rows: DataFrame, keys: list[str], changed: str, by: str) -> DataFrame:
    """Every second row as one batch, then all rows, some of them changed, as another, and that one again."""
    folder = f"{blobs.shared_folder(t.spark)}/table_{uuid.uuid4().hex}"
    again = rows.withColumn(changed, F.expr(by))
    tables.insert(rows.where("n % 2 = 0"), folder, "first", keys, ["n"])
    tables.insert(again, folder, "second", keys, ["n"])
    refused = tables.insert(again, folder, "second", keys, ["n"])
    held = tables.read(t.spark, folder, rows.schema)
    return held.withColumn("state", F.lit("stored")).unionByName(refused.withColumn("state", F.lit("conflict"))).select(*keys, changed, "state")


def jobs(t) -> DataFrame:
    rows = t.fx_jobs.select("tenant_id", "job_id", "job_type", "created_at", F.col("k").alias("n"))
    return twice(t, rows, ["tenant_id", "job_id"], "job_type", "if(n % 5 = 0, 'other', job_type)")


def chapters(t) -> DataFrame:
    rows = t.fx_bodies.select("tenant_id", "job_id", "ordinal", "data", F.expr("cast(substr(job_id, 5) as bigint) + ordinal").alias("n"))
    return twice(t, rows, ["tenant_id", "job_id", "ordinal"], "data", "if(n % 5 = 0, 'x' || data, data)")


def schedules(t) -> DataFrame:
    """Each schedule is asked for by all its runs, of which the first counts."""
    rows = t.fx_runs.select("tenant_id", "schedule_id", "scheduled_at", F.col("event_id").alias("n"))
    return twice(t, rows, ["tenant_id", "schedule_id"], "scheduled_at", "if(n % 5 = 0, scheduled_at + interval 1 hour, scheduled_at)")


BUILT = {"q_sink_jobs": jobs, "q_sink_chapters": chapters, "q_sink_schedules": schedules}


def sql() -> dict[str, str]:
    def twice(source: str, keys: str, changed: str, by: str) -> str:
        return f"""a AS ({source}), b AS (SELECT * REPLACE ({by} AS {changed}) FROM a), one AS (SELECT * FROM a WHERE n % 2 = 0 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n) = 1),
two AS (SELECT * FROM b WHERE ({keys}) NOT IN (SELECT ({keys}) FROM one) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n) = 1), held AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""

    def query(names: tuple[str, ...], source: str, keys: list[str], changed: str, by: str) -> str:
        k, same = ", ".join(keys), " AND ".join(f"b.{c} = h.{c}" for c in keys)
        return with_(names, twice(source, k, changed, by)) + f"SELECT {k}, {changed}, 'stored' AS state FROM held UNION ALL SELECT {', '.join('b.' + c for c in keys)}, b.{changed}, 'conflict' FROM b JOIN held h ON {same} WHERE b.{changed} <> h.{changed} OR b.n <> h.n"

    return {
        "q_sink_jobs": query(("fx_jobs",), "SELECT tenant_id, job_id, job_type, created_at, k AS n FROM fx_jobs", ["tenant_id", "job_id"], "job_type", "CASE WHEN n % 5 = 0 THEN 'other' ELSE job_type END"),
        "q_sink_chapters": query(("fx_bodies",), "SELECT tenant_id, job_id, ordinal, data, CAST(substr(job_id, 5) AS BIGINT) + ordinal AS n FROM fx_bodies", ["tenant_id", "job_id", "ordinal"], "data", "CASE WHEN n % 5 = 0 THEN 'x' || data ELSE data END"),
        "q_sink_schedules": query(("fx_runs",), "SELECT tenant_id, schedule_id, scheduled_at, event_id AS n FROM fx_runs", ["tenant_id", "schedule_id"], "scheduled_at", "CASE WHEN n % 5 = 0 THEN scheduled_at + INTERVAL '1' HOUR ELSE scheduled_at END"),
    }
