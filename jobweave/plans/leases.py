"""Queries of lease transitions and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.plans.oracle import with_
from jobweave.sources import blobs
from jobweave.sources.fixtures import projected
from jobweave.streaming import leases

NEED, DELAY = "high", 5


def streamed(t) -> DataFrame:
    """The table that the stream over the events files leaves."""
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet")
    placed = t.fx_lease_log  # numbers of commands are counted over the table; the stream joins them
    rows = source.select("event_id").join(placed, "event_id")
    return leases.run(rows, f"{blobs.shared_folder(t.spark)}/leases_{uuid.uuid4().hex}", NEED, f"{DELAY} seconds")


def batch(t) -> DataFrame:
    rows = leases.commands(t.fx_lease_log)
    return leases.fold(rows, NEED, rows.agg(F.max("at")).first()[0] - DELAY)


STATE = ["job", *(f for f in leases.FIELDS if f != "reported")]
EXPIRED = ["job", "lease_id", "worker", "until", "latest_ordinal"]
REFUSED = ["job", "event_id", "command", "asked_ordinal", "result", "latest_ordinal"]


BUILT = {
    "q_lease_states": lambda t: leases.states(batch(t)).select(*STATE), "q_lease_stream": lambda t: leases.states(streamed(t)).select(*STATE),
    "q_lease_expired": lambda t: streamed(t).where("kind = 'expired'").select(*EXPIRED), "q_lease_refused": lambda t: streamed(t).where("kind = 'refused'").select(*REFUSED),
}

FOLD = """l AS (SELECT *, epoch(ts) AS sec, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n FROM fx_lease_log),
f AS (
  SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, 'high' AS need, CAST(NULL AS DOUBLE) AS available_at, CAST(NULL AS VARCHAR) AS lease_id, CAST(NULL AS VARCHAR) AS worker, CAST(NULL AS DOUBLE) AS until, CAST(NULL AS VARCHAR) AS alternate_need,
    CAST(NULL AS DOUBLE) AS alternate_at, CAST(-1 AS BIGINT) AS latest_ordinal, CAST(MAP {} AS MAP(BIGINT, VARCHAR)) AS chapters, CAST(NULL AS DOUBLE) AS archived_at, CAST(NULL AS VARCHAR) AS completion, false AS cancelled,
    CAST(NULL AS DOUBLE) AS last_at, CAST(0 AS BIGINT) AS n_refused, '' AS result, CAST(NULL AS BIGINT) AS event_id, '' AS command, CAST(NULL AS BIGINT) AS asked_ordinal, false AS lapsed
  FROM l
  UNION ALL
  SELECT job, n, CASE WHEN ok AND command IN ('lease', 'reschedule') THEN c_need ELSE need END, CASE WHEN ok AND command = 'reschedule' THEN coalesce(wait_until, sec) ELSE available_at END,
    CASE WHEN ok AND command = 'lease' THEN c_lease WHEN ok AND command IN ('cancel', 'reschedule', 'complete') THEN NULL ELSE lease_id END,
    CASE WHEN ok AND command = 'lease' THEN c_worker WHEN ok AND command IN ('cancel', 'reschedule', 'complete') THEN NULL ELSE worker END,
    CASE WHEN ok AND command IN ('lease', 'keepalive') THEN sec + coalesce(seconds, 30) WHEN ok AND command IN ('cancel', 'reschedule', 'complete') THEN NULL ELSE until END,
    CASE WHEN ok AND (command = 'complete' OR command = 'lease' AND fired) THEN NULL WHEN ok AND command = 'reschedule' THEN c_alternate ELSE alternate_need END,
    CASE WHEN ok AND (command = 'complete' OR command = 'lease' AND fired) THEN NULL WHEN ok AND command = 'reschedule' THEN CASE WHEN c_alternate IS NOT NULL THEN sec + coalesce(alternate_after, 0) END ELSE alternate_at END,
    CASE WHEN ok AND command IN ('append', 'complete') THEN greatest(latest_ordinal, target) ELSE latest_ordinal END,
    CASE WHEN ok AND command IN ('append', 'complete') AND target > latest_ordinal THEN map_concat(chapters, map([target], [digest])) ELSE chapters END,
    CASE WHEN ok AND command IN ('cancel', 'complete') THEN coalesce(archived_at, sec) ELSE archived_at END,
    CASE WHEN ok AND command = 'cancel' THEN coalesce(completion, 'cancelled') WHEN ok AND command = 'complete' THEN outcome ELSE completion END,
    CASE WHEN ok AND (command = 'cancel' OR command = 'complete' AND outcome = 'cancelled') THEN true ELSE cancelled END, sec, n_refused + CASE WHEN ok THEN 0 ELSE 1 END, r, event_id, command, ordinal, ran_out
  FROM (SELECT *, r = 'ok' AS ok FROM (SELECT *, CASE WHEN command = 'cancel' THEN 'ok'
      WHEN command = 'lease' THEN CASE WHEN archived_at IS NOT NULL OR cancelled THEN 'archived' WHEN CASE WHEN fired THEN alternate_need ELSE need END <> c_need THEN 'other_need' WHEN lease_id IS NOT NULL AND until > sec THEN 'held' WHEN available_at > sec THEN 'waiting' ELSE 'ok' END
      WHEN command = 'reschedule' AND (coalesce(c_need, '') = '' OR coalesce(alternate_after, 0) < 0 OR c_alternate IS NULL AND coalesce(alternate_after, 0) > 0) THEN 'invalid'
      WHEN archived_at IS NOT NULL OR lease_id IS NULL OR lease_id <> c_lease OR until <= sec OR command <> 'append' AND worker <> c_worker THEN 'lease_lost'
      WHEN command IN ('keepalive', 'reschedule') THEN 'ok' WHEN target <= latest_ordinal THEN CASE WHEN command = 'complete' AND chapters[target] = digest THEN 'ok' ELSE 'chapter_exists' END
      WHEN target <> latest_ordinal + 1 THEN 'not_appendable' ELSE 'ok' END AS r
    FROM (SELECT l.job, l.n, l.sec, l.event_id, l.command, l.lease_id AS c_lease, l.worker AS c_worker, l.need AS c_need, l.seconds, l.ordinal, l.digest, l.wait_until, nullif(l.alternate_need, '') AS c_alternate, l.alternate_after, l.outcome,
        f.need, f.available_at, f.lease_id, f.worker, f.until, f.alternate_need, f.alternate_at, f.latest_ordinal, f.chapters, f.archived_at, f.completion, f.cancelled, f.last_at, f.n_refused,
        coalesce(f.alternate_at <= l.sec, false) AS fired, CASE WHEN coalesce(l.ordinal, -1) < 0 THEN f.latest_ordinal + 1 ELSE l.ordinal END AS target, f.archived_at IS NULL AND f.lease_id IS NOT NULL AND f.until <= l.sec AS ran_out
      FROM f JOIN l ON l.job = f.job AND l.n = f.n + 1) x) y) z),
ends AS (SELECT job, max(n) AS n FROM l GROUP BY job)"""


def sql() -> dict[str, str]:
    fold = with_(("fx_lease_log",), FOLD)
    state = fold + f"SELECT {', '.join('n AS n_commands' if c == 'n_commands' else c for c in STATE)} FROM f JOIN ends USING (job, n)"
    return {
        "q_lease_states": state, "q_lease_stream": state,
        "q_lease_expired": fold + f"""SELECT DISTINCT p.job, p.lease_id, p.worker, p.until, p.latest_ordinal FROM f p LEFT JOIN f x ON x.job = p.job AND x.n = p.n + 1
WHERE p.archived_at IS NULL AND p.lease_id IS NOT NULL AND (x.lapsed OR x.n IS NULL AND p.until <= (SELECT max(sec) FROM l) - {DELAY})""",
        "q_lease_refused": fold + "SELECT job, event_id, command, asked_ordinal, result, latest_ordinal FROM f WHERE n > 0 AND result <> 'ok'",
    }
