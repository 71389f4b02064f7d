"""Requests against jobs, worked out for whole tables of requests: submit, restart, children, leases, waits, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions import expr, jsontext
from jobweave.operators.history import JOB


def first_true(*tests: tuple[str, Column], otherwise: str = "OK") -> Column:
    """The name of the first test that holds; one that is null doesn't."""
    out = F.lit(otherwise)
    for name, test in reversed(tests):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def submit(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds result to requests (tenant_id, job_id, job_type, input_hash, metadata, wait_for, seq).

    NEW creates the job, SAME is one that exists just so, and otherwise the first thing that differs from the job that
    exists: JOB_TYPE, INPUT, METADATA or PREREQUISITES. Of requests for one id the one of the least seq comes first, and
    the rest meet what it made. Metadata is compared as JSON, and only if the job has some.
    """
    parts = ["job_type", "input_hash", "metadata", "wait_for"]
    held = existing.select(*JOB, F.struct(*parts).alias("_held"))
    first = Window.partitionBy(*JOB).orderBy("seq")
    rows = requests.withColumn("_first", F.first(F.struct("seq", *parts)).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(held, JOB, "left")  # in the order that the window has made
    old = F.coalesce("_held", F.when(F.col("seq") > F.col("_first.seq"), F.struct(*(F.col(f"_first.{p}") for p in parts))))
    rows = rows.withColumn("_old", old)
    differs = lambda p: ~F.col(p).eqNullSafe(F.col(f"_old.{p}"))
    listed = lambda x: F.array_distinct(F.coalesce(x, F.array().cast("array<string>")))
    rows = rows.withColumn("_a", jsontext.canonical("metadata")).withColumn("_b", jsontext.canonical(F.col("_old.metadata")))
    result = first_true(
        ("NEW", F.col("_old").isNull()), ("JOB_TYPE", differs("job_type")), ("INPUT", differs("input_hash")),
        ("METADATA", (F.trim(F.coalesce("_old.metadata", F.lit(""))) != "") & ~F.col("_a").eqNullSafe(F.col("_b"))),
        ("PREREQUISITES", listed(F.col("wait_for")) != listed(F.col("_old.wait_for"))), otherwise="SAME",
    )
    return rows.withColumn("result", result).select(*requests.columns, "result")


def restart(requests: DataFrame, chapters: DataFrame) -> DataFrame:
    """What restarting jobs gives, for requests (tenant_id, prior_job_id, job_id, last_step).

    The history up to last_step is kept by forking it there. The chapter after must exist and begin its task, since a cut
    into a chain of retries is refused. job_type comes from the start chapter, next_ordinal is the new job's next one.
    """
    at = lambda name, columns: chapters.select("tenant_id", F.col("job_id").alias("prior_job_id"), F.col("ordinal").alias(name), *columns)
    start = at("_zero", [F.col("task_type").alias("_type")]).where("_zero = 0").drop("_zero")
    after = at("_next", [F.when(F.coalesce("attempt", F.lit(0)) == 0, 1).otherwise(F.col("attempt")).alias("_attempt")])
    rows = requests.withColumn("_next", F.col("last_step") + 1).join(start, ["tenant_id", "prior_job_id"], "left").join(after, ["tenant_id", "prior_job_id", "_next"], "left")
    result = first_true(
        ("NEGATIVE_STEP", F.col("last_step") < 0), ("NO_SOURCE", F.col("_type").isNull()), ("NO_NEXT_CHAPTER", F.col("_attempt").isNull()),
        ("CUTS_RETRIES", F.col("_attempt") > 1),
    )
    ok = F.col("result") == "OK"
    rows = rows.withColumn("result", result)
    return rows.select(*requests.columns, "result", F.when(ok, F.col("_type")).alias("job_type"), F.when(ok, F.col("last_step")).alias("fork_ordinal"), F.when(ok, F.col("_next")).alias("next_ordinal"))


def has_lease(now: str, lease: str = "asked_lease") -> Column:
    """Whether the lease that a request names is the job's and lives."""
    return F.col("archived_at").isNull() & (F.coalesce("lease_id", F.lit("")) != "") & F.col("lease_id").eqNullSafe(F.col(lease)) & (F.col("lease_expires_at") > expr.at(now))


def child_submits(requests: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """Children that parents under lease submit (tenant_id, parent_job_id, asked_lease, child_id, asked_tenant).

    The child gets the parent's tenant, whatever was asked for; without a live lease the request is refused.
    """
    held = jobs.select("tenant_id", F.col("job_id").alias("parent_job_id"), "archived_at", "lease_id", "lease_expires_at", F.lit(True).alias("_here"))
    rows = requests.join(held, ["tenant_id", "parent_job_id"], "left")
    result = first_true(("NOT_FOUND", F.col("_here").isNull()), ("LEASE_LOST", ~F.coalesce(has_lease(now), F.lit(False))))
    return rows.select("tenant_id", "parent_job_id", "child_id", result.alias("result"))


def job_leases(requests: DataFrame, jobs: DataFrame, now: str, seconds: int = 30) -> DataFrame:
    """Leases that asking for given jobs gets (requests: tenant_id, job_id, capabilities); jobs need status.

    Only ready jobs and those whose lease has lapsed give one, and only to a worker that has what they need next.
    """
    rows = requests.join(jobs.select(*JOB, "status", expr.effective_need(now).alias("need")), JOB, "left")
    result = first_true(
        ("NOT_FOUND", F.col("status").isNull()), ("NOT_LEASEABLE", ~F.col("status").isin("READY", "CRASH_CONCERN")),
        ("NO_CAPABILITY", ~F.array_contains("capabilities", F.col("need"))), otherwise="LEASED",
    )
    rows = rows.withColumn("result", result)
    until = expr.at(now) + F.expr(f"interval {seconds} seconds")
    return rows.select(*JOB, "result", F.when(F.col("result") == "LEASED", F.col("need")).alias("need"), F.when(F.col("result") == "LEASED", until).alias("expires_at"))


def classify(jobs: DataFrame, outputs: DataFrame, supported: list[str]) -> DataFrame:
    """How a run without a lease ends for each job (with status): COMPLETED, FAILED, SUSPENDED or NOT_LEASEABLE.

    A job suspends if it waits for jobs or a time, or needs what is not supported (`missing`). A completed job whose
    output is an error has failed.
    """
    done = F.col("status").isin("COMPLETED", "CANCELLED")
    missing = F.when(~done & ~F.col("next_need").isin(supported), F.col("next_need"))
    result = (
        F.when(F.col("status") == "CANCELLED", "FAILED").when((F.col("status") == "COMPLETED") & (F.col("state") == "OK"), "COMPLETED").when(F.col("status") == "COMPLETED", "FAILED")
        .when(F.col("status").isin("PENDING_JOBS", "AWAITING_FUTURE") | missing.isNotNull(), "SUSPENDED").otherwise("NOT_LEASEABLE")
    )
    return jobs.join(outputs.select(*JOB, "state"), JOB, "left").select(*JOB, result.alias("result"), missing.alias("missing"))


def complete_tasks(requests: DataFrame, jobs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Results for tasks that jobs wait for (requests: tenant_id, job_id, capability, resume, in_ordinal, in_hash, out_ordinal).

    Jobs carry what they wait with: wait_in, wait_out, wait_next and wait_hash, all null when they wait for nothing. What a
    request leaves empty (or 0) is not compared. The first guard that fails names the conflict; a job that passes resumes
    at resume_need, and the output becomes chapter out_ordinal, which must be the next one.
    """
    last = chapters.groupBy(*JOB).agg(F.max("ordinal").alias("_last"))
    held = jobs.select(*JOB, "next_need", "archived_at", "wait_in", "wait_out", "wait_next", "wait_hash", F.lit(True).alias("_here")).join(last, JOB, "left")
    rows = requests.join(held, JOB, "left")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    capability = F.when(given("capability"), F.col("capability")).otherwise(F.col("next_need"))
    result = first_true(
        ("NOT_FOUND", F.col("_here").isNull()), ("NOT_WAITING", F.col("wait_out").isNull()),
        ("OTHER_CAPABILITY", given("capability") & (F.col("next_need") != F.col("capability"))), ("OTHER_RESUME", given("resume") & (F.col("wait_next") != F.col("resume"))),
        ("OTHER_INPUT", (F.coalesce("in_ordinal", F.lit(0)) != 0) & (F.col("wait_in") != F.col("in_ordinal"))), ("OTHER_OUTPUT", F.col("wait_out") != F.col("out_ordinal")),
        ("OTHER_HASH", given("in_hash") & (F.col("wait_hash") != F.col("in_hash"))), ("NO_TASK_TYPE", F.instr(capability, ":") == 0),
        ("NOT_NEXT_CHAPTER", F.col("wait_out") != F.coalesce("_last", F.lit(-1)) + 1), ("FINISHED", F.col("archived_at").isNotNull()),
    )
    rows = rows.withColumn("result", result)
    ok = F.col("result") == "OK"
    return rows.select(
        *JOB, "result", F.when(ok, F.expr("split_part(coalesce(nullif(capability, ''), next_need), ':', 2)")).alias("task_type"),
        F.when(ok, F.when(given("resume"), F.col("resume")).otherwise(F.col("wait_next"))).alias("resume_need"),
    )


def awaited(waits: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each job that awaits others (tenant_id, job_id, dep_job_id): whether all are over, and those that are not.

    A job that does not exist counts as over; so do completed and cancelled ones. Jobs need status. One that is not done
    is to be rescheduled until its dependencies are.
    """
    pending = waits.join(jobs.select("tenant_id", F.col("job_id").alias("dep_job_id"), "status"), ["tenant_id", "dep_job_id"], "left")
    still = F.coalesce(~F.col("status").isin("COMPLETED", "CANCELLED"), F.lit(False))
    return pending.groupBy(*JOB).agg(
        (F.max(still.cast("int")) == 0).alias("done"), F.count("*").alias("n_awaited"), F.sum(still.cast("long")).alias("n_pending"), F.min(F.when(still, F.col("dep_job_id"))).alias("first_pending")
    )


def await_until(wake: Column, invocation: Column, total: Column, now: Column, threshold_seconds: int = 300, replay: bool = False) -> Column:
    """What a wait until `wake` does at `now` under two deadlines (null: none): action and the time it ends.

    A deadline that has passed is a timeout, the total one first (not retryable; the invocation's is). The wait ends at
    the earliest of all three. Nothing to wait for: CONTINUE. In a replay, waiting is NOT_READY. Waits above the
    threshold give the lease back (RESCHEDULE), shorter ones stay (SLEEP).
    """
    until = F.least(wake, invocation, total)
    waits = wake.isNotNull() & (until > now)
    far = until > now + F.make_dt_interval(secs=F.lit(threshold_seconds))
    action = F.when(total < now, "TIMEOUT_TOTAL").when(invocation < now, "TIMEOUT_INVOCATION").when(~waits, "CONTINUE").when(F.lit(replay), "NOT_READY").when(far, "RESCHEDULE").otherwise("SLEEP")
    return F.struct(action.alias("action"), F.when(action.isin("RESCHEDULE", "SLEEP"), until).alias("until"))


def attempt_step(kind: Column, retry: Column, attempt: Column, maximum: Column, ended: Column, backoff_ms: Column, total: Column, now: Column) -> Column:
    """What follows a stored outcome: action, the next attempt, and the time it may begin.

    Past the total deadline: TIMEOUT. Output: RETURN. An error that may not be retried or has used its attempts: FAIL.
    Else RETRY, after the backoff.
    """
    n = F.when(attempt <= 0, 1).otherwise(attempt)
    action = F.when(total < now, "TIMEOUT").when(kind == "App", "RETURN").when(~retry | (n >= maximum), "FAIL").otherwise("RETRY")
    wake = ended + F.make_dt_interval(secs=(backoff_ms / 1000).cast("decimal(18,6)"))
    return F.struct(action.alias("action"), F.when(action == "RETRY", n + 1).alias("next_attempt"), F.when(action == "RETRY", wake).alias("wake_at"))


def replay_misses(expected: DataFrame, chapters: DataFrame) -> DataFrame:
    """Steps (tenant_id, job_id, ordinal, kind, task_type, input_hash) whose result is not stored or is not that step's.

    kind is task or job. task_result_missing and job_result_missing: no chapter at the ordinal. NOT_DETERMINISTIC: the
    chapter is of another type or task, or keeps another input's hash; hashes that are empty are not compared.
    """
    stored = chapters.select(*JOB, "ordinal", "chapter_type", F.col("task_type").alias("_task"), F.col("input_hash").alias("_hash"))
    rows = expected.join(stored, [*JOB, "ordinal"], "left")
    other = (F.when(F.col("kind") == "job", "JobAttemptOutcome").otherwise("TaskAttemptOutcome") != F.col("chapter_type")) | ((F.col("kind") == "task") & (F.col("task_type") != F.col("_task")))
    hashes = (F.col("_hash") != "") & (F.col("input_hash") != "") & (F.col("_hash") != F.col("input_hash"))
    reason = F.when(F.col("chapter_type").isNull(), F.concat("kind", F.lit("_result_missing"))).when(other | F.coalesce(hashes, F.lit(False)), "NOT_DETERMINISTIC")
    return rows.withColumn("reason", reason).where("reason is not null").select(*expected.columns, "reason")
