"""Job histories: attempts, task runs, latest and next attempts, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions import expr

JOB = ["tenant_id", "job_id"]


def last_chapter(chapters: DataFrame) -> DataFrame:
    columns = [c for c in chapters.columns if c not in JOB]
    return chapters.groupBy(*JOB).agg(F.max_by(F.struct(*columns), "ordinal").alias("c")).select(*JOB, "c.*")


def with_segments(chapters: DataFrame) -> DataFrame:
    """Adds job_attempt and segment: an outcome of attempt n ends a segment, what follows belongs to attempt n + 1."""
    before = Window.partitionBy(*JOB).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("chapter_type") == "JobAttemptOutcome"
    attempt = F.coalesce(F.last(F.when(ends, F.col("attempt")), ignorenulls=True).over(before), F.lit(0)) + 1
    return chapters.withColumn("job_attempt", attempt).withColumn("segment", F.coalesce(F.max(F.when(ends, F.col("ordinal"))).over(before), F.lit(-1)))


def task_runs(chapters: DataFrame) -> DataFrame:
    """Runs of task chapters: a run begins a segment, at an attempt of 1 or less, or where the task type changes.

    All windows have the order of `with_segments`, so that a job's chapters are sorted once.
    """
    tasks = with_segments(chapters).where("chapter_type = 'TaskAttemptOutcome'")
    order = Window.partitionBy(*JOB).orderBy("ordinal")
    prior = lambda c: F.lag(c).over(order)
    begins = ~prior("segment").eqNullSafe(F.col("segment")) | prior("task_type").isNull() | (F.col("attempt") <= 1) | (prior("task_type") != F.col("task_type"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = tasks.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(running))
    return numbered.groupBy(*JOB, "run").agg(
        F.min("job_attempt").alias("job_attempt"), F.min_by("task_type", "ordinal").alias("task_type"), F.min("ordinal").alias("first_ordinal"),
        F.count("*").alias("n_attempts"), F.max_by("payload_kind", F.struct("attempt", "ordinal")).alias("latest_kind"),
    ).withColumn("run_id", F.concat("task_type", F.lit(":"), F.col("first_ordinal").cast("string")))


def nested_runs(chapters: DataFrame) -> DataFrame:
    """One row per job: attempts, each with its task runs in order."""
    runs = task_runs(chapters).groupBy(*JOB, "job_attempt").agg(F.array_sort(F.collect_list(F.struct("first_ordinal", "run_id", "n_attempts", "latest_kind"))).alias("tasks"))
    return runs.groupBy(*JOB).agg(F.array_sort(F.collect_list(F.struct("job_attempt", "tasks"))).alias("attempts"))


def outcomes(chapters: DataFrame) -> DataFrame:
    """The latest job attempt outcome of each job, by (attempt, ordinal)."""
    ends = chapters.where("chapter_type = 'JobAttemptOutcome'")
    return ends.groupBy(*JOB).agg(F.max_by(F.struct("attempt", "ordinal", "payload_kind"), F.struct("attempt", "ordinal")).alias("o")).select(*JOB, "o.*")


def next_attempt(chapters: DataFrame, max_attempts: int) -> DataFrame:
    """Jobs whose last outcome failed, may be retried and has attempts left, with the attempt to come.

    Chapters may have the payload's text in `data`, whose `retryable` then counts.
    """
    flag = F.get_json_object("data", "$.retryable").cast("boolean") if "data" in chapters.columns else F.lit(None).cast("boolean")
    retry = expr.retryable(F.col("payload_kind"), F.col("retry_flag"))
    ends = chapters.withColumn("retry_flag", flag).where("chapter_type = 'JobAttemptOutcome'")
    last = ends.groupBy(*JOB).agg(F.max_by(F.struct("attempt", "payload_kind", "retry_flag"), F.struct("attempt", "ordinal")).alias("o")).select(*JOB, "o.*")
    failed = last.where((F.col("payload_kind") != "App") & retry & (F.col("attempt") > 0) & (F.col("attempt") < F.greatest(F.lit(max_attempts), F.lit(1))))
    return failed.select(*JOB, (F.col("attempt") + 1).alias("next_attempt"))


def runtime_state(now: str) -> Column:
    """What the row that a job is at does, by its status: READY, LEASED or WAITING; null where there is no such row."""
    c = F.col("status")
    ready = F.when(F.col("available_at") <= expr.at(now), "READY").otherwise("WAITING")
    return F.when(c == "READY", ready).when(c == "ACTIVE", "LEASED").when(c.isin("AWAITING_FUTURE", "PENDING_JOBS"), "WAITING")


def runtime_rows(jobs: DataFrame, chapters: DataFrame, now: str) -> DataFrame:
    """The row after the last chapter that a job (with status) is at; cancelled, crashed and archived jobs have none.

    A job without chapters is at ordinal 0. input_ordinal is the chapter that its input comes from.
    """
    last = chapters.groupBy(*JOB).agg(F.max("ordinal").alias("last"))
    rows = jobs.where("archived_at is null").withColumn("state", runtime_state(now)).where("state is not null").join(last, JOB, "left")
    ordinal, need = F.coalesce(F.col("last") + 1, F.lit(0)), F.coalesce(F.nullif("next_need", F.lit("")), "job_type")
    return rows.select(*JOB, ordinal.alias("ordinal"), need.alias("next_need"), "state", F.concat(need, F.lit(":"), ordinal.cast("string")).alias("run_id"), F.col("last").alias("input_ordinal"))


def with_input(chapters: DataFrame) -> DataFrame:
    """Adds the data of the chapter of the same job that input_ref names: input_data and input_state FOUND, NOT_FOUND or NONE."""
    held = chapters.select(*JOB, F.col("ordinal").alias("input_ref"), F.col("data").alias("input_data"), F.lit(True).alias("_here"))
    state = F.when(F.col("input_ref").isNull(), "NONE").when(F.col("_here"), "FOUND").otherwise("NOT_FOUND")
    return chapters.join(held, [*JOB, "input_ref"], "left").withColumn("input_state", state).drop("_here")


def event_times(chapters: DataFrame) -> DataFrame:
    """Adds began and ended of each chapter's event in a replay: its own times, else when it was written.

    A job attempt begins where the one before it ended, the first when the job was written, whatever start its outcome says.
    """
    before = Window.partitionBy(*JOB).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    c = lambda name: F.col(name) if name in chapters.columns else F.lit(None).cast("timestamp_ntz")
    starts, ends = F.col("chapter_type") == "JobStart", F.col("chapter_type") == "JobAttemptOutcome"
    own = F.when(starts, F.col("created_at")).otherwise(F.coalesce(c("started_at"), F.col("created_at")))
    times = chapters.withColumn("ended", F.coalesce(c("finished_at"), F.col("created_at"))).withColumn("began", own)
    attempt = F.last(F.when(starts, F.col("began")).when(ends, F.col("ended")), ignorenulls=True).over(before)
    return times.withColumn("began", F.when(ends, F.coalesce(attempt, F.col("began"))).otherwise(F.col("began")))


def prefix_difference(source: DataFrame, target: DataFrame) -> DataFrame:
    """Ordinals at which two histories differ, including those that one of them lacks."""
    columns = ["chapter_type", "task_type", "attempt", "payload_kind"]
    a = source.select("pair", "ordinal", F.struct(*columns).alias("a"))
    b = target.select("pair", "ordinal", F.struct(*columns).alias("b"))
    both = a.join(b, ["pair", "ordinal"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("pair", "ordinal", F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("differs").alias("kind"))
