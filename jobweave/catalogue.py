"""All job queries of the library by name, over the fixture tables; equivalent SQL is in plans.oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobweave.functions import expr
from jobweave.operators import history, lifecycle, listing, payloads, quality, schedules, schemas
from jobweave.operators import stories as story_ops
from jobweave.operators.listing import ListRequest
from jobweave.plans import leases, oracle, sinks, small, stories, timing, workers
from jobweave.sources import blobs
from jobweave.sources.fixtures import NOW, fixture, projected
from jobweave.streaming import fold

TENANT, ALL_TENANTS = "BUILDING", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
JOB = ["tenant_id", "job_id"]
SHOWN = ["tenant_id", "job_id", "status", "created_at"]
CRON, DAYS = "*/15 9-17 * * 1-5", 8


class Tables:
    """Fixtures and test tables, read when named."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)


def listed(**request):
    request.setdefault("tenants", [TENANT])
    return lambda t: listing.list_jobs(t.fx_jobs, t.fx_wait, NOW, ListRequest(**request)).select(*SHOWN)


def second_page(t: Tables) -> DataFrame:
    """The page after the one that ends at a known job: a token is made from that job's row."""
    request = {"tenants": ALL_TENANTS, "page_size": 50}
    cursor = {"created_at": oracle.CURSOR_TIME, "tenant_id": "FURNITURE", "job_id": oracle.CURSOR_JOB}
    return listing.list_jobs(t.fx_jobs, t.fx_wait, NOW, ListRequest(**request, token=listing.page_token(cursor))).select(*SHOWN)


def by_keys(t: Tables) -> DataFrame:
    keys = t.fx_jobs.where("parent_job_id is not null").select("tenant_id", F.col("parent_job_id").alias("job_id"))
    return listing.list_jobs(t.fx_jobs, t.fx_wait, NOW, ListRequest(tenants=ALL_TENANTS, keys=keys, page_size=200)).select(*SHOWN)


def summaries(t: Tables) -> DataFrame:
    jobs = listing.with_status(t.fx_jobs, t.fx_wait, NOW)
    return jobs.select(
        "tenant_id", "job_id", "status", expr.job_key().alias("job_key"), expr.effective_need(NOW).alias("need"), expr.job_type_of("next_need").alias("need_job_type"),
        expr.task_type_of("next_need").alias("need_task_type"), F.coalesce("parent_job_id", F.lit("")).alias("parent"), expr.app_value("metadata", "rank").alias("rank"),
        expr.app_value("metadata", "team").alias("team"), expr.schema_hash_of("metadata").alias("schema_hash"),
    )


def lease_plan(t: Tables) -> DataFrame:
    found = listing.poll_candidates(t.fx_jobs, t.fx_wait, NOW, TENANT, ["high", "low", "urgent", "medium:review"])
    return listing.lease_plan(found, NOW, 20)


def poll_meta(t: Tables) -> DataFrame:
    return listing.poll_candidates(t.fx_jobs, t.fx_wait, NOW, TENANT, ["high", "low"], {("team",): ["t1", "t3"]}).select("tenant_id", "job_id", "need")


def waiting_tasks(t: Tables) -> DataFrame:
    return t.fx_jobs.where("archived_at is null and next_need like '%:%'").select("tenant_id", "job_id", "job_type", expr.task_type_of("next_need").alias("task_type"))


def get_job(t: Tables) -> DataFrame:
    """Status, and the last outcome of archived jobs."""
    jobs = listing.with_status(t.fx_jobs, t.fx_wait, NOW)
    joined = jobs.join(history.outcomes(t.fx_chapters), ["tenant_id", "job_id"], "left")
    return joined.select("tenant_id", "job_id", "status", F.when(F.col("archived_at").isNotNull(), F.col("payload_kind")).alias("outcome"))


def children(t: Tables) -> DataFrame:
    """An extension: direct children of each parent."""
    return t.fx_jobs.where("parent_job_id is not null").groupBy("tenant_id", "parent_job_id").agg(F.count("*").alias("n_children"))


def prerequisites(t: Tables) -> DataFrame:
    """Whether each dependency is missing, open, or has succeeded."""
    deps = t.fx_jobs.select("tenant_id", F.col("job_id").alias("dep_job_id"), "archived_at", "completion_status")
    state = F.when(F.col("archived_at").isNull() & F.col("_here").isNull(), "missing").when(F.col("archived_at").isNull(), "open").when(F.col("completion_status") == "success", "success").otherwise("failed")
    return t.fx_wait.join(deps.withColumn("_here", F.lit(True)), ["tenant_id", "dep_job_id"], "left").select("tenant_id", "job_id", "dep_job_id", state.alias("state"))


def attempts_flat(t: Tables) -> DataFrame:
    flat = history.nested_runs(t.fx_chapters).select("tenant_id", "job_id", F.explode("attempts").alias("a")).select("tenant_id", "job_id", "a.job_attempt", F.posexplode("a.tasks").alias("place", "t"))
    return flat.select("tenant_id", "job_id", "job_attempt", "place", "t.run_id", "t.n_attempts")


def restart_difference(t: Tables) -> DataFrame:
    """Histories of order 2k compared with those of order 2k + 1."""
    c = t.fx_chapters.join(t.fx_jobs.select("tenant_id", "job_id", "k"), ["tenant_id", "job_id"]).withColumn("pair", F.expr("k div 2"))
    return history.prefix_difference(c.where("k % 2 = 0"), c.where("k % 2 = 1"))


def chapter_page(t: Tables) -> DataFrame:
    return t.fx_chapters.where("ordinal between 1 and 2").select("tenant_id", "job_id", "ordinal", "chapter_type")


def chapter_created_before(t: Tables) -> DataFrame:
    """Deadline of each task chapter: the chapter before, plus half an hour."""
    prior = F.lag("created_at").over(Window.partitionBy("tenant_id", "job_id").orderBy("ordinal"))
    return t.fx_chapters.withColumn("deadline", F.coalesce(prior, F.col("created_at")) + F.expr("interval 30 minutes")).where("ordinal > 0").select("tenant_id", "job_id", "ordinal", "deadline")


def fork_owners(t: Tables) -> DataFrame:
    base = F.when(F.col("base_story_id").isNotNull(), F.col("anthology_id"))
    rows = t.fx_stories.withColumn("base_anthology_id", base).withColumn("latest_ordinal", F.col("own_latest"))
    owned = story_ops.resolved(rows, t.fx_story_chapters)
    return owned.select("story_id", "ordinal", F.col("owner_story").alias("owner"), "depth", "task_type", F.length("body").cast("long").alias("n_chars"))


def timed(chapters: DataFrame) -> DataFrame:
    """Chapters of which some say when they started and ended."""
    return chapters.withColumn("started_at", F.expr("case when ordinal % 2 = 1 then created_at - interval 2 hours end")).withColumn("finished_at", F.expr("case when ordinal % 3 = 1 then created_at - interval 1 hour end"))


def story_page(t: Tables) -> DataFrame:
    return t.fx_stories.where("not deleted and story_id > 10").orderBy("story_id").limit(26).select("story_id", "own_latest")


def input_hashes(t: Tables) -> DataFrame:
    parts = quality.artifacts(t.documents).select(F.pmod("doc_id", F.lit(50)).alias("job"), F.concat_ws("|", "name", "sha256").alias("part"))
    return parts.groupBy("job").agg(F.collect_list("part").alias("parts")).select("job", expr.input_hash(F.concat(F.lit("job-"), F.col("job").cast("string")), F.col("parts")).alias("input_hash"))


def cron_matches(t: Tables) -> DataFrame:
    local = F.from_utc_timestamp(F.col("scheduled_at").cast("timestamp"), "UTC")
    return t.fx_runs.where(schedules.cron_matches("0-29/2 8-20 1,15,20-25 * *", local)).select("event_id", "schedule_id", "scheduled_at")


def cron_next(t: Tables) -> DataFrame:
    return schedules.cron_next(t.fx_runs.select("event_id", "scheduled_at"), CRON, "scheduled_at", DAYS).select("event_id", "next_fire")


def interval_next(t: Tables) -> DataFrame:
    fire = schedules.interval_next(F.col("scheduled_at"), 5400, expr.at("2024-01-05 00:00:00"), expr.at("2024-01-25 00:00:00"))
    return t.fx_runs.select("event_id", fire.alias("next_fire"))


def schedule_ids(t: Tables) -> DataFrame:
    return t.fx_runs.select("event_id", expr.schedule_job_id(F.col("schedule_id"), F.lit(3), F.col("scheduled_at")).alias("job_id"))


def bits(t: Tables) -> DataFrame:
    return schedules.failure_windows(t.fx_runs, 8).select("event_id", "tenant_id", "schedule_id", "bits")


def violated(t: Tables) -> DataFrame:
    return schedules.failure_windows(t.fx_runs, 8).select("event_id", schedules.violates("bits", 2, 70).alias("violated"))


def checked(t: Tables) -> DataFrame:
    """Occurrences against schedules whose state, generation, spec and end go by their numbers; every fourth one has begun."""
    runs = schedules.failure_windows(t.fx_runs, 8).withColumn("violated", schedules.violates("bits", 2, 70)).withColumn("run_generation", F.lit(1) + F.col("event_id") % 2)
    runs = runs.withColumn("n_chapters", F.when(F.col("event_id") % 4 == 0, 2).otherwise(1)).withColumn("run_spec_hash", F.when(F.col("event_id") % 11 == 0, "a").otherwise("b"))
    n = F.regexp_extract("schedule_id", r"(\d+)$", 1).cast("int")
    rows = t.fx_runs.select("tenant_id", "schedule_id").distinct().where((n % 13 != 0) | (F.col("tenant_id") == "t1"))
    state = F.when(n % 5 == 0, "PAUSED").when(n % 7 == 0, "ARCHIVED").otherwise("ACTIVE")
    table = rows.select("tenant_id", "schedule_id", F.lit("b").alias("spec_hash"), state.alias("state"), (F.lit(1) + n % 2).alias("generation"), F.when(n % 3 == 0, expr.at("2024-01-20 00:00:00")).alias("end_at"))
    return schedules.preflight(runs, table)


def successors(t: Tables) -> DataFrame:
    leased = F.col("scheduled_at") + F.expr("make_dt_interval(0, 0, event_id % 50, 0)")
    due = checked(t).withColumn("overlap", F.when(F.col("event_id") % 6 == 1, "parallel")).withColumn("next_fire", schedules.interval_next(leased, 5400, expr.at("2024-01-05 00:00:00"), expr.at("2024-01-25 00:00:00")))
    return schedules.successors(due, "next_fire").select("event_id", "tenant_id", "job_id", "scheduled_at", F.get("wait_for", F.lit(0)).alias("waits_for"), "bits")


def app_metadata(t: Tables) -> DataFrame:
    """Each row's metadata is parsed once."""
    v = F.col("value")
    rows = t.fx_metadata.select(*JOB, "parent_job_id", "metadata", F.try_parse_json("metadata").alias("value"))
    return rows.select(*JOB, expr.parent_of(value=v).alias("parent"), expr.app_metadata(value=v).alias("app"), expr.schema_hash_of("metadata", v).alias("schema_hash"))


def occurrences(t: Tables) -> DataFrame:
    return t.fx_metadata.select(*JOB, expr.occurrence().alias("o")).where("o is not null").select(*JOB, "o.*")


def merged_policies(t: Tables) -> DataFrame:
    """Policies of jobs, of which this or that is not set, over the default one."""
    override = F.expr("""named_struct('initial_ms', k % 3 * 100, 'coefficient', cast(k % 2 * 2 as double), 'max_ms', cast(null as bigint), 'max_attempts', k % 4 - 1,
      'non_retryable', if(k % 5 = 0, array('A'), cast(array() as array<string>)), 'invocation_ms', if(k % 7 = 6, null, k % 7 * 1000 - 2000), 'total_ms', cast(null as bigint))""")
    base = F.expr("named_struct('initial_ms', 100L, 'coefficient', 0D, 'max_ms', 30000L, 'max_attempts', 3L, 'non_retryable', array('B'), 'invocation_ms', 600000L, 'total_ms', 1800000L)")
    rows = t.fx_jobs.select(*JOB, expr.merged_policy(override, base).alias("p")).select(*JOB, "p.*")
    return rows.withColumn("non_retryable", F.array_join("non_retryable", ","))


def chapter_inputs(t: Tables) -> DataFrame:
    """Each chapter's input is one to three chapters before it; some are before the first."""
    rows = t.fx_bodies.withColumn("input_ref", F.expr("case when ordinal > 0 then ordinal - 1 - ordinal % 3 end"))
    return history.with_input(rows).select(*JOB, "ordinal", "input_state", "input_data")


def schedule_runs(t: Tables) -> DataFrame:
    return t.fx_runs.orderBy(F.desc("scheduled_at"), F.desc("event_id")).limit(101)


def backoff(t: Tables) -> DataFrame:
    chapters = t.fx_chapters.where("chapter_type = 'TaskAttemptOutcome'")
    delay = expr.backoff_ms(F.col("attempt"), F.lit(100.0), F.lit(2.0), F.lit(350.0))
    return chapters.select("tenant_id", "job_id", "ordinal", delay.alias("backoff_ms"), expr.retryable(F.col("payload_kind"), F.lit(None).cast("boolean")).alias("retryable"))


def fold_state(t: Tables) -> DataFrame:
    return fold.fold(fold.commands(t.fx_commands))


def stream_state(t: Tables) -> DataFrame:
    """The fold as a stream over the events files, run to its end and read back from a table in the warehouse."""
    import uuid

    spark, name = t.spark, f"fold_{uuid.uuid4().hex}"
    source = spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet")
    return fold.stream_fold(fold.commands(projected(spark, "fx_commands", events=source)), f"{blobs.shared_folder(spark)}/{name}")


def chapter_outcomes(t: Tables) -> DataFrame:
    o = t.fx_bodies.where("ordinal > 0").withColumn("o", payloads.outcome(F.col("payload_kind"), F.col("data")))
    return o.select(*JOB, "ordinal", "o.status", F.col("o.error.kind").alias("error_kind"), "o.error.message", "o.error.code", "o.error.retryable", "o.output")


def job_outputs(t: Tables) -> DataFrame:
    jobs = listing.with_status(t.fx_jobs, t.fx_wait, NOW)
    return payloads.outputs(jobs, t.fx_bodies)


def completions(t: Tables) -> DataFrame:
    ends = t.fx_bodies.where("chapter_type = 'JobAttemptOutcome'")
    return ends.select(*JOB, "ordinal", payloads.completion(F.col("payload_kind"), F.col("data"), F.col("ordinal") % 5 == 0).alias("c")).select(*JOB, "ordinal", "c.*")


def failed_round_trip(t: Tables) -> DataFrame:
    failed = t.fx_bodies.withColumn("e", payloads.error(F.col("payload_kind"), F.col("data"))).where("e is not null")
    failed = failed.withColumn("f", payloads.failed_error(F.col("e"))).withColumn("c", payloads.failed_cause(F.col("f")))
    return failed.select(*JOB, "ordinal", F.col("f.level").alias("outer_level"), F.size("f.attrs").cast("long").alias("n_attrs"), "c.*")


def submits(t: Tables) -> DataFrame:
    """Jobs 3k are new; every job is asked for twice, with this or that changed."""
    jobs = t.fx_jobs.select("k", *JOB, "job_type", F.concat(F.lit("h"), (F.col("k") % 4).cast("string")).alias("input_hash"), "metadata", F.lit(None).cast("array<string>").alias("wait_for"))
    asked = jobs.withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1))))
    asked = asked.withColumn("job_type", F.expr("case when k % 5 = 1 or (seq = 1 and k % 17 = 5) then 'other' else job_type end")).withColumn("input_hash", F.expr("case when k % 7 = 2 then 'x' else input_hash end"))
    spaced = F.replace(F.col("metadata"), F.lit(","), F.lit(" , "))
    asked = asked.withColumn("metadata", F.when(F.col("k") % 11 == 3, spaced).when(F.col("k") % 13 == 4, "{}").otherwise(F.col("metadata")))
    return lifecycle.submit(asked, jobs.where("k % 3 <> 0")).select(*JOB, "seq", "result")


def restarts(t: Tables) -> DataFrame:
    asked = t.fx_jobs.select("tenant_id", F.col("job_id").alias("prior_job_id"), F.concat("job_id", F.lit("-again")).alias("job_id"), (F.col("k") % 6 - 1).alias("last_step"))
    return lifecycle.restart(asked, t.fx_chapters)


def child_submits(t: Tables) -> DataFrame:
    lease = F.concat(F.lit("lease-"), F.when(F.col("k") % 3 == 0, "0").otherwise((F.col("k") - F.col("k") % 10).cast("string")))
    asked = t.fx_jobs.where("parent_job_id is not null").select("tenant_id", "parent_job_id", lease.alias("asked_lease"), F.concat("job_id", F.lit("-child")).alias("child_id"))
    return lifecycle.child_submits(asked, t.fx_jobs, NOW)


def job_leases(t: Tables) -> DataFrame:
    asked = t.fx_jobs.select("tenant_id", F.expr("case when k % 50 = 7 then 'none' else job_id end as job_id"), F.array(F.lit("high"), F.lit("low"), F.lit("urgent")).alias("capabilities"))
    return lifecycle.job_leases(asked, listing.with_status(t.fx_jobs, t.fx_wait, NOW), NOW)


def run_results(t: Tables) -> DataFrame:
    jobs = listing.with_status(t.fx_jobs, t.fx_wait, NOW)
    return lifecycle.classify(jobs, payloads.outputs(jobs, t.fx_bodies), ["high", "low", "urgent", "medium:review"])


def completed_tasks(t: Tables) -> DataFrame:
    """Jobs with a task to wait for; requests for them get this or that wrong."""
    last = t.fx_chapters.groupBy(*JOB).agg(F.max("ordinal").alias("last"))
    jobs = t.fx_jobs.join(last, JOB).withColumn("waits", F.expr("next_need like '%:%'"))
    jobs = jobs.selectExpr(
        "tenant_id", "job_id", "k", "next_need", "archived_at", "case when waits then k % 3 end wait_in", "case when waits then last + if(k % 9 = 0, 2, 1) end wait_out",
        "case when waits then job_type end wait_next", "case when waits then 'h0' end wait_hash",
    )
    asked = jobs.selectExpr(
        "tenant_id", "job_id", "case when k % 7 = 0 then 'x:y' when k % 3 = 0 then '' else next_need end capability", "case when k % 8 = 0 then 'other' else '' end resume",
        "case when k % 10 = 0 then 5 else 0 end in_ordinal", "case when k % 22 = 0 then 'h9' else 'h0' end in_hash", "wait_out + if(k % 26 = 0, 1, 0) out_ordinal",
    )
    return lifecycle.complete_tasks(asked, jobs, t.fx_chapters)


def awaited_jobs(t: Tables) -> DataFrame:
    return lifecycle.awaited(t.fx_wait, listing.with_status(t.fx_jobs, t.fx_wait, NOW))


def awaits(t: Tables) -> DataFrame:
    wake = F.expr("scheduled_at + make_dt_interval(0, 0, event_id % 600)")
    invocation, total = F.expr("case when event_id % 3 = 0 then scheduled_at + interval 1 hour end"), F.expr("case when event_id % 4 = 0 then scheduled_at + interval 2 hours end")
    step = lifecycle.await_until(wake, invocation, total, expr.at("2024-01-15 12:00:00"))
    return t.fx_runs.select("event_id", step.alias("s")).select("event_id", "s.*")


def attempt_steps(t: Tables) -> DataFrame:
    flag = payloads.field(F.col("data"), "retryable").cast("boolean")
    step = lifecycle.attempt_step(
        F.col("payload_kind"), expr.retryable(F.col("payload_kind"), flag), F.col("attempt"), F.lit(3), F.col("created_at"),
        expr.backoff_ms(F.col("attempt"), F.lit(100.0), F.lit(2.0), F.lit(350.0)), F.col("created_at") + F.expr("interval 2000 days"), expr.at(NOW),
    )
    return t.fx_bodies.where("chapter_type = 'TaskAttemptOutcome'").select(*JOB, "ordinal", step.alias("s")).select(*JOB, "ordinal", "s.*")


def replay_misses(t: Tables) -> DataFrame:
    """A run that expects three tasks of type task_a and then the job's outcome."""
    steps = t.fx_jobs.select(*JOB, "k", F.explode(F.expr("array(1L, 2L, 3L, 4L)")).alias("ordinal"))
    steps = steps.selectExpr("tenant_id", "job_id", "ordinal", "if(ordinal = 4, 'job', 'task') kind", "if(ordinal = 4, '', 'task_a') task_type", "if(k % 10 = 0, 'other', 'h' || ordinal) input_hash")
    return lifecycle.replay_misses(steps, t.fx_bodies)


def registry(t: Tables) -> DataFrame:
    """All schemas that were asked for; those of nations 5, 6 and 7 are archived."""
    made = schemas.register(None, t.fx_schemas)
    return schemas.archive(made, schemas.hashed(t.fx_schemas.where("n in (5, 6, 7)")), NOW)


def schema_selectors(t: Tables) -> DataFrame:
    rows = schemas.hashed(t.fx_schemas.where("n % 10 < 8"))
    wanted = F.expr("case n % 4 when 0 then schema_hash when 1 then '' when 2 then 'sha256:' || repeat('0', 64) else 'md5:1' end")
    chosen = rows.select("n", "created_at", "tenant_id", wanted.alias("wanted_hash"), F.expr("case when n % 3 = 0 then schema when n % 3 = 1 then '' end").alias("inline"))
    return schemas.resolve(chosen, registry(t)).select("n", "created_at", "resolved", "error")


def rejected_chapters(t: Tables) -> DataFrame:
    """Chapters against their jobs' schemas: order k of tenant i has the schema of nation i + 5 (k % 5)."""
    of = schemas.hashed(t.fx_schemas.where("n % 10 < 8")).select("tenant_id", F.expr("n div 5").alias("pick"), "schema_hash").distinct()
    jobs = t.fx_jobs.select(*JOB, (F.col("k") % 5).alias("pick"), F.col("archived_at").isNotNull().alias("archived")).join(of, ["tenant_id", "pick"])
    last = F.max("ordinal").over(Window.partitionBy(*JOB))
    rows = payloads.chapter_document(t.fx_bodies.join(jobs, JOB).withColumn("last", last))
    completes = F.col("archived") & (F.col("ordinal") == F.col("last")) & (F.col("chapter_type") == "JobAttemptOutcome")
    return schemas.rejected_chapters(rows.withColumn("role", schemas.role(F.col("ordinal"), completes)), registry(t))


def schedule_list(t: Tables) -> DataFrame:
    last = schedules.schedule_log(t.fx_schedule_log, every=False)
    return schedules.list_schedules(last, "t1", states=["ACTIVE", "PAUSED"], page_size=500).select("schedule_id", "state", "generation", "updated_at")


def cron_first(t: Tables) -> DataFrame:
    """First times from a whole minute on, so that a minute that matches counts itself."""
    return schedules.cron_initial(t.fx_runs.select("event_id", F.date_trunc("minute", "scheduled_at").cast("timestamp_ntz").alias("from_at")), CRON, "from_at", DAYS).select("event_id", "next_fire")


def artifact_lookup(t: Tables) -> DataFrame:
    """Documents as artifacts of seven names in the chapters of 50 jobs; references by name, or by name and digest."""
    made = t.documents.selectExpr("'t' tenant_id", "doc_id % 50 job_id", "doc_id div 50 % 3 ordinal", "doc_id div 150 position", "concat('n', doc_id % 7) name", "sha2(cast(text as binary), 256) digest", "cast(octet_length(text) as long) size", "doc_id")
    refs = made.selectExpr("tenant_id", "job_id", "ordinal", "name", "case when doc_id % 3 = 0 then digest when doc_id % 3 = 1 then '' else 'none' end digest")
    return payloads.find_artifacts(refs, made).drop("tenant_id")


def worker_groups(t: Tables) -> DataFrame:
    made = t.fx_jobs.groupBy("job_type").agg(F.collect_set(F.when(F.instr("next_need", ":") > 0, expr.task_type_of("next_need"))).alias("task_types"))
    groups = listing.poll_groups(made.withColumn("signature", F.when(F.col("job_type").like("%h"), "team=t1")))
    return groups.select("signature", F.array_join("capabilities", ",").alias("capabilities"))


def blob_round_trip(t: Tables) -> DataFrame:
    """Documents above the inline limit, saved as blobs twice and read back by digest."""
    import uuid

    folder = f"{blobs.shared_folder(t.spark)}/blobs_{uuid.uuid4().hex}"
    docs = t.documents.select("doc_id", F.col("text").cast("binary").alias("content")).where(F.octet_length("content") > 256)
    blobs.save(docs.where("doc_id % 2 = 0"), folder, exists=False)
    blobs.save(docs, folder)
    held = docs.select("doc_id", blobs.digest(F.col("content")).alias("digest"))
    return held.join(blobs.opened(t.spark, folder), "digest").select("doc_id", "digest", "size", blobs.digest(F.col("content")).alias("read_digest"))


BUILT = {
    "q_status": lambda t: listing.with_status(t.fx_jobs, t.fx_wait, NOW).select("tenant_id", "job_id", "status"),
    "q_list_ready": listed(statuses=["READY"]),
    "q_list_status_in": listed(statuses=["ACTIVE", "CANCELLED", "CRASH_CONCERN"], stores=["ARCHIVED"], page_size=200),
    "q_list_store_active": listed(stores=["ACTIVE"], page_size=200),
    "q_list_store_archived": listed(stores=["ARCHIVED"]),
    "q_list_type": listed(job_types=["urgent", "high"], tenants=ALL_TENANTS, page_size=500),
    "q_list_task": listed(job_tasks=[("low", "review"), ("high", "review"), ("", "x")], page_size=150),
    "q_list_keys": by_keys,
    "q_list_parent": listed(parents=["job-000000010", "job-000000100", "job-000000200"], tenants=ALL_TENANTS),
    "q_list_root": listed(root_only=True, page_size=60),
    "q_list_created_range": listed(created_from="1998-01-01 00:00:00", created_to="1998-03-01 00:00:00", tenants=ALL_TENANTS, page_size=200),
    "q_list_meta_eq": listed(metadata={("rank",): [1]}),
    "q_list_meta_or": listed(metadata={("rank",): [1, 2.0, 7]}),
    "q_list_meta_and": listed(metadata={("rank",): [1, 3, 5], ("team",): ["t1", "t3"]}),
    "q_page_1": listed(tenants=ALL_TENANTS, page_size=50),
    "q_page_2": second_page,
    "q_summary": summaries,
    "q_poll_candidates": lambda t: listing.poll_candidates(t.fx_jobs, t.fx_wait, NOW, TENANT, ["high", "low", "urgent", "medium:review"]).select("tenant_id", "job_id", "need"),
    "q_poll_lease_plan": lease_plan,
    "q_poll_meta": poll_meta,
    "q_waiting_tasks": waiting_tasks,
    "q_children_count": children,
    "q_prereq_check": prerequisites,
    "q_get_job": get_job,
    "q_last_chapter": lambda t: history.last_chapter(t.fx_chapters),
    "q_attempts": lambda t: history.with_segments(t.fx_chapters).select("tenant_id", "job_id", "ordinal", "job_attempt", "segment"),
    "q_task_runs": lambda t: history.task_runs(t.fx_chapters).drop("run"),
    "q_run_nested": attempts_flat,
    "q_latest_attempt": lambda t: history.outcomes(t.fx_chapters),
    "q_next_attempt": lambda t: history.next_attempt(t.fx_bodies, 4),
    "q_runtime_row": lambda t: history.runtime_rows(listing.with_status(t.fx_jobs, t.fx_wait, NOW), t.fx_chapters.where("job_id not like '%7'"), NOW),
    "q_chapter_range": chapter_page,
    "q_task_deadline": chapter_created_before,
    "q_restart_diff": restart_difference,
    "q_story_page": story_page,
    "q_fork_resolve": fork_owners,
    "q_artifact_hash": lambda t: quality.artifacts(t.documents),
    "q_input_hash": input_hashes,
    "q_cron_match": cron_matches,
    "q_cron_next": cron_next,
    "q_interval_next": interval_next,
    "q_sched_job_id": schedule_ids,
    "q_sched_runs": schedule_runs,
    "q_failure_bits": bits,
    "q_failure_violated": violated,
    "q_preflight": lambda t: checked(t).select("event_id", "reason"),
    "q_preflight_cancel": lambda t: schedules.cancelled(checked(t)),
    "q_successors": successors,
    "q_app_metadata": app_metadata,
    "q_occurrence": occurrences,
    "q_policy_merge": merged_policies,
    "q_input_chapter": chapter_inputs,
    "q_event_times": lambda t: history.event_times(timed(t.fx_chapters)).select(*JOB, "ordinal", "began", "ended"),
    "q_backoff": backoff,
    "q_outcomes": chapter_outcomes,
    "q_chapter_document": lambda t: payloads.chapter_document(t.fx_bodies).select(*JOB, "ordinal", "document"),
    "q_get_output": lambda t: job_outputs(t).select(*JOB, "state", "output", F.col("error.kind").alias("error_kind"), "error.message"),
    "q_completion_status": completions,
    "q_failed_round_trip": failed_round_trip,
    "q_submit": submits,
    "q_restart": restarts,
    "q_child_submit": child_submits,
    "q_job_lease": job_leases,
    "q_run_result": run_results,
    "q_complete_task": completed_tasks,
    "q_await_jobs": awaited_jobs,
    "q_await_until": awaits,
    "q_attempt_step": attempt_steps,
    "q_replay_misses": replay_misses,
    "q_schema_hash": lambda t: schemas.hashed(t.fx_schemas).select("n", "created_at", "canonical", "schema_hash"),
    "q_schema_registry": registry,
    "q_schema_refused": lambda t: schemas.refused(t.fx_schemas).select("n", "created_at", "error"),
    "q_schema_list": lambda t: schemas.list_schemas(registry(t), TENANT).select("schema_hash", "created_at", "state"),
    "q_schema_resolve": schema_selectors,
    "q_schema_rejected": rejected_chapters,
    "q_schedule_log": lambda t: schedules.schedule_log(t.fx_schedule_log),
    "q_schedule_list": schedule_list,
    "q_cron_first": cron_first,
    "q_artifact_lookup": artifact_lookup,
    "q_poll_groups": worker_groups,
    "q_blob_round_trip": blob_round_trip,
    "q_fold_final_state": fold_state,
    "q_stream_fold": stream_state,
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in (BUILT | stories.BUILT | leases.BUILT | timing.BUILT | sinks.BUILT | workers.BUILT | small.BUILT).items()}


def oracle_sql() -> dict[str, str]:
    return oracle.sql() | stories.sql() | leases.sql() | timing.sql() | sinks.sql() | workers.sql() | small.sql()
