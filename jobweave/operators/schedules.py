"""Schedules: cron and interval times, failure windows, preflight decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions import expr
from jobweave.streaming.fold import folded

KEY = ["tenant_id", "schedule_id"]
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


def parse_cron(text: str) -> list[list[int]]:
    """The allowed values of the five fields. Lists, ranges and steps; weekday 7 is 0; a step after one value adds none."""
    parts = text.split()
    if len(parts) != 5:
        raise ValueError("a cron expression has five fields")
    out = []
    for part, (name, low, high) in zip(parts, FIELDS, strict=True):
        values: set[int] = set()
        for item in part.split(","):
            span, slash, step = item.partition("/")
            by = int(step) if slash else 1
            a, dash, b = span.partition("-")
            first, last = (low, high) if span == "*" else (int(a), int(b) if dash else int(a))
            if by <= 0 or not low <= first <= last <= high:
                raise ValueError(f"bad {name}: {item}")
            values |= set(range(first, last + 1, by))
        out.append(sorted({v % 7 for v in values} if name == "weekday" else values))
    return out


def cron_matches(spec: str, local: Column) -> Column:
    """All five fields must hold, the day of the month and that of the week both."""
    minute, hour, day, month, weekday = parse_cron(spec)
    return (
        F.month(local).isin(month) & F.dayofmonth(local).isin(day) & (F.dayofweek(local) - 1).isin(weekday)
        & F.hour(local).isin(hour) & F.minute(local).isin(minute)
    )


def cron_next(rows: DataFrame, spec: str, after: str, days: int, zone: str = "UTC") -> DataFrame:
    """Adds next_fire: the first matching minute after column `after` and at most `days` days on; null if none.

    Matching minutes are worked out once for each calendar day in reach, days first, and kept as one array a day, so
    the rows meet them in one join by day.
    """
    _, _, day, month, weekday = parse_cron(spec)
    keyed = rows.withColumn("_from", F.date_trunc("minute", F.col(after).cast("timestamp")) + F.expr("interval 1 minute")).withColumn("_day", F.to_date("_from"))
    reach = keyed.select("_day").distinct().select(F.explode(F.sequence("_day", F.date_add("_day", days), F.expr("interval 1 day"))).alias("_day")).distinct()
    fit = lambda d: F.month(d).isin(month) & F.dayofmonth(d).isin(day) & (F.dayofweek(d) - 1).isin(weekday)
    near = reach.where(fit(F.col("_day")) | fit(F.date_add("_day", 1)) | fit(F.date_sub("_day", 1)))  # a zone's day may be a neighbour
    start = F.col("_day").cast("timestamp")
    minutes = near.select("_day", F.explode(F.sequence(start, start + F.expr("interval 1439 minutes"), F.expr("interval 1 minute"))).alias("_m"))
    hits = minutes.where(cron_matches(spec, F.from_utc_timestamp("_m", zone))).groupBy("_day").agg(F.array_sort(F.collect_list("_m")).alias("_hits"))
    later = reach.select("_day", F.explode(F.sequence(F.date_add("_day", 1), F.date_add("_day", days), F.expr("interval 1 day"))).alias("_next"))
    later = later.join(hits.select(F.col("_day").alias("_next"), F.get("_hits", F.lit(0)).alias("_first")), "_next").groupBy("_day").agg(F.min("_first").alias("_first"))
    found = keyed.join(hits, "_day", "left").join(later, "_day", "left")
    today = F.array_min(F.filter("_hits", lambda m: m >= F.col("_from")))
    return found.withColumn("next_fire", F.coalesce(today, "_first").cast("timestamp_ntz")).drop("_day", "_from", "_hits", "_first")


def cron_initial(rows: DataFrame, spec: str, at: str, days: int, zone: str = "UTC") -> DataFrame:
    """Adds next_fire as `cron_next` does, except that a matching minute that begins exactly at column `at` counts."""
    return cron_next(rows.withColumn("_at", F.col(at) - F.expr("interval 1 microsecond")), spec, "_at", days, zone).drop("_at")


def interval_next(after: Column, seconds: int, start_at: Column, end_at: Column) -> Column:
    """after + interval, not before start_at, null past end_at."""
    fire = F.greatest(after + F.expr(f"interval {seconds} seconds"), start_at)
    return F.when(fire <= end_at, fire)


def failure_windows(runs: DataFrame, size: int) -> DataFrame:
    """Adds bits: successes and failures of the last `size` runs of a tenant's schedule, oldest first; of all runs if size is 0."""
    first = -(size - 1) if size > 0 else Window.unboundedPreceding
    last = Window.partitionBy(*KEY).orderBy("scheduled_at", "event_id").rowsBetween(first, 0)
    return runs.withColumn("bits", F.array_join(F.collect_list(F.when(F.col("success"), "1").otherwise("0")).over(last), ""))


def violates(bits: str, max_sequential: int, min_percent: int) -> Column:
    """Whether a window breaks a failure policy: failures at its end, or its share of successes."""
    trailing = F.length(bits) - F.length(F.rtrim(F.col(bits), F.lit("0")))
    good = F.length(F.replace(F.col(bits), F.lit("0"), F.lit("")))
    too_many = (trailing >= max_sequential) if max_sequential > 0 else F.lit(False)
    too_few = (good * 100 < min_percent * F.length(bits)) if min_percent > 0 else F.lit(False)
    return (F.length(bits) > 0) & (too_many | too_few)


def preflight(runs: DataFrame, schedules: DataFrame) -> DataFrame:
    """Why an occurrence is cancelled before it runs, or OK; the first reason that holds. One with a second chapter has begun and is OK."""
    both = runs.join(schedules, KEY, "left")
    reason = (
        F.when(F.col("n_chapters") > 1, "OK").when(F.col("state").isNull(), "MISSING").when(F.col("state") == "PAUSED", "PAUSED").when(F.col("state") == "ARCHIVED", "ARCHIVED")
        .when(F.col("generation") != F.col("run_generation"), "GENERATION").when(F.col("spec_hash") != F.col("run_spec_hash"), "SPEC").when(F.col("end_at") < F.col("scheduled_at"), "ENDED")
        .when(F.col("violated"), "FAILURE_POLICY").otherwise("OK")
    )
    return both.withColumn("reason", reason)


#: reasons of `preflight`, as the completion detail of a cancelled occurrence and its error chapter name them
REASONS = {
    "MISSING": ("schedule_missing", "schedule missing before app start"), "PAUSED": ("schedule_paused", "schedule paused before app start"),
    "ARCHIVED": ("schedule_archived", "schedule archived before app start"), "GENERATION": ("schedule_generation_mismatch", "schedule generation changed before app start"),
    "SPEC": ("schedule_spec_mismatch", "schedule spec changed before app start"), "ENDED": ("schedule_ended", "schedule ended before app start"),
    "FAILURE_POLICY": ("failure_policy", "schedule failure policy blocked this occurrence"),
}


def cancelled(checked: DataFrame) -> DataFrame:
    """The system error chapter, at ordinal 1, that ends each occurrence which `preflight` gave a reason other than OK."""
    of = lambda k: F.create_map(*(F.lit(x) for name, v in REASONS.items() for x in (name, v[k])))[F.col("reason")]
    rows = checked.where("reason <> 'OK'")
    return rows.select(*KEY, "event_id", F.lit(1).alias("ordinal"), F.lit("cancelled").alias("completion_status"), F.lit("jobdb.schedule_preflight").alias("component"), of(0).alias("code"), of(1).alias("message"))


def successors(checked: DataFrame, next_fire: str) -> DataFrame:
    """The occurrence after each that `preflight` passed at its first chapter: due at next_fire, which counts from the lease.

    With serial overlap it waits until the one before it is over; failure bits are handed on.
    """
    rows = checked.where((F.col("reason") == "OK") & (F.col("n_chapters") <= 1) & F.col(next_fire).isNotNull())
    job = lambda time: expr.schedule_job_id(F.col("schedule_id"), F.col("generation"), F.col(time))
    overlap = F.coalesce(F.nullif(F.col("overlap"), F.lit("")), F.lit("serial")) if "overlap" in checked.columns else F.lit("serial")
    wait = F.when(overlap == "serial", F.array(job("scheduled_at"))).otherwise(F.array().cast("array<string>"))
    return rows.select(*KEY, "event_id", job(next_fire).alias("job_id"), F.col(next_fire).alias("scheduled_at"), job("scheduled_at").alias("previous_job_id"), wait.alias("wait_for"), "bits")


def with_previous(occurrences: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds previous_success to occurrences (tenant_id, previous_job_id): archived with status success; null without a previous job."""
    held = jobs.select("tenant_id", F.col("job_id").alias("previous_job_id"), (F.col("archived_at").isNotNull() & (F.col("completion_status") == "success")).alias("_ok"))
    both = occurrences.join(held, ["tenant_id", "previous_job_id"], "left")
    return both.withColumn("previous_success", F.when(F.col("previous_job_id").isNotNull(), F.coalesce("_ok", F.lit(False)))).drop("_ok")


def members(*parts: tuple[str, Column, Column | None]) -> Column:
    """A JSON object of (name, text, when): members whose `when` is false or null are left out."""
    listed = F.array_compact(F.array(*(F.when(F.lit(True) if when is None else when, F.concat(F.lit(f'"{name}":'), text)) for name, text, when in parts)))
    return F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}"))


def nonzero(name: str, value: Column) -> tuple[str, Column, Column]:
    return name, value.cast("string"), F.coalesce(value, F.lit(0)) != 0


def spec_trigger(kind: Column, expression: Column, zone: Column, start_at: Column, end_at: Column, interval_ns: Column) -> Column:
    """The trigger of `spec_hash` as JSON text; times are UTC texts, what is empty is left out."""
    text = lambda name, c: (name, expr.json_string(c), F.coalesce(c, F.lit("")) != "")
    return members(("kind", expr.json_string(kind), None), text("expression", expression), text("timezone", zone), text("startAt", start_at), text("endAt", end_at), nonzero("interval", interval_ns))


def spec_failure(min_percent: Column, window: Column, max_sequential: Column) -> Column:
    """The failure policy of `spec_hash` as JSON text; zeros are left out."""
    return members(nonzero("minSuccessPercent", min_percent), nonzero("windowSize", window), nonzero("maxSequentialFailures", max_sequential))


def spec_policy(policy: Column) -> Column:
    """A run policy as JSON text, all members there: initial_ns, coefficient, max_ns, max_attempts, non_retryable (array), invocation_ns, total_ns."""
    number = lambda k: F.coalesce(policy[k], F.lit(0)).cast("string")
    or_null = lambda k: F.coalesce(policy[k].cast("string"), F.lit("null"))
    names = F.when(policy["non_retryable"].isNull(), "null").otherwise(expr.json_escaped(F.to_json(policy["non_retryable"])))
    retry = members(
        ("InitialInterval", number("initial_ns"), None), ("BackoffCoefficient", expr.float_text(F.coalesce(policy["coefficient"], F.lit(0.0))), None), ("MaximumInterval", number("max_ns"), None),
        ("MaximumAttempts", number("max_attempts"), None), ("NonRetryableErrorTypes", names, None),
    )
    return members(("Retry", retry, None), ("InvocationTimeout", or_null("invocation_ns"), None), ("TotalTimeout", or_null("total_ns"), None))


def spec_target(job_type: Column, data: Column, artifacts: Column, policy: Column, metadata: Column) -> Column:
    """The target of `spec_hash` as JSON text: data compacted, artifacts (array of name, sha256, size) sorted, what is empty left out but for the policy.

    metadata is canonical JSON text.
    """
    one = lambda a: members(("name", expr.json_string(a["name"]), None), ("sha256", expr.json_string(a["sha256"]), a["sha256"] != ""), nonzero("size", a["size"]))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(artifacts), one), ","), F.lit("]"))
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return members(("jobType", expr.json_string(job_type), None), ("data", expr.json_compact(data), filled(data)), ("artifacts", listed, F.size(artifacts) > 0), ("runPolicy", policy, None), ("metadata", expr.json_escaped(metadata), filled(metadata)))


def spec_hash(trigger: Column, target: Column, overlap: Column, failure: Column) -> Column:
    """sha256 of a schedule's trigger, target, overlap and failure policy as JSON texts, in this order; '' of overlap is serial."""
    shown = expr.json_string(F.coalesce(F.nullif(overlap, F.lit("")), F.lit("serial")))
    return F.concat(F.lit("sha256:"), F.sha2(members(("trigger", trigger, None), ("target", target, None), ("overlapPolicy", shown, None), ("failurePolicy", failure, None)), 256))


def request_error(job_type: Column, data: Column, kind: Column, expression: Column, seconds: Column, overlap: Column, window: Column, percent: Column, failures: Column) -> Column:
    """What is wrong with a schedule request, or '': the first thing that is."""
    low = lambda c: F.coalesce(c, F.lit("")) == ""
    bad = (F.coalesce(window, F.lit(0)) < 0) | ~F.coalesce(percent, F.lit(0)).between(0, 100) | (F.coalesce(failures, F.lit(0)) < 0)
    return (
        F.when(low(job_type), "JOB_TYPE_REQUIRED").when(data.isNull(), "DATA_REQUIRED").when(~F.coalesce(overlap, F.lit("")).isin("", "serial"), "OVERLAP_POLICY")
        .when((kind == "cron") & low(F.trim(expression)), "CRON_REQUIRED").when((kind == "interval") & (F.coalesce(seconds, F.lit(0)) <= 0), "INTERVAL_REQUIRED")
        .when(~F.coalesce(kind, F.lit("")).isin("cron", "interval"), "TRIGGER_KIND").when(bad, "FAILURE_POLICY").otherwise("")
    )


#: commands that set a state, beside upsert (which sets ACTIVE, or PAUSED if it asks so) and trigger (which sets none)
STATES = {"pause": "PAUSED", "resume": "ACTIVE", "archive": "ARCHIVED"}
LOGGED = "tenant_id string, schedule_id string, event_id long, ts timestamp_ntz, command string, result string, state string, generation long, created_at timestamp_ntz, updated_at timestamp_ntz, fire_at timestamp_ntz"


def advance(state: dict | None, row: dict) -> tuple[dict | None, tuple]:
    """A schedule after a command, and what the command gives.

    NOT_FOUND: only upsert makes a schedule. ARCHIVED: an archived one takes nothing but archive. GENERATION: the command
    expects another one. Every command but trigger that is OK raises the generation; upsert keeps created_at.
    """
    command, now, wanted = row["command"], row["ts"], row["expected_generation"]
    archived = state is not None and state["state"] == "ARCHIVED"
    stale = wanted is not None and (state is None or state["generation"] != wanted)
    if command == "upsert":
        result = "ARCHIVED" if archived else "GENERATION" if stale else "OK"
    elif state is None:
        result = "NOT_FOUND"
    elif command == "trigger":
        result = "ARCHIVED" if archived else "OK"
    elif command in STATES:
        result = "GENERATION" if stale else "ARCHIVED" if archived and command != "archive" else "OK"
    else:
        result = "UNKNOWN_COMMAND"
    if result == "OK" and command != "trigger":
        old = state or {"generation": 0, "created_at": now}
        state = {"state": STATES.get(command, "PAUSED" if row["paused"] else "ACTIVE"), "generation": old["generation"] + 1, "created_at": old["created_at"], "updated_at": now}
        state |= {c: row[c] if command == "upsert" else old[c] for c in ("start_at", "end_at")}
        fire = max(now, state["start_at"] or now)
        state["fire_at"] = fire if state["state"] == "ACTIVE" and fire <= (state["end_at"] or fire) else None
    shown = state or dict.fromkeys(("state", "generation", "created_at", "updated_at", "fire_at"))
    return state, (row["tenant_id"], row["schedule_id"], row["event_id"], now, command, result, *(shown[c] for c in ("state", "generation", "created_at", "updated_at", "fire_at")))


def schedule_log(log: DataFrame, every: bool = True) -> DataFrame:
    """Commands on schedules (tenant_id, schedule_id, event_id, ts, command, expected_generation) with their results and the state after.

    Optional columns: paused, start_at, end_at (of an upsert's trigger). fire_at is the first time an interval trigger
    fires, and for a cron trigger the time to give to `cron_initial`; next_job_id is the interval occurrence's. every=False
    returns the state after each schedule's last command only.
    """
    c = lambda name, kind: F.col(name).cast(kind).alias(name) if name in log.columns else F.lit(None).cast(kind).alias(name)
    rows = log.select(
        c("tenant_id", "string"), c("schedule_id", "string"), c("event_id", "long"), c("ts", "timestamp_ntz"), c("command", "string"), c("expected_generation", "long"),
        c("paused", "boolean"), c("start_at", "timestamp_ntz"), c("end_at", "timestamp_ntz"),
    )
    rows = rows.where("schedule_id is not null").withColumn("key", F.to_json(F.struct(*KEY)))
    done = folded(rows, "key", ["ts", "event_id"], advance, None, LOGGED, every)
    return done.withColumn("next_job_id", F.when(F.col("fire_at").isNotNull(), expr.schedule_job_id(F.col("schedule_id"), F.col("generation"), F.col("fire_at"))))


def list_schedules(schedules: DataFrame, tenant: str, ids: list[str] | None = None, states: list[str] | None = None, page_size: int = 0) -> DataFrame:
    """A tenant's schedules of the given ids and states, last updated first and then by id, from the last; a size beyond 1 to 200 is 100."""
    schedules = schedules.where(F.col("tenant_id") == tenant)
    for name, values in (("schedule_id", ids), ("state", states)):
        if values:
            schedules = schedules.where(F.col(name).isin(values))
    return schedules.orderBy(F.desc("updated_at"), F.desc("schedule_id")).limit(page_size if 0 < page_size <= 200 else 100)
