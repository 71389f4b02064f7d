"""Derived columns of jobs, needs, schedules and retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def status(now: str, blocked: str = "blocked") -> Column:
    """Derived job status; the order of the tests matters. `blocked`: a dependency is not archived yet."""
    c = F.col
    archived = F.when(c("cancel_requested") | (F.coalesce("completion_status", F.lit("")) == "cancelled"), "CANCELLED").otherwise("COMPLETED")
    leased = F.when(c("lease_expires_at") > at(now), "ACTIVE").otherwise("CRASH_CONCERN")
    return (
        F.when(c("archived_at").isNotNull(), archived).when(c("cancel_requested"), "CANCELLED").when(F.coalesce("lease_id", F.lit("")) != "", leased)
        .when(c(blocked), "PENDING_JOBS").when(c("available_at") > at(now), "AWAITING_FUTURE").otherwise("READY")
    )


def effective_need(now: str) -> Column:
    """The alternate need once its time has come, else the next need."""
    return F.when((F.coalesce("alternate_need", F.lit("")) != "") & (F.col("alternate_at") <= at(now)), F.col("alternate_need")).otherwise(F.col("next_need"))


def job_type_of(need: str) -> Column:
    """Text before the first colon, unless that is the first character."""
    return F.when(F.instr(need, ":") > 1, F.substring_index(need, ":", 1)).otherwise(F.col(need))


def task_type_of(need: str) -> Column:
    """Text after the first colon, else the whole."""
    return F.when(F.instr(need, ":") > 0, F.expr(f"substr({need}, instr({need}, ':') + 1)")).otherwise(F.col(need))


def capability(job_type: Column, task_type: Column) -> Column:
    return F.concat_ws(":", job_type, F.when(task_type != "", task_type))


def job_key(tenant: str = "tenant_id", job: str = "job_id") -> Column:
    return F.concat_ws("/", tenant, job)


def json_escaped(text: Column) -> Column:
    """JSON text with the characters escaped that matter in HTML, and the two line separators."""
    for c in "<>&\u2028\u2029":
        text = F.replace(text, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return text


def json_string(value: Column) -> Column:
    """A string as JSON text."""
    listed = F.to_json(F.array(value))
    return json_escaped(F.substr(listed, F.lit(2), F.length(listed) - 2))


def json_compact(text: Column) -> Column:
    """JSON text without white space between its parts."""
    return json_escaped(F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|\s+', "$1"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def float_text(value: Column) -> Column:
    """A double as JSON text: the fewest digits that give it back, as a decimal from 1e-6 up to below 1e21, else with an exponent."""

    def shortest(v: Column) -> Column:
        tries = (F.format_string(f"%.{p}e", v) for p in (14, 15))
        text = F.coalesce(*(once(t, lambda t: F.when(t.cast("double") == v, t)) for t in tries), F.format_string("%.16e", v))
        return once(text, lambda t: F.struct(
            F.when(t.startswith("-"), "-").otherwise("").alias("sign"), F.rtrim(F.regexp_replace(F.regexp_extract(t, r"^-?([0-9.]+)e", 1), r"\.", ""), F.lit("0")).alias("digits"),
            F.regexp_extract(t, r"e([+-]?[0-9]+)$", 1).cast("int").alias("power"),
        ))

    def written(s: Column) -> Column:
        digits, power, n = s["digits"], s["power"], F.length(s["digits"])
        whole = F.when(n <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2)))
        plain = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).otherwise(whole)
        point = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(n > 1, ".").otherwise(""), F.substr(digits, F.lit(2)))
        far = F.concat(point, F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string"))
        return F.concat(s["sign"], F.when(digits == "", "0").when((power < -6) | (power >= 21), far).otherwise(plain))

    return once(once(value, shortest), written)


def variant_path(*path: str) -> str:
    """The path of a value by its keys; a key with quotes of both kinds has none."""
    if bad := [p for p in path if "'" in p and '"' in p]:
        raise ValueError(f"no path to {bad}")
    return "$" + "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in path)


def app_value(metadata: str, *path: str) -> Column:
    """Canonical JSON text of a value under `app`, null where the path is missing. Numbers are doubles.

    Numbers inside arrays and objects keep their digits; a zero has no sign.
    """
    value = F.try_variant_get(F.try_parse_json(F.col(metadata)), variant_path("app", *path), "variant")
    kind = F.schema_of_variant(value)
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    string = json_string(F.try_variant_get(value, "$", "string"))
    return F.when(number, float_text(F.try_variant_get(value, "$", "double"))).when(kind == "STRING", string).otherwise(json_escaped(F.to_json(value)))


def schema_hash_of(metadata: str, value: Column | None = None) -> Column:
    """The first schema hash among three keys at the root, under app, then under internal; '' if none.

    Here and below, `value` is the metadata parsed already, for callers that read it more than once.
    """
    value = F.try_parse_json(F.col(metadata)) if value is None else value
    paths = [f"$.{scope}{key}" for scope in ("", "app.", "internal.") for key in ("jobdb_schema_hash", "schema_hash", "schemaHash")]

    def string(path: str) -> Column:
        found = F.try_variant_get(value, path, "variant")
        return F.when(found.isNotNull(), F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.trim(F.try_variant_get(found, "$", "string")), F.lit(""))))

    return F.coalesce(*(string(p) for p in paths), F.lit(""))


def is_object(value: Column) -> Column:
    return F.coalesce(F.to_json(value).startswith("{"), F.lit(False))


def parent_of(parent: str = "parent_job_id", metadata: str = "metadata", value: Column | None = None) -> Column:
    """The parent's id: the column, else `internal.parentJobId` of the metadata, trimmed; '' without one."""
    value = F.try_parse_json(F.col(metadata)) if value is None else value
    internal = F.trim(F.try_variant_get(value, "$.internal.parentJobId", "string"))
    return F.coalesce(F.nullif(F.col(parent), F.lit("")), internal, F.lit(""))


def app_metadata(metadata: str = "metadata", value: Column | None = None) -> Column:
    """What applications see of stored metadata, as JSON text: `app` where there is one, nothing of known internal metadata, else the text as it is.

    Blank metadata and an `app` of null are null; text that is no JSON object comes back as it is.
    """
    raw = F.col(metadata)
    value = F.try_parse_json(raw) if value is None else value
    app, internal = F.try_variant_get(value, "$.app", "variant"), F.try_variant_get(value, "$.internal", "variant")
    known = is_object(internal) & F.coalesce(*(F.when(F.try_variant_get(internal, f"$.{k}", "variant").isNotNull(), True) for k in ("schedule", "schemaHash", "parentJobId")), F.lit(False))
    shown = F.when(app.isNotNull(), F.when(~F.is_variant_null(app), F.to_json(app))).when(known, F.lit(None)).otherwise(raw)
    holds = value.isNotNull() & F.ltrim(raw).startswith("{")  # text that parses and begins so is an object
    return F.when(F.trim(raw) == "", F.lit(None)).when(~holds, raw).otherwise(shown)


def metadata_envelope(app: Column, schedule: Column, schema_hash: Column, parent: Column) -> Column:
    """Stored metadata as JSON text: the application's, normalized, and the runtime's own; null if there is neither.

    Blank text is no application metadata, empty texts are no schema hash and no parent, and schedule is JSON text or null.
    """
    blank = F.trim(F.coalesce(app, F.lit(""))) == ""
    shown = json_escaped(F.to_json(F.try_parse_json(app)))
    member = lambda name, text, when: F.when(when, F.concat(F.lit(f'"{name}":'), text))
    parts = F.array_compact(F.array(member("schedule", schedule, schedule.isNotNull()), member("schemaHash", json_string(schema_hash), schema_hash != ""), member("parentJobId", json_string(parent), parent != "")))
    own = F.when(F.size(parts) > 0, F.concat(F.lit('"internal":{'), F.array_join(parts, ","), F.lit("}")))
    both = F.array_compact(F.array(member("app", shown, ~blank), own))
    return F.when(F.size(both) > 0, F.concat(F.lit("{"), F.array_join(both, ","), F.lit("}")))


def instant(text: Column) -> Column:
    """An RFC 3339 time as UTC without zone; null for other text."""
    ok = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$".replace("\\\\", "\\"))
    time = F.when(ok, text).try_cast("timestamp")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), time.cast("timestamp_ntz"))


def occurrence(metadata: str = "metadata") -> Column:
    """The schedule occurrence that a job's metadata names: schedule_id, generation, spec_hash, scheduled_at, run_id and error; null if none is named.

    error tells what makes the entry invalid: a field of another type (a generation that is no whole number, a time that is
    none), missing fields or another kind.
    """
    entry = F.try_variant_get(F.try_parse_json(F.col(metadata)), "$.internal.schedule", "variant")
    get = lambda k, kind: F.try_variant_get(entry, f"$.{k}", kind)
    kind_of = lambda k: F.coalesce(F.schema_of_variant(get(k, "variant")), F.lit("VOID"))
    text = F.when(kind_of("scheduledAt") == "STRING", get("scheduledAt", "string"))
    time = instant(text)
    typed = [~kind_of(k).isin("STRING", "VOID") for k in ("scheduleId", "specHash", "kind", "runId", "scheduledAt")] + [~kind_of("generation").isin("BIGINT", "VOID"), text.isNotNull() & time.isNull()]
    invalid = typed[0]
    for t in typed[1:]:
        invalid = invalid | t
    zero = time == F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    missing = (F.coalesce(get("scheduleId", "string"), F.lit("")) == "") | (F.coalesce(get("generation", "long"), F.lit(0)) <= 0) | (F.coalesce(get("specHash", "string"), F.lit("")) == "") | F.coalesce(zero, F.lit(True))
    other = ~F.coalesce(get("kind", "string"), F.lit("")).isin("", "schedule_tick")
    found = F.struct(
        get("scheduleId", "string").alias("schedule_id"), F.when(kind_of("generation") == "BIGINT", get("generation", "long")).alias("generation"), get("specHash", "string").alias("spec_hash"), time.alias("scheduled_at"),
        F.coalesce(F.nullif(get("runId", "string"), F.lit("")), run_id(time)).alias("run_id"), F.when(invalid, "INVALID").when(missing, "MISSING_FIELDS").when(other, "OTHER_KIND").alias("error"),
    )
    return F.when(entry.isNotNull() & ~F.is_variant_null(entry), found)


def backoff_ms(attempt: Column, initial: Column, coefficient: Column, cap: Column) -> Column:
    """initial * coefficient ^ (attempt - 1), at most cap, never negative."""
    return F.greatest(F.least(initial * F.pow(coefficient, attempt - 1), cap), F.lit(0.0))


def retryable(kind: Column, flag: Column) -> Column:
    """Whether a failure may be tried again: yes, but system errors if told otherwise, and timeouts unless told so. Output is no failure."""
    return F.when(kind == "App", False).when(kind == "SystemError", F.coalesce(flag, F.lit(True))).when(kind == "Timeout", F.coalesce(flag, F.lit(False))).otherwise(True)


def retryable_under(kind: Column, flag: Column, non_retryable: Column, type_names: Column, refused: Column) -> Column:
    """`retryable` under a policy: not if the error is marked non-retryable or has a type name that the policy refuses."""
    named = F.coalesce(F.arrays_overlap(type_names, refused), F.lit(False))
    return F.when(kind == "Timeout", F.coalesce(flag, F.lit(False))).otherwise((kind != "App") & ~F.coalesce(non_retryable, F.lit(False)) & ~named)


def merged_policy(override: Column, base: Column) -> Column:
    """A run policy of two: fields that are set win; attempts are 1 at least, a coefficient of 0 is 1, negative timeouts are none.

    Fields: initial_ms, coefficient, max_ms, max_attempts (0 or null: not set), non_retryable (array), invocation_ms, total_ms (null: not set).
    """
    set_ = lambda k: F.coalesce(F.nullif(override[k], F.lit(0)), base[k])
    timeout = lambda k: F.when(F.coalesce(override[k], base[k]) >= 0, F.coalesce(override[k], base[k]))
    names = F.when(F.size(override["non_retryable"]) > 0, override["non_retryable"]).otherwise(base["non_retryable"])
    return F.struct(
        set_("initial_ms").alias("initial_ms"), F.coalesce(F.nullif(set_("coefficient"), F.lit(0)), F.lit(1.0)).alias("coefficient"), set_("max_ms").alias("max_ms"),
        F.greatest(F.coalesce(set_("max_attempts"), F.lit(1)), F.lit(1)).alias("max_attempts"), names.alias("non_retryable"), timeout("invocation_ms").alias("invocation_ms"), timeout("total_ms").alias("total_ms"),
    )


def schedule_job_id(schedule: Column, generation: Column, time: Column) -> Column:
    """jobdbsched_<id>_g<generation>_run_<UTC time to the nanosecond>."""
    return F.concat(F.lit("jobdbsched_"), schedule, F.lit("_g"), generation.cast("string"), F.lit("_run_"), run_id(time))


def run_id(time: Column) -> Column:
    """UTC time to the nanosecond."""
    return F.concat(F.date_format(time, "yyyyMMdd'T'HHmmss"), F.date_format(time, "SSSSSS"), F.lit("000Z"))


def manual_job_id(schedule: Column, request: Column, now: Column) -> Column:
    """The id of a job that a schedule is asked for by hand; a request without an id is named by its time."""
    return F.concat(F.lit("jobdbsched_"), schedule, F.lit("_manual_"), F.coalesce(F.nullif(request, F.lit("")), run_id(now)))


def time_of_ns(ns: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))).cast("timestamp_ntz")


def ns_of_time(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) * 1000


def key_parts(key: Column) -> Column:
    """Tenant and job of `tenant/job`; null unless both are there with one slash between."""
    ok = key.rlike("^[^/]+/[^/]+$")
    return F.when(ok, F.struct(F.split_part(key, F.lit("/"), F.lit(1)).alias("tenant_id"), F.split_part(key, F.lit("/"), F.lit(2)).alias("job_id")))


def input_hash(data: Column, artifacts: Column) -> Column:
    """sha256 of the data followed by sorted name|sha256 parts."""
    return F.sha2(F.concat(data, F.array_join(F.array_sort(artifacts), "")), 256)
