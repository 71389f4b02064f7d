"""What chapters carry: outcomes by payload kind, schema documents, outputs of jobs, errors of failed jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators.history import JOB

ERROR = "struct<kind:string,message:string,level:string,component:string,code:string,scope:string,retryable:boolean>"
#: payload kinds and the kind of error that each stands for
ERROR_KINDS = {"AppError": "app", "SystemError": "system", "Timeout": "timeout"}
#: payload kinds and the completion status that a job gets from them
COMPLETIONS = {"App": "success", "AppError": "failed_app", "SystemError": "failed_system", "Timeout": "failed_timeout"}
#: statuses that a completion request may name in two ways
SUCCEEDED = ["", "success", "succeeded"]


def pick(kind: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[kind]


def present(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def field(data: Column, name: str) -> Column:
    return F.get_json_object(data, f"$.{name}")


def error(kind: Column, data: Column) -> Column:
    """The error that a payload stands for; null for application output. A kind that isn't known is an error of its own."""
    flag = field(data, "retryable").cast("boolean")
    known = kind.isin(*ERROR_KINDS)
    return F.when(kind == "App", F.lit(None).cast(ERROR)).otherwise(
        F.struct(
            F.coalesce(pick(kind, ERROR_KINDS), F.lit("system")).alias("kind"),
            F.when(known, F.coalesce(field(data, "message"), F.lit(""))).otherwise(F.concat(F.lit('unsupported payload kind "'), kind, F.lit('"'))).alias("message"),
            F.when(kind == "AppError", field(data, "level")).alias("level"),
            F.when(kind.isin("SystemError", "Timeout"), field(data, "component")).alias("component"),
            F.when(kind.isin("SystemError", "Timeout"), field(data, "code")).when(~known, "unknown_payload_kind").alias("code"),
            F.when(kind == "Timeout", field(data, "scope")).alias("scope"),
            F.when(kind.isin("SystemError", "Timeout"), F.coalesce(flag, F.lit(False))).alias("retryable"),
        ).cast(ERROR)
    )


def outcome(kind: Column, data: Column) -> Column:
    """SUCCEEDED or FAILED, with the error and, for application output, the data."""
    return F.struct(F.when(kind == "App", "SUCCEEDED").otherwise("FAILED").alias("status"), error(kind, data).alias("error"), F.when(kind == "App", data).alias("output"))


def rfc3339(time: Column) -> Column:
    """UTC time with only the digits of the second's fraction that it needs."""
    fraction = F.rtrim(F.date_format(time, ".SSSSSS"), F.lit("0"))
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != ".", fraction).otherwise(""), F.lit("Z"))


def json_text(value: Column) -> Column:
    """The JSON text of a variant, with numbers as variant writes them when it has read its own text; null: JSON null."""
    return F.coalesce(F.to_json(F.parse_json(F.to_json(value))), F.lit("null"))


def body_document(chapter_type: Column, kind: Column, data: Column) -> Column:
    """The body of a schema document as JSON text: kind, and the input, output or outcome. Keys are sorted, empty fields left out."""
    value = F.try_parse_json(data)
    e = lambda name: present(field(data, name))
    flag = field(data, "retryable").cast("boolean")
    message = F.coalesce(field(data, "message"), F.lit(""))
    attrs = F.try_variant_get(value, "$.attrs", "variant")
    app = F.to_json(F.struct(e("level").alias("level"), message.alias("message")))
    app = F.concat(F.coalesce(F.concat(F.lit('{"attrs":'), F.when(attrs.isNotNull(), json_text(attrs)), F.lit(",")), F.lit("{")), F.substring(app, 2, 1 << 30))
    system = F.to_json(F.struct(e("code").alias("code"), e("component").alias("component"), message.alias("message"), F.when(flag, True).alias("retryable")))
    late = F.to_json(
        F.struct(
            F.coalesce(e("after"), F.lit("0s")).alias("after"), e("code").alias("code"), e("component").alias("component"), e("kind").alias("kind"), e("message").alias("message"),
            F.coalesce(flag, F.lit(False)).alias("retryable"), F.coalesce(field(data, "scope"), F.lit("")).alias("scope"),
        )
    )
    around = lambda before, text, after: F.concat(F.lit(before), text, F.lit(after))
    result = F.when(kind == "App", around('{"kind":"success","output":', json_text(value), "}")).when(kind == "AppError", around('{"error":', app, ',"kind":"appError"}'))
    result = result.when(kind == "SystemError", around('{"error":', system, ',"kind":"systemError"}')).when(kind == "Timeout", around('{"kind":"timeout","timeout":', late, "}")).otherwise("null")
    ends = chapter_type.isin("JobAttemptOutcome", "TaskAttemptOutcome")
    named = F.when(chapter_type == "JobAttemptOutcome", '{"kind":"jobAttemptOutcome","outcome":').otherwise('{"kind":"taskAttemptOutcome","outcome":')
    return (
        F.when(chapter_type == "JobStart", around('{"input":', json_text(value), ',"kind":"jobStart"}')).when(chapter_type == "RestartExtra", around('{"kind":"restartExtra","output":', json_text(value), "}"))
        .when(ends, F.concat(named, result, F.lit("}")))
    )


def chapter_document(chapters: DataFrame) -> DataFrame:
    """Adds document: the JSON text of a chapter that schemas are checked against, keys sorted, empty fields left out.

    Takes chapter_type, task_type, attempt, payload_kind, data, ordinal and created_at, and where there are such columns
    artifacts (array of digest, name, size), input_hash, worker_id, max_attempts and backoff_ms.
    """
    have = set(chapters.columns)
    c = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    files = "array<struct<digest:string,name:string,size:long>>"
    before = {
        "artifacts": F.coalesce(c("artifacts", files), F.array().cast(files)), "attempt": F.nullif(c("attempt", "long"), F.lit(0)), "backoffMillis": F.nullif(c("backoff_ms", "long"), F.lit(0)),
    }
    after = {
        "createdAt": rfc3339(F.col("created_at")), "inputHash": present(c("input_hash", "string")), "maxAttempts": F.nullif(c("max_attempts", "long"), F.lit(0)), "ordinal": F.col("ordinal"),
        "taskType": present(c("task_type", "string")), "workerId": present(c("worker_id", "string")),
    }
    inside = lambda fields: F.regexp_extract(F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))), r"(?s)^\{(.*)\}$", 1)
    body = F.concat(F.lit('"body":'), body_document(F.col("chapter_type"), F.col("payload_kind"), F.col("data")))
    document = F.concat(F.lit("{"), F.concat_ws(",", inside(before), body, F.nullif(inside(after), F.lit(""))), F.lit("}"))
    return chapters.withColumn("document", document)


def outputs(jobs: DataFrame, chapters: DataFrame) -> DataFrame:
    """What asking each job (with status) for its output gives: `state` CANCELLED, NOT_COMPLETE, FAILED, MISSING_OUTPUT or OK."""
    last = chapters.where("chapter_type = 'JobAttemptOutcome'").groupBy(*JOB).agg(F.max_by(F.struct("payload_kind", "data"), F.struct("attempt", "ordinal")).alias("o"))
    kind, data = F.col("o.payload_kind"), F.col("o.data")
    state = (
        F.when(F.col("status") == "CANCELLED", "CANCELLED").when((F.col("status") != "COMPLETED") | F.col("o").isNull(), "NOT_COMPLETE")
        .when(kind != "App", "FAILED").when(data.isNull(), "MISSING_OUTPUT").otherwise("OK")
    )
    found = jobs.join(last, JOB, "left").withColumn("state", state)
    return found.select(*JOB, "state", F.when(F.col("state") == "OK", data).alias("output"), F.when(F.col("state") == "FAILED", error(kind, data)).alias("error"))


def completion(kind: Column, data: Column, cancelled: Column) -> Column:
    """Status and detail that a job completes with; a null kind is success, one that isn't known a system failure."""
    status = F.when(cancelled, "cancelled").when(kind.isNull(), "success").otherwise(F.coalesce(pick(kind, COMPLETIONS), F.lit("failed_system")))
    return F.struct(status.alias("status"), F.when(status == "success", "").otherwise(F.coalesce(field(data, "message"), F.lit(""))).alias("detail"))


def requested_status(status: Column) -> Column:
    return F.when(F.coalesce(status, F.lit("")).isin(SUCCEEDED), "success").otherwise(status)


def cancel_reason(detail: Column) -> Column:
    """The reason inside a completion detail; '' without one or where the detail is no JSON."""
    return F.coalesce(field(detail, "reason"), F.lit(""))


def failed_error(cause: Column, prefix: str = "_job_failed") -> Column:
    """An error as the application error of a job that failed with it; `attrs` keeps the cause under marked names."""
    parts = {"": F.lit("true"), "_kind": cause["kind"], "_component": cause["component"], "_code": cause["code"], "_scope": cause["scope"], "_retryable": cause["retryable"].cast("string")}
    attrs = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(prefix + k).alias("k"), v.alias("v")) for k, v in parts.items())), lambda e: e["v"].isNotNull()))
    return F.struct(cause["message"].alias("message"), F.when(cause["kind"] == "app", cause["level"]).otherwise("error").alias("level"), attrs.alias("attrs"))


def failed_cause(failed: Column, prefix: str = "_job_failed") -> Column:
    """The cause that `failed_error` kept; null for an application error that is not marked."""
    get = lambda k: failed["attrs"][prefix + k]
    kind = F.when(get("_kind").isin("timeout", "system"), get("_kind")).otherwise("app")
    cause = F.struct(
        kind.alias("kind"), failed["message"].alias("message"), F.when(kind == "app", failed["level"]).alias("level"), get("_component").alias("component"), get("_code").alias("code"),
        get("_scope").alias("scope"), get("_retryable").cast("boolean").alias("retryable"),
    )
    return F.when(get("") == "true", cause.cast(ERROR))


def find_artifacts(refs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The artifact that each reference (tenant_id, job_id, ordinal, name, digest) names; found is false without one.

    Of the chapter's artifacts (tenant_id, job_id, ordinal, position, name, digest, size) that is the first of the name
    whose digest is the same, where both are known. References that repeat are answered once.
    """
    key = [*JOB, "ordinal", "name"]
    known = F.coalesce("digest", F.lit("")).alias("_d")
    held = artifacts.select(*key, known, F.struct("position", "digest", "size").alias("_a"))
    named = held.groupBy(*key).agg(F.min("_a").alias("_any"), F.min(F.when(F.col("_d") == "", F.col("_a"))).alias("_bare"))
    same = held.where("_d <> ''").groupBy(*key, "_d").agg(F.min("_a").alias("_same"))
    asked = refs.select(*key, "digest").distinct().withColumn("_d", known)
    first = F.when(F.col("_d") == "", F.col("_any")).otherwise(F.least("_bare", "_same"))
    best = asked.join(named, key, "left").join(same, [*key, "_d"], "left").withColumn("_a", first)
    return best.select(*key, "digest", F.col("_a").isNotNull().alias("found"), F.col("_a.position").alias("position"), F.col("_a.size").alias("size"))
