"""A registry of JSON Schemas addressed by content, selectors that name them, and chapters checked against them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobweave.functions import expr, jsontext

KEY = ["tenant_id", "schema_hash"]
HASH = r"^sha256:[0-9a-f]{64}$"
#: the fields that a schema document may have
DESCRIBING, SHAPES = ["$schema", "description"], ["chapterShape", "firstChapterShape", "lastChapterShape"]


def schema_error(canonical: str | None) -> str:
    """Why a canonical document can't be registered, or ''."""
    if canonical is None:
        return "schema must be a JSON object"
    document = jsontext.load(canonical)
    for name, value in document.items():
        if name not in DESCRIBING + SHAPES:
            return f"unknown schema field {name}"
        if name in DESCRIBING and not isinstance(value, str | None):
            return f"{name} must be a string"
    if "chapterShape" not in document:
        return "chapterShape is required"
    for name in SHAPES:
        shape = document.get(name, True)
        if not isinstance(shape, dict | bool):
            return f"{name} must be a JSON Schema object or boolean"
        if unknown := jsontext.unknown_keywords(shape):
            return f"unsupported keyword {min(unknown)}"
        try:
            jsontext.problems({}, shape)
        except (TypeError, AttributeError, ValueError, re.error) as e:
            return f"{name} is no schema: {type(e).__name__}"
    return ""


@F.pandas_udf(StringType())
def schema_errors(canonical: pd.Series) -> pd.Series:
    return canonical.map(schema_error)


def hash_of(canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical.cast("binary"), 256))


def hashed(rows: DataFrame, column: str = "schema") -> DataFrame:
    """Adds canonical (null unless a JSON object) and schema_hash."""
    return rows.withColumn("canonical", jsontext.canonical(column)).withColumn("schema_hash", hash_of(F.col("canonical")))


def register(registry: DataFrame | None, requests: DataFrame) -> DataFrame:
    """The registry after requests (tenant_id, schema, created_at): a schema already there keeps its row, state and time.

    Texts that are the same document are one schema; the earliest request counts. Requests that `schema_error` refuses
    are left out; `refused` returns them.
    """
    new = hashed(requests).where(schema_errors("canonical") == "").groupBy(*KEY).agg(F.first("canonical").alias("schema"), F.min("created_at").alias("created_at"))
    new = new.withColumn("state", F.lit("ACTIVE")).withColumn("archived_at", F.lit(None).cast("timestamp_ntz"))
    return new if registry is None else registry.unionByName(new.join(registry, KEY, "left_anti"))


def refused(requests: DataFrame) -> DataFrame:
    return hashed(requests).withColumn("error", schema_errors("canonical")).where("error <> ''")


def archive(registry: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """The registry with the named schemas archived; the first archive time stays."""
    named = keys.select(*KEY).distinct().withColumn("_named", F.lit(True))
    both = registry.join(named, KEY, "left")
    hit = F.coalesce("_named", F.lit(False))
    return both.select(
        *KEY, "schema", "created_at", F.when(hit, "ARCHIVED").otherwise(F.col("state")).alias("state"),
        F.when(hit, F.coalesce("archived_at", expr.at(now))).otherwise(F.col("archived_at")).alias("archived_at"),
    )


def list_schemas(registry: DataFrame, tenant: str, state: str = "ACTIVE") -> DataFrame:
    """Schemas of a tenant, newest first and then by hash; state ACTIVE, ARCHIVED or ALL."""
    if state not in ("ACTIVE", "ARCHIVED", "ALL"):
        raise ValueError(f"unknown state {state}")
    rows = registry.where(F.col("tenant_id") == tenant)
    return (rows if state == "ALL" else rows.where(F.col("state") == state)).orderBy(F.desc("created_at"), "schema_hash")


def resolve(selectors: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds resolved and error to selectors (tenant_id, wanted_hash, inline): the schema that a new job gets.

    No selector resolves to ''. An inline schema is registered if it is new, so it must only be valid; one given with a
    hash must have that hash; a hash alone must be registered; an archived schema is refused.
    """
    rows = selectors.withColumn("_hash", F.trim(F.coalesce("wanted_hash", F.lit("")))).withColumn("_inline", F.trim(F.coalesce("inline", F.lit(""))))
    rows = rows.withColumn("_canonical", F.when(F.col("_inline") != "", jsontext.canonical("_inline"))).withColumn("_computed", hash_of(F.col("_canonical")))
    rows = rows.withColumn("_refused", F.when(F.col("_inline") != "", schema_errors("_canonical")).otherwise("")).withColumn("schema_hash", F.coalesce("_computed", "_hash"))
    both = rows.join(registry.select(*KEY, F.col("state").alias("_state")), KEY, "left")
    error = (
        F.when((F.col("_hash") != "") & ~F.col("_hash").rlike(HASH), "MALFORMED_HASH").when(F.col("_refused") != "", "INVALID_SCHEMA")
        .when((F.col("_hash") != "") & (F.col("_computed") != F.col("_hash")), "HASH_MISMATCH").when(F.col("schema_hash") == "", "")
        .when(F.col("_state").isNull() & (F.col("_inline") == ""), "NOT_FOUND").when(F.col("_state") == "ARCHIVED", "ARCHIVED").otherwise("")
    )
    out = both.withColumn("error", error).withColumn("resolved", F.when(error == "", F.col("schema_hash")))
    return out.select(*selectors.columns, "resolved", "error")


def role(ordinal: Column, completes: Column) -> Column:
    """first for the start, last for the outcome that completes a job, else chapter."""
    return F.when(ordinal == 0, "first").when(completes, "last").otherwise("chapter")


def shape(schema: Column, role: Column) -> Column:
    """The JSON Schema for a role: its own, or chapterShape where the document has none for it."""
    own = F.when(role == "first", F.get_json_object(schema, "$.firstChapterShape")).when(role == "last", F.get_json_object(schema, "$.lastChapterShape"))
    return F.coalesce(own, F.get_json_object(schema, "$.chapterShape"))


def rejected_chapters(chapters: DataFrame, registry: DataFrame) -> DataFrame:
    """Chapters (tenant_id, job_id, ordinal, role, schema_hash, document) that their job's schema rejects, and why.

    Chapters without a schema hash pass. A hash that is not registered is a problem of its own.
    """
    roles = F.explode(F.array(*map(F.lit, ("first", "chapter", "last"))))
    shapes = registry.select(*KEY, roles.alias("_role"), "schema").select(*KEY, "_role", F.lit(True).alias("_here"), shape(F.col("schema"), F.col("_role")).alias("_shape"))
    own = F.when(F.col("role").isin("first", "last"), F.col("role")).otherwise("chapter")
    held = chapters.where("coalesce(schema_hash, '') <> ''").withColumn("_role", own).join(shapes, [*KEY, "_role"], "left")
    found = F.when(F.col("_here").isNull(), "schema not registered").otherwise(jsontext.first_problem("document", "_shape"))
    return held.withColumn("problem", found).where("problem <> ''").select("tenant_id", "job_id", "ordinal", "role", "schema_hash", "problem")
