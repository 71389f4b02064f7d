"""Listing jobs: derived status, filters, keyset paging; lease candidates and plans."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions import expr

STATUSES = ("READY", "ACTIVE", "PENDING_JOBS", "AWAITING_FUTURE", "CRASH_CONCERN", "COMPLETED", "CANCELLED", "EXPIRED")
PAGE, LARGEST_PAGE = 100, 200


@dataclass
class ListRequest:
    """What to list. Given statuses, `stores` is ignored, as the statuses tell the store."""

    tenants: list[str]
    statuses: list[str] = field(default_factory=list)
    stores: list[str] = field(default_factory=list)
    job_types: list[str] = field(default_factory=list)
    job_tasks: list[tuple[str, str]] = field(default_factory=list)
    keys: DataFrame | None = None
    parents: list[str] = field(default_factory=list)
    root_only: bool = False
    created_from: str | None = None
    created_to: str | None = None
    metadata: dict[tuple[str, ...], list] = field(default_factory=dict)
    page_size: int = 0
    token: str | None = None

    def check(self) -> None:
        if not self.tenants:
            raise ValueError("a tenant is required")
        if self.parents and self.root_only:
            raise ValueError("parents and root_only exclude each other")
        if bad := set(self.statuses) - set(STATUSES):
            raise ValueError(f"unknown status {sorted(bad)}")
        if any(v is None for values in self.metadata.values() for v in values):
            raise ValueError("a metadata value can't be null")


def with_blocked(jobs: DataFrame, waits: DataFrame) -> DataFrame:
    """Adds `blocked`: some dependency of the same tenant exists and is not archived."""
    open_jobs = jobs.where("archived_at is null").select("tenant_id", F.col("job_id").alias("dep_job_id"))
    blocked = waits.where("dep_job_id <> ''").join(open_jobs, ["tenant_id", "dep_job_id"], "left_semi").select("tenant_id", "job_id").distinct()
    return jobs.join(blocked.withColumn("_b", F.lit(True)), ["tenant_id", "job_id"], "left").withColumn("blocked", F.coalesce("_b", F.lit(False))).drop("_b")


def with_status(jobs: DataFrame, waits: DataFrame, now: str) -> DataFrame:
    return with_blocked(jobs, waits).withColumn("status", expr.status(now))


class RawJson(str):
    """A metadata value given as JSON text, which is compared as it is written."""


def encoded(value: object) -> str:
    """A metadata value as JSON text: whole numbers with all digits, floats with the fewest."""
    if isinstance(value, RawJson):
        json.loads(value)
        return str(value)
    if isinstance(value, float):
        mantissa, _, power = repr(value).partition("e")
        if value == 0 or 1e-6 <= abs(value) < 1e21:
            text = f"{Decimal(repr(value)):f}"
            return text.rstrip("0").rstrip(".") if "." in text else text
        return f"{mantissa.removesuffix('.0')}e{'-' if power.startswith('-') else '+'}{power.lstrip('+-').lstrip('0')}"
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def metadata_matches(metadata: dict[tuple[str, ...], list]) -> Column:
    """AND over paths of OR over values, by JSON encoding."""
    out = F.lit(True)
    for path, values in metadata.items():
        out &= F.coalesce(expr.app_value("metadata", *path).isin([encoded(v) for v in values]), F.lit(False))
    return out


def page_token(row: dict) -> str:
    body = json.dumps({"created_at": str(row["created_at"]), "tenant": row["tenant_id"], "job": row["job_id"]}, separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def after(token: str) -> Column:
    """Rows that follow a page's last row in (created desc, key desc)."""
    last = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    created, key = expr.at(last["created_at"]), f"{last['tenant']}/{last['job']}"
    return (F.col("created_at") < created) | ((F.col("created_at") == created) & (expr.job_key() < key))


def list_jobs(jobs: DataFrame, waits: DataFrame, now: str, request: ListRequest, more: int = 0) -> DataFrame:
    """A page of jobs in (created desc, key desc), and `more` rows that follow. Filters on stored columns come before the dependency join."""
    request.check()
    r, keep = request, F.col("tenant_id").isin(request.tenants)
    if r.statuses:
        if not {"COMPLETED", "CANCELLED"} & set(r.statuses):
            keep &= F.col("archived_at").isNull()
    elif r.stores and set(r.stores) == {"ACTIVE"}:
        keep &= F.col("archived_at").isNull()
    elif r.stores and set(r.stores) == {"ARCHIVED"}:
        keep &= F.col("archived_at").isNotNull()
    if r.job_types:
        keep &= F.col("job_type").isin(r.job_types)
    if r.job_tasks:
        keep &= F.col("next_need").isin([f"{a}:{b}" for a, b in r.job_tasks if a and b]) if any(a and b for a, b in r.job_tasks) else F.lit(False)
    if r.parents:
        keep &= expr.parent_of().isin(r.parents)
    if r.root_only:
        keep &= expr.parent_of() == ""
    if r.created_from:
        keep &= F.col("created_at") >= expr.at(r.created_from)
    if r.created_to:
        keep &= F.col("created_at") <= expr.at(r.created_to)
    if r.metadata:
        keep &= metadata_matches(r.metadata)
    if r.token:
        keep &= after(r.token)
    some = jobs.where(keep)
    if r.keys is not None:
        some = some.join(r.keys, ["tenant_id", "job_id"], "left_semi")
    size = PAGE if r.page_size <= 0 else min(r.page_size, LARGEST_PAGE)
    size += more
    order = [F.desc("created_at"), F.desc(expr.job_key())]
    if not r.statuses:  # no status decides, so the page is known before any is worked out
        some = some.orderBy(*order).limit(size)
    here = F.col("tenant_id").isin(r.tenants)
    open_jobs = jobs.where(here & F.col("archived_at").isNull()).select("tenant_id", F.col("job_id").alias("dep_job_id"))
    blocked = waits.where(here).join(open_jobs, ["tenant_id", "dep_job_id"], "left_semi").select("tenant_id", "job_id").distinct().withColumn("blocked", F.lit(True))
    found = some.join(blocked, ["tenant_id", "job_id"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False))).withColumn("status", expr.status(now))
    if r.statuses:
        found = found.where(F.col("status").isin(r.statuses))
    return found.orderBy(*order).limit(size)


def list_page(jobs: DataFrame, waits: DataFrame, now: str, request: ListRequest) -> tuple[list, str | None]:
    """The rows of a page, and the token of the next one if more follow."""
    size = PAGE if request.page_size <= 0 else min(request.page_size, LARGEST_PAGE)
    rows = list_jobs(jobs, waits, now, request, 1).collect()  # LARGEST_PAGE rows and one at most
    return rows[:size], page_token(rows[size - 1].asDict()) if len(rows) > size else None


def point_reads(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """The row of each job (tenant_id, job_id) that is asked for, with `found`; a job of another tenant is none."""
    return asked.select("tenant_id", "job_id").join(jobs.withColumn("_here", F.lit(True)), ["tenant_id", "job_id"], "left").withColumn("found", F.coalesce("_here", F.lit(False))).drop("_here")


class Filter:
    """A metadata filter: Empty, field = value, field = one of values, and all of several. Fields are top-level names.

    `predicates()` is what ListRequest.metadata takes, and `of` the way back.
    """

    def __init__(self, *parts: tuple[str, list]) -> None:
        self.parts = list(parts)

    @staticmethod
    def equal(field: str, value: object) -> Filter:
        if not field.strip() or "." in field:
            raise ValueError(f"metadata field {field!r} must be a top-level name")
        if value is None:
            raise ValueError(f"metadata field {field!r} needs a value")
        return Filter((field, [value]))

    @staticmethod
    def of(metadata: dict[tuple[str, ...], list]) -> Filter:
        out = Filter()
        for (field, *deeper), values in metadata.items():
            if deeper or not values:
                raise ValueError("a predicate has one field and a value at least")
            one = Filter()
            for v in values:
                one = one.or_(Filter.equal(field, v))
            out = out.and_(one)
        return out

    def and_(self, other: Filter | None) -> Filter:
        return Filter(*self.parts, *(other.parts if other else []))

    def or_(self, other: Filter | None) -> Filter:
        """Either of two, which must be about one field; with an empty filter, the other one."""
        if other is None or not other.parts:
            return self
        if not self.parts:
            return other
        if len(self.parts) > 1 or len(other.parts) > 1 or self.parts[0][0] != other.parts[0][0]:
            raise ValueError("or needs filters of one field")
        return Filter((self.parts[0][0], self.parts[0][1] + other.parts[0][1]))

    def predicates(self) -> list[tuple[str, list]]:
        return self.parts

    def column(self) -> Column:
        out = F.lit(True)
        for field, values in self.parts:
            out &= metadata_matches({(field,): values})
        return out


def poll_candidates(jobs: DataFrame, waits: DataFrame, now: str, tenant: str, capabilities: list[str], metadata: dict | None = None) -> DataFrame:
    """Jobs of a tenant that may be leased now: not cancelled, no live lease, ready, available, and wanted."""
    some = jobs.where((F.col("tenant_id") == tenant) & F.col("archived_at").isNull())
    free = (F.coalesce("lease_id", F.lit("")) == "") | (F.col("lease_expires_at") <= expr.at(now))
    ok = ~F.col("cancel_requested") & free & (F.col("available_at") <= expr.at(now)) & metadata_matches(metadata or {})
    wanted = some.withColumn("need", expr.effective_need(now)).where(ok & F.col("need").isin(capabilities))
    open_deps = waits.join(some.select("tenant_id", F.col("job_id").alias("dep_job_id")), ["tenant_id", "dep_job_id"], "left_semi")
    return wanted.join(open_deps.select("tenant_id", "job_id").distinct(), ["tenant_id", "job_id"], "left_anti")


def lease_plan(candidates: DataFrame, now: str, limit: int, seconds: int = 30) -> DataFrame:
    """The first `limit` candidates by (created, job), with the lease each would get."""
    first = candidates.orderBy("created_at", "job_id").limit(limit)
    place = F.row_number().over(Window.orderBy("created_at", "job_id"))  # over at most `limit` rows
    return first.select("tenant_id", "job_id", F.col("need").alias("next_need"), place.alias("place"), (expr.at(now) + F.expr(f"interval {seconds} seconds")).alias("expires_at"))


def poll_groups(workers: DataFrame) -> DataFrame:
    """What a fleet of workers (job_type, task_types, signature) polls for: one sorted list of capabilities for each signature.

    The signature is the text of a worker's metadata filter, '' without one.
    """
    tasks = F.transform(F.coalesce("task_types", F.array().cast("array<string>")), lambda t: expr.capability(F.col("job_type"), t))
    able = workers.select(F.coalesce("signature", F.lit("")).alias("signature"), F.explode(F.concat(F.array("job_type"), tasks)).alias("capability"))
    return able.groupBy("signature").agg(F.array_sort(F.collect_set("capability")).alias("capabilities"))
