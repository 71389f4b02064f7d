"""Next fire times from a calendar of days, five years on, and chains of occurrences that follow from them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions import expr
from jobweave.operators.schedules import KEY, parse_cron, violates
from jobweave.streaming.fold import folded

#: Minutes that are searched from the first one on.
SEARCH_MINUTES = 366 * 24 * 60 * 5
DAYS = SEARCH_MINUTES // (24 * 60) + 2


def day_hits(days: DataFrame, spec: str, zone: str) -> DataFrame:
    """Adds `hits` to local days `_day`: all UTC minutes of that day that match, in order. Days have the right date already.

    Local times that a change of clocks leaves out match never, those that it repeats match twice.
    """
    minute, hour, *_ = parse_cron(spec)
    wall = F.array(*(F.expr(f"make_dt_interval(0, {h}, {m}, 0)") for h in hour for m in minute)) if len(hour) * len(minute) < 100 else None
    if wall is None:
        fits = lambda i: F.floor(i / 60).cast("int").isin(hour) & (i % 60).isin(minute)
        wall = F.transform(F.filter(F.sequence(F.lit(0), F.lit(1439)), fits), lambda i: F.make_dt_interval(F.lit(0), F.lit(0), i, F.lit(0)))
    local = F.transform(wall, lambda w: F.col("_day").cast("timestamp_ntz") + w)
    if zone == "UTC":
        return days.withColumn("hits", F.array_sort(local))
    utc = F.flatten(F.transform(local, lambda x: F.transform(F.array(*(F.lit(s) for s in (-3600, -1800, 0, 1800, 3600))), lambda s: F.struct(x.alias("x"), (F.convert_timezone(F.lit(zone), F.lit("UTC"), x) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s)).alias("u")))))
    real = F.filter(utc, lambda p: F.convert_timezone(F.lit("UTC"), F.lit(zone), p["u"]) == p["x"])
    return days.withColumn("hits", F.array_sort(F.array_distinct(F.transform(real, lambda p: p["u"]))))


def cron_next(rows: DataFrame, spec: str, after: Column, zone: str = "UTC", start_at: Column | None = None, end_at: Column | None = None) -> DataFrame:
    """Adds next_fire, the first matching minute after `after` and not before start_at's minute, null past end_at; and `exhausted`,
    whether the search ends without one. Times are UTC without zone.

    The calendar has a row for each day in reach that may fire, with its minutes; days are matched first, and a reverse
    running minimum gives each day the next one that fires. Rows meet it in one join by day.
    """
    _, _, day, month, weekday = parse_cron(spec)
    local = lambda c: c if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), c)
    cursor = F.date_trunc("minute", after).cast("timestamp_ntz") + F.expr("interval 1 minute")
    if start_at is not None:
        cursor = F.when(cursor < start_at, F.date_trunc("minute", start_at).cast("timestamp_ntz")).otherwise(cursor)
    keyed = rows.withColumn("_from", cursor).withColumn("_end", F.lit(None).cast("timestamp_ntz") if end_at is None else end_at).withColumn("_day", F.to_date(local(F.col("_from"))))
    span = keyed.agg(F.min("_day").alias("a"), F.max("_day").alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence(F.col("a"), F.date_add("b", DAYS))).alias("_day"))
    fits = F.month("_day").isin(month) & F.dayofmonth("_day").isin(day) & (F.dayofweek("_day") - 1).isin(weekday)
    fires = day_hits(days.where(fits), spec, zone).where(F.size("hits") > 0)
    calendar = days.join(fires, "_day", "left").withColumn("first", F.get("hits", F.lit(0)))
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)  # some thousand days in all
    calendar = calendar.withColumn("following", F.min("first").over(later)).drop("first")
    met = keyed.join(calendar, "_day", "left")
    today = F.get(F.filter("hits", lambda m: m >= F.col("_from")), F.lit(0))
    found = F.coalesce(today, F.when(F.col("following") >= F.col("_from"), F.col("following")))
    found = F.when(found < F.col("_from") + F.expr(f"interval {SEARCH_MINUTES} minutes"), found)
    ended = F.coalesce(found > F.col("_end"), F.coalesce(F.col("_end") < F.col("_from") + F.expr(f"interval {SEARCH_MINUTES} minutes"), F.lit(False)))
    out = met.withColumn("next_fire", F.when(~F.coalesce(found > F.col("_end"), F.lit(False)), found)).withColumn("exhausted", F.col("_from").isNotNull() & found.isNull() & ~ended)
    return out.drop("_from", "_end", "_day", "hits", "following")


CHAINED = "tenant_id string, schedule_id string, generation long, step int, scheduled_at timestamp_ntz, leased_at timestamp_ntz, previous_at timestamp_ntz, bits string"


def broken(bits: str, max_sequential: int, min_percent: int) -> bool:
    """`violates` for one window."""
    trailing = len(bits) - len(bits.rstrip("0"))
    return bool(bits) and (0 < max_sequential <= trailing or 0 < min_percent and bits.count("1") * 100 < min_percent * len(bits))


def chains(schedules: DataFrame, runs: DataFrame, window: int, max_sequential: int, min_percent: int) -> DataFrame:
    """The occurrences that follow from each schedule's first one, up to its end or to where its failure policy stops it.

    schedules has tenant_id, schedule_id, generation, first_at, seconds, start_at and end_at; runs what happens at each
    step: tenant_id, schedule_id, step, delay_s (from due and free to leased), duration_s, success. An occurrence is made
    when the one before it is leased, due an interval after that moment; with serial overlap it waits until the one
    before is over. It carries the bits of earlier outcomes, to which its own lease adds that of the one before; if they
    break the policy, it is cancelled and has no successor. A schedule's runs are one sorted stream, so that a chain may be
    of any length.
    """

    def later(at: datetime | None, micros: int | None) -> datetime | None:
        return None if at is None or micros is None else at + timedelta(microseconds=micros)

    def latest(*times: datetime | None) -> datetime | None:
        return max((x for x in times if x is not None), default=None)

    def advance(last: dict | None, r: dict) -> tuple[dict | None, tuple]:
        if last is None and r["step"] == 0:
            due, free, before, bits = r["first_at"], None, None, ""
        elif last is None or r["step"] != last["step"] + 1 or broken(last["bits"], max_sequential, min_percent):
            return last, (None,) * 8
        else:
            due, free, before = latest(later(last["leased_at"], r["interval"]), r["start_at"]), later(last["leased_at"], last["duration"]), last["scheduled_at"]
            bits = (last["bits"] + ("1" if last["success"] else "0"))[-window:]
            if due is None or (r["end_at"] is not None and due > r["end_at"]):
                return last, (None,) * 8
        leased = later(latest(due, free), r["delay"])
        made = {"step": r["step"], "scheduled_at": due, "leased_at": leased, "duration": r["duration"], "success": r["success"], "bits": bits}
        return made, (r["tenant_id"], r["schedule_id"], r["generation"], r["step"], due, leased, before, bits)

    micros = lambda c: (F.col(c).cast("decimal(24,6)") * 1000000).cast("long")
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_at", "start_at", "end_at")]
    made_by = schedules.select(*KEY, F.col("generation").cast("long").alias("generation"), *times, micros("seconds").alias("interval"))
    asked = runs.select(*KEY, F.col("step").cast("int").alias("step"), micros("delay_s").alias("delay"), micros("duration_s").alias("duration"), "success")
    rows = folded(asked.join(made_by, KEY).withColumn("key", F.struct(*KEY)), "key", ["step"], advance, None, CHAINED, every=True).where("step is not null")
    job = lambda time: expr.schedule_job_id(F.col("schedule_id"), F.col("generation"), F.col(time))
    stopped = violates("bits", max_sequential, min_percent)
    return rows.select(
        "tenant_id", "schedule_id", "step", job("scheduled_at").alias("job_id"), "scheduled_at", "leased_at", F.when(F.col("previous_at").isNotNull(), job("previous_at")).alias("waits_for"), "bits", F.when(stopped, "failure_policy").alias("cancelled")
    )


def violated_sql(bits: str, max_sequential: int, min_percent: int) -> str:
    """`violates` as SQL text that Spark and DuckDB both run."""
    parts = [f"length({bits}) - length(regexp_replace({bits}, '0+$', '')) >= {max_sequential}"] if max_sequential > 0 else []
    parts += [f"length(replace({bits}, '0', '')) * 100 < {min_percent} * length({bits})"] if min_percent > 0 else []
    return f"(length({bits}) > 0 AND ({' OR '.join(parts) or 'false'}))"
