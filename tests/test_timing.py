"""Calendars against a plain scan of minutes, number texts, and tables that take batches."""

import json
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from jobweave.functions import expr
from jobweave.operators import calendar, listing
from jobweave.operators.schedules import parse_cron
from jobweave.sources import tables


def scanned(spec, after, zone, start, end, most=60 * 24 * 500):
    """The first minute that matches, by trying one after the other."""
    minute, hour, day, month, weekday = parse_cron(spec)
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    if start and at < start:
        at = start.replace(second=0, microsecond=0)
    for _ in range(most):
        if end and at > end:
            return None
        local = at.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone))
        if local.minute in minute and local.hour in hour and local.day in day and local.month in month and (local.weekday() + 1) % 7 in weekday:
            return at
        at += timedelta(minutes=1)
    return None


@pytest.mark.parametrize(
    ("spec", "zone"),
    [("30 2 * * *", "America/New_York"), ("*/30 1 * 11 0", "America/New_York"), ("0 0 1 * *", "Asia/Kolkata"), ("15 0,23 * * 1-5", "Australia/Lord_Howe"), ("* * * * *", "UTC"), ("59 23 31 12 *", "Pacific/Apia")],
)
def test_next_fire_in_zones(spark, spec, zone):
    """Around changes of clocks: times that are left out never match, repeated ones twice."""
    times = [datetime(2024, m, d, h, 17, 5) for m, d in ((3, 9), (3, 10), (4, 6), (10, 5), (11, 2), (11, 3), (12, 31)) for h in (0, 5, 6, 14, 23)]
    rows = [(k, a, a + timedelta(days=3) if k % 3 == 1 else None, a + timedelta(days=6) if k % 4 == 2 else None) for k, a in enumerate(times)]
    df = spark.createDataFrame(rows, "id int, a timestamp_ntz, s timestamp_ntz, e timestamp_ntz")
    got = {r["id"]: r for r in calendar.cron_next(df, spec, F.col("a"), zone, F.col("s"), F.col("e")).collect()}
    for k, a, s, e in rows:
        assert got[k]["next_fire"] == scanned(spec, a, zone, s, e) and not got[k]["exhausted"], (k, a)


def test_five_years(spark):
    df = spark.createDataFrame([(datetime(2096, 3, 1),), (datetime(2095, 3, 1, 0, 0),), (datetime(2024, 2, 29, 12, 0),), (None,)], "a timestamp_ntz")
    got = {r["a"]: (r["next_fire"], r["exhausted"]) for r in calendar.cron_next(df, "0 12 29 2 *", F.col("a")).collect()}
    assert got[datetime(2096, 3, 1)] == (None, True)  # 2100 is no leap year
    assert got[datetime(2095, 3, 1)] == (datetime(2096, 2, 29, 12), False) and got[datetime(2024, 2, 29, 12)] == (datetime(2028, 2, 29, 12), False) and got[None] == (None, False)
    assert calendar.cron_next(df.where("false"), "0 12 29 2 *", F.col("a")).count() == 0


def test_number_texts(spark):
    want = {0.0: "0", 1.0: "1", 2.5: "2.5", 1e20: "100000000000000000000", 1e21: "1e+21", 1e-6: "0.000001", 1e-7: "1e-7", 1.25e-10: "1.25e-10", 0.1: "0.1", 1 / 3: "0.3333333333333333", 9007199254740993.0: "9007199254740992", 1.7976931348623157e308: "1.7976931348623157e+308", -1234.5: "-1234.5", 100.0: "100"}
    rows = spark.createDataFrame([(k,) for k in want], "x double").select("x", expr.float_text(F.col("x")).alias("t")).collect()
    assert {r["x"]: r["t"] for r in rows} == want and {k: listing.encoded(k) for k in want} == want
    assert [listing.encoded(x) for x in (9007199254740993, True, "a<b", {"b": 1, "a": [1]}, listing.RawJson(" 1"))] == ["9007199254740993", "true", '"a\\u003cb"', '{"a":[1],"b":1}', " 1"]
    with pytest.raises(json.JSONDecodeError):
        listing.encoded(listing.RawJson("{"))
    with pytest.raises(ValueError, match="no path"):
        expr.variant_path("a'b\"c")


def test_batches(spark, tmp_path):
    folder = f"{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string, n int")
    assert tables.insert(rows((1, "a", 0), (1, "a", 0), (1, "b", 1), (2, None, 0)), folder, "x", ["k"], ["n"]).collect() == [(1, "b", 1)]
    assert sorted(tables.insert(rows((2, None, 0), (2, "c", 0), (3, "d", 0)), folder, "y", ["k"], ["n"]).collect()) == [(2, "c", 0)]
    before = tables.committed(folder, "y")
    assert tables.insert(rows((2, None, 0), (2, "c", 0), (3, "d", 0)), folder, "y", ["k"], ["n"]).collect() == [(2, "c", 0)] and tables.committed(folder, "y") == before
    held = tables.read(spark, folder, rows((1, "", 0)).schema)
    assert sorted(map(tuple, held.collect())) == [(1, "a", 0), (2, None, 0), (3, "d", 0)]
    spark.dataSource.register(tables.BatchTable)
    rows((9, "late", 0)).write.format("batch_table").option("folder", folder).option("batch", "y").mode("append").save()  # raced by another run of the batch
    assert sorted(map(tuple, tables.read(spark, folder, held.schema).collect())) == [(1, "a", 0), (2, None, 0), (3, "d", 0)]
    assert len(list((tmp_path / "t" / "data").glob("*.parquet"))) == sum(len(tables.committed(folder, b)["files"]) for b in "xy")
    assert tables.read(spark, f"{tmp_path}/none", held.schema).count() == 0


def test_chain_beyond_the_limits_of_recursion(spark):
    """A thousand steps and more of two schedules; a schedule whose fourth occurrence is due after its end; one that lacks a step."""
    begin = datetime(2024, 1, 1)
    made = [("t", "a", 1, begin, 60, None, None), ("t", "b", 1, begin, 60, begin, None), ("t", "c", 1, begin, 60, None, begin + timedelta(seconds=130)), ("t", "d", 1, begin, 60, None, None)]
    made = spark.createDataFrame(made, "tenant_id string, schedule_id string, generation int, first_at timestamp_ntz, seconds int, start_at timestamp_ntz, end_at timestamp_ntz")
    steps = [("t", s, n, 5, 90 if n == 1 else 1, True) for s in "abc" for n in range(1100)] + [("t", "d", n, 5, 1, True) for n in (0, 1, 3)]
    runs = spark.createDataFrame(steps, "tenant_id string, schedule_id string, step int, delay_s long, duration_s long, success boolean")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got = {(r["schedule_id"], r["step"]): r for r in calendar.chains(made, runs, 8, 3, 50).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert [sum(k[0] == s for k in got) for s in "abcd"] == [1100, 1100, 3, 2]
    assert got["a", 2]["scheduled_at"] == begin + timedelta(seconds=5 + 60 + 5 + 60) and got["a", 2]["leased_at"] == begin + timedelta(seconds=70 + 90 + 5)
    assert got["a", 1099]["bits"] == "1" * 8 and got["a", 1099]["waits_for"] == got["a", 1098]["job_id"]


def test_conflicts_shuffle_keys_once(spark, tmp_path):
    """Neither side of the join carries its keys again inside a struct; tables of keys alone have no conflicts."""
    rows = spark.createDataFrame([("t", 1, "a", None), ("t", 2, None, 1.0), ("u", 1, "b", 2.0)], "t string, k long, v string, x double")
    assert tables.insert(rows, f"{tmp_path}/t", "x", ["t", "k"], ["v"]).isEmpty()
    again = rows.selectExpr("t", "k", "if(k = 1, 'c', v) v", "x")
    found = tables.insert(again, f"{tmp_path}/t", "y", ["t", "k"], ["v"])
    assert sorted(found.collect()) == [("t", 1, "c", None), ("u", 1, "c", 2.0)] and found.columns == rows.columns
    assert "struct(" not in found._jdf.queryExecution().optimizedPlan().toString()
    only = rows.select("t", "k")
    assert tables.insert(only.union(only), f"{tmp_path}/k", "x", ["t", "k"], ["k"]).isEmpty() and sorted(tables.read(spark, f"{tmp_path}/k", only.schema).collect()) == sorted(only.collect())
