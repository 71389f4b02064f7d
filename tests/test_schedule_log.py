"""Schedule commands, blobs, artifact references and poll groups on small rows; the fold on keys of many rows."""

import datetime as dt
import threading

from pyspark.sql import functions as F

from jobweave.operators import listing, payloads, schedules
from jobweave.sources import blobs
from jobweave.streaming import fold

LOG = "tenant_id string, schedule_id string, event_id long, ts timestamp_ntz, command string, expected_generation long, paused boolean, end_at timestamp_ntz"


def day(n):
    return dt.datetime(2024, 1, n)


def test_schedule_commands(spark):
    asked = [
        ("pause", None, "NOT_FOUND"), ("upsert", 1, "GENERATION"), ("upsert", None, "OK"), ("upsert", 2, "GENERATION"), ("trigger", 9, "OK"), ("pause", 1, "OK"), ("resume", 1, "GENERATION"),
        ("resume", None, "OK"), ("archive", 3, "OK"), ("upsert", None, "ARCHIVED"), ("resume", None, "ARCHIVED"), ("trigger", None, "ARCHIVED"), ("archive", None, "OK"), ("odd", None, "UNKNOWN_COMMAND"),
    ]
    log = spark.createDataFrame([("t", "s", i, day(i + 1), c, g, None, None) for i, (c, g, _) in enumerate(asked)], LOG)
    rows = schedules.schedule_log(log).orderBy("event_id").collect()
    assert [r["result"] for r in rows] == [want for *_, want in asked]
    assert [r["generation"] for r in rows] == [None, None, 1, 1, 1, 2, 2, 3, 4, 4, 4, 4, 5, 5]
    assert rows[7]["state"] == "ACTIVE" and rows[7]["created_at"] == day(3) and rows[7]["fire_at"] == rows[7]["updated_at"] == day(8)
    assert rows[7]["next_job_id"] == "jobdbsched_s_g3_run_20240108T000000000000000Z" and rows[5]["next_job_id"] is None
    last = schedules.schedule_log(log, every=False).collect()
    assert len(last) == 1 and last[0]["state"] == "ARCHIVED" and last[0]["generation"] == 5


def test_schedule_triggers_end_and_odd_rows(spark):
    rows = [("t", "a", 1, day(2), "upsert", None, True, None), ("t", "b", 1, day(2), "upsert", None, False, day(1)), ("t", None, 1, day(2), "upsert", None, None, None), ("t", "c", 1, day(2), "upsert", None, None, day(2))]
    got = {r["schedule_id"]: (r["state"], r["fire_at"]) for r in schedules.schedule_log(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {"a": ("PAUSED", None), "b": ("ACTIVE", None), "c": ("ACTIVE", day(2))}
    assert schedules.schedule_log(spark.createDataFrame([], LOG)).count() == 0


def test_schedule_pages(spark):
    rows = spark.range(250).select(F.col("id").cast("string").alias("schedule_id"), F.lit("t").alias("tenant_id"), F.lit("ACTIVE").alias("state"), F.lit(day(1)).alias("updated_at"))
    assert [schedules.list_schedules(rows, "t", page_size=n).count() for n in (0, 201, 200, 7)] == [100, 100, 200, 7]
    assert schedules.list_schedules(rows, "t", ids=["7"], states=["PAUSED"]).count() == 0 and schedules.list_schedules(rows, "t").first()["schedule_id"] == "99"


def test_cron_initial_counts_its_own_minute(spark):
    times = spark.createDataFrame([(dt.datetime(2024, 1, 1, 9, 15),), (dt.datetime(2024, 1, 1, 9, 15, 1),)], "t timestamp_ntz")
    assert [r["next_fire"].minute for r in schedules.cron_initial(times, "*/15 * * * *", "t", 2).orderBy("t").collect()] == [15, 30]


def test_fold_of_a_key_with_most_rows(spark):
    """One key has 60,000 rows over many batches; the state is carried across them."""
    rows = spark.range(60_100).select(F.when(F.col("id") < 60_000, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("n"))
    add = lambda s, r: (s + r["n"], (r["k"], s + r["n"]))
    got = dict(fold.folded(rows, "k", ["n"], add, 0, "k string, total long").collect())
    assert len(got) == 101 and got["hot"] == sum(range(60_000)) and got["60007"] == 60007
    assert fold.folded(rows, "k", ["n"], add, 0, "k string, total long", every=True).count() == 60_100


def test_blobs(spark, tmp_path):
    folder = str(tmp_path / "blobs")
    rows = spark.createDataFrame([(b"a",), (b"a",), (b"",), (None,), (bytes(100_000),)], "content binary")
    blobs.save(rows, folder, exists=False)
    blobs.save(rows.unionByName(spark.createDataFrame([(b"new",)], "content binary")), folder)
    held = blobs.opened(spark, folder)
    assert sorted(r["size"] for r in held.collect()) == [0, 1, 3, 100_000] and blobs.broken(held).count() == 0
    assert blobs.broken(held.withColumn("size", F.lit(1).cast("long"))).count() == 3
    blobs.remove(spark, folder, held.where("size > 1").select("digest"), f"{folder}-2")
    assert sorted(bytes(r["content"]) for r in blobs.opened(spark, f"{folder}-2").collect()) == [b"", b"a"]
    (tmp_path / "plain.bin").write_bytes(b"xyz")
    assert [(r["size"], bytes(r["content"])) for r in blobs.files(spark, str(tmp_path), "*.bin").collect()] == [(3, b"xyz")]


def test_artifact_references(spark):
    held = spark.createDataFrame([("t", "j", 1, 0, "a", "d1", 5), ("t", "j", 1, 1, "a", "d2", 6), ("t", "j", 1, 2, "b", None, 7)], "tenant_id string, job_id string, ordinal int, position int, name string, digest string, size int")
    refs = spark.createDataFrame([("t", "j", 1, n, d) for n, d in (("a", None), ("a", "d2"), ("a", "no"), ("b", "any"), ("c", ""))], "tenant_id string, job_id string, ordinal int, name string, digest string")
    got = {(r["name"], r["digest"]): (r["found"], r["position"]) for r in payloads.find_artifacts(refs, held).collect()}
    assert got == {("a", None): (True, 0), ("a", "d2"): (True, 1), ("a", "no"): (False, None), ("b", "any"): (True, 2), ("c", ""): (False, None)}


def test_artifacts_of_one_name(spark):
    """Many references to many artifacts of one name in one chapter: no pairs of the two are made."""
    held = spark.range(30000).selectExpr("'t' tenant_id", "'j' job_id", "1 ordinal", "cast(30000 - id as int) position", "'a' name", "'d' || id digest", "id size")
    refs = spark.range(30000).selectExpr("'t' tenant_id", "'j' job_id", "1 ordinal", "'a' name", "case when id % 2 = 0 then 'd' || id else 'no' || id end digest")
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = payloads.find_artifacts(refs, held).groupBy("found").agg({"*": "count", "position": "max"}).collect()
    finally:
        stop.cancel()
    assert sorted(map(tuple, got)) == [(False, 15000, None), (True, 15000, 30000)]


def test_poll_groups(spark):
    workers = spark.createDataFrame([("b", ["y", "x"], None), ("a", None, ""), ("c", [], "team=1"), ("c", ["z"], "team=1")], "job_type string, task_types array<string>, signature string")
    assert {r[0]: r[1] for r in listing.poll_groups(workers).collect()} == {"": ["a", "b", "b:x", "b:y"], "team=1": ["c", "c:z"]}
