"""Cases that the fixture tables do not reach."""

import pytest
from pyspark.sql import functions as F

from jobweave import catalogue
from jobweave.functions import expr
from jobweave.operators import history, listing, schedules
from jobweave.streaming import fold


def test_cron_fields():
    assert schedules.parse_cron("5/15 * * * *")[0] == [5]
    assert schedules.parse_cron("0 0 * * 7")[4] == [0]
    assert schedules.parse_cron("0-10/5 1,2 * * *")[:2] == [[0, 5, 10], [1, 2]]
    for bad in ("* * * *", "61 * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            schedules.parse_cron(bad)


def test_cron_day_and_weekday_both_hold(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",)], ["t"]).select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert str(schedules.cron_next(df, "0 0 13 * 5", "t", 400).first()["next_fire"]) == "2024-09-13 00:00:00"
    assert schedules.cron_next(df, "0 0 30 2 *", "t", 400).first()["next_fire"] is None


def test_cron_daylight_saving(spark):
    df = spark.createDataFrame([("2024-11-03 05:30:00",), ("2024-03-10 00:00:00",)], ["t"]).select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = {str(r["t"]): str(r["next_fire"]) for r in schedules.cron_next(df, "30 1 * * *", "t", 5, "America/New_York").collect()}
    assert got["2024-11-03 05:30:00"] == "2024-11-03 06:30:00"  # 01:30 comes twice
    missing = schedules.cron_next(df.where("t < '2024-05-01'"), "30 2 10 3 *", "t", 3, "America/New_York").first()
    assert missing["next_fire"] is None  # 02:30 never comes that day


def test_failure_policy(spark):
    df = spark.createDataFrame([("1100",), ("0111",), ("",), ("01",)], ["bits"])
    assert [r[0] for r in df.select(schedules.violates("bits", 2, 0)).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(schedules.violates("bits", 0, 60)).collect()] == [True, False, False, True]


def test_metadata_by_encoding(spark):
    df = spark.createDataFrame([('{"app":{"n":1.0,"s":"1"}}',), ('{"app":{"n":2}}',), ("{bad",), (None,)], ["metadata"])
    assert [r[0] for r in df.select(listing.metadata_matches({("n",): [1]})).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(listing.metadata_matches({("s",): [1]})).collect()] == [False] * 4
    assert [r[0] for r in df.select(listing.metadata_matches({("s",): ["1"]})).collect()] == [True, False, False, False]


def test_request_checks():
    for bad in ({"tenants": []}, {"tenants": ["a"], "statuses": ["X"]}, {"tenants": ["a"], "parents": ["p"], "root_only": True}, {"tenants": ["a"], "metadata": {("x",): [None]}}):
        with pytest.raises(ValueError):
            listing.ListRequest(**bad).check()


def test_needs_and_hashes(spark):
    df = spark.createDataFrame([("a:b:c",), (":x",), ("plain",)], ["need"])
    assert [r[0] for r in df.select(expr.job_type_of("need")).collect()] == ["a", ":x", "plain"]
    assert [r[0] for r in df.select(expr.task_type_of("need")).collect()] == ["b:c", "x", "plain"]
    meta = spark.createDataFrame([('{"app":{"schema_hash":"h1"}}',), ('{"schemaHash":"h0","app":{"schema_hash":"h1"}}',), ("{",)], ["m"])
    assert [r[0] for r in meta.select(expr.schema_hash_of("m")).collect()] == ["h1", "h0", ""]


def test_transitions():
    s = fold.step(fold.NEW, "append", 0.0, "w")
    assert s[6] == 1  # no lease
    s = fold.step(s, "lease", 0.0, "w")
    assert s[0] == "ACTIVE" and fold.step(s, "lease", 1.0, "v")[6] == 2 and fold.step(s, "append", 1.0, "v")[6] == 2  # another worker
    assert fold.step(s, "lease", fold.LEASE_SECONDS, "v")[:3] == ("ACTIVE", 2.0 * fold.LEASE_SECONDS, "v")  # lapsed leases are taken again
    assert fold.step(s, "keepalive", 5.0, "w")[1] == 5.0 + fold.LEASE_SECONDS and fold.step(s, "reschedule", 5.0, "w")[0] == "READY"
    done = fold.step(fold.step(s, "append", 1.0, "w"), "complete", 2.0, "w")
    assert done[:6] == ("COMPLETED", 0.0, None, 2.0, 2, 1) and fold.step(done, "lease", 9.0, "w")[6] == 2
    assert fold.step(done, "cancel", 3.0)[:2] == ("CANCELLED", 0.0) and fold.step(s, "fail", 3.0, "w")[0] == "COMPLETED"
    assert fold.step(done, "cancel", 1.0) == (*done[:6], done[6] + 1)  # late


def test_filter_algebra(spark):
    f, equal = listing.Filter(), listing.Filter.equal
    assert f.or_(equal("a", 1)).or_(equal("a", 2)).and_(equal("b", "x")).predicates() == [("a", [1, 2]), ("b", ["x"])]
    assert listing.Filter.of({("a",): [1, 2], ("b",): ["x"]}).predicates() == [("a", [1, 2]), ("b", ["x"])]
    for bad in (lambda: equal("a.b", 1), lambda: equal(" ", 1), lambda: equal("a", None), lambda: equal("a", 1).or_(equal("b", 1)), lambda: equal("a", 1).and_(equal("b", 1)).or_(equal("a", 2))):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([('{"app":{"a":2,"b":"x"}}',), ('{"app":{"a":3,"b":"x"}}',)], ["metadata"])
    assert [r[0] for r in df.select(listing.Filter.of({("a",): [1, 2], ("b",): ["x"]}).column()).collect()] == [True, False]


def test_pages_end(spark):
    t = catalogue.Tables(spark, "/root/testdata/sf0.001")
    request = listing.ListRequest(tenants=["BUILDING"], page_size=100)
    seen = 0
    while True:
        rows, token = listing.list_page(t.fx_jobs, t.fx_wait, catalogue.NOW, request)
        seen += len(rows)
        if token is None:
            break
        request = listing.ListRequest(tenants=["BUILDING"], page_size=100, token=token)
    assert seen == t.fx_jobs.where("tenant_id = 'BUILDING'").count()


def test_unbounded_failure_window_and_small_columns(spark):
    runs = spark.createDataFrame([("t", "s", k, k, k % 3 > 0) for k in range(5)], "tenant_id string, schedule_id string, scheduled_at int, event_id int, success boolean")
    assert max(r["bits"] for r in schedules.failure_windows(runs, 0).collect()) == "01101"
    row = spark.range(1).select(
        expr.key_parts(F.lit("a/b")).alias("p"), expr.key_parts(F.lit("a/b/c")).alias("q"), expr.time_of_ns(F.lit(1_700_000_000_123_456_789)).cast("string").alias("t"),
        expr.manual_job_id(F.lit("s"), F.lit("r"), F.lit(None).cast("timestamp_ntz")).alias("m"),
        expr.retryable_under(F.lit("AppError"), F.lit(None), F.lit(False), F.array(F.lit("A")), F.array(F.lit("A"))).alias("no"),
        expr.retryable_under(F.lit("AppError"), F.lit(None), F.lit(False), F.array(F.lit("A")), F.array(F.lit("B"))).alias("yes"),
        schedules.spec_hash(F.lit("{}"), schedules.spec_target(F.lit("j"), F.lit("1"), F.array().cast("array<struct<name:string,sha256:string,size:long>>"), F.lit("{}"), F.lit("")), F.lit(""), F.lit("{}")).alias("h"),
    ).first()
    import hashlib

    text = '{"trigger":{},"target":{"jobType":"j","data":1,"runPolicy":{}},"overlapPolicy":"serial","failurePolicy":{}}'
    assert tuple(row["p"]) == ("a", "b") and row["q"] is None and row["t"] == "2023-11-14 22:13:20.123456" and row["m"] == "jobdbsched_s_manual_r"
    assert row["no"] is False and row["yes"] is True and row["h"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_event_times_of_attempts(spark):
    """A job attempt begins where the one before it ended, the first when the job was written; tasks have times of their own, else when they were written."""
    rows = [
        (0, "JobStart", 1, None, None), (1, "TaskAttemptOutcome", 5, None, None), (2, "TaskAttemptOutcome", 9, 6, 8), (3, "JobAttemptOutcome", 11, None, 10),
        (4, "RestartExtra", 14, None, 13), (5, "JobAttemptOutcome", 16, 15, None), (6, "JobAttemptOutcome", 20, None, None), (7, "TaskAttemptOutcome", 22, 21, None),
    ]
    at = lambda hour: f"2024-01-01 {hour:02}:00:00" if hour else None
    df = spark.createDataFrame([(job, o, kind, *map(at, times)) for job in "ab" for o, kind, *times in rows if job == "a" or o > 2], "job_id string, ordinal long, chapter_type string, created_at string, started_at string, finished_at string")
    df = df.withColumn("tenant_id", F.lit("t")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "started_at", "finished_at")})
    hours = lambda times: {(r["job_id"], r["ordinal"]): (r["began"].hour, r["ended"].hour) for r in times.collect()}
    want = {0: (1, 1), 1: (5, 5), 2: (6, 8), 3: (1, 10), 4: (14, 13), 5: (10, 16), 6: (16, 20), 7: (21, 22)}
    lone = {o: x for o, x in want.items() if o > 3} | {3: (11, 10)}  # without its first chapter an attempt has its own times
    assert hours(history.event_times(df)) == {("a", o): x for o, x in want.items()} | {("b", o): x for o, x in lone.items()}
    bare = hours(history.event_times(df.drop("started_at", "finished_at").where("job_id = 'a'")))
    assert bare == {("a", o): (b, e) for o, b, e in ((0, 1, 1), (1, 5, 5), (2, 9, 9), (3, 1, 11), (4, 14, 14), (5, 11, 16), (6, 16, 20), (7, 22, 22))}


def test_stream_equals_batch(spark):
    q, sf = catalogue.queries(), "/root/testdata/sf0.001"
    batch, stream = (sorted(map(tuple, q[n](spark, sf).collect())) for n in ("q_fold_final_state", "q_stream_fold"))
    assert batch == stream


def test_stream_fold_goes_on_from_stored_states(spark, tmp_path):
    """Time-ordered files, one a micro-batch, then a second run on the same base, against the batch fold of all rows."""
    kinds = ["lease", "append", "complete", "reschedule", "fail", "keepalive"]
    rows = [("hot" if k % 3 else f"j{k % 7}", k * 60, k, kinds[(k * k + k // 5) % 6], "w") for k in range(3000)]
    all_rows = spark.createDataFrame(rows, "job string, at long, event_id long, command string, worker string").selectExpr("job", "timestamp_seconds(at) ts", "event_id", "command", "worker")
    for k in range(3):
        all_rows.where(f"event_id div 1000 = {k}").orderBy("command").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k:
            source = spark.readStream.schema(all_rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            got = fold.stream_fold(source, f"{tmp_path}/base")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold.fold(all_rows.where(f"event_id < {1000 * (k + 1)}")).collect()))


def test_one_listing_a_page(spark, monkeypatch):
    """A page reads one row more than it shows, instead of a second listing that asks whether any follow."""
    asked, made = [], listing.list_jobs
    monkeypatch.setattr(listing, "list_jobs", lambda *a: asked.append(a) or made(*a))
    t = catalogue.Tables(spark, "/root/testdata/sf0.001")
    every = made(t.fx_jobs, t.fx_wait, catalogue.NOW, listing.ListRequest(tenants=[catalogue.TENANT], page_size=200)).collect()
    few = t.fx_jobs.where(F.col("job_id").isin([r["job_id"] for r in every[:6]]) & (F.col("tenant_id") == catalogue.TENANT)).cache()
    token, seen = None, []
    for more in (True, False):  # the last page is full
        rows, token = listing.list_page(few, t.fx_wait, catalogue.NOW, listing.ListRequest(tenants=[catalogue.TENANT], page_size=3, token=token))
        seen += [r["job_id"] for r in rows]
        assert len(rows) == 3 and (token is not None) == more
    assert seen == [r["job_id"] for r in every[:6]] and len(asked) == 2
