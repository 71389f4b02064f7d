"""Requests, payloads, JSON texts, schemas and integrity on rows that the fixture tables do not hold."""

import pytest
from pyspark.sql import functions as F

from jobweave.functions import expr, jsontext
from jobweave.operators import lifecycle, payloads, quality, schemas

NOW = "2001-08-01 00:00:00"
SHAPE = '{"chapterShape":{"type":"object","required":["ordinal"]},"firstChapterShape":{"properties":{"ordinal":{"const":0}}},"lastChapterShape":false}'


def one(spark, column, schema, row):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_canonical_json():
    assert jsontext.canonical_object('{ "b": 1.0, "a": [1e2, -0, null, true], "é": "<&>\\u2028 x" }') == '{"a":[1e2,-0,null,true],"b":1.0,"é":"\\u003c\\u0026\\u003e\\u2028 x"}'
    assert jsontext.canonical_object('{"x":{}}') == '{"x":{}}' and jsontext.canonical_object('{"a":1,"a":2}') == '{"a":2}'
    assert [jsontext.canonical_object(t) for t in (None, "", "[1]", "{", '{"a":NaN}', '"x"', '{"a":' + "[" * 200000)] == [None] * 7


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ('{"type":"integer"}', "1.0", "1.5"), ('{"type":["null","string"]}', "null", "1"), ('{"enum":[1,"a"]}', "1.0", '"b"'), ('{"const":{"a":[1]}}', '{"a":[1.0]}', '{"a":[2]}'),
        ('{"minimum":2}', "2", "1.9"), ('{"exclusiveMaximum":3}', "2", "3"), ('{"multipleOf":0.5}', "1.5", "1.6"), ('{"minLength":2}', '"日本"', '"a"'), ('{"pattern":"^a+$"}', '"aa"', '"ab"'),
        ('{"items":{"type":"number"},"prefixItems":[true]}', '["x",1]', '["x","y"]'), ('{"uniqueItems":true}', "[1,2]", "[1,1.0]"), ('{"contains":{"const":1}}', "[2,1]", "[2]"),
        ('{"required":["a"],"additionalProperties":false,"properties":{"a":true}}', '{"a":1}', '{"a":1,"b":2}'), ('{"patternProperties":{"^x":{"type":"string"}}}', '{"x1":"a","y":1}', '{"x1":1}'),
        ('{"propertyNames":{"maxLength":1}}', '{"a":1}', '{"ab":1}'), ('{"dependentRequired":{"a":["b"]}}', '{"a":1,"b":1}', '{"a":1}'), ('{"allOf":[{"minimum":1},{"maximum":2}]}', "1", "3"),
        ('{"anyOf":[{"const":1},{"const":2}]}', "2", "3"), ('{"oneOf":[{"minimum":1},{"minimum":2}]}', "1", "2"), ('{"not":{"type":"null"}}', "0", "null"),
        ('{"if":{"minimum":10},"then":{"multipleOf":5},"else":{"maximum":3}}', "15", "4"), ("true", "1", None), ("false", None, "1"),
    ],
)
def test_schema_keywords(schema, good, bad):
    shape = jsontext.load(schema)
    assert good is None or jsontext.problems(jsontext.load(good), shape) == []
    assert bad is None or jsontext.problems(jsontext.load(bad), shape) != []


def test_schema_errors():
    refused = [None, "{}", '{"chapterShape":1}', '{"chapterShape":{},"more":1}', '{"chapterShape":{},"description":2}', '{"chapterShape":{"$ref":"#"}}', '{"chapterShape":{"items":{"pattern":"("}}}']
    assert [schemas.schema_error(t) != "" for t in refused[:6]] == [True] * 6
    assert schemas.schema_error(SHAPE) == "" and schemas.schema_error('{"$schema":"x","chapterShape":true}') == ""


def test_registry_keeps_the_first_and_archives_once(spark):
    asked = spark.createDataFrame([("t", SHAPE, 2), ("t", SHAPE.replace(":", ": "), 1), ("u", SHAPE, 3), ("t", "{}", 1), ("t", None, 1)], "tenant_id string, schema string, n int")
    asked = asked.select("tenant_id", "schema", (expr.at(NOW) + F.make_dt_interval(F.col("n"))).alias("created_at"))
    made = schemas.register(None, asked)
    assert sorted((r["tenant_id"], str(r["created_at"])[:10]) for r in made.collect()) == [("t", "2001-08-02"), ("u", "2001-08-04")]
    assert schemas.register(made, asked).count() == 2 and schemas.refused(asked).count() == 2
    twice = schemas.archive(schemas.archive(made, made.where("tenant_id = 't'"), NOW), made, "2002-01-01 00:00:00")
    assert sorted((r["tenant_id"], r["state"], str(r["archived_at"])[:4]) for r in twice.collect()) == [("t", "ARCHIVED", "2001"), ("u", "ARCHIVED", "2002")]
    with pytest.raises(ValueError):
        schemas.list_schemas(made, "t", "GONE")


def test_selectors_and_chapters(spark):
    registry = schemas.register(None, spark.createDataFrame([("t", SHAPE)], "tenant_id string, schema string").withColumn("created_at", expr.at(NOW)))
    good, other = registry.first()["schema_hash"], "sha256:" + "0" * 64
    rows = [(0, "t", None, None), (1, "t", good, None), (2, "t", other, ""), (3, "t", "md5:1", None), (4, "t", other, SHAPE), (5, "t", None, '{"chapterShape":true}'), (6, "t", None, "{}"), (7, "u", good, None)]
    got = {r["n"]: (r["resolved"], r["error"]) for r in schemas.resolve(spark.createDataFrame(rows, "n int, tenant_id string, wanted_hash string, inline string"), registry).collect()}
    assert [got[n][1] for n in range(8)] == ["", "", "NOT_FOUND", "MALFORMED_HASH", "HASH_MISMATCH", "", "INVALID_SCHEMA", "NOT_FOUND"]
    assert got[0][0] == "" and got[1][0] == good and got[5][0].startswith("sha256:")
    chapters = [("t", "j", 0, "first", good, '{"ordinal":0}'), ("t", "j", 1, "chapter", good, "{}"), ("t", "j", 2, "last", good, '{"ordinal":2}'), ("t", "j", 3, "chapter", "", "{}"), ("t", "j", 4, "chapter", other, "{}"), ("t", "j", 5, "chapter", good, None)]
    frame = spark.createDataFrame(chapters, "tenant_id string, job_id string, ordinal int, role string, schema_hash string, document string")
    assert {r["ordinal"]: r["problem"] for r in schemas.rejected_chapters(frame, registry).collect()} == {1: "/ required ordinal", 2: "/ false", 4: "schema not registered", 5: "/ type"}


JOBS = "tenant_id string, job_id string, job_type string, input_hash string, metadata string, wait_for array<string>"


def test_submit(spark):
    held = spark.createDataFrame([("t", "a", "x", "h", '{"r":1}', ["p", "q"]), ("t", "b", "x", "h", None, None)], JOBS)
    rows = [("a", "x", "h", '{ "r" : 1 }', ["p", "q", "p"], 0), ("a", "x", "h", '{"r":2}', ["p"], 1), ("a", "y", "g", None, None, 2), ("b", "x", "h", '{"z":1}', [], 0), ("b", "x", None, None, None, 1), ("n", "x", "h", None, ["p"], 0), ("n", "x", "h", None, None, 1), ("n", "y", "h", None, None, 2)]
    asked = spark.createDataFrame([("t", *r) for r in rows], JOBS + ", seq int")
    got = {(r["job_id"], r["seq"]): r["result"] for r in lifecycle.submit(asked, held).collect()}
    assert [got[r[0], r[5]] for r in rows] == ["SAME", "METADATA", "JOB_TYPE", "SAME", "INPUT", "NEW", "PREREQUISITES", "JOB_TYPE"]
    assert lifecycle.submit(asked, held.limit(0)).where("result = 'NEW'").count() == 3


def test_restart(spark):
    chapters = spark.createDataFrame([("t", "j", 0, "kind", 1), ("t", "j", 1, "a", 1), ("t", "j", 2, "b", 2), ("t", "j", 3, "b", 0)], "tenant_id string, job_id string, ordinal int, task_type string, attempt int")
    asked = spark.createDataFrame([("t", j, f"new{s}", s) for j, s in (("j", 0), ("j", 1), ("j", 2), ("j", 3), ("j", -1), ("none", 0))], "tenant_id string, prior_job_id string, job_id string, last_step int")
    got = {(r["prior_job_id"], r["last_step"]): (r["result"], r["job_type"], r["next_ordinal"]) for r in lifecycle.restart(asked, chapters).collect()}
    assert got[("j", 0)] == ("OK", "kind", 1) and got[("j", 2)] == ("OK", "kind", 3)
    assert [got[k][0] for k in (("j", 1), ("j", 3), ("j", -1), ("none", 0))] == ["CUTS_RETRIES", "NO_NEXT_CHAPTER", "NEGATIVE_STEP", "NO_SOURCE"]


def test_waits(spark):
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    none, now = at(None), at("2024-01-01 00:00:00")
    cases = [
        (("2024-01-01 00:01:00", None, None), "SLEEP"), (("2024-01-01 01:00:00", None, None), "RESCHEDULE"), (("2023-12-31 00:00:00", None, None), "CONTINUE"), ((None, None, None), "CONTINUE"),
        (("2024-01-01 01:00:00", "2023-12-31 00:00:00", None), "TIMEOUT_INVOCATION"), (("2024-01-01 01:00:00", "2023-12-31 00:00:00", "2023-12-31 00:00:00"), "TIMEOUT_TOTAL"),
        (("2024-01-01 01:00:00", "2024-01-01 00:02:00", None), "SLEEP"),
    ]
    frame = spark.range(1).select(*(lifecycle.await_until(*(at(x) for x in times), now).alias(f"c{i}") for i, (times, _) in enumerate(cases)), lifecycle.await_until(at("2024-01-02 00:00:00"), none, none, now, replay=True).alias("r"))
    row = frame.first()
    assert [row[f"c{i}"]["action"] for i in range(len(cases))] == [want for _, want in cases] and row["r"]["action"] == "NOT_READY"
    waits = spark.createDataFrame([("t", "a", "x"), ("t", "a", "y"), ("t", "b", "none"), ("t", "c", "y")], "tenant_id string, job_id string, dep_job_id string")
    states = spark.createDataFrame([("t", "x", "READY"), ("t", "y", "COMPLETED"), ("u", "none", "READY")], "tenant_id string, job_id string, status string")
    got = {r["job_id"]: (r["done"], r["n_awaited"], r["n_pending"], r["first_pending"]) for r in lifecycle.awaited(waits, states).collect()}
    assert got == {"a": (False, 2, 1, "x"), "b": (True, 1, 0, None), "c": (True, 1, 0, None)}


def test_errors_survive_a_failed_job(spark):
    for kind, data in (("AppError", '{"message":"m","level":"warn"}'), ("SystemError", '{"message":"m","component":"c","code":"k","retryable":true}'), ("Timeout", '{"message":"m","scope":"total"}'), ("SystemError", "{}")):
        e = payloads.error(F.col("k"), F.col("d"))
        was, now = one(spark, F.struct(e.alias("was"), payloads.failed_cause(payloads.failed_error(e)).alias("now")), "k string, d string", (kind, data))
        assert was == now
    assert one(spark, payloads.error(F.col("k"), F.col("d")), "k string, d string", ("Odd", None))["code"] == "unknown_payload_kind"
    assert one(spark, payloads.error(F.col("k"), F.col("d")), "k string, d string", ("App", "{}")) is None


def test_completion_and_times(spark):
    ask = lambda *row: tuple(one(spark, payloads.completion(F.col("k"), F.col("d"), F.col("c")), "k string, d string, c boolean", row))
    assert ask(None, None, False) == ("success", "") and ask("App", "{}", True) == ("cancelled", "") and ask("Odd", '{"message":"x"}', False) == ("failed_system", "x")
    times = [one(spark, payloads.rfc3339(F.col("t").cast("timestamp_ntz")), "t string", (t,)) for t in ("2024-01-02 03:04:05", "2024-01-02 03:04:05.120", "2024-01-02 03:04:05.000001")]
    assert times == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.12Z", "2024-01-02T03:04:05.000001Z"]


def test_integrity_finds_what_is_broken(spark):
    chapters = spark.createDataFrame([("t", "a", 0, "JobStart"), ("t", "a", 1, "TaskAttemptOutcome"), ("t", "b", 0, "JobStart"), ("t", "b", 2, "TaskAttemptOutcome"), ("t", "c", 1, "TaskAttemptOutcome")], "tenant_id string, job_id string, ordinal long, chapter_type string")
    broken = {r["job_id"] for r in quality.broken_histories(chapters).collect()}
    assert broken == {"b", "c"}


def test_only_members_that_a_schema_names_are_judged(monkeypatch):
    calls, judge = [], jsontext.problems
    monkeypatch.setattr(jsontext, "problems", lambda *a: calls.append(a) or judge(*a))
    value = jsontext.load('{"a":1,' + ",".join(f'"k{i}":{i}' for i in range(50)) + "}")
    assert jsontext.problems(value, {"properties": {"a": {"type": "string"}}}) == ["/a type"] and len(calls) == 2
    assert judge(value, {"properties": {"a": True}, "additionalProperties": False})[:1] == ["/k0 false"]


def test_rows_of_a_job_are_sorted_once(spark):
    """Task runs: once for all windows and once for the runs. Submits: each side of the join once, the window's order serves it."""
    from jobweave.operators import history, lifecycle

    sorts = lambda frame: frame._jdf.queryExecution().executedPlan().toString().count("Sort [")
    chapters = spark.createDataFrame([], "tenant_id string, job_id string, ordinal long, chapter_type string, task_type string, attempt int, payload_kind string")
    jobs = spark.range(9).selectExpr("'t' tenant_id", "'j' || id job_id", "'x' job_type", "'h' input_hash", "'{}' metadata", "cast(null as array<string>) wait_for", "id seq")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorts(history.task_runs(chapters.unionByName(spark.range(5).selectExpr("'t' tenant_id", "'j' job_id", "id ordinal", "'TaskAttemptOutcome' chapter_type", "'a' task_type", "1 attempt", "'App' payload_kind")))) <= 2
        assert sorts(lifecycle.submit(jobs, jobs.drop("seq"))) <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
