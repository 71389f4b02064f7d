"""What a worker does with jobs: which worker gets which, and where the attempts of a task stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions import expr


def dispatch(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """Jobs (tenant_id, job_id, need, created_at) and the worker that gets each; jobs beyond all limits get none.

    workers has tenant_id, worker, need and free, the number of jobs of that need that the worker takes. The oldest jobs
    go first. Running sums of the workers' limits are met with the jobs' ranks, so that no job has two workers and no
    worker too many jobs. Only as many jobs of a need as its workers take at most are ranked across tasks.
    """
    group = ["tenant_id", "need"]
    asked = workers.where("free > 0").groupBy(*group, "worker").agg(F.sum("free").alias("free"))
    upto = Window.partitionBy(*group).orderBy("worker").rowsBetween(Window.unboundedPreceding, 0)
    spans = asked.withColumn("last", F.sum("free").over(upto)).withColumn("first", F.col("last") - F.col("free"))
    most = asked.groupBy(*group).agg(F.sum("free").alias("n")).agg(F.max("n")).first()[0] or 0
    order = Window.partitionBy(*group).orderBy("created_at", "job_id")
    first = jobs.select(*group, "job_id", "created_at").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    met = first.join(spans, group).where("rank > first and rank <= last")
    return met.select("tenant_id", "job_id", "need", "worker", (F.col("rank") - F.col("first")).alias("place"))


def attempt_loop(outcomes: DataFrame, keys: list[str], policy: dict[str, float], now: str) -> DataFrame:
    """Where each task stands after its stored outcomes: action, attempt and wake_at.

    outcomes has the keys, ordinal, attempt, payload_kind, retry_flag, started_at and created_at. They are gone through in
    order, as a worker does that replays a job: output returns; an outcome after the total deadline, counted from the
    first one's start, ends the task for good; one that took longer than an invocation may is a timeout that can be
    tried again; a failure that can't be, or that was the last attempt, fails; else the next attempt is due after a
    backoff. A next attempt past the total deadline is none. The fold is one expression over a task's few outcomes.
    """
    seconds = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n).cast("decimal(18,6)"))
    rows = outcomes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", "attempt", "payload_kind", "retry_flag", "started_at", "created_at"))).alias("rows"))
    rows = rows.withColumn("deadline", F.get("rows", F.lit(0))["started_at"] + seconds(policy["total_s"]))
    none = F.lit(None).cast("timestamp_ntz")
    state = lambda action, attempt, wake: F.struct(action.alias("action"), attempt.cast("int").alias("attempt"), wake.alias("wake_at"))

    def after(s: Column, x: Column) -> Column:
        late = x["created_at"] - x["started_at"] > seconds(policy["invocation_s"])
        again = F.when(late, True).otherwise(expr.retryable(x["payload_kind"], x["retry_flag"]))
        wake = x["created_at"] + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (expr.backoff_ms(x["attempt"], F.lit(policy["initial_ms"]), F.lit(policy["coefficient"]), F.lit(policy["max_ms"])) / 1000).cast("decimal(18,6)"))
        action = (
            F.when((x["payload_kind"] == "App") & ~late, "RETURN").when(x["created_at"] > F.col("deadline"), "TIMEOUT_TOTAL").when(~again, "FAIL")
            .when(x["attempt"] >= int(policy["max_attempts"]), "FAIL").when(wake > F.col("deadline"), "TIMEOUT_TOTAL").otherwise("RETRY")
        )
        return F.when(s["action"] != "RETRY", s).otherwise(F.when(action == "RETRY", state(action, x["attempt"] + 1, wake)).otherwise(state(action, x["attempt"], none)))

    end = F.aggregate("rows", state(F.lit("RETRY"), F.lit(1), none), after)
    done = rows.withColumn("s", end).select(*keys, "deadline", "s.*")
    over = (F.col("action") == "RETRY") & (F.col("deadline") < expr.at(now))
    return done.select(*keys, F.when(over, "TIMEOUT_TOTAL").otherwise(F.col("action")).alias("action"), "attempt", F.when(~over, F.col("wake_at")).alias("wake_at"))
