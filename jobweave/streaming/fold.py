"""Job state as a fold over commands: one pure transition, run in batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Of the commands here; a runtime that polls every few seconds asks for less.
LEASE_SECONDS = 12 * 3600
STATE = "status string, lease_until double, holder string, last_at double, latest_ordinal long, n_done long, n_conflicts long"
OUT = f"job string, {STATE}"
NEW = ("READY", 0.0, None, None, 0, 0, 0)


def step(state: tuple, command: str, at: float, worker: str | None = None) -> tuple:
    """The state after a command; one that doesn't apply counts as a conflict and changes nothing else.

    lease: needs a job that isn't archived, and is free or its lease has lapsed. keepalive, append, reschedule, complete
    and fail: need a live lease of the worker. reschedule frees the job, complete and fail archive it. cancel applies to
    every job, also to a completed one, and clears the lease. A command older than the last one is late and a conflict.
    """
    status, until, holder, last, ordinal, done, conflicts = state
    if last is not None and at < last:
        return (*state[:6], conflicts + 1)
    live = status == "ACTIVE" and until > at and holder == worker
    if command == "cancel":
        return "CANCELLED", 0.0, None, at, ordinal, done, conflicts
    if command == "lease" and (status == "READY" or status == "ACTIVE" and until <= at):
        return "ACTIVE", at + LEASE_SECONDS, worker, at, ordinal, done, conflicts
    if command == "keepalive" and live:
        return status, at + LEASE_SECONDS, holder, at, ordinal, done, conflicts
    if command == "append" and live:
        return status, until, holder, at, ordinal + 1, done, conflicts
    if command == "reschedule" and live:
        return "READY", 0.0, None, at, ordinal, done, conflicts
    if command in ("complete", "fail") and live:
        return "COMPLETED", 0.0, None, at, ordinal + 1, done + (command == "complete"), conflicts
    return status, until, holder, at, ordinal, done, conflicts + 1


def commands(rows: DataFrame) -> DataFrame:
    """Commands (job, ts, event_id, command, worker) with their times as instants."""
    return rows.select("job", F.col("ts").cast("timestamp").alias("ts"), "event_id", "command", "worker")


def folded(rows: DataFrame, key: str, order: list[str], advance: Callable[[Any, dict], tuple], new: Any, out: str, every: bool = False) -> DataFrame:
    """Each key's rows, in order, through advance(state, row) -> (state, result row); a null key is left out.

    Returns the result row of each key's last row, or of every row. A task reads its keys as a sorted stream and holds
    one state, so that a key may have any number of rows.
    """
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, last = None, new, None
        table = lambda found: pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in found], schema=schema)
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row[key] != at:
                    if last is not None and not every:
                        found.append(last)
                    at, state = row[key], new
                state, last = advance(state, row)
                if every:
                    found.append(last)
            yield table(found)
        if last is not None and not every:
            yield table([last])

    schema = to_arrow_schema(StructType.fromDDL(out))
    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def fold(commands: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """State of each job after its commands, from the stored state of jobs that have one."""
    names = [c.split()[0] for c in STATE.split(", ")]

    def advance(state: tuple, row: dict) -> tuple:
        state = tuple(row[c] for c in names) if row["status"] is not None else step(state, row["command"], row["at"], row["worker"])
        return state, (row["job"], *state)

    timed = commands.withColumn("at", F.unix_micros("ts") / 1e6)
    rows = timed.select("job", "ts", "event_id", "command", "worker", "at", F.lit(0).alias("turn"), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in STATE.split(", ")))
    if stored is not None:
        rows = rows.unionByName(stored.withColumn("turn", F.lit(-1)), allowMissingColumns=True)
    return folded(rows, "job", ["turn", "ts", "event_id"], advance, NEW, OUT)


def stream_fold(commands: DataFrame, base: str) -> DataFrame:
    """The same fold over a stream, run until its source has no more: the state of each job after the last micro-batch.

    Each micro-batch is folded onto the states that the one before left in `base`, read as sorted streams like the batch
    fold; a later run with the same base goes on from there.
    """
    spark = commands.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        stored = batch.sparkSession.read.schema(OUT).parquet(f"{base}/out/batch={n - 1}") if n else None
        fold(batch, stored).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    commands.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{OUT}, batch long").parquet(f"{base}/out")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
