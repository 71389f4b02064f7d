"""Leases in full: one transition of a job's row under commands, as a batch fold and as a stream with keyed state and timers.

A command has job, ts, event_id, command, lease_id, worker, and by its kind: need and seconds (lease), seconds
(keepalive), ordinal and digest (append, complete; an ordinal below 0 is the next one), need, wait_until, alternate_need
and alternate_after (reschedule), outcome (complete). Times are seconds.

The stream keeps each job's row and the digests of its chapters in the state store; a micro-batch touches only the jobs it
has commands for. Each lease sets a timer for its end on event time, so that a lease that runs out without another command
is reported too, when the watermark passes. Everything goes to one append-only table, parted by kind: `state` rows of the
jobs that a micro-batch changed, `expired` leases, and `refused` commands.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from jobweave.streaming.fold import folded

#: Where a command doesn't say.
LEASE_SECONDS = 30.0
ROW = "need string, available_at double, lease_id string, worker string, until double, reported boolean, alternate_need string, alternate_at double, latest_ordinal long, archived_at double, completion string, cancelled boolean, last_at double, n_commands long, n_refused long"
FIELDS = [c.split()[0] for c in ROW.split(", ")]
COMMAND = "event_id long, at double, command string, lease_id string, worker string, need string, seconds double, ordinal long, digest string, wait_until double, alternate_need string, alternate_after double, outcome string"
ASKED = [c.split()[0] for c in COMMAND.split(", ")]
OUT = f"job string, kind string, event_id long, at double, command string, asked_ordinal long, result string, {ROW}"
NAMES = [c.split()[0] for c in OUT.split(", ")]
SHOWN = Row(*NAMES)
#: Chapters whose digests are stored together.
BLOCK = 64
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new(need: str) -> dict:
    """The row of a job just submitted."""
    return dict.fromkeys(FIELDS) | {"need": need, "reported": False, "latest_ordinal": -1, "cancelled": False, "n_commands": 0, "n_refused": 0}


def live(row: dict, lease_id: str | None, worker: str | None, at: float) -> bool:
    """Whether the lease is the job's, and holds at that time; no worker: any."""
    return row["archived_at"] is None and bool(lease_id) and row["lease_id"] == lease_id and (worker is None or row["worker"] == worker) and row["until"] > at


FREE = {"lease_id": None, "worker": None, "until": None, "reported": False}


def appended(row: dict, c: dict, chapters: Chapters | dict[int, str], same: bool) -> str:
    """Writes the chapter if it is the next one. `same`: one that is there already with the same contents counts as written."""
    ordinal = row["latest_ordinal"] + 1 if c["ordinal"] is None or c["ordinal"] < 0 else c["ordinal"]
    if ordinal <= row["latest_ordinal"]:
        return "ok" if same and chapters.get(ordinal) == c["digest"] else "chapter_exists"
    if ordinal != row["latest_ordinal"] + 1:
        return "not_appendable"
    chapters[ordinal] = c["digest"]
    row["latest_ordinal"] = ordinal
    return "ok"


def changed(row: dict, c: dict, chapters: Chapters | dict[int, str]) -> str:
    """Applies a command to the row; what came of it."""
    at, command = c["at"], c["command"]
    if row["last_at"] is not None and at < row["last_at"]:
        return "late"
    row["last_at"] = at
    if command == "cancel":
        row.update(FREE, cancelled=True, archived_at=at if row["archived_at"] is None else row["archived_at"], completion=row["completion"] or "cancelled")
        return "ok"
    if command == "lease":
        fired = row["alternate_need"] is not None and row["alternate_at"] <= at
        if row["archived_at"] is not None or row["cancelled"]:
            return "archived"
        if (row["alternate_need"] if fired else row["need"]) != c["need"]:
            return "other_need"
        if row["lease_id"] is not None and row["until"] > at:
            return "held"
        if row["available_at"] is not None and row["available_at"] > at:
            return "waiting"
        row.update(FREE, need=c["need"], lease_id=c["lease_id"], worker=c["worker"], until=at + (c["seconds"] or LEASE_SECONDS))
        if fired:
            row.update(alternate_need=None, alternate_at=None)
        return "ok"
    if command == "reschedule" and (not c["need"] or (c["alternate_after"] or 0) < 0 or not c["alternate_need"] and (c["alternate_after"] or 0) > 0):
        return "invalid"
    if not live(row, c["lease_id"], None if command == "append" else c["worker"] or "", at):
        return "lease_lost"
    if command == "append":
        return appended(row, c, chapters, False)
    if command == "keepalive":
        row["until"] = at + (c["seconds"] or LEASE_SECONDS)
        return "ok"
    if command == "reschedule":
        alternate = at + (c["alternate_after"] or 0) if c["alternate_need"] else None
        row.update(FREE, need=c["need"], available_at=at if c["wait_until"] is None else c["wait_until"], alternate_need=c["alternate_need"] or None, alternate_at=alternate)
        return "ok"
    result = appended(row, c, chapters, True)
    if result == "ok":
        row.update(FREE, archived_at=at, completion=c["outcome"], cancelled=row["cancelled"] or c["outcome"] == "cancelled", alternate_need=None, alternate_at=None)
    return result


def lapsed(row: dict, at: float) -> bool:
    """Whether the lease has run out by then and nothing has said so."""
    return row["archived_at"] is None and row["lease_id"] is not None and not row["reported"] and row["until"] <= at


def shown(job: str, kind: str, row: dict, c: dict | None = None, result: str | None = None) -> tuple:
    c = c or {"event_id": None, "at": row["until"], "command": None, "ordinal": None}
    return (job, kind, c["event_id"], c["at"], c["command"], c["ordinal"], result, *(row[f] for f in FIELDS))


def step(job: str, row: dict, c: dict, chapters: Chapters | dict[int, str]) -> list[tuple]:
    """The row after a command, and rows to report: a lease that had run out before it, and the command if it is refused."""
    out = []
    if (row["last_at"] is None or c["at"] >= row["last_at"]) and lapsed(row, c["at"]):
        row["reported"] = True
        out.append(shown(job, "expired", row))
    row["n_commands"] += 1
    result = changed(row, c, chapters)
    if result != "ok":
        row["n_refused"] += 1
        out.append(shown(job, "refused", row, c, result))
    return out


def commands(rows: DataFrame) -> DataFrame:
    """Commands with `at` in seconds; fields that are absent are null."""
    names = dict(c.split() for c in COMMAND.split(", "))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    have = {"at": at} | {n: F.col(n).cast(k) if n in rows.columns else F.lit(None).cast(k) for n, k in names.items() if n != "at"}
    return rows.select("job", F.col("ts").cast("timestamp").alias("ts"), *(have[n].alias(n) for n in names))


def fold(rows: DataFrame, need: str, until: float | None = None) -> DataFrame:
    """The three kinds of rows for a table of commands; leases that run out after a job's last command, by `until`."""

    def advance(state: tuple | None, r: dict) -> tuple:
        row, chapters = state or (new(need), {})
        c = {k: r[k] for k in ASKED}
        out = [] if r["turn"] else step(r["job"], row, c, chapters)
        if r["turn"]:
            if until is not None and lapsed(row, until):
                row["reported"] = True
                out.append(shown(r["job"], "expired", row))
            out.append(shown(r["job"], "state", row))
        return (row, chapters), (out,)

    last = rows.select("job").distinct().withColumn("turn", F.lit(1))
    every = rows.withColumn("turn", F.lit(0)).unionByName(last, allowMissingColumns=True)
    made = folded(every, "job", ["turn", "at", "event_id"], lambda s, r: (lambda t: (t[0], ([dict(zip(NAMES, x, strict=True)) for x in t[1][0]],)))(advance(s, r)), None, f"rows array<struct<{OUT.replace(' ', ':')}>>".replace(",:", ","), every=True)
    return made.select(F.explode("rows").alias("r")).select("r.*")


class Chapters:
    """A job's chapter digests in the state store, BLOCK ordinals under one key. Holds one block at a time.

    `latest` is the latest ordinal that is stored: it tells which blocks are there.
    """

    def __init__(self, state, latest: int) -> None:
        self.state, self.latest, self.at, self.block, self.dirty = state, latest, None, [], False

    def to(self, at: int) -> None:
        """Goes to a block."""
        if at != self.at:
            self.save()
            self.at, self.block = at, list(self.state.getValue((at,))[0]) if at * BLOCK <= self.latest else []

    def get(self, ordinal: int) -> str | None:
        self.to(ordinal // BLOCK)
        return self.block[ordinal % BLOCK] if ordinal % BLOCK < len(self.block) else None

    def __setitem__(self, ordinal: int, digest: str) -> None:
        """Chapters are written in the order of their ordinals."""
        self.to(ordinal // BLOCK)
        self.block.append(digest)
        self.dirty = True

    def save(self) -> None:
        if self.dirty:
            self.state.updateValue((self.at,), (self.block,))
            self.latest, self.dirty = max(self.latest, self.at * BLOCK + len(self.block) - 1), False


class Leases(StatefulProcessor):
    """The transition on a stream: a job's row and chapters as state, a timer for the end of its lease."""

    def __init__(self, need: str) -> None:
        self.need = need
        self.kinds = [StructType.fromDDL(k) for k in (ROW, "block long", "digests array<string>")]  # needs the driver's session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.kinds[0])
        self.chapters = handle.getMapState("chapters", self.kinds[1], self.kinds[2])

    def keep(self, row: dict, before: float | None) -> None:
        """Stores the row; the timer goes with the lease's end. Times are whole milliseconds there."""
        self.row.update(tuple(row[f] for f in FIELDS))
        ends = row["until"] if row["lease_id"] is not None and not row["reported"] else None
        if ends != before:
            if before is not None:
                self.handle.deleteTimer(int(before * 1000))
            if ends is not None:
                self.handle.registerTimer(int(ends * 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        row = dict(zip(FIELDS, self.row.get(), strict=True)) if self.row.exists() else new(self.need)
        chapters, out = Chapters(self.chapters, row["latest_ordinal"]), []
        before = row["until"] if row["lease_id"] is not None and not row["reported"] else None
        for c in sorted((r["c"] for r in rows), key=lambda c: (c["at"], c["event_id"])):  # one job's commands of one micro-batch
            out += step(key[0], row, c, chapters)
        chapters.save()
        self.keep(row, before)
        return (SHOWN(*r) for r in (*out, shown(key[0], "state", row)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        row, at = dict(zip(FIELDS, self.row.get(), strict=True)), expiredTimerInfo.getExpiryTimeInMs() / 1000
        if lapsed(row, at):
            row["reported"] = True
            self.row.update(tuple(row[f] for f in FIELDS))
            yield SHOWN(*shown(key[0], "expired", row))
            yield SHOWN(*shown(key[0], "state", row))

    def close(self) -> None:
        pass


def run(source: DataFrame, base: str, need: str, delay: str = "5 seconds") -> DataFrame:
    """Runs the stream of commands until its source has no more, and reads the table it has appended to: OUT and `batch`."""
    spark = source.sparkSession
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        rows = commands(source).withWatermark("ts", delay).select("job", "ts", F.struct(*ASKED).alias("c"))  # one value is read faster than many columns
        made = rows.groupBy("job").transformWithState(Leases(need), StructType.fromDDL(OUT), "append", "EventTime")
        put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")  # noqa: E731  a batch that is run again writes the same place
        made.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(f"{OUT}, batch int").parquet(f"{base}/out")


def states(rows: DataFrame) -> DataFrame:
    """The last row of each job."""
    last = rows.where("kind = 'state'").groupBy("job").agg(F.max_by(F.struct(*FIELDS), F.struct("n_commands", F.coalesce("reported", F.lit(False)))).alias("r"))
    return last.select("job", "r.*")
