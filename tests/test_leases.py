"""Lease transitions one by one, and the stream over several micro-batches against the batch fold."""

from jobweave.sources.fixtures import fixture
from jobweave.streaming import leases

SF = "/root/testdata/sf0.001"


class Job:
    """A job's row and chapters, with commands that say only what matters."""

    def __init__(self):
        self.row, self.chapters, self.reports, self.n = leases.new("high"), {}, [], 0

    def __call__(self, command, at, **said):
        c = dict.fromkeys(leases.ASKED) | {"event_id": self.n, "at": float(at), "command": command, "lease_id": "l", "worker": "w", "need": "high", "digest": "d", "outcome": "success"} | said
        self.n += 1
        refused = self.row["n_refused"]
        made = leases.step("job", self.row, c, self.chapters)
        self.reports += [r for r in made if r[1] == "expired"]
        return "ok" if self.row["n_refused"] == refused else made[-1][leases.NAMES.index("result")]


def test_transitions():
    j = Job()
    assert j("append", 0) == "lease_lost" and j("lease", 0, need="low") == "other_need" and j("lease", 0) == "ok" and j.row["until"] == leases.LEASE_SECONDS
    assert j("lease", 29.9, lease_id="m") == "held" and j("keepalive", 20, worker="v") == "late" and j("keepalive", 29.9, worker="v") == "lease_lost"
    assert j("append", 29.9, worker="v") == "ok" and j("append", 29.9, ordinal=0) == "chapter_exists" and j("append", 29.9, ordinal=2) == "not_appendable"  # an append names the lease alone
    assert j("lease", 30, lease_id="m", worker="w") == "ok" and len(j.reports) == 1  # a worker's first lease is lost when it gets a second one
    assert j("keepalive", 31) == "lease_lost" and j("keepalive", 31, lease_id="m", seconds=60.0) == "ok" and j.row["until"] == 91
    assert j("reschedule", 32, lease_id="m", need="") == "invalid" and j("reschedule", 32, lease_id="m", alternate_after=1.0) == "invalid" and j("reschedule", 32, lease_id="m", alternate_need="x", alternate_after=-1.0) == "invalid"
    assert j("reschedule", 32, lease_id="m", need="low", wait_until=50.0, alternate_need="other", alternate_after=30.0) == "ok" and j.row["lease_id"] is None
    assert j("lease", 40, need="low") == "waiting" and j("lease", 62, need="low") == "other_need" and j("lease", 62, need="other") == "ok" and j.row["need"] == "other" and j.row["alternate_need"] is None
    assert j("complete", 63, ordinal=0, digest="e") == "chapter_exists" and j("complete", 63, ordinal=5) == "not_appendable" and j("complete", 63, worker="") == "lease_lost"
    assert j("complete", 63, ordinal=0) == "ok" and j.row["archived_at"] == 63 and j.row["latest_ordinal"] == 0  # the chapter is there already, word for word
    assert j("lease", 64, need="other") == "archived" and j("complete", 64) == "lease_lost"
    assert j("cancel", 65) == "ok" and (j.row["archived_at"], j.row["completion"], j.row["cancelled"]) == (63, "success", True)
    k = Job()
    assert k("cancel", 1) == "ok" and (k.row["archived_at"], k.row["completion"]) == (1, "cancelled") and k("lease", 2) == "archived" and not k.reports


def test_stream_in_several_batches(spark, tmp_path):
    """Files in the order of time, one a micro-batch; a second run with the same folder goes on from the stored states."""
    log = fixture(spark, SF, "fx_lease_log")
    cuts = [0, 150, 300, 450, 10_000]
    source = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        log.where(f"ts >= timestamp_ntz'2024-01-01' + interval {a} seconds and ts < timestamp_ntz'2024-01-01' + interval {b} seconds").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 1 or k == 3:
            rows = leases.run(source(), f"{tmp_path}/base", "high")
    last = leases.commands(log)
    want = leases.fold(last, "high", last.agg({"at": "max"}).first()[0] - 5).cache()
    for kind, columns in (("expired", ["job", "lease_id", "until", "latest_ordinal"]), ("refused", ["job", "event_id", "result", "asked_ordinal", "latest_ordinal"])):
        got, plain = ([tuple(r) for r in x.where(f"kind = '{kind}'").select(*columns).collect()] for x in (rows, want))
        assert sorted(got, key=str) == sorted(plain, key=str) and got
    state = [sorted(map(str, leases.states(x).collect())) for x in (rows, want)]
    assert state[0] == state[1] and rows.select("batch").distinct().count() >= 4
    assert rows.where("kind = 'state'").groupBy("batch").count().agg({"count": "max"}).first()[0] <= 15


class Store:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = ([*value[0]],)


def test_chapters_are_stored_in_blocks():
    """A micro-batch of many appends takes a call of the state store for each block, not for each chapter."""
    store, row = Store(), leases.new("high")
    n = 2 * leases.BLOCK + 3
    for until in (n, 2 * n):  # two micro-batches; the second goes on inside a block
        chapters = leases.Chapters(store, row["latest_ordinal"])
        while row["latest_ordinal"] < until - 1:
            assert leases.appended(row, {"ordinal": -1, "digest": f"d{row['latest_ordinal'] + 1}"}, chapters, False) == "ok"
        same = [leases.appended(row, {"ordinal": k, "digest": d}, chapters, True) for k, d in ((0, "d0"), (leases.BLOCK, f"d{leases.BLOCK}"), (until - 1, f"d{until - 1}"), (1, "d0"))]
        assert same == ["ok", "ok", "ok", "chapter_exists"]
        chapters.save()
    assert [d for _, (block,) in sorted(store.held.items()) for d in block] == [f"d{k}" for k in range(2 * n)]
    assert store.calls < n // 4
