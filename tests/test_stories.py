"""Stories as a fold over their log, and reads through chains of forks."""

import random

import pytest

from jobweave.operators import stories

LOG = "seq long, anthology_id string, story_id string, command string, ordinal long, base_anthology_id string, base_story_id string, last_ordinal long"


def plain(log):
    """All commands in one pass over all stories."""
    held, out = {}, []
    for row in sorted(log):
        r = dict(zip((c.split()[0] for c in LOG.split(", ")), row, strict=True))
        key, base = (r["anthology_id"], r["story_id"]), held.get((r["base_anthology_id"], r["base_story_id"]))
        r |= {"base_live": base is not None and not base[5], "base_latest": base and base[0]}
        r["at"] = r["seq"]
        held[key], result = stories.step(held.get(key), r)
        if held[key] is None:
            del held[key]
        out.append((r["seq"], result, *(held.get(key) or (None,) * 8)))
    return out


def folded(spark, log):
    rows = stories.history(spark.createDataFrame(log, LOG)).collect()
    return sorted((r["seq"], r["result"], *(r[c.split()[0]] for c in stories.VERSION.split(", "))) for r in rows)


def test_linked_stories(spark):
    """What a store has to answer to each command, one by one."""
    b, c = ("anth", "base"), ("anth", "clone")
    said = [
        (*b, "append", 0, None, None, None, "not_found"), (*b, "create", None, None, None, None, "ok"), (*b, "append", 0, None, None, None, "ok"), (*b, "append", 1, None, None, None, "ok"), (*b, "append", 2, None, None, None, "ok"),
        (*b, "create", None, None, None, None, "exists"), (*c, "clone", None, *b, 1, "ok"), (*c, "append", 0, None, None, None, "invalid"), (*c, "append", 2, None, None, None, "ok"), (*c, "append", 4, None, None, None, "invalid"),
        (*c, "append", 2, None, None, None, "chapter_exists"), ("anth", "x", "clone", None, "anth", "missing", 0, "not_found"), ("anth", "y", "clone", None, *b, 99, "range"), (*c, "clone", None, *b, 1, "exists"), (*b, "clone", None, *b, 1, "invalid"),
        ("other", "base", "clone", None, *c, -1, "ok"), ("other", "base", "append", 3, None, None, None, "ok"), (*b, "tombstone", None, None, None, None, "invalid"), (*b, "publish", None, None, None, None, "ok"), (*b, "publish", None, None, None, None, "finalized"),
        (*b, "append", 3, None, None, None, "finalized"), (*b, "tombstone", None, None, None, None, "ok"), (*b, "publish", None, None, None, None, "not_found"), ("anth", "z", "clone", None, *b, 0, "not_found"), (*b, "create", None, None, None, None, "exists"),
        (*c, "delete", None, None, None, None, "ok"), (*c, "delete", None, None, None, None, "not_found"), ("anth", "e", "create", None, None, None, None, "ok"), ("anth", "f", "clone", None, "anth", "e", -1, "range"),
    ]
    log = [(n, *row[:-1]) for n, row in enumerate(said)]
    assert folded(spark, log) == plain(log) and [r[1] for r in plain(log)] == [row[-1] for row in said]
    made = stories.history(spark.createDataFrame(log, LOG))
    every = stories.stories_at(made, deleted=True)
    shown = stories.resolved(every, stories.chapters_at(made)).orderBy("anthology_id", "story_id", "ordinal").collect()
    owned = [(r["anthology_id"], r["story_id"], r["ordinal"], r["owner_anthology"], r["owner_story"], r["depth"]) for r in shown]
    assert owned == [("other", "base", n, *key, d) for n, key, d in ((0, b, 2), (1, b, 2), (2, c, 1), (3, ("other", "base"), 0))]  # through two deleted stories
    assert stories.stories_at(made, 8).count() == 2 and stories.stories_at(made).select("story_id").distinct().count() == 2


def test_any_log(spark, monkeypatch):
    """Random commands of few stories, among them stories that wait for each other, with a base that many are cloned from."""
    monkeypatch.setattr(stories, "SPAN", 16)
    rng = random.Random(11)
    key = lambda: (rng.choice("ab"), f"s{rng.randint(0, 5)}")
    log = [(0, "a", "m1", "clone", None, "a", "m2", 0), (1, "a", "m2", "clone", None, "a", "m1", -1), (2, "a", "m1", "create", None, None, None, None), (3, "a", "m2", "clone", None, "a", "m1", 0), (4, "a", "m1", "append", 0, None, None, None), (5, "a", "m2", "clone", None, "a", "m1", -1)]
    for n in range(6, 260):
        command = rng.choice(["create", "clone", "clone", "append", "append", "append", "append", "publish", "tombstone", "delete"] if n > 120 else ["create", "clone", "append", "append", "append"])
        base = (("a", "s0") if rng.random() < 0.4 else key()) + (rng.randint(-1, 3),) if command == "clone" else (None, None, None)
        log.append((n, *key(), command, rng.randint(0, 4) if command == "append" else None, *base))
    want = plain(log)
    assert folded(spark, log) == want and {r[1] for r in want} >= {"ok", "not_found", "exists", "range", "invalid", "chapter_exists", "finalized"}


@pytest.mark.parametrize(("length", "deep"), [(1023, 0), (1026, 5)])
def test_long_chains(spark, length, deep):
    """Two chains whose ids clash; chapter 0 is the root's, the chapter above each fork a story's own."""
    rows = [(a, f"s{i}", 1 + i % 2, i == 7, *((a, f"s{i - 1}", 0) if i else (None, None, None))) for a in "ab" for i in range(length + 1)]
    table = spark.createDataFrame(rows, "anthology_id string, story_id string, latest_ordinal long, deleted boolean, base_anthology_id string, base_story_id string, fork_ordinal long")
    asked = table.where("not deleted").selectExpr("anthology_id", "story_id", "0L low", "latest_ordinal high")
    got = stories.owners(table, asked).collect()
    assert sum(r["too_deep"] for r in got) == deep + (deep and 1)
    roots = [r for r in got if r["owner_story"] == "s0" and r["low"] == 0]
    assert {r["anthology_id"]: max(x["depth"] for x in roots if x["anthology_id"] == r["anthology_id"]) for r in roots} == {"a": 1023, "b": 1023}
    assert all(r["owner_anthology"] == r["anthology_id"] for r in got)


def test_chains_are_joined_on_numbers(spark, monkeypatch):
    """Ids of stories as text are shuffled once; bases that are missing own what is handed on to them."""
    seen, made = [], stories.lifts
    monkeypatch.setattr(stories, "lifts", lambda links: seen.append(made(links)) or seen[-1])
    rows = [("a", "s1", "a", "s0", 1), ("a", "s2", "a", "s1", 0), ("b", "s1", None, None, None), ("b", "s2", "b", "s1", -1)]
    table = spark.createDataFrame(rows, "anthology_id string, story_id string, base_anthology_id string, base_story_id string, fork_ordinal long")
    asked = table.selectExpr("anthology_id", "story_id", "0L low", "2L high").union(spark.createDataFrame([("c", "new", 0, 2)], "a string, s string, l long, h long"))
    got = sorted(tuple(r) for r in stories.owners(table, asked).collect())
    want = [("a", "s1", "a", "s0", 0, 1, 1), ("a", "s1", "a", "s1", 2, 2, 0), ("a", "s2", "a", "s0", 0, 0, 2), ("a", "s2", "a", "s2", 1, 2, 0)]
    assert got == [(*r, False) for r in (*want, ("b", "s1", "b", "s1", 0, 2, 0), ("b", "s2", "b", "s2", 0, 2, 0), ("c", "new", "c", "new", 0, 2, 0))]
    assert seen and all(kind == "bigint" for t in seen[0] for _, kind in t.dtypes)


def test_no_stories(spark):
    empty = stories.history(spark.createDataFrame([], LOG))
    assert empty.count() == 0 and stories.stories_at(empty).count() == 0
