"""Stories: a log of creations, clones, appends, publications and deletions as row versions; reads as of a commit; forks.

A log has one row a command: `seq` (commit number, unique), anthology_id, story_id, command, ordinal (append),
base_anthology_id, base_story_id and last_ordinal (clone; less than 0: the base's latest).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.sources.blobs import shared_folder
from jobweave.streaming.fold import folded

KEY = ["anthology_id", "story_id"]
BASE = ["base_anthology_id", "base_story_id"]
VERSION = "latest_ordinal long, fork_ordinal long, base_anthology_id string, base_story_id string, finalized boolean, deleted boolean, created_at long, updated_at long"
OUT = f"anthology_id string, story_id string, seq long, command string, ordinal long, result string, {VERSION}"
#: Links that a read follows at most, less one: 2 ** LEVELS.
LEVELS = 10
#: Commits in one span of the running latest ordinal.
SPAN = 1 << 16


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def step(story: tuple | None, row: dict) -> tuple[tuple | None, str]:
    """The story after a command, and what came of the command; None is a story that was never made."""
    command, at = row["command"], row["seq"]
    if command == "clone":
        fork = row["base_latest"] if row["last_ordinal"] < 0 else row["last_ordinal"]
        if not row["base_live"]:
            return story, "not_found"
        if fork < 0 or fork > row["base_latest"]:
            return story, "range"
        base = (row["base_anthology_id"], row["base_story_id"])
        if base == (row["anthology_id"], row["story_id"]):
            return story, "invalid"
        return (story, "exists") if story else ((fork, fork, *base, False, False, at, at), "ok")
    if command == "create":
        return (story, "exists") if story else ((-1, None, None, None, False, False, at, at), "ok")
    if story is None or story[5]:
        return story, "not_found"
    latest, fork, a, s, finalized, _, created, _ = story
    if command == "append":
        if finalized:
            return story, "finalized"
        if (-1 if fork is None else fork) < row["ordinal"] <= latest:
            return story, "chapter_exists"
        return ((row["ordinal"], fork, a, s, False, False, created, at), "ok") if row["ordinal"] == latest + 1 else (story, "invalid")
    if command == "publish":
        return (story, "finalized") if finalized else ((latest, fork, a, s, True, False, created, at), "ok")
    if command == "tombstone" and not finalized:
        return story, "invalid"
    return (latest, fork, a, s, True, True, created, at), "ok"  # tombstone, or delete, which publishes where needed


def latest_at(asked: DataFrame, done: DataFrame) -> DataFrame:
    """asked(seq, BASE) with `base_live` and `base_latest` just before: from the versions of their bases.

    The latest ordinal never falls, so it is a running maximum: within spans of commits, over what earlier spans had. A base
    that many stories are cloned from is split by spans.
    """
    made = done.where("result = 'ok'").select(*(F.col(k).alias(b) for k, b in zip(KEY, BASE, strict=True)), "seq", "latest_ordinal", "deleted")
    rows = made.withColumn("asks", F.lit(False)).unionByName(asked.select(*BASE, "seq").withColumn("asks", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("span", F.floor(F.col("seq") / SPAN)).withColumn("gone", F.when(F.col("deleted"), 1).otherwise(0))
    earlier = Window.partitionBy(*BASE).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*BASE, "span").agg(F.max("latest_ordinal").alias("l"), F.max("gone").alias("g"))
    spans = spans.select(*BASE, "span", F.max("l").over(earlier).alias("l"), F.max("g").over(earlier).alias("g"))
    within = Window.partitionBy(*BASE, "span").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    now = rows.select(*BASE, "span", "seq", "asks", F.max("latest_ordinal").over(within).alias("own_l"), F.max("gone").over(within).alias("own_g")).where("asks")
    latest = F.greatest("own_l", "l")
    return now.join(spans, [*BASE, "span"]).select("seq", latest.alias("base_latest"), (latest.isNotNull() & (F.coalesce(F.greatest("own_g", "g"), F.lit(0)) == 0)).alias("base_live"))


def history(log: DataFrame) -> DataFrame:
    """Every command with its result and the story's version after it.

    A clone looks at its base, so stories are folded in rounds: one is due when the bases of its clone commands have been
    folded, or have no commands. Each story is folded once, as part of a sorted stream; there are as many rounds as clones
    of clones. Clones after a story's first create can't make it and wait for nothing; why they fail is told at the end. Where stories wait for each other,
    the earliest command among them finds no base.
    """
    spark = log.sparkSession
    first = log.where("command = 'create'").groupBy(*KEY).agg(F.min("seq").alias("made"))
    log = cut(log.join(first, KEY, "left"))
    all_clones = log.where("command = 'clone'")
    waits = cut(all_clones.where("made is null or seq < made").select(*KEY, *BASE, "seq").where("struct(anthology_id, story_id) <> struct(base_anthology_id, base_story_id)"))
    left = cut(log.select(*KEY).distinct())
    folder, kind, n = f"{shared_folder(spark)}/stories_{uuid.uuid4().hex}", f"{OUT}, round int", 0

    def advance(story: tuple | None, row: dict) -> tuple:
        story, result = step(story, row)
        return story, (row["anthology_id"], row["story_id"], row["seq"], row["command"], row["ordinal"], result, *(story or (None,) * 8))

    while not left.isEmpty():
        open_bases = left.select(*(F.col(k).alias(b) for k, b in zip(KEY, BASE, strict=True)))
        waiting = waits.join(left, KEY, "left_semi").join(open_bases, BASE, "left_semi")
        due = cut(left.join(waiting.select(*KEY), KEY, "left_anti"))
        if due.isEmpty():  # stories that wait for each other: commands before any that could make their bases fail
            begins = waiting.groupBy(*KEY).agg(F.min("seq").alias("begins")).select(*(F.col(k).alias(b) for k, b in zip(KEY, BASE, strict=True)), "begins")
            vain = waiting.join(begins, BASE).where("seq < begins").select("seq")
            waits = cut(waits.join(vain, "seq", "left_anti"))
            continue
        rows = log.join(due, KEY, "left_semi")
        seen = spark.read.schema(kind).parquet(folder) if n else spark.createDataFrame([], kind)
        if n:
            rows = rows.join(latest_at(all_clones.join(due, KEY, "left_semi"), seen), "seq", "left")
        else:
            rows = rows.withColumns({"base_latest": F.lit(None).cast("long"), "base_live": F.lit(False)})
        rows = rows.withColumn("key", F.struct(*KEY)).withColumn("base_live", F.coalesce("base_live", F.lit(False)))
        folded(rows, "key", ["seq"], advance, None, OUT, every=True).write.parquet(f"{folder}/round={n}")
        left, n = cut(left.join(due, KEY, "left_anti")), n + 1
    made = (spark.read.schema(kind).parquet(folder) if n else spark.createDataFrame([], kind)).drop("round")
    return with_reasons(made, all_clones.select(*KEY, *BASE, "seq", "last_ordinal"))


def with_reasons(made: DataFrame, clones: DataFrame) -> DataFrame:
    """Names why each clone failed, now that all bases are known: also those of stories that existed already."""
    asked = clones.join(made.where("command = 'clone' and result <> 'ok'").select("seq"), "seq", "left_semi")
    fork = F.when(F.col("last_ordinal") < 0, F.col("base_latest")).otherwise(F.col("last_ordinal"))
    own = F.struct(*KEY) == F.struct(*(F.col(b).alias(k) for k, b in zip(KEY, BASE, strict=True)))
    reason = F.when(~F.col("base_live"), "not_found").when((fork < 0) | (fork > F.col("base_latest")), "range").when(own, "invalid").otherwise("exists")
    named = asked.join(latest_at(asked, made), "seq").select("seq", reason.alias("reason"))
    return made.join(named, "seq", "left").withColumn("result", F.coalesce("reason", "result")).select(*made.columns)


def stories_at(history: DataFrame, at: int | None = None, deleted: bool = False) -> DataFrame:
    """The stories as they were after commit `at`, or as they are; deleted ones only if asked for."""
    rows = history.where("result = 'ok'") if at is None else history.where((F.col("result") == "ok") & (F.col("seq") <= at))
    names = [c.split()[0] for c in VERSION.split(", ")]
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*names), "seq").alias("v")).select(*KEY, "v.*")
    last = last.withColumn("chapter_count", F.col("latest_ordinal") + 1)
    return last if deleted else last.where(~F.col("deleted"))


def chapters_at(history: DataFrame, at: int | None = None) -> DataFrame:
    """Chapters that stories hold themselves after commit `at`: KEY, ordinal and the commit that wrote each."""
    rows = history.where("result = 'ok' and command = 'append'")
    return (rows if at is None else rows.where(F.col("seq") <= at)).select(*KEY, "ordinal", "seq")


def ordinals(stories: DataFrame, chapters: DataFrame, start: int = 0, limit: int = 0) -> DataFrame:
    """The first `limit` own ordinals (0: all) from `start` on of each of the stories, and whether there are more."""
    rows = chapters.where(F.col("ordinal") >= start).join(stories.select(*KEY), KEY, "left_semi").select(*KEY, "ordinal")
    if not limit:
        return rows.withColumn("has_more", F.lit(False))
    order = Window.partitionBy(*KEY).orderBy("ordinal")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit + 1)
    more = F.max("place").over(Window.partitionBy(*KEY)) > limit
    return first.withColumn("has_more", more).where(F.col("place") <= limit).drop("place")


def read(asked: DataFrame, stories: DataFrame, chapters: DataFrame, artifacts: DataFrame) -> DataFrame:
    """asked(KEY, ordinal) with `state` ok, story_not_found or chapter_not_found, body, and artifacts by position.

    Only a story's own chapters are found. Whether deleted stories count is up to `stories`.
    """
    shown = [c for c in artifacts.columns if c not in (*KEY, "ordinal")]
    lists = artifacts.groupBy(*KEY, "ordinal").agg(F.array_sort(F.collect_list(F.struct("position", *(c for c in shown if c != "position")))).alias("artifacts"))
    rows = asked.join(stories.select(*KEY, F.lit(True).alias("_story")), KEY, "left").join(chapters.select(*KEY, "ordinal", "body", F.lit(True).alias("_chapter")), [*KEY, "ordinal"], "left")
    state = F.when(F.col("_story").isNull(), "story_not_found").when(F.col("_chapter").isNull(), "chapter_not_found").otherwise("ok")
    ok = F.col("state") == "ok"
    empty = F.array().cast(lists.schema["artifacts"].dataType)
    rows = rows.join(lists, [*KEY, "ordinal"], "left").withColumn("state", state)
    return rows.withColumn("body", F.when(ok, F.col("body"))).withColumn("artifacts", F.when(ok, F.coalesce("artifacts", empty))).drop("_story", "_chapter")


def lifts(links: DataFrame) -> list[DataFrame]:
    """For 1, 2, 4, ... links(id, up, reach) up from each story: the story there, and the largest ordinal that all of those links hand on."""
    tables = [cut(links)]
    while len(tables) < LEVELS:
        low = tables[-1]
        high = low.select(F.col("id").alias("up"), F.col("up").alias("u"), F.col("reach").alias("r"))
        both = cut(low.join(high, "up").select("id", F.col("u").alias("up"), F.least("reach", "r").alias("reach")))
        if both.isEmpty():
            break
        tables.append(both)
    return tables


def owners(stories: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(KEY, low, high) cut into runs of ordinals (low, high) with the story that owns them, its depth, and `too_deep`.

    A link hands on the ordinals up to its fork. Tables of links double their reach, so that a chain of 1000 takes ten
    joins, on numbers given to the stories. `stories` holds deleted ones, too; a chain that goes on after
    2 ** LEVELS - 1 links is too deep.
    """
    bases = stories.where("base_story_id is not null").select(*KEY, *BASE, F.col("fork_ordinal").alias("reach"))
    every = stories.select(*KEY).union(bases.select(*BASE)).union(asked.select(*KEY)).distinct()
    ids = cut(every.withColumn("id", F.monotonically_increasing_id()))  # stored, so that a lost task numbers alike
    named = lambda id, *key: ids.select(F.col("id").alias(id), *(F.col(k).alias(n) for k, n in zip(KEY, key, strict=True)))
    tables = lifts(bases.join(ids, KEY).join(named("up", *BASE), BASE).select("id", "up", "reach"))
    rows = asked.join(ids, KEY).select("id", F.col("id").alias("owner"), "low", "high", F.lit(0).alias("depth"))
    at = lambda t: t.select(F.col("id").alias("owner"), "up", "reach")
    for level in reversed(range(len(tables))):
        met = rows.join(at(tables[level]), "owner", "left")
        first = F.when(F.col("reach").isNull(), F.col("low")).otherwise(F.greatest("low", F.col("reach") + 1))
        stays = F.struct("owner", first.alias("low"), "high", "depth")
        goes = F.struct(F.col("up").alias("owner"), "low", F.least("high", "reach").alias("high"), (F.col("depth") + (1 << level)).alias("depth"))
        rows = met.select("id", F.explode(F.array(stays, F.when(F.col("reach").isNotNull(), goes))).alias("p")).where("p.low <= p.high").select("id", "p.*")
        rows = cut(rows) if level % 4 == 0 else rows
    if len(tables) < LEVELS:
        rows = rows.withColumn("too_deep", F.lit(False))
    else:
        rows = rows.join(at(tables[0]).drop("up"), "owner", "left").withColumn("too_deep", F.coalesce(F.col("low") <= F.col("reach"), F.lit(False)))
    shown = rows.join(named("owner", "owner_anthology", "owner_story"), "owner").join(ids, "id")
    return shown.select(*KEY, "owner_anthology", "owner_story", "low", "high", "depth", "too_deep")


def resolved(stories: DataFrame, chapters: DataFrame) -> DataFrame:
    """All chapters that live stories show: KEY, ordinal, the owner, how many links it is away, and the chapter's columns."""
    live = stories.where(~F.col("deleted") & (F.col("latest_ordinal") >= 0)).select(*KEY, F.lit(0).cast("long").alias("low"), F.col("latest_ordinal").alias("high"))
    runs = owners(stories, live).where(~F.col("too_deep")).drop("too_deep")
    held = chapters.select(F.col("anthology_id").alias("owner_anthology"), F.col("story_id").alias("owner_story"), *(c for c in chapters.columns if c not in KEY))
    return runs.join(held, ["owner_anthology", "owner_story"]).where("ordinal between low and high").drop("low", "high")


def selected(stories: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(KEY, selector) to `ordinal`: less than 0 counts back from the latest; null where the story isn't live or lacks it."""
    rows = asked.join(stories.where(~F.col("deleted")).select(*KEY, "latest_ordinal"), KEY, "left")
    target: Column = F.when(F.col("selector") < 0, F.col("latest_ordinal") + F.col("selector") + 1).otherwise(F.col("selector"))
    return rows.withColumn("ordinal", F.when(target.between(0, F.col("latest_ordinal")), target)).drop("latest_ordinal")
