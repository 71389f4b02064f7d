"""Queries of stories and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.operators import stories
from jobweave.plans.oracle import with_

KEY = stories.KEY
#: All commits but the late deletions.
BEFORE = 900_000


def folded(t) -> DataFrame:
    return stories.history(t.fx_story_log.drop("body"))


def chapters(t, history: DataFrame, at: int | None = None) -> DataFrame:
    return stories.chapters_at(history, at).join(t.fx_story_log.select("seq", "body"), "seq")


def artifacts(t, held: DataFrame) -> DataFrame:
    """Artifacts of the appends that became chapters."""
    return t.fx_story_artifacts.join(held.select("seq"), "seq", "left_semi").drop("seq", "artifact_seq")


def versions(t) -> DataFrame:
    return folded(t)


def before_deletions(t) -> DataFrame:
    return stories.stories_at(folded(t), BEFORE, deleted=True)


def ordinals(t) -> DataFrame:
    made = folded(t)
    return stories.ordinals(stories.stories_at(made), stories.chapters_at(made), 1, 3)


def reads(t) -> DataFrame:
    """Ordinals 0 to 9 of every story that was ever asked for, read with and without deleted ones."""
    made = folded(t)
    held = chapters(t, made)
    asked = t.fx_story_log.select(*KEY).distinct().withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("ordinal", F.col("ordinal").cast("long"))
    shown = lambda deleted: stories.read(asked, stories.stories_at(made, deleted=deleted), held.drop("seq"), artifacts(t, held))
    both = shown(True).select(*KEY, "ordinal", F.col("state").alias("state_all"), F.length("body").alias("n_chars"), F.size("artifacts").alias("n_artifacts"))
    return both.join(shown(False).select(*KEY, "ordinal", "state"), [*KEY, "ordinal"])


def artifact_reads(t) -> DataFrame:
    """The artifacts of all chapters of live stories, in the order of their positions."""
    made = folded(t)
    held = chapters(t, made)
    read = stories.read(held.select(*KEY, "ordinal"), stories.stories_at(made), held.drop("seq"), artifacts(t, held)).where("state = 'ok'")
    rows = read.select(*KEY, "ordinal", F.posexplode("artifacts").alias("place", "a"))
    return rows.select(*KEY, "ordinal", "place", "a.position", "a.name", "a.sha256", "a.size_bytes", F.col("a.inline_data").isNotNull().alias("inline"), "a.blob_path")


def selected(t) -> DataFrame:
    """Chapters by selectors that count from either end, through links also to deleted bases."""
    made = folded(t)
    every = stories.stories_at(made, deleted=True)
    asked = t.fx_story_log.select(*KEY).distinct().withColumn("selector", F.explode(F.array(*(F.lit(n).cast("long") for n in (-9, -2, -1, 0, 2)))))
    rows = stories.selected(every, asked)
    owned = stories.resolved(every, chapters(t, made).drop("seq"))
    return rows.join(owned, [*KEY, "ordinal"], "left").select(*KEY, "selector", "ordinal", "owner_anthology", "owner_story", "depth", F.length("body").alias("n_chars"))


def chains(t) -> DataFrame:
    """Chains of a thousand forks in two anthologies whose story ids clash."""
    return stories.resolved(t.fx_chain, t.fx_chain_chapters)


BUILT = {
    "q_story_fold": versions, "q_story_as_of": before_deletions, "q_story_ordinals": ordinals, "q_story_read": reads,
    "q_story_artifacts": artifact_reads, "q_story_selected": selected, "q_fork_chain": chains,
}

ENTRY = "STRUCT(latest BIGINT, fork BIGINT, ba VARCHAR, bs VARCHAR, fin BOOLEAN, del BOOLEAN, ca BIGINT, ua BIGINT)"
FOLD = f"""l AS (SELECT *, row_number() OVER (ORDER BY seq) AS n, anthology_id || '/' || story_id AS key, base_anthology_id || '/' || base_story_id AS bkey FROM fx_story_log),
st(n, m, result) AS (
  SELECT CAST(0 AS BIGINT), CAST(MAP {{}} AS MAP(VARCHAR, {ENTRY})), ''
  UNION ALL
  SELECT n, CASE WHEN r = 'ok' THEN map_concat(m, map([key], [CAST(CASE command WHEN 'create' THEN row(-1, NULL, NULL, NULL, false, false, seq, seq) WHEN 'clone' THEN row(f, f, base_anthology_id, base_story_id, false, false, seq, seq)
      WHEN 'append' THEN row(ordinal, s.fork, s.ba, s.bs, false, false, s.ca, seq) ELSE row(s.latest, s.fork, s.ba, s.bs, true, command <> 'publish', s.ca, seq) END AS {ENTRY})])) ELSE m END, r
  FROM (SELECT *, CASE WHEN command = 'clone' THEN CASE WHEN b IS NULL OR b.del THEN 'not_found' WHEN f < 0 OR f > b.latest THEN 'range' WHEN key = bkey THEN 'invalid' WHEN s IS NOT NULL THEN 'exists' ELSE 'ok' END
      WHEN command = 'create' THEN CASE WHEN s IS NOT NULL THEN 'exists' ELSE 'ok' END
      WHEN s IS NULL OR s.del THEN 'not_found'
      WHEN command = 'append' THEN CASE WHEN s.fin THEN 'finalized' WHEN ordinal > coalesce(s.fork, -1) AND ordinal <= s.latest THEN 'chapter_exists' WHEN ordinal = s.latest + 1 THEN 'ok' ELSE 'invalid' END
      WHEN command = 'publish' AND s.fin THEN 'finalized' WHEN command = 'tombstone' AND NOT s.fin THEN 'invalid' ELSE 'ok' END AS r
    FROM (SELECT l.*, m, m[key] AS s, m[bkey] AS b, CASE WHEN last_ordinal < 0 THEN m[bkey].latest ELSE last_ordinal END AS f FROM st JOIN l ON l.n = st.n + 1) x) y),
h AS (SELECT l.*, result, m[key] AS s FROM st JOIN l USING (n)),
hist AS (SELECT anthology_id, story_id, seq, command, ordinal, result, s.latest AS latest_ordinal, s.fork AS fork_ordinal, s.ba AS base_anthology_id, s.bs AS base_story_id, s.fin AS finalized, s.del AS deleted, s.ca AS created_at, s.ua AS updated_at, body FROM h),
last AS (SELECT * FROM hist WHERE result = 'ok' QUALIFY row_number() OVER (PARTITION BY anthology_id, story_id ORDER BY seq DESC) = 1),
held AS (SELECT anthology_id, story_id, ordinal, seq, body FROM hist WHERE result = 'ok' AND command = 'append')"""
K = "anthology_id, story_id"
VERSION = "latest_ordinal, fork_ordinal, base_anthology_id, base_story_id, finalized, deleted, created_at, updated_at"
WALK = """walk(anthology_id, story_id, ordinal, owner_anthology, owner_story, depth) AS (
  SELECT anthology_id, story_id, unnest(range(0, latest_ordinal + 1)), anthology_id, story_id, 0 FROM {0} WHERE NOT deleted
  UNION ALL
  SELECT w.anthology_id, w.story_id, w.ordinal, s.base_anthology_id, s.base_story_id, depth + 1 FROM walk w JOIN {0} s ON s.anthology_id = owner_anthology AND s.story_id = owner_story WHERE w.ordinal <= s.fork_ordinal),
owned AS (SELECT w.* FROM walk w JOIN {0} s ON s.anthology_id = owner_anthology AND s.story_id = owner_story WHERE s.fork_ordinal IS NULL OR w.ordinal > s.fork_ordinal)"""


def sql() -> dict[str, str]:
    fold = with_(("fx_story_log", "fx_story_artifacts"), FOLD)
    owner = "h.anthology_id = o.owner_anthology AND h.story_id = o.owner_story AND h.ordinal = o.ordinal"
    return {
        "q_story_fold": fold + f"SELECT {K}, seq, command, ordinal, result, {VERSION} FROM hist",
        "q_story_as_of": fold + f"SELECT {K}, {VERSION}, latest_ordinal + 1 AS chapter_count FROM hist WHERE result = 'ok' AND seq <= {BEFORE} QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY seq DESC) = 1",
        "q_story_ordinals": fold + f"""SELECT h.anthology_id, h.story_id, h.ordinal, count(*) OVER (PARTITION BY h.anthology_id, h.story_id) > 3 AS has_more FROM held h JOIN last USING ({K}) WHERE NOT deleted AND h.ordinal >= 1
QUALIFY row_number() OVER (PARTITION BY h.anthology_id, h.story_id ORDER BY h.ordinal) <= 3""",
        "q_story_read": fold + f"""SELECT a.anthology_id, a.story_id, a.ordinal, CASE WHEN l.seq IS NULL THEN 'story_not_found' WHEN h.seq IS NULL THEN 'chapter_not_found' ELSE 'ok' END AS state_all,
CASE WHEN l.seq IS NULL OR l.deleted THEN 'story_not_found' WHEN h.seq IS NULL THEN 'chapter_not_found' ELSE 'ok' END AS state, length(h.body) AS n_chars,
CASE WHEN h.seq IS NOT NULL THEN (SELECT count(*) FROM fx_story_artifacts x WHERE x.seq = h.seq) END AS n_artifacts
FROM (SELECT {K}, unnest(range(0, 10)) AS ordinal FROM (SELECT DISTINCT {K} FROM fx_story_log) k) a LEFT JOIN last l USING ({K}) LEFT JOIN held h ON h.anthology_id = a.anthology_id AND h.story_id = a.story_id AND h.ordinal = a.ordinal""",
        "q_story_artifacts": fold + f"""SELECT h.anthology_id, h.story_id, h.ordinal, row_number() OVER (PARTITION BY h.seq ORDER BY x.position) - 1 AS place, x.position, x.name, x.sha256, x.size_bytes, x.inline_data IS NOT NULL AS inline, x.blob_path
FROM held h JOIN last l USING ({K}) JOIN fx_story_artifacts x ON x.seq = h.seq WHERE NOT l.deleted""",
        "q_story_selected": with_(("fx_story_log",), FOLD, WALK.format("last")) + f"""SELECT a.anthology_id, a.story_id, a.selector, a.ordinal, owner_anthology, owner_story, depth, length(h.body) AS n_chars FROM (
SELECT k.anthology_id, k.story_id, selector, CASE WHEN t BETWEEN 0 AND latest_ordinal THEN t END AS ordinal FROM (
  SELECT k.anthology_id, k.story_id, selector, l.latest_ordinal, CASE WHEN selector < 0 THEN l.latest_ordinal + selector + 1 ELSE selector END AS t
  FROM (SELECT {K}, unnest([-9, -2, -1, 0, 2]) AS selector FROM (SELECT DISTINCT {K} FROM fx_story_log) k0) k LEFT JOIN (SELECT * FROM last WHERE NOT deleted) l USING ({K})) k) a
LEFT JOIN (SELECT o.*, h.body FROM owned o JOIN held h ON {owner}) h ON h.anthology_id = a.anthology_id AND h.story_id = a.story_id AND h.ordinal = a.ordinal""",
        "q_fork_chain": with_(("fx_chain", "fx_chain_chapters"), WALK.format("fx_chain")) + f"SELECT o.anthology_id, o.story_id, o.ordinal, owner_anthology, owner_story, depth, h.body FROM owned o JOIN fx_chain_chapters h ON {owner}",
    }
