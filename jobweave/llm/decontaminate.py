"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment.

An item's bottom-k MinHash sketch is searched among the shingles of every document. k comes from the item's size
class: of n shingles, at most n - ceil(t n) may be missing at containment t, so a sketch one longer always has a
shingle in common with a document that contains the item, and no such document is missed. A document's own size
class drops items too large for it. Candidates are then verified on the item's whole set of shingle texts.

Candidates and items are small beside the corpus as a rule: they are sent to all executors if their counted size is
within BROADCAST_ROWS, so that no text is shuffled, and joined by shuffles above, where Spark splits a popular item.

DataFrame functions only. Words are runs of letters, digits and non-ASCII characters of the lower-cased text; shingles
are WIDTH words, or an item's whole word sequence if it has fewer.

Defined cases: null or word-free texts and items match nothing; items without an item_id are no items. Each row is
judged by its own text, those that repeat or lack an id too; items that repeat an id are found each and reported once.
Extra columns are ignored by `contamination` and kept by `without_items`; an empty documents table gives an empty one,
an empty benchmark only clean rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import cut

WIDTH, PERCENT = 5, 80
#: Rows of sketches or candidates, or shingles of items, up to which they are sent to all executors.
BROADCAST_ROWS = 200_000
#: What tells rows apart: doc_id and two hashes of the text.
KEYS = ["doc", "t1", "t2"]
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), GAP), "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often `use` and lambdas in it name it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_texts(w: Column, width: Column) -> Column:
    """All runs of `width` words as texts; none if there are fewer."""
    run = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
    return bound(w, lambda w: F.when(F.size(w) >= width, run(w)))


def shingle_codes(w: Column, width: int) -> Column:
    """A 64-bit hash of each run of `width` words, from hashes of the words."""
    run = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))
    return bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) >= width, run(h)))


def code_of(width: int):
    """The hash that shingle_codes gives the shingle of a text of `width` words."""
    return lambda s: F.xxhash64(*(F.xxhash64(F.get(F.split(s, " "), F.lit(j))) for j in range(width)))


def keyed(docs: DataFrame) -> DataFrame:
    """KEYS, text, and all columns of each row as a struct."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("t1"), F.crc32(text.cast("binary")).alias("t2"), text.alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )


def bounded(rows: DataFrame, size: Column | None = None) -> DataFrame:
    """The rows, stored; to be sent to all executors if they, or the sum of `size`, are within BROADCAST_ROWS."""
    rows = cut(rows)
    counted = rows.agg(F.sum(size) if size is not None else F.count("*")).first()[0] or 0
    return F.broadcast(rows) if counted <= BROADCAST_ROWS else rows


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """KEYS of the rows that contain an item, with item_id, n_shared and n_item."""
    w = items.where("item_id is not null").select("item_id", F.xxhash64("text").alias("it"), words().alias("w")).where(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(width)))
    shingled = w.select("item_id", "it", "width", F.array_distinct(shingle_texts(F.col("w"), F.col("width"))).alias("item")).dropDuplicates(["item_id", "it"])
    sized = shingled.withColumn("n", F.size("item")).withColumn("need", F.expr(f"cast(-floor(-(n * {percent}) / 100) as int)"))
    sized = bounded(sized, F.col("n"))
    sketch = None
    for k in [r[0] for r in sized.select("width").distinct().limit(width + 1).collect()]:
        own = sized.where(F.col("width") == k)
        least = F.slice(F.array_sort(F.transform("item", code_of(k))), F.lit(1), F.col("n") - F.col("need") + 1)
        one = own.select("item_id", "it", "width", "need", F.explode(least).alias("code"))
        sketch = one if sketch is None else sketch.unionByName(one)
    rows = keyed(docs).select(*KEYS, "text")
    if sketch is None:
        return rows.where("false").select(*KEYS, F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("n_shared"), F.lit(1).alias("n_item"))
    sketch = bounded(sketch)
    coded = rows.select(*KEYS, words().alias("w"))
    found = None
    for k in [r[0] for r in sketch.select("width").distinct().limit(width + 1).collect()]:
        codes = coded.select(*KEYS, shingle_codes(F.col("w"), k).alias("codes"))
        probe = codes.select(*KEYS, F.size("codes").alias("size"), F.explode("codes").alias("code"))
        hit = probe.join(sketch.where(F.col("width") == k).drop("width"), "code").where("size >= need").select(*KEYS, "item_id", "it")
        found = hit if found is None else found.unionByName(hit)
    texts = rows.join(bounded(found.distinct()), KEYS).join(sized, ["item_id", "it"])
    shared = F.size(F.array_intersect("item", shingle_texts(words(), F.col("width"))))
    return texts.select(*KEYS, "item_id", shared.alias("n_shared"), F.col("n").alias("n_item"), "need").where("n_shared >= need").drop("need").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_items, item_ids, containment, contaminated) for each row of docs."""
    found = matches(docs, items, width, percent).groupBy(*KEYS).agg(F.collect_set("item_id").alias("ids"), F.max(F.col("n_shared") / F.col("n_item")).alias("containment"))
    both = keyed(docs).select(*KEYS, "row.doc_id").join(bounded(found), KEYS, "left")
    return both.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ","), F.lit("")).alias("item_ids"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"), F.col("ids").isNotNull().alias("contaminated"),
    )


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that contain no item."""
    hit = bounded(matches(docs, items).select(*KEYS).distinct())
    return keyed(docs).select(*KEYS, "row").join(hit, KEYS, "left_anti").select("row.*")
