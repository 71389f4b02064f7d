"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make every signature coordinate: sigma spreads the shingles over a ring of 2**32 places, and
coordinate k is the least pi(place - k mod 2**32) of a document's shingles. Bands of coordinates bring candidates
together; each link is confirmed on the full shingle sets.

Groups of copies never become pairs of pairs. Texts of equal words are one class at once. Each bucket of a band then
compares its members with one centre, and verified links are contracted to components. Where a bucket still holds
several components, its rows are compared in blocks, so no link between different components is lost; blocks meet only
if their documents' sizes can reach the threshold. The pairs of a common centre are dealt in parts, each of which gets the
centre's text once, and only texts that are in some pair are shuffled.

Defined cases: a null or word-free text has no shingles and is linked with nothing. A text with fewer words than
the width has its whole word sequence as its one shingle. Rows are judged each, those that repeat or lack a doc_id too:
a component's id is the smallest one of its rows that have any, and null if none has. Other columns are ignored by
`near_duplicates` and kept by `one_of_each`; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import components, cut, mix64, shingle_hashes, single

#: What tells rows apart: doc_id (missing ones last) and two hashes of the text.
KEYS = ["doc", "t1", "t2"]

BANDS, ROWS = 32, 4
#: 100 * intersection >= THRESHOLD * union
THRESHOLD = 80
U32 = np.uint32
#: Blocks hold up to about BLOCK shingles, a document counting for LEAST_WEIGHT at least; SLICE is a matrix's width.
BLOCK, LEAST_WEIGHT, SLICE = 1 << 18, 256, 1 << 13
WIDE = 512  # shingles that are shifted together
#: Shingles of members that meet one copy of their centre; rows of keys up to which they are sent to all executors.
PART, BROADCAST_ROWS = 1 << 22, 200_000


def pi(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit places."""
    x = (x ^ (x >> U32(16))) * U32(0x85EBCA6B)
    x = (x ^ (x >> U32(13))) * U32(0xC2B2AE35)
    return x ^ (x >> U32(16))


def signature(shingles: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """k coordinates: one set of places, shifted around the ring once for each coordinate."""
    places = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(U32)
    shift = np.arange(k, dtype=U32)[:, None]
    parts = [pi(places[i : i + WIDE] - shift).min(axis=1) for i in range(0, len(places), WIDE)]
    return np.minimum.reduce(parts)


def band_keys(sig: np.ndarray) -> np.ndarray:
    words = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for j in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + words[:, j])
    return key.view(np.int64)


def sketcher(width: int):
    """Adds the number of shingles, a digest of the words in order, and the bands; takes the text away."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, bands = [], [], [], []
            for text in batch["text"].to_pylist():
                lowered = (text or "").encode().lower()
                s = shingle_hashes(lowered, width)
                digest = hashlib.blake2b(b" ".join(lowered.split()), digest_size=16).digest()
                n.append(len(s))
                one.append(int.from_bytes(digest[:8], "little", signed=True))
                two.append(int.from_bytes(digest[8:], "little", signed=True))
                bands.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in KEYS), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=[*KEYS, "n_shingles", "d1", "d2", "bands"],
            )

    return sketch


def shingle_set(text: str, width: int) -> set[tuple[bytes, ...]]:
    w = (text or "").encode().lower().split()
    width = min(width, len(w))
    return set(zip(*(w[k:] for k in range(width)), strict=False))


def verifier(width: int, threshold: int):
    """Rows (y, part, side, x, text) sorted by these: after the text of a centre (side 0) come those of its members."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, q = None, set()
        for batch in batches:
            a, b = [], []
            for y, side, x, text in zip(*(batch[c].to_pylist() for c in ("y", "side", "x", "text")), strict=True):
                s = shingle_set(text, width)
                if not side:
                    centre, q = y, s
                    continue
                both = len(s & q) if centre == y else 0
                if 100 * both >= threshold * (len(s) + len(q) - both) > 0:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return verify


def texts_of(needed: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the nodes that are needed. Other texts aren't shuffled where the keys of these can be sent around."""
    keys = cut(nodes.join(needed.select("node").distinct(), "node").select("node", *KEYS))
    return texts.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, KEYS).select("node", "text")


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Of candidate pairs (x, y, n), the links (a, b) whose full sets meet the threshold; n is the size of x.

    Pairs are dealt by their centre y, whose text comes once to each part of about PART shingles of its members.
    """
    parts = cut(pairs.groupBy("y").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST_WEIGHT))) / PART).alias("parts")))
    held = texts_of(pairs.select(F.col("x").alias("node")).unionByName(parts.select(F.col("y").alias("node"))), nodes, texts)
    members = pairs.join(parts, "y").select("y", F.pmod(F.xxhash64("x"), "parts").alias("part"), F.lit(1).alias("side"), "x").join(held.withColumnRenamed("node", "x"), "x")
    centres = parts.select("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("x"))
    rows = centres.join(held.withColumnRenamed("node", "y"), "y").unionByName(members)
    return rows.repartition("y", "part").sortWithinPartitions("y", "part", "side").mapInArrow(verifier(width, threshold), "a long, b long")


def block_comparer(width: int, threshold: int):
    """Exact comparison of two blocks: one link (a, b) of each two components that have a similar pair in them."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("x")
        c, side = group["c"].to_numpy(), group["side"].to_numpy()
        texts = group["x_text"]
        sets = [shingle_hashes((t or "").encode().lower(), width) for t in texts.to_pylist()]
        n = np.array([len(s) for s in sets])
        left, right = (np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)) if side.any() else (np.arange(len(c)),) * 2
        owner = np.repeat(np.arange(len(c)), n)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(left), len(right)), np.int64)
        for at in range(0, int(column[-1]) + 1, SLICE):
            lo, hi = np.searchsorted(column, (at, at + SLICE))
            m = np.zeros((len(c), SLICE), np.float32)
            m[owner[lo:hi], column[lo:hi] - at] = 1
            both += (m[left] @ m[right].T).astype(np.int64)
        union = n[left][:, None] + n[right][None, :] - both
        i, j = np.nonzero((100 * both >= threshold * union) & (c[left][:, None] != c[right][None, :]))
        i, j = left[i], right[j]
        found: set[tuple[int, int]] = set()
        full: dict[int, set] = {}
        for p, q in zip(i.tolist(), j.tolist(), strict=True):  # hashes have found it, the full sets confirm it
            pair = (min(int(c[p]), int(c[q])), max(int(c[p]), int(c[q])))
            if pair not in found:
                for k in (p, q):
                    if k not in full:
                        full[k] = shingle_set(texts[k].as_py(), width)
                shared = len(full[p] & full[q])
                if 100 * shared >= threshold * (len(full[p]) + len(full[q]) - shared):
                    found.add(pair)
        a, b = zip(*sorted(found), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def across(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame | None:
    """Links (a, b) of components that still meet in a bucket, from comparing blocks instead of emitting pairs.

    Every member of such a bucket goes into one block of bounded size, with others of about its size whose buckets have
    the same centre. Two blocks are compared, whole against whole, if any bucket holds rows of both and their sizes are
    close enough: documents over `size` steps apart differ in more shingles than the threshold allows.
    """
    at = members.join(labels.withColumnRenamed("node", "x"), "x", "left").select("key", "x", "n", "y", F.coalesce("component", "x").alias("c"))
    mixed = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    at = cut(at.join(mixed, "key"))
    if at.isEmpty():
        return None
    step = math.log(100 / min(threshold, 99)) * (1 + 1e-9)
    homes = at.groupBy("x").agg(F.min("y").alias("home"), F.max("n").alias("n"), F.max("c").alias("c")).withColumn("size", F.floor(F.log("n") / step))
    parts = homes.groupBy("home", "size").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST_WEIGHT))) / BLOCK).alias("parts"))
    blocks = cut(homes.join(parts, ["home", "size"]).select("x", "c", "size", F.xxhash64("home", "size", F.pmod(F.xxhash64("x"), "parts")).alias("block")))
    held = at.select("key", "x").join(blocks, "x")
    meet = held.groupBy("key", "block", "size").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    other = meet.select("key", *(F.col(k).alias(f"{k}2") for k in ("block", "size", "lo", "hi")))
    close = "block <= block2 and abs(size - size2) <= 1 and least(lo, lo2) < greatest(hi, hi2)"
    pairs = meet.join(other, "key").where(close).select("block", "block2").distinct()
    pairs = pairs.withColumn("pair", F.xxhash64("block", "block2"))
    sides = pairs.select("pair", "block", F.when(F.col("block") == F.col("block2"), 0).otherwise(-1).alias("side"))
    sides = sides.unionByName(pairs.where("block < block2").select("pair", F.col("block2").alias("block"), F.lit(1).alias("side")))
    held = texts_of(blocks.select(F.col("x").alias("node")), nodes, texts).select(F.col("node").alias("x"), F.col("text").alias("x_text"))
    rows = blocks.join(held, "x").join(sides, "block").select("pair", "side", "x", "c", "x_text")
    return cut(rows.groupBy("pair").applyInArrow(block_comparer(width, threshold), "a long, b long"))


def keyed(docs: DataFrame) -> DataFrame:
    """KEYS, text, and all columns of each row as a struct."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("t1"), F.crc32(text.cast("binary")).alias("t2"), text.alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )


def judged(docs: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows by KEYS, and the component of each class of equal words (d1, d2, low, component).

    Components are numbers of classes; `low` is the smallest doc_id of the class.
    """
    kinds = "doc long, t1 long, t2 long, n_shingles long, d1 long, d2 long, bands array<long>"
    sketches = cut(keyed(docs).select(*KEYS, "text").mapInArrow(sketcher(width), kinds))
    classes = sketches.where("n_shingles > 0").groupBy("d1", "d2").agg(F.first(F.struct(*KEYS, "n_shingles", "bands")).alias("r"), F.min("doc").alias("low"))
    nodes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "low", "r.*"))
    rows = nodes.select(F.col("node").alias("x"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("x").alias("y")).where("c > 1").select("key", "y")
    members = cut(rows.join(shared, "key").select("key", "x", "n", "y"))  # only rows of buckets with company
    texts = single(keyed(docs).select(*KEYS, "text"), KEYS, sketches)
    named = nodes.select("node", *KEYS)
    pairs = cut(members.where("x <> y").select("x", "y", "n").distinct())
    links = cut(confirmed(pairs, named, texts, width, threshold))
    labels = components(links)
    rest = across(members, labels, named, texts, width, threshold)
    found = nodes.select("node", "d1", "d2", "low").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if rest is not None:  # links of components make a far smaller graph than those of rows
        merged = components(rest).select(F.col("node").alias("component"), F.col("component").alias("into"))
        found = found.join(merged, "component", "left").withColumn("component", F.coalesce("into", "component"))
    return sketches, found.select("d1", "d2", "low", "component")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    Rows without a doc_id are kept if no row of their component has one.
    """
    sketches, classes = judged(docs, width, threshold)
    low = classes.groupBy("component").agg(F.min("low").alias("low"))
    of_class = classes.select("d1", "d2", "component").join(low, "component").select("d1", "d2", "low")
    found = sketches.select("doc", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left").withColumn("low", F.coalesce("low", "doc"))
    known = lambda c: F.when(F.col(c) != (1 << 63) - 1, F.col(c))
    return found.select(known("doc").alias("doc_id"), "n_shingles", known("low").alias("component_id"), (F.col("low") == F.col("doc")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, less all but one row of each component: that which comes first by doc_id.

    Rows without words are linked with nothing and stay.
    """
    sketches, classes = judged(docs, width, threshold)
    rows = sketches.select(*KEYS, "d1", "d2", "n_shingles")
    in_component = rows.where("n_shingles > 0").join(classes, ["d1", "d2"])
    kept = in_component.groupBy("component").agg(F.min(F.struct(*KEYS)).alias("k")).select("k.*").unionByName(rows.where("n_shingles = 0").select(*KEYS).distinct())
    left = keyed(docs).select(*KEYS, "row").join(kept, KEYS, "left_semi")
    return single(left, KEYS, sketches.where("n_shingles > 0").select(*KEYS)).select("row.*")
