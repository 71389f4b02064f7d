"""Hard negatives by a Voronoi-partitioned distributed kNN join.

Vectors are put on one sphere: with M the largest norm, s becomes (s, sqrt(M^2 - |s|^2)) and an anchor a becomes (a, 0), so
that a larger inner product is a smaller angle. A bounded sample of rows, PIVOTS of them, cuts the sphere into Voronoi
cells; every row goes to the cell of its nearest pivot and keeps its angle to it. Anchors of near cells form groups of
about GROUP. A score that an anchor's k-th partner must reach follows from the pivots' own scores and, for positives, from
the k least angles in each cell; by the triangle inequality it becomes, for each group and cell, an interval of angles,
and a row is sent only to groups in whose interval it lies. There an exact join scores it against the group's anchors in
64-bit integers. Intervals are never narrower than the bounds allow, so the result is that of a full comparison.

The first join finds each anchor's positives among rows of its label, the second the negatives, whose scores must lie in
a band below the positive's: its upper end is a bound, too. Candidates of a group meet its anchors in parts of about PART
rows, each giving its best, and the best of these are merged by a window that is limited before the shuffle. So a hot
label, cell or vector is split, and no group grows with the data. How many rows the bounds spare depends on the vectors;
rows spread evenly over many dimensions go to most groups of anchors, and the cost is that of a full comparison.

Defined cases: rows with a null vec_id, label or vector, or with any null or non-finite component, take no part. Of rows that
repeat a vec_id, one takes part, the least by label and vector. A vector that is shorter than others counts as filled with
zeros; an empty one scores 0 everywhere. Ties go by smaller vec_id. Anchors without a row of their label have no positives
and no output, positives without a negative in the band none either. Extra columns are ignored; an empty table gives an
empty one. Scores are exact while they fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.common import cut, stored

#: Rows sampled as pivots, anchors in a group, candidate rows that meet a group's anchors at once.
PIVOTS, GROUP, PART = 256, 1024, 8192
#: Intervals up to which they are sent to all executors.
BROADCAST_ROWS = 200_000
#: Radians by which intervals are widened for rounding.
SLACK = 1e-6
EXACT = float(1 << 53)
FAR = 10.0  # an angle beyond all


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of integers, filled with zeros where some are shorter."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(n.max(initial=0))
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; by floating point where every partial sum is exact in it."""
    width = max(x.shape[1], y.shape[1])
    x, y = wide(x, width), wide(y, width)
    most = lambda v: float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    if most(x) * most(y) < EXACT:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


class Sphere:
    """The pivots and the radius M; angles of rows and anchors to the pivots."""

    def __init__(self, vectors: list[list[int]], radius: float) -> None:
        self.pivots = matrix(pa.array(vectors, pa.list_(pa.int64())))
        self.radius = radius
        self.lifts = np.sqrt(np.maximum(radius**2 - norms(self.pivots) ** 2, 0))

    def inner(self, x: np.ndarray) -> np.ndarray:
        width = max(x.shape[1], self.pivots.shape[1])
        return wide(x, width).astype(np.float64) @ wide(self.pivots, width).astype(np.float64).T

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its angle to the cell's pivot."""
        if not self.radius:
            return np.zeros(len(x), np.int64), np.zeros(len(x))
        lift = np.sqrt(np.maximum(self.radius**2 - norms(x) ** 2, 0))
        cosine = (self.inner(x) + lift[:, None] * self.lifts) / self.radius**2
        cell = cosine.argmax(axis=1)
        return cell, np.arccos(np.clip(cosine[np.arange(len(x)), cell], -1, 1))

    def anchors(self, x: np.ndarray) -> np.ndarray:
        """Angles of anchors to all pivots."""
        length = norms(x)[:, None] * self.radius
        return np.arccos(np.clip(self.inner(x) / np.where(length, length, 1), -1, 1))

    def angle(self, scores: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The angle at which a row has the score with the anchor; without norms, beyond all."""
        length = norms(x)[:, None] * self.radius
        return np.where(length > 0, np.arccos(np.clip(scores / np.where(length, length, 1), -1, 1)), FAR)


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): labels as they are to be, components as whole 256ths."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("q"))
    again = cut(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if again.isEmpty():
        return rows
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")
    return rows.join(again, "vec_id", "left_anti").unionByName(least)


def celled(sphere: Sphere):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = sphere.rows(matrix(batch["q"]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("vec_id", "label", "q")), pa.array(cell, pa.int64()), pa.array(angle, pa.float64())], names=["vec_id", "label", "q", "cell", "angle"])

    return run


def chain(sphere: Sphere) -> list[int]:
    """For each pivot its place in a walk that goes on to the nearest one not yet visited."""
    near = sphere.inner(sphere.pivots) + sphere.lifts[:, None] * sphere.lifts
    place, at = [0] * len(near), 0
    for k in range(len(near)):
        place[at] = k
        near[:, at] = -np.inf
        at = int(near[at].argmax())
    return place


def in_groups(anchors: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """Adds `group` to anchors: of about GROUP, within equal keys, from cells that follow each other in the walk."""
    cells = anchors.groupBy(*keys, place.alias("place")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys or [F.lit(0)]).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "place", "n", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / GROUP).alias("from"), F.ceil(F.col("n") / GROUP).alias("parts"))
    split = F.pmod(F.xxhash64("vec_id"), F.col("parts"))  # a cell with many anchors
    rows = anchors.withColumn("place", place).join(F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells, [*keys, "place"])
    return rows.withColumn("group", F.xxhash64(*keys, "from", F.when(F.col("parts") > 1, F.struct("place", split)))).drop("place", "n", "from", "parts")


def intervals(x: np.ndarray, least: np.ndarray, most: np.ndarray, sphere: Sphere) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the least and largest angle at which some anchor x may score between `least` and `most` with a row."""
    to = sphere.anchors(x)
    near, far = sphere.angle(least[:, None], x), sphere.angle(most[:, None], x)
    far = np.where(far == FAR, 0, far)
    low = np.maximum(to - near, far - to) - SLACK
    return low.min(axis=0, initial=FAR), (to + near + SLACK).max(axis=0, initial=-FAR)


def kth_largest(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """In each row the k-th largest allowed score, or minus infinity."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    held = np.where(allowed, scores, -np.inf)
    return -np.partition(-held, k - 1, axis=1)[:, k - 1]


def positive_bounds(sphere: Sphere, ids: np.ndarray, labels: np.ndarray, k: int):
    """(group, anchors of a label) and (group, cells of that label) to (group, label, cell, low, high)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, own = matrix(left["q"]), left["vec_id"].to_numpy()
        label = int(left["label"][0].as_py()) if len(left) else 0
        allowed = (labels == label) & (ids != own[:, None])
        bound = kth_largest(products(x, sphere.pivots).astype(np.float64), allowed, k)
        cells = right["cell"].to_numpy()
        angles = right["angles"].to_pylist()  # the k + 1 least of each cell, as one may be the anchor's own
        to = sphere.anchors(x)
        sums = np.concatenate([to[:, [c]] + np.array(a) for c, a in zip(cells, angles, strict=True)] or [np.zeros((len(x), 0))], axis=1)
        if sums.shape[1] > k:
            angle = np.minimum(np.partition(sums, k, axis=1)[:, k] + SLACK, np.pi)
            bound = np.maximum(bound, np.cos(angle) * norms(x) * sphere.radius)
        low, high = intervals(x, bound, np.full(len(x), np.inf), sphere)
        low, high = low[cells], high[cells]
        some = (right["nearest"].to_numpy() <= high) & (right["farthest"].to_numpy() >= low)
        n = int(some.sum())
        group = left["group"][0].as_py() if len(left) else 0
        return pa.table({"group": pa.array([group] * n, pa.int64()), "label": pa.array([label] * n, pa.int64()), "cell": pa.array(cells[some], pa.int64()), "low": pa.array(low[some]), "high": pa.array(high[some])})

    return run


def band(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest integer score of a negative."""
    return -(-low * positive // 100), high * positive // 100


def negative_bounds(sphere: Sphere, ids: np.ndarray, labels: np.ndarray, k: int, low: int, high: int):
    """(group, anchors with their positives) to (group, cell, low, high)."""

    def run(group: pa.Table) -> pa.Table:
        x, own = matrix(group["q"]), group["label"].to_numpy()
        scores = products(x, sphere.pivots).astype(np.float64)
        least, most = np.full(len(x), np.inf), np.full(len(x), -np.inf)
        for i, positives in enumerate(group["positives"].to_pylist()):
            other = scores[i : i + 1, labels != own[i]]
            for p in positives:
                a, b = band(p["score"], low, high)
                if a <= b:
                    found = kth_largest(other, (other >= a) & (other <= b), k)[0]
                    least[i], most[i] = min(least[i], max(a, found)), max(most[i], b)
        x, least, most = (v[most >= least] for v in (x, least, most))
        lows, highs = intervals(x, least, most, sphere)
        some = np.flatnonzero(lows <= highs)
        return pa.table({"group": pa.array([group["group"][0].as_py()] * len(some), pa.int64()), "cell": pa.array(some, pa.int64()), "low": pa.array(lows[some]), "high": pa.array(highs[some])})

    return run


def best_positives(k: int):
    """Anchors and rows of one label: the k best of each anchor."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("vec_id")
        own, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        out = []
        if len(own) and len(ids):
            scores = products(matrix(left["q"]), matrix(right["q"]))
            for i in range(len(own)):
                order = np.argsort(-scores[i], kind="stable")[: k + 1]
                order = order[ids[order] != own[i]][:k]
                out.append((np.full(len(order), own[i]), ids[order], scores[i][order]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("anchor_id", "positive_id", "score"), (pa.array(c, pa.int64()) for c in columns), strict=True)))

    return run


def best_negatives(k: int, low: int, high: int):
    """Anchors with their positives, and rows: for each positive the k best rows of other labels in its band."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("vec_id")
        own, ids, labels, of = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), right["label"].to_numpy(), left["label"].to_numpy()
        out = []
        if len(own) and len(ids):
            scores = products(matrix(left["q"]), matrix(right["q"]))
            for i, positives in enumerate(left["positives"].to_pylist()):
                bands = [band(p["score"], low, high) for p in positives]
                some = np.flatnonzero((labels != of[i]) & (scores[i] >= min(a for a, _ in bands)) & (scores[i] <= max(b for _, b in bands)))
                some = some[np.argsort(-scores[i][some], kind="stable")]
                down = -scores[i][some]
                for p, (a, b) in zip(positives, bands, strict=True):
                    take = some[(at := int(np.searchsorted(down, -b))) : min(at + k, int(np.searchsorted(down, -a, "right")))]
                    fill = lambda v, n=len(take): np.full(n, v, np.int64)
                    out.append((fill(own[i]), fill(p["positive_id"]), fill(p["score"]), ids[take], scores[i][take]))
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(names, (pa.array(c, pa.int64()) for c in columns), strict=True)))

    return run


def sent(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, once for each group in whose interval of their cell they lie."""
    ranges = cut(ranges)
    ranges = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
    return rows.join(ranges, keys).where("angle between low and high").select("group", "vec_id", "label", "q")


def fresh(rows: DataFrame) -> DataFrame:
    """The same columns under new identities, so that rows of one origin can be cogrouped."""
    return rows.select(*(F.col(c).alias(c) for c in rows.columns))


def met(anchors: DataFrame, rows: DataFrame, compare, kinds: str) -> DataFrame:
    """compare(anchors, rows) for each group, its rows in `parts` parts."""
    left = anchors.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return left.groupBy("group", "part").cogroup(fresh(right).groupBy("group", "part")).applyInArrow(compare, kinds)


def ranked(rows: DataFrame, keys: list[str], score: str, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), by)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    kinds = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    out = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = taking_part(vectors)
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    radius = rows.agg(F.max(square)).first()[0]
    if radius is None:
        return spark.createDataFrame([], kinds).withColumn("rank", F.lit(0)).select(*out)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    sphere, ids, labels = Sphere([r["q"] for r in sample], radius**0.5), np.array([r["vec_id"] for r in sample]), np.array([r["label"] for r in sample])
    rows = stored(rows.mapInArrow(celled(sphere), "vec_id long, label long, q array<long>, cell long, angle double"))
    place = F.get(F.lit(chain(sphere)), F.col("cell").cast("int"))
    anchors = rows.where(F.col("vec_id") % every == 0)

    # positives: anchors in groups of one label, against rows of that label
    k = positives
    cells = rows.groupBy("label", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("nearest"), F.max("angle").alias("farthest"))
    least = ranked(rows.select("label", "cell", (-F.col("angle")).alias("back"), "vec_id"), ["label", "cell"], "back", "vec_id", k + 1)
    least = least.groupBy("label", "cell").agg(F.collect_list(-F.col("back")).alias("angles"))
    cells = cut(cells.join(least, ["label", "cell"]))
    parts = cells.groupBy("label").agg(F.ceil(F.sum("n") / PART).alias("parts"))
    one = cut(in_groups(anchors.select("vec_id", "label", "q", "cell"), ["label"], place).join(parts, "label"))
    of_group = one.select("group", "label", "parts").distinct().join(cells, "label")
    ranges = one.groupBy("group").cogroup(fresh(of_group).groupBy("group")).applyInArrow(positive_bounds(sphere, ids, labels, k), "group long, label long, cell long, low double, high double")
    near = sent(rows, ranges, ["label", "cell"]).join(parts, "label")
    pairs = met(one.select("group", "vec_id", "q", "parts"), near.select("group", "vec_id", "q", "parts"), best_positives(k), "anchor_id long, positive_id long, score long")
    best = ranked(pairs, ["anchor_id"], "score", "positive_id", k).groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))

    # negatives: anchors of all labels in a group, against rows of other labels
    some = anchors.join(best.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "q", "cell", "positives")
    two = cut(in_groups(cut(some), [], place))
    ranges = two.groupBy("group").applyInArrow(negative_bounds(sphere, ids, labels, negatives, low, high), "group long, cell long, low double, high double")
    total = F.lit(-(-rows.count() // PART)).cast("long")
    near = sent(rows, ranges, ["cell"]).withColumn("parts", total)
    found = met(two.select("group", "vec_id", "label", "q", "positives").withColumn("parts", total), near, best_negatives(negatives, low, high), kinds)
    return ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(*out)
