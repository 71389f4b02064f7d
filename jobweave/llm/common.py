"""What the text operators share: table access, checkpoints, vectorised word hashes, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64, for prefix-sum polynomial hashes.
POLY = 0x9E3779B97F4A7C15
POLY_INVERSE = pow(POLY, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. Local mode without one gets a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: a lost executor costs a re-read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As `cut`, for wide rows: a compressed Parquet table in the same folder, which is read again by columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that Arrow and the C library hold unused back to the system: a worker lives on through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def single(rows: DataFrame, keys: list[str], all_keys: DataFrame) -> DataFrame:
    """The rows, and of those that repeat in `keys` one each; `all_keys` has the keys of all of them.

    Rows whose keys don't repeat are not shuffled for it, and without any that do the rows come back as they are.
    """
    again = cut(all_keys.groupBy(*keys).count().where("count > 1").select(*keys))
    if again.isEmpty():
        return rows
    return rows.join(again, keys, "left_anti").unionByName(rows.join(again, keys, "left_semi").dropDuplicates(keys))


def crc32_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def byte_table() -> np.ndarray:
    """A fixed 64-bit value for each byte value."""
    return mix64(np.arange(1, 257, dtype=U64) * U64(POLY))


class Powers:
    """Powers of POLY and of its inverse, grown on demand and kept for a worker's lifetime."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 12)
            grow = lambda base: np.multiply.accumulate(np.r_[U64(1), np.full(n - 1, base, U64)])
            self.up, self.down = grow(U64(POLY)), grow(U64(POLY_INVERSE))
        return self.up, self.down


POWERS, BYTES = Powers(), byte_table()
#: 1 for the bytes 0x20 and 0x09 to 0x0D, which divide words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(lowered: bytes) -> np.ndarray:
    """A 64-bit hash of each word between white-space bytes, in text order."""
    a = np.frombuffer(lowered, np.uint8)
    gap = np.r_[True, IS_SPACE[a], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, U64)
    up, down = POWERS.to(len(a) + 1)
    total = np.r_[U64(0), np.cumsum(BYTES[a] * up[: len(a)], dtype=U64)]
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def shingle_hashes(lowered: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `width` words; with fewer words, of the whole sequence."""
    w = word_hashes(lowered)
    if not len(w):
        return w
    width = min(width, len(w))
    n = len(w) - width + 1
    h = np.full(n, U64(width), U64)
    for k in range(width):
        h = mix64(h * U64(POLY) + w[k : k + n])
    return np.unique(h)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, component), component being the smallest node reachable.

    Alternates large-star and small-star contractions (each a min per node, a join and a distinct), so hubs
    only ever meet partial aggregates and joins that can be split. Each round is checkpointed.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
