"""Blobs addressed by content: a Parquet table of digest and bytes in any folder that Spark reaches (local, s3a, gs, abfss)."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOB = "digest string, size long, content binary"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: spark.checkpoint.dir. Local mode without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def opened(spark: SparkSession, folder: str) -> DataFrame:
    """All blobs of a folder (digest, size, content). Bytes are read only where content is selected."""
    return spark.read.schema(BLOB).parquet(folder)


def save(contents: DataFrame, folder: str, exists: bool = True) -> None:
    """Appends the blobs of contents(content) that the folder does not hold yet, each once; null contents are no blobs.

    Spark's committer makes a failed write leave nothing behind that readers see.
    """
    rows = contents.where("content is not null").select(digest(F.col("content")).alias("digest"), F.octet_length("content").cast("long").alias("size"), "content")
    rows = rows.groupBy("digest", "size").agg(F.first("content").alias("content"))
    if exists:
        rows = rows.join(opened(contents.sparkSession, folder).select("digest"), "digest", "left_anti")
    rows.write.mode("append").parquet(folder)


def remove(spark: SparkSession, folder: str, digests: DataFrame, target: str) -> None:
    """Writes the folder's blobs without the given digests to target; blobs that don't exist are no error."""
    opened(spark, folder).join(digests.select("digest"), "digest", "left_anti").write.mode("errorifexists").parquet(target)


def broken(blobs: DataFrame) -> DataFrame:
    """Blobs whose bytes are not of their digest or size."""
    return blobs.where((digest(F.col("content")) != F.col("digest")) | (F.octet_length("content") != F.col("size"))).select("digest", "size")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Plain files below a folder as blobs: path, digest, size and content."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return read.select("path", digest(F.col("content")).alias("digest"), F.col("length").alias("size"), "content")
