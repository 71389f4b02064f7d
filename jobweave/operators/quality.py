"""Invariants of job tables as queries that return violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def broken_histories(chapters: DataFrame) -> DataFrame:
    """Jobs whose ordinals are not 0, 1, 2, ... without gaps or repeats."""
    g = chapters.groupBy("tenant_id", "job_id").agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("d"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    return g.where("n <> d or lo <> 0 or hi <> n - 1")


def bad_links(stories: DataFrame) -> DataFrame:
    """Stories linked to themselves, or forked beyond their base's latest chapter."""
    base = stories.select(F.col("story_id").alias("base_story_id"), F.col("own_latest").alias("base_latest"))
    return stories.join(base, "base_story_id").where("base_story_id = story_id or fork_ordinal < 0 or fork_ordinal > base_latest")


def double_leases(jobs: DataFrame) -> DataFrame:
    """Lease ids held by several jobs."""
    return jobs.where("coalesce(lease_id, '') <> ''").withColumn("n", F.count("*").over(Window.partitionBy("lease_id"))).where("n > 1")


def artifacts(documents: DataFrame, inline_limit: int = 256) -> DataFrame:
    """Documents as artifacts: size, digest, and whether the bytes are kept inline."""
    size = F.octet_length("text")
    return documents.select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), size.cast("long").alias("size_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), (size <= inline_limit).alias("inline"),
    )
