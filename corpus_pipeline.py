"""A training-text pipeline of five operators, each a stage from documents to documents (the last to sequences)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import decontaminate, minhash, packing, quality, suffix
from jobweave.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Each row is scored by its own text, also if it repeats or lacks a doc_id; null and empty texts get the score of no
    evidence. Extra columns stay, whatever their names; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 or more): that with the smallest doc_id.

    Rows are judged each by id and text: other texts under the same id stay, and rows without an id are kept, but for
    near copies of a row that comes before them (those without one come last). Null, empty and word-free texts are near
    to nothing and stay. Extra columns stay, whatever their names; an empty table stays empty.
    """
    return minhash.one_of_each(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that begin earlier in the corpus, n_chars counted again; those with nothing left go.

    Each row keeps what is left of its own text, also if it repeats or lacks a doc_id; of rows equal in id and text, all
    but one have nothing left. Null, empty and short texts stay as they are. Extra columns stay, whatever their names; an
    empty table stays empty.
    """
    left = suffix.without_repeats(docs).where("kept is null or length(trim(kept)) > 0")
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    columns = (F.coalesce(new[c].cast(docs.schema[c].dataType), F.col("row")[c]) if c in new else F.col("row")[c] for c in docs.columns)
    return left.select(*(x.alias(c) for x, c in zip(columns, docs.columns, strict=True)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Each row is judged by its own text, also if it repeats or lacks a doc_id; null and empty texts contain nothing and
    stay. Extra columns stay, whatever their names; an empty table stays empty.
    """
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 4096 tokens.

    Each row is packed, also if it repeats or lacks a doc_id; a null or empty text is its end token alone. Extra columns
    go; an empty table gives an empty one.
    """
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]
#: Trained dictionaries, suffix sorting and subword ids have no SQL form; a test compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
