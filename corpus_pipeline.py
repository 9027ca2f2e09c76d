"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents;
the last returns packed pieces. None of the stages' results can be written in SQL as a whole (a fitted classifier,
weighted sampling, a tokenizer), so there is no ORACLE_SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import files_for, free_name, materialise, table
from graphloom.llm.decontaminate import drop_contaminated
from graphloom.llm.line_dedup import drop_lines
from graphloom.llm.near_dup import drop_near_duplicates
from graphloom.llm.pack import packed
from graphloom.llm.quality import METADATA, THRESHOLD, train, with_scores


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; null and empty texts have a score like all others, and repeated rows are judged alike."""
    score = free_name(docs, "score")
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels"), metadata=tuple(m for m in METADATA if m in docs.columns)), column=score)
    return scored.where(F.col(score) >= THRESHOLD).drop(score)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that several documents share, but in the largest doc_id (in all rows of that id); n_chars is counted anew. A null text stays null."""
    left = drop_lines(docs).coalesce(files_for(docs))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: of the least doc_id, null last. Empty and null texts are one class; repeated rows leave one."""
    return drop_near_duplicates(docs).coalesce(files_for(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item; null and empty texts have no words and stay, repeated rows stay or go together."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).coalesce(files_for(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed: an empty or null text is its end token, repeated rows are packed one by one."""
    return packed(docs).coalesce(files_for(docs))


STAGES = [
    ("quality", good_quality),
    ("lines", without_shared_lines),
    ("near_duplicates", without_near_duplicates),
    ("benchmark", without_benchmark),
    ("packing", packed_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
