"""A training corpus from raw documents: quality, repeated lines, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet and reads
them again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.llm import bpe, decontaminate, linededup, neardup, quality
from gazeframe.llm.common import numbered, read, remove_folder, shared_folder
from gazeframe.llm.queries import TOKENIZER_PATH


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, learnt from the stage's labelled documents, doesn't reject."""
    forest = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, forest, keep=docs.columns, prefix="__")
    return scored.where(F.col("__predicted") == 1).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later similar lines; a document that had words and keeps none goes."""
    cleaned = linededup.remove_similar_lines(docs, prefix="__")
    kept = cleaned.where((F.col("__n_removed") == 0) | F.col("text").rlike(r"\S"))
    length = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", length).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of repeated rows of it, one."""
    rows = numbered(docs, "__row")
    classes = neardup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"))
    # Within a group the smallest doc_id leads; the row number settles equal or missing ids.
    grouped = rows.select("__row", "doc_id").join(classes.select(F.col("doc_id").alias("__row"), "class_id"), "__row")
    leaders = grouped.groupBy("class_id").agg(F.min_by("__row", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "__row")).alias("__row")).select("__row")
    return rows.join(leaders, "__row", "left_semi").select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    rows = numbered(docs, "__row")
    leaked = decontaminate.leaks(rows.select(F.col("__row").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return rows.join(leaked.select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids themselves."""
    return bpe.encode_documents(docs, TOKENIZER_PATH, with_ids=True)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("bpe", tokens),
]

#: Boosted trees and alignments are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder, deleted once the next is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
