"""A training-corpus pipeline: each stage takes (spark, docs, sf_dir), and its result is written and read again.

toxicity -> line_dedup -> near_dedup -> decontaminate -> pack.  All stages but the last return the columns of documents.
Documents that the toxicity classifier rejects go; lines that repeat an earlier one go, but every document stays (with
what is left of its text); one document of each near-duplicate group stays; contaminated documents go; the rest is
packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bestfit, decontam, line_dedup, minhash, tokens, toxicity
from textloom.llm.common import shared_dir, table
from textloom.llm.queries import TOKENIZER
from textloom.operators.common import forget, made, remove


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.3 or more; learns from labelled documents of its input.

    Null and empty texts score as texts without features; rows are judged each by its own text.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of 30 characters or more within one edit of an earlier line; all rows stay.

    Rows with a null doc_id or a null text stay as they are.
    """
    return line_dedup.replace_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by a similarity of 0.8 over shingles of five words.

    Rows with a null doc_id and texts without words stay; rows that share a doc_id stay or go together.
    """
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words at least 5 % lie in 13-word windows of benchmark items.

    Rows are judged each by its own text; null and empty texts stay.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of at most 4096 tokens; a null or empty text is its end mark alone."""
    return bestfit.pack(docs, tokens.public(TOKENIZER))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontaminate", benchmark_stage), ("pack", pack_stage)]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages leave of `documents`; each stage's result is written and read again.

    Null and empty texts are documents without words: no stage drops them, and each is packed as its end mark.  Rows with
    a null doc_id pass the stages that compare documents.  An empty table gives no rows.
    Tables that a stage wrote on its way go when its result is written, and so does the result before it.
    """
    docs, before, start = table(spark, sf_dir, "documents"), None, made()
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/textloom/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        forget(spark, start)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
