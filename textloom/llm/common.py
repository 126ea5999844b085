"""Shared pieces: the folder that all executors see, and safe column handling."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import materialise, shared_dir

__all__ = ["by_id", "copies_of", "id_text", "lean", "materialise", "only_named", "shared_dir", "some_named", "table", "tasks"]


def lean(run: Callable) -> Callable:
    """A batch function that gives unused memory back when its task ends: workers live on between tasks."""

    @wraps(run)
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return go


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long) and text (string, null: empty) alone, so extra columns can't clash with working names."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def by_id(base: DataFrame) -> DataFrame:
    """base dealt by `kid`, the doc_id, or for rows without one a number of its text and partition (never null).

    Joins on kid need no null filter, so every join of a plan reuses the one shuffle of the texts, and rows without an
    id are spread.  Their kid can equal an id: what is joined to such rows must be left out where doc_id is null.
    """
    kid = F.coalesce("doc_id", F.xxhash64("text", F.spark_partition_id()))
    return base.withColumn("kid", kid).repartition(tasks(base.sparkSession), "kid")


def only_named(col: str) -> Column:
    """The column where the row has a doc_id, null elsewhere."""
    return F.when(F.col("doc_id").isNotNull(), F.col(col)).alias(col)


def some_named(col: str) -> Column:
    """Whether the row has a doc_id and the array holds anything.

    One condition over both sides of a join: a test of doc_id alone would move below the shuffle of the texts, which then
    differs from that of other joins and is made twice.
    """
    return F.size(F.coalesce(only_named(col), F.array())) > 0


def copies_of(named: DataFrame) -> DataFrame:
    """digest, rep (smallest doc_id), last, rows of the texts that several rows hold."""
    digest = named.select("doc_id", F.md5("text").alias("digest"))
    return materialise(digest.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).filter("rows > 1"), "copies")
