"""Deduplication of documents by identifier or text, and n-grams that all pages of a document share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .common import materialise


def first_by_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, first_id, keep: the smallest id with the same text is kept."""
    x = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    # Repeated texts alone, written, so that the join can split the rows of a text that very many documents have.
    first = x.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_id")
    out = x.join(materialise(first, "first"), "digest", "left").select("id", F.coalesce("first_id", "id").alias("first_id"))
    return out.select("id", "first_id", (F.col("id") == F.col("first_id")).alias("keep"))


def by_identifier(files: DataFrame, path: str = "path") -> DataFrame:
    """path, identifier, keep: a verdict, nothing is deleted.

    Tracked-changes files go; an identifier that is another one with five characters (its year) appended goes; of each
    identifier the first path stays.
    """
    name = F.regexp_replace(F.regexp_extract(F.col(path), r"([^/]+)$", 1), r"\.[^.]*$", "")
    x = files.select(F.col(path).alias("path"), T.file_identifier(name).alias("identifier"), T.tracked_changes(name).alias("tracked"))
    ids = x.filter("not tracked").select("identifier").distinct()
    suffixed = ids.withColumn("base", F.expr("substring(identifier, 1, greatest(length(identifier) - 5, 0))")).join(ids.select(F.col("identifier").alias("base")), "base", "left_semi").select("identifier", F.lit(True).alias("dated"))
    first = x.filter("not tracked").groupBy("identifier").agg(F.min("path").alias("first"))
    out = x.join(suffixed, "identifier", "left").join(first, "identifier", "left")
    return out.select("path", "identifier", (~F.col("tracked") & F.col("dated").isNull() & F.coalesce(F.col("path") == F.col("first"), F.lit(False))).alias("keep"))


def shared_lengths(ref: np.ndarray, other: np.ndarray, least: int, most: int) -> np.ndarray:
    """For each position of ref the words, at most `most`, for which it runs as it does somewhere in other (0: under least)."""
    ids = np.concatenate([ref, other])
    rank, out = ids, np.zeros(len(ref), np.int32)
    for n in range(1, most + 1):
        if n > 1:
            rank = np.unique(rank[:-1] * (int(ids.max()) + 1) + ids[n - 1 :], return_inverse=True)[1]
        own, there = len(ref) - n + 1, len(ref)
        if own <= 0 or len(rank) <= there:
            break
        hit = np.isin(rank[:own], rank[there:])
        if not hit.any():
            break
        if n >= least:
            out[:own][hit] = n
    return out


def _lengths(least: int, most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for doc, ref, other in zip(f["doc"], f["ref"], f["w"], strict=True):
                ids = np.unique(np.concatenate([ref, other]), return_inverse=True)[1].astype(np.int64)
                found.append((doc, shared_lengths(ids[: len(ref)], ids[len(ref) :], least, most)))
            yield pd.DataFrame(found, columns=["doc", "n"])

    return run


def common_ngrams(pages: DataFrame, doc: str, page: str, text: str, least: int = 3, most: int = 29) -> DataFrame:
    """doc, ngram, n: the longest n-gram of words that every page of a document holds (ties by text).

    A gram of all pages is in the shortest one, so each page tells for each word of that one how far it runs alike; the
    least over the pages is what all share.  One pass over the pages, and a row per word of the shortest page is all that
    is counted.  Documents of one page share nothing, nor do rows without a document; rows that share a page id must each hold the gram.
    """
    x = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.split(F.coalesce(F.col(text), F.lit("")), " ").alias("w"))
    held = x.groupBy("doc").agg(F.countDistinct("page").alias("pages"), F.min(F.struct(F.size("w").alias("n"), "page", "w")).alias("short"))
    # Written, so that a join can split the rows of a document with very many pages.
    short = materialise(held.filter("pages > 1").select("doc", F.col("short.w").alias("ref")), "shortest")
    told = x.select("doc", "w").join(short, "doc").mapInPandas(_lengths(least, most), f"doc {pages.schema[doc].dataType.simpleString()}, n array<int>")
    run = told.select("doc", F.posexplode("n").alias("pos", "n")).groupBy("doc", "pos").agg(F.min("n").alias("n")).filter(F.col("n") >= least)
    longest = run.groupBy("doc").agg(F.max("n").alias("n"))
    grams = run.join(longest, ["doc", "n"]).join(short, "doc").select("doc", F.array_join(F.slice("ref", F.col("pos") + 1, F.col("n")), " ").alias("ngram"), F.col("n").cast("long").alias("n"))
    return grams.groupBy("doc").agg(F.min("ngram").alias("ngram"), F.first("n").alias("n"))
