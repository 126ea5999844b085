"""Places where models plug in; the defaults need no files."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stem as suffixes


class Embedder(Protocol):
    def __call__(self, texts: list[str], dims: int) -> np.ndarray: ...


class SpanTagger(Protocol):
    """Texts to lists of spans."""

    def __call__(self, texts: list[str]) -> list[list[str]]: ...


class SentenceSplitter(Protocol):
    def __call__(self, texts: list[str]) -> list[list[str]]: ...


def list_column(fn: SpanTagger | SentenceSplitter) -> Callable[[Column], Column]:
    """A tagger or splitter as a column function over Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fn(texts.fillna("").tolist()))

    return run


def normalise_words(words: Column, how: str = "lower", stem: Callable[[Column], Column] | None = None) -> Column:
    """Words lower-cased; stemmed by the suffix rules of functions/stem.py, or a column function of one's own."""
    low = F.transform(words, F.lower)
    if how == "lower":
        return low
    if how == "stem":
        return F.transform(low, stem or suffixes.stem)
    raise ValueError(how)


def register(spark: SparkSession) -> None:
    """SQL functions of the text operators, as expressions (no Python runs)."""
    make = lambda sig, returns, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sig} RETURNS {returns} RETURN {body}")
    make("tl_tokens(t STRING)", "ARRAY<STRING>", r"regexp_extract_all(lower(t), r'[\p{L}\p{N}]+', 0)")
    make("tl_space_collapse(t STRING)", "STRING", "array_join(filter(split(t, ' '), x -> x <> ''), ' ')")
    make("tl_similarity(a STRING, b STRING)", "DOUBLE", "100 - levenshtein(lower(a), lower(b)) / nullif(greatest(length(a), length(b)), 0) * 100")
    make("tl_id_part(id STRING, n INT)", "STRING", "get(split(id, '##'), n - 1)")


def with_spans(df: DataFrame, text: str, tagger: SpanTagger | None, out: str = "spans", weight: float = 1.0) -> DataFrame:
    """df with the spans of a text; with a weight of 0 or less, or without a tagger, there are none and nothing runs."""
    if tagger is None or weight <= 0:
        return df.withColumn(out, F.array().cast("array<string>"))
    return df.withColumn(out, list_column(tagger)(F.col(text)))
