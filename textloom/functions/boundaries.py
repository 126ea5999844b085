"""Sentence ends that know abbreviations, learnt from texts without labels.

A word type that nearly always stands before a full stop, and is short, is an abbreviation: a log-likelihood ratio
compares how often it has a stop with how often words at large have one, and is drawn down by occurrences without a stop
and by length.  Counts are one aggregation; the result is a single expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Score from which a type is an abbreviation, least occurrences with a stop, and letters at most.
LEAST, OFTEN, LETTERS = 5.0, 3, 9


def type_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, stopped, plain: how often each lower-cased word stands with a full stop behind it, and without one.

    Words are letters, inner stops included; the last word of a line does not count, as its stop ends a sentence.
    """
    line = F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    rows = docs.select(line.alias("line")).select(F.explode(F.regexp_extract_all("line", F.lit(r"(?:^| )(\p{L}(?:\.?\p{L})*\.?)(?= )"), F.lit(1))).alias("w"))
    word = F.lower(F.rtrim(F.col("w"), F.lit(".")))
    stop = F.col("w").endswith(".")
    return rows.groupBy(word.alias("word")).agg(F.count_if(stop).alias("stopped"), F.count_if(~stop).alias("plain"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """word, stopped, plain, score of types(word, stopped, plain) that have a stop somewhere."""
    total = counts.agg(F.sum("stopped").alias("stops"), F.sum(F.col("stopped") + F.col("plain")).alias("all"))
    x = counts.filter("stopped > 0").crossJoin(F.broadcast(total))  # one row
    n, k = F.col("stopped") + F.col("plain"), F.col("stopped")
    share, sure = F.col("stops") / F.col("all"), F.lit(0.99)
    ratio = 2 * (k * (F.log(sure) - F.log(share)) + F.col("plain") * (F.log(1 - sure) - F.log(F.greatest(1 - share, F.lit(1e-9)))))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    # Unlike words that end sentences, abbreviations have a stop wherever they stand, and few letters.
    score = ratio * F.exp(-F.col("plain") / k) / letters * (F.length("word") - letters + 1)
    return x.select("word", "stopped", "plain", F.round(F.when(n > 0, score), 6).alias("score"))


def abbreviations(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> list[str]:
    """The abbreviations of some texts: short types of a score, which an expression can hold."""
    found = abbreviation_scores(type_counts(docs, text_col)).filter((F.col("score") >= least) & (F.col("stopped") >= OFTEN) & (F.length("word") <= LETTERS))
    return sorted(r.word for r in found.select("word").collect())


def sentences(text: Column, known: list[str]) -> Column:
    """As functions.text.sentences, but a full stop behind one of the known abbreviations ends nothing.

    An abbreviation before a line feed does end its sentence.  Null texts give null.
    """
    if not known:
        return T.sentences(text)
    kept = "|".join(re.escape(w) for w in sorted(known, key=lambda w: (-len(w), w)))
    ends = rf"(?<=[.!?])(?<!(?<![\p{{L}}.])(?:{kept})\.) +"
    return F.filter(F.transform(F.split(F.regexp_replace(text, f"(?iu){ends}", "\n"), "\n"), T.strip), lambda s: s != "")
