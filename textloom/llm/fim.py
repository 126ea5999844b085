"""Fill-in-middle transformation over the lines of a text, as relations.

A text's units (lines with their line feed) are numbered rows of lengths; a window sums them up; cut requests, one row
for each text, meet the units at their ordinals; an aggregate gives the offsets of a text, and three substrings of it
change places.  The texts are dealt once, by `kid`; units, requests and offsets are made where their text lies, so
nothing else moves.

A request comes from a hash of seed and doc_id alone, so a text is cut alike at every run and in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, tasks

UNIT = r"[^\n]*+\n|[^\n]++"
#: Marks before prefix, suffix and middle; a text that holds one of them stays plain.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}


def numbers(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hexadecimal digits of a hash of seed and doc_id (null: no digits)."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _lines(text: Column) -> Column:
    """How many units a text has."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def requests(texts: DataFrame, seed: int) -> DataFrame:
    """kid, first and last: the numbers of units before the middle and before the suffix of each text."""
    cut = texts.groupBy("kid").agg(F.max(_lines(F.col("text"))).alias("n"))
    h = numbers(F.col("kid.doc_id"), seed)
    a, b = (x % (F.col("n") + 1) for x in h[:2])
    return cut.select("kid", F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))


def offsets(texts: DataFrame, seed: int) -> DataFrame:
    """kid, start and stop: the code points before the middle and before the suffix, where one of them is not 0."""
    units = texts.select("kid", F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), lambda u: F.length(u))).alias("ordinal", "size"))
    # Rows of one kid hold one text: its units stand side by side, as often as there are such rows.
    upto = Window.partitionBy("kid").orderBy("ordinal").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    units = units.select(F.col("kid").alias("unit_of"), (F.col("ordinal") + 1).cast("long").alias("ordinal"), F.sum(F.col("size").cast("long")).over(upto).alias("chars"))
    # One condition over both sides keeps the join on kid alone, by which both lie.
    at = (F.col("ordinal") - F.col("first")) * (F.col("ordinal") - F.col("last")) == 0
    met = units.join(requests(texts, seed), (F.col("kid") == F.col("unit_of")) & at)

    def chars(cut: str) -> Column:
        here = F.when(F.col("ordinal") == F.col(cut), F.col("chars"))
        return F.coalesce(F.max(here) / F.count(here), F.lit(0)).cast("long")

    return met.groupBy("kid").agg(chars("first").alias("start"), chars("last").alias("stop"))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output for each row of docs(doc_id, text).

    rate: percentage of texts that are transformed; spm_rate: of those, with the suffix first.  A text stays plain (null
    chars) where it is empty or null or holds a mark.  Null doc_ids count as no digits in the hash; rows that repeat are
    each transformed, alike where doc_id and text are; an empty table gives no rows.  Extra columns are ignored.
    """
    base = id_text(docs)
    # The partition keeps many equal rows apart; nothing else depends on it.
    kid = F.struct("doc_id", F.xxhash64("text", F.spark_partition_id()).alias("told"))
    texts = base.select(kid.alias("kid"), "text").repartition(tasks(docs.sparkSession), "kid")
    both = texts.join(offsets(texts, seed).withColumnRenamed("kid", "of"), F.col("kid") == F.col("of"), "left")
    h = numbers(F.col("kid.doc_id"), seed)
    text = F.col("text")
    marked = text.rlike("<[PSM]>")
    form = F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    at = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("start", "stop")]
    x = both.select(F.col("kid.doc_id").alias("doc_id"), _lines(text).alias("n"), form.alias("form"), *at, "text")
    start, stop = F.col("start"), F.col("stop")
    prefix = F.concat(F.lit(MARKS["prefix"]), text.substr(F.lit(1), start.cast("int")))
    middle = F.concat(F.lit(MARKS["middle"]), text.substr((start + 1).cast("int"), (stop - start).cast("int")))
    suffix = F.concat(F.lit(MARKS["suffix"]), text.substr((stop + 1).cast("int"), F.length(text)))
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).otherwise(F.concat(suffix, prefix, middle))
    cut = F.col("form") != "plain"
    return x.select("doc_id", "n", "form", F.when(cut, start).alias("prefix_chars"), F.when(cut, stop - start).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed output was made from: its parts back in order."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
