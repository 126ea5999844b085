"""Passage splitter: sentences are packed greedily up to a number of words; one fold, no window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sentences, space_collapse

STATE = "struct<cum:int,cur:array<string>,out:array<array<string>>>"


def pack(sents: Column, most: int = 100, cut: int = 300, overlap: int = 0) -> Column:
    """array<array<string>> of sentences: a slice is emitted before a sentence that would exceed `most` words.

    A sentence over `most` words is cut to `cut` characters but counts with its original length.  With an overlap, a
    new slice starts with the last whole sentences that reach that many words.
    """

    def words(s: Column) -> Column:
        return F.size(F.split(s, " "))

    def tail(cur: Column) -> Column:
        back = F.aggregate(
            F.reverse(cur),
            F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept")),
            lambda a, s: F.when(a["n"] >= overlap, a).otherwise(F.struct((a["n"] + words(s)).alias("n"), F.concat(F.array(s), a["kept"]).alias("kept"))),
        )
        return back

    def step(state: Column, s: Column) -> Column:
        n = words(s)
        text = F.when(n > most, F.substring(s, 1, cut)).otherwise(s)
        full = state["cum"] + n > most
        if overlap:
            kept = tail(state["cur"])
            again = F.struct((kept["n"] + n).alias("cum"), F.concat(kept["kept"], F.array(text)).alias("cur"))
        else:
            again = F.struct(n.alias("cum"), F.array(text).alias("cur"))
        return F.when(full, F.struct(again["cum"].alias("cum"), again["cur"].alias("cur"), F.concat(state["out"], F.array(state["cur"])).alias("out"))).otherwise(F.struct((state["cum"] + n).alias("cum"), F.concat(state["cur"], F.array(text)).alias("cur"), state["out"].alias("out")))

    first = F.struct(F.lit(0).alias("cum"), F.array().cast("array<string>").alias("cur"), F.array().cast("array<array<string>>").alias("out")).cast(STATE)
    slices = F.aggregate(sents, first, step, lambda s: F.concat(s["out"], F.array(s["cur"])))
    return F.filter(slices, lambda x: F.size(x) > 0)


def passages(pages: DataFrame, id_col: str, text_col: str, most: int = 100, overlap: int = 0) -> DataFrame:
    """A row per passage: id, split_id (from 0), content, n_sentences, split_size."""
    text = space_collapse(F.coalesce(F.col(text_col), F.lit("")))
    packed = pages.select(F.col(id_col).alias("id"), F.posexplode(pack(sentences(text), most, overlap=overlap)).alias("split_id", "sents"))
    return packed.select("id", F.col("split_id").cast("long").alias("split_id"), F.array_join("sents", " ").alias("content"), F.size("sents").cast("long").alias("n_sentences"), F.lit(most).cast("long").alias("split_size"))
