"""Defined terms, labels computed once and scattered back, profiles of predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import top

GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct character grams of up to GRAM characters: every substring begins with one of them."""
    n = F.length(text)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, size))).otherwise(F.array().cast("array<string>")))))


def containing(spans: DataFrame, terms: DataFrame) -> DataFrame:
    """span, term: all terms(term) that a span(span) contains, lower-cased; by an equi join on the term's first gram."""
    s = spans.select("span").distinct().select("span", F.explode(_grams(F.lower("span"))).alias("g"))
    t = terms.select(F.lower("term").alias("term")).filter("term <> ''").distinct().select("term", F.substring("term", 1, GRAM).alias("g"))
    return s.join(t, "g").filter(F.lower("span").contains(F.col("term"))).select("span", "term")


def defined_term_check(spans: DataFrame, terms: DataFrame) -> DataFrame:
    """span, how: exact, part (a term is within the span) or none."""
    found = containing(spans, terms).groupBy("span").agg(F.max(F.col("term") == F.lower("span")).alias("exact"))
    return spans.select("span").distinct().join(found, "span", "left").select("span", F.when(F.col("exact"), "exact").when(F.col("exact").isNotNull(), "part").otherwise("none").alias("how"))


def definition_counts(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """term, n: how often each definition(term) occurs in occurrences(term); 0 for those never seen."""
    n = occurrences.groupBy("term").agg(F.count("*").alias("n"))
    return definitions.select("term").distinct().join(n, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def outstanding(definitions: DataFrame, seen: DataFrame) -> DataFrame:
    return definitions.select("term").distinct().join(seen.select("term"), "term", "left_anti")


def skip_sentences(sentences: DataFrame, doc: str, prefix: str = "all_figures", gold: DataFrame | None = None) -> DataFrame:
    """Sentences of documents whose id lacks the prefix and that aren't gold(doc)."""
    left = sentences.filter(~F.col(doc).startswith(prefix))
    return left.join(gold.select(doc).distinct(), doc, "left_anti") if gold is not None else left


def scatter(rows: DataFrame, key: str, labels: str, compute: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """rows with `out`: compute(label) -> (label, value) run once per distinct label, put back in order.

    Blank labels never enter and are left out of the result; empty lists give empty lists.
    """
    flat = rows.select(key, F.posexplode(labels).alias("pos", "label")).filter("trim(label) <> ''")
    values = compute(flat.select("label").distinct())
    back = flat.join(values, "label").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("__x"))
    value = values.schema["value"].dataType.simpleString()
    return rows.join(back, key, "left").withColumn(out, F.coalesce(F.transform("__x", lambda p: p["value"]), F.array().cast(f"array<{value}>"))).drop("__x")


def top_labels(counts: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """The k most frequent labels(by..., label, n) of each group, ties by label."""
    return top(counts, by, [F.desc("n"), F.col("label")], k)


def preview(passages: Column, k: int = 3) -> Column:
    return F.slice(passages, 1, k)


def prediction_profile(predictions: DataFrame) -> DataFrame:
    """Per origin of predictions(doc_id, words, tags): sentences, tokens without edges, and per tag head their number."""
    heads = ("PD", "BH", "IH", "BD", "ID")
    x = predictions.select(F.when(F.col("doc_id").startswith("d"), "domestic").otherwise("non-domestic").alias("origin"), F.greatest(F.size("words") - 2, F.lit(0)).alias("n"), F.slice("tags", 2, F.greatest(F.size("tags") - 2, F.lit(0))).alias("t"))

    def number(head: str) -> Column:
        return F.sum(F.size(F.filter("t", lambda t: t.startswith(head)))).cast("long").alias(head)

    return x.groupBy("origin").agg(F.count("*").alias("n_sentences"), F.sum("n").cast("long").alias("n_tokens"), F.avg("n").alias("mean_tokens"), *map(number, heads))


def merge_continued(spans: DataFrame, key: str) -> DataFrame:
    """Spans(key, type, start, end) whose type continues (`C-x`) join the span of type x that ends right before."""
    base = F.regexp_replace("type", "^C-", "")
    marked = spans.select(key, base.alias("type"), "start", "end", F.col("type").startswith("C-").alias("more"))
    w = Window.partitionBy(key, "type").orderBy("start")
    opens = ~F.col("more") | ~F.coalesce(F.col("start") == F.lag("end").over(w) + 1, F.lit(False))
    return marked.withColumn("n", F.sum(F.when(opens, 1).otherwise(0)).over(w)).groupBy(key, "type", "n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("n")
