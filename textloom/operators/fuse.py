"""Fusion, deduplication and ranking of per-field results.

Results: query_id, field, id (passage), doc_title, text, score, and whatever columns follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import top


def weigh(results: DataFrame, weights: dict[str, float], mode: str = "intended") -> DataFrame:
    """Scores times field weights; unknown fields count as they are; compat: bm25 fields are never weighted."""
    known = {f: w for f, w in weights.items() if not (mode == "compat" and f.startswith("bm25"))}
    if not known:
        return results
    name = F.when(F.col("field").startswith("bm25"), "bm25").otherwise(F.col("field"))
    table = F.create_map(*(x for f, w in known.items() for x in (F.lit(f), F.lit(float(w)))))
    return results.withColumn("score", F.col("score") * F.coalesce(table[name], F.lit(1.0)))


def merge_passages(results: DataFrame) -> DataFrame:
    """One row per query and passage: summed score, retrieving fields, first text; zero scores are left out."""
    kept = results.filter("score <> 0")
    return kept.groupBy("query_id", "doc_title", "id").agg(F.round(F.sum("score"), 6).alias("score"), F.array_sort(F.collect_list("field")).alias("retrieved_by"), F.min("text").alias("text"))


def fuse(results: DataFrame) -> DataFrame:
    """One row per query and document: sum of scores, number of hits, passages by falling score (ties by id)."""
    p = merge_passages(results)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "id", "text", "retrieved_by", "score")))
    return p.groupBy("query_id", "doc_title").agg(F.round(F.sum("score"), 6).alias("score"), F.sum(F.size("retrieved_by")).cast("long").alias("times_retrieved"), F.transform(order, lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["score"].alias("score"), x["retrieved_by"].alias("retrieved_by"))).alias("passages"))


def label_counters(results: DataFrame, label_types: list[str]) -> DataFrame:
    """query_id, doc_title, label_type, label, n: labels of a type count for hits of that field, or of bm25."""
    pairs = F.array(*(F.struct(F.lit(t).alias("label_type"), F.col(t).alias("labels")) for t in label_types))
    rows = results.filter("score <> 0").select("query_id", "doc_title", "field", F.explode(pairs).alias("p")).filter((F.col("p.label_type") == F.col("field")) | (F.col("field") == "bm25"))
    return rows.select("query_id", "doc_title", "p.label_type", F.explode("p.labels").alias("label")).groupBy("query_id", "doc_title", "label_type", "label").agg(F.count("*").alias("n"))


def counters_map(counts: DataFrame) -> DataFrame:
    """counters map<label_type, map<label, n>> per query and document."""
    inner = counts.groupBy("query_id", "doc_title", "label_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    return inner.groupBy("query_id", "doc_title").agg(F.map_from_entries(F.collect_list(F.struct("label_type", "labels"))).alias("counters"))


def drop_duplicates(ranked: DataFrame) -> DataFrame:
    """Documents (query_id, doc_title, ord, identifier, texts array) that repeat neither identifier nor any text.

    Order is `ord`; texts of dropped documents count as seen; a document whose own texts repeat is dropped, too.
    """
    ids = ranked.filter("identifier is not null and identifier <> ''").groupBy("query_id", "identifier").agg(F.min("ord").alias("first_id"))
    texts = ranked.select("query_id", "ord", F.posexplode("texts").alias("pos", "text"))
    first = texts.groupBy("query_id", "text").agg(F.min(F.struct("ord", "pos")).alias("first"))
    repeated = texts.join(first, ["query_id", "text"]).filter(F.struct("ord", "pos") > F.col("first")).select("query_id", "ord").distinct()
    left = ranked.join(ids, ["query_id", "identifier"], "left").filter("first_id is null or first_id = ord").drop("first_id")
    return left.join(repeated, ["query_id", "ord"], "left_anti")


def rank_documents(docs: DataFrame, k: int | None = None, mode: str = "intended") -> DataFrame:
    """Documents by falling score with their rank; compat: of equal scores only the first stays."""
    if mode == "compat":
        docs = top(docs, ["query_id", "score"], [F.col("doc_title")], 1).drop("rank")
    order = [F.desc("score"), F.col("doc_title")]
    return top(docs, ["query_id"], order, k) if k else docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def untangle(docs: DataFrame) -> DataFrame:
    """Passages by themselves: those found by title alone go, and add their score to later ones of the document.

    docs: query_id, doc_title, pos, id, score, retrieved_by.
    """
    alone = F.col("retrieved_by") == F.array(F.lit("doc_title"))
    w = Window.partitionBy("query_id", "doc_title").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    more = F.coalesce(F.last(F.when(alone, F.col("score")), ignorenulls=True).over(w), F.lit(0.0))
    return docs.withColumn("more", more).withColumn("alone", alone).filter("not alone").withColumn("score", F.round(F.col("score") + F.col("more"), 6)).drop("more", "alone")


def paginate(ranked: DataFrame, page: int, per_page: int = 10) -> DataFrame:
    """Page (from 1) of ranked documents."""
    return ranked.filter((F.col("rank") > (page - 1) * per_page) & (F.col("rank") <= page * per_page))


def page_count(ranked: DataFrame, per_page: int = 10, mode: str = "intended") -> DataFrame:
    """query_id, pages; compat: a partial last page is not counted."""
    whole = F.floor if mode == "compat" else F.ceil
    return ranked.groupBy("query_id").agg(whole(F.count("*") / per_page).cast("long").alias("pages"))
