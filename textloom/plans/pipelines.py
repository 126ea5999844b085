"""Whole searches, composed of operators; queries are batches (query_id, query).

`stored` is an index of the documents (sources/index.py); without one the texts are read instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..operators import expand, fuse, retrieve, stats
from ..operators.common import materialise
from ..sources.index import Index

#: Places of the sources of expansion terms: of equal scores the one met first counts.
ORDER = {"nn": 0, "kg": 1, "prf": 2}


def labelled(docs: DataFrame, settings: Settings = Settings(), tagger: Callable[[Column], Column] = T.phrases, field: str = "NER_labels", text: str = "text") -> DataFrame:
    """docs with a label field: the tagger's spans of a text where the field's weight is above 0, else none and no tagger in the plan.

    tagger: an expression, or plugins.list_column of a model.  Null texts have no spans; a field that is there is replaced.
    """
    on = settings.field_weights.get(field, 0) > 0
    none = F.array().cast("array<string>")
    return docs.withColumn(field, F.coalesce(tagger(F.coalesce(F.col(text), F.lit(""))), none) if on else none)


def search(docs: DataFrame | Index, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, id, score, rank: the best documents by BM25."""
    return retrieve.bm25(docs, queries, query_id="query_id", query_text="query", k=settings.top_k, k1=settings.bm25_k1, b=settings.bm25_b)


def feedback(docs: DataFrame, queries: DataFrame, settings: Settings = Settings(), stored: Index | None = None) -> DataFrame:
    """query_id, source, candidate, ord: terms of the documents that a first search finds."""
    hits = retrieve.fetched(search(stored or docs, queries, settings), docs.select(F.col("doc_id").alias("id"), "text"))
    labels = hits.select("query_id", F.explode(T.phrases(F.col("text"))).alias("label")).groupBy("query_id", "label").agg(F.count("*").alias("n"))
    found = expand.feedback_candidates(labels, expand.query_spans(queries, "query_id", "query"), k=settings.expansions_per_source)
    return found.select("query_id", F.lit("prf").alias("source"), "candidate", (F.lit(ORDER["prf"] * 1_000_000) + F.col("rank")).alias("ord"))


def _of_spans(found: DataFrame, spans: DataFrame, source: str) -> DataFrame:
    first = spans.groupBy("query_id", "span").agg(F.min("ord").alias("at"))
    return found.join(first, ["query_id", "span"]).select("query_id", F.lit(source).alias("source"), "candidate", (F.lit(ORDER[source] * 1_000_000) + F.col("at") * 100 + F.col("rank")).alias("ord"))


def candidates(docs: DataFrame, queries: DataFrame, settings: Settings = Settings(), stored: Index | None = None, graph: DataFrame | None = None, neighbours: DataFrame | None = None) -> DataFrame:
    """query_id, source, candidate, ord from feedback and, where given, a term graph and the nearest spans.

    graph: symmetric edges (src, dst, weight); neighbours: (query_id, span, candidate, rank) of query spans.
    """
    spans = expand.query_spans(queries, "query_id", "query")
    out = feedback(docs, queries, settings, stored)
    if graph is not None:
        found = expand.graph_candidates(spans, graph, settings.max_degree, settings.expansions_per_source, settings.mode)
        out = out.unionByName(_of_spans(found, spans, "kg"))
    if neighbours is not None:
        found = expand.dissimilar_neighbours(neighbours, settings.expansions_per_source)
        out = out.unionByName(_of_spans(found, spans, "nn"))
    return out


def chosen_terms(docs: DataFrame, queries: DataFrame, settings: Settings = Settings(), stored: Index | None = None, weights: dict[str, float] | None = None, **sources) -> DataFrame:
    """query_id, candidate, score, rank: the best candidates of all sources."""
    spans = expand.query_spans(queries, "query_id", "query")
    found = candidates(docs, queries, settings, stored, **sources)
    if stored:
        idf = stored.idf
    else:  # the tokens of candidates alone are counted
        found = materialise(found, "candidates")
        idf = stats.sentence_idf(docs, "text", materialise(expand.candidate_tokens(found), "tokens"))
    return expand.select_terms(found, spans, idf, weights or {"prf": 1.0}, k=settings.max_expansions, default=settings.idf_default)


def expand_queries(docs: DataFrame, queries: DataFrame, settings: Settings = Settings(), stored: Index | None = None, weights: dict[str, float] | None = None, **sources) -> DataFrame:
    """query_id, query, expanded."""
    chosen = chosen_terms(docs, queries, settings, stored, weights, **sources)
    return expand.expanded_queries(queries, expand.query_spans(queries, "query_id", "query"), chosen)


def search_expanded(docs: DataFrame, queries: DataFrame, settings: Settings = Settings(), stored: Index | None = None, weights: dict[str, float] | None = None, **sources) -> DataFrame:
    """query_id, id, score, rank for queries expanded by feedback and the given sources.

    The expanded queries are written once: the second search counts their terms before it plans.
    """
    longer = materialise(expand_queries(docs, queries, settings, stored, weights, **sources).select("query_id", F.col("expanded").alias("query")), "expanded")
    return search(stored or docs, longer, settings.with_values(top_k=settings.top_k_expanded))


def rank(results: DataFrame, weights: dict[str, float], settings: Settings = Settings()) -> DataFrame:
    """Per-field results to ranked documents without duplicates: weigh, fuse, drop repeats, rank."""
    fused = fuse.rank_documents(fuse.fuse(fuse.weigh(results, weights, settings.mode))).withColumnRenamed("rank", "ord")
    named = fused.withColumn("identifier", T.find_identifier(F.col("doc_title"))).withColumn("texts", F.transform("passages", lambda p: p["text"]))
    return fuse.rank_documents(fuse.drop_duplicates(named).drop("ord", "identifier", "texts"), mode=settings.mode)
