"""Query expansion: nearest neighbours, a weighted term graph, pseudo-relevance feedback, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import broadcast_if_small, hint_if_small, materialise, top
from .stats import idf_weights


def dissimilar_neighbours(pairs: DataFrame, k: int = 2) -> DataFrame:
    """pairs(query_id, span, candidate, rank) whose candidate is neither in the span nor like it; the first k a span."""
    ok = ~F.lower("span").contains(F.lower("candidate")) & ~T.similar(F.col("candidate"), F.col("span"))
    return top(pairs.filter(ok).withColumnRenamed("rank", "near"), ["query_id", "span"], [F.col("near"), F.col("candidate")], k)


#: Rows of names with a number, up to which they are broadcast to the edges of a graph.
NAMES = 500_000


def undirected(edges: DataFrame) -> DataFrame:
    """src, dst, weight in both directions, each pair once (its least weight)."""
    once = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    return both_ways(once)


def both_ways(once: DataFrame) -> DataFrame:
    """src, dst, weight in both directions of edges that have each pair once."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return once.select(F.explode(ways).alias("way"), "weight").select("way.src", "way.dst", "weight")


def _measured(spans: DataFrame, edges: DataFrame, max_degree: int) -> tuple[DataFrame, DataFrame]:
    """Degrees of the nodes that spans may lead to, and the edges of those spans; of all nodes where spans are many.

    Few spans need the nodes two steps away alone: the graph is counted once, written, and only read after that.  Many
    read it where it lies: names above max_degree and names that are met are few, and travel to the edges.
    """
    wanted = materialise(spans.select(F.col("span").alias("src")).filter("src is not null").distinct(), "spans")
    if hint_if_small(wanted) is not F.broadcast:
        return _measured_for_many(edges, max_degree)
    edges = materialise(edges, "edges")
    of = lambda nodes: edges.join(hint_if_small(nodes)(nodes), "src", "left_semi")
    own = of(wanted).groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") <= max_degree).select("src")
    near = materialise(of(materialise(own, "own")), "near")
    met = materialise(near.select("src").union(near.select("dst")).distinct(), "met")
    around = materialise(of(met).select("src", "dst"), "around")
    others = materialise(around.select(F.col("dst").alias("src")).distinct(), "others")
    degree = materialise(of(others).groupBy("src").agg(F.count("*").alias("degree")), "degree")
    known = hint_if_small(degree)(degree.select(F.col("src").alias("dst"), F.col("degree").alias("d")))
    mean = around.join(known, "dst").groupBy("src").agg(F.count("*").alias("degree"), F.avg("d").alias("avg_degree"))
    return mean.withColumnRenamed("src", "node"), near


def _measured_for_many(edges: DataFrame, max_degree: int) -> tuple[DataFrame, DataFrame]:
    """Degrees of all nodes, their means for neighbours of nodes up to max_degree, and the edges of the latter.

    Edges are shuffled once, for the mean.
    """
    few = lambda nodes: broadcast_if_small(nodes, NAMES)
    degree = materialise(edges.groupBy("src").agg(F.count("*").alias("degree")), "degree")
    near = edges.join(few(degree.filter(F.col("degree") > max_degree).select("src")), "src", "left_anti")
    met = materialise(near.select(F.col("dst").alias("src")).distinct(), "met")
    known = few(degree.select(F.col("src").alias("dst"), F.col("degree").alias("d")))
    mean = edges.join(few(met), "src", "left_semi").select("src", "dst").join(known, "dst").groupBy("src").agg(F.avg("d").alias("avg_degree"))
    nodes = degree.join(mean, "src", "left").withColumnRenamed("src", "node")
    return materialise(nodes, "nodes"), near


def graph_candidates(spans: DataFrame, edges: DataFrame, max_degree: int = 75, k: int = 2, mode: str = "intended") -> DataFrame:
    """query_id, span, candidate, score, rank from a symmetric graph.

    Nodes above max_degree aren't expanded, neighbours whose average neighbour degree is above it are left out.  A
    neighbour's score is weight + ln(degree) + ln(average neighbour degree), ascending, ties by name.  intended: the
    first k of each span; compat: the first k over all spans of a query.
    """
    nodes, edges = _measured(spans, edges, max_degree)
    own = nodes.filter(F.col("degree") <= max_degree).select(F.col("node").alias("span"))
    other = nodes.filter(F.col("avg_degree") <= max_degree).select(F.col("node").alias("dst"), (F.log("degree") + F.log("avg_degree")).alias("measure"), T.bare_term(F.col("node")).alias("bare"))
    start = spans.select("query_id", "span", "ord").distinct().join(own, "span").withColumn("bare_span", T.bare_term(F.col("span")))
    near = edges.select(F.col("src").alias("span"), "dst", "weight").join(broadcast_if_small(other, NAMES), "dst").join(start, "span")
    scored = near.select("query_id", "span", "ord", F.col("dst").alias("candidate"), F.round(F.col("weight") + F.col("measure"), 6).alias("score"), "bare_span", "bare")
    kept = scored.filter(F.col("candidate").contains(F.col("span")) | (~T.alike(F.col("bare_span"), F.col("bare")) & ~F.lower("span").contains(F.lower("candidate")))).drop("bare_span", "bare")
    by, order = (["query_id", "span"], [F.col("score"), F.col("candidate")]) if mode == "intended" else (["query_id"], [F.col("ord"), F.col("score"), F.col("candidate")])
    return top(kept, by, order, k).drop("ord")


def feedback_candidates(labels: DataFrame, spans: DataFrame, k: int = 2, least: int = 2) -> DataFrame:
    """query_id, candidate, n, rank: the k most frequent labels(query_id, label, n) of retrieved documents.

    Blank labels, labels of the query itself, those under `least` and those like any span of the query are left out.
    """
    total = labels.filter("label <> ''").groupBy("query_id", "label").agg(F.sum("n").cast("long").alias("n")).filter(F.col("n") >= least)
    held = spans.groupBy("query_id").agg(F.collect_set("span").alias("spans"))
    ok = F.coalesce(F.forall("spans", lambda s: (F.col("label") != s) & ~T.similar(F.col("label"), s)), F.lit(True))
    return top(total.join(held, "query_id", "left").filter(ok).select("query_id", F.col("label").alias("candidate"), "n"), ["query_id"], [F.desc("n"), F.col("candidate")], k)


def select_terms(candidates: DataFrame, spans: DataFrame, idf: DataFrame, weights: dict[str, float], k: int = 5, default: float = 0.5) -> DataFrame:
    """query_id, candidate, score, rank from candidates(query_id, source, candidate, ord): the k best.

    A candidate scores its mean IDF times the weight of its source, summed over sources; spans of the query are
    skipped; ties go to the first met.
    """
    table = F.create_map(*(x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))))
    left = candidates.join(spans.select("query_id", F.col("span").alias("candidate")).distinct(), ["query_id", "candidate"], "left_anti")
    weighed = left.join(idf_weights(left.select(F.col("candidate").alias("term")), idf, default).withColumnRenamed("term", "candidate"), "candidate")
    total = weighed.groupBy("query_id", "candidate").agg(F.round(F.sum(F.col("weight") * F.coalesce(table[F.col("source")], F.lit(0.0))), 6).alias("score"), F.min("ord").alias("ord"))
    return top(total, ["query_id"], [F.desc("score"), F.col("ord"), F.col("candidate")], k).drop("ord")


def candidate_tokens(candidates: DataFrame) -> DataFrame:
    """token: the distinct tokens of candidates, whose IDF select_terms asks for."""
    return candidates.select(F.explode(T.tokens(F.col("candidate"))).alias("token")).distinct()


def expanded_queries(queries: DataFrame, spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """query_id, query, expanded: queries(query_id, query) with their spans and chosen terms appended."""
    s = spans.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", "span"))), lambda x: x["span"]).alias("s"))
    t = chosen.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"]).alias("t"))
    none = F.array().cast("array<string>")
    both = queries.join(s, "query_id", "left").join(t, "query_id", "left").select("query_id", "query", F.coalesce("s", none).alias("s"), F.coalesce("t", none).alias("t"))
    return both.select("query_id", "query", F.when(F.size("s") + F.size("t") > 0, T.expand_query(F.col("query"), F.col("s"), F.col("t"))).otherwise(F.col("query")).alias("expanded"))


def query_spans(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query_id, span, ord: cleaned spans of each query by the default tagger."""
    x = queries.select(F.col(id_col).alias("query_id"), F.posexplode(T.phrases(T.sanitise_query(F.col(text_col)))).alias("ord", "phrase"))
    return x.select("query_id", T.strip_determiners(F.coalesce(T.clean_span(F.col("phrase")), F.lit(""))).alias("span"), "ord").filter("span <> ''")


# SKOS lookups over triples(s, p, o): labels that contain a term, and labels of nodes related to theirs.


def labelled(triples: DataFrame, terms: DataFrame, kinds: tuple[str, ...] = ("prefLabel", "altLabel")) -> DataFrame:
    """term, node: nodes with a label that contains a term (lower-cased)."""
    labels = triples.filter(F.col("p").isin(*kinds)).select(F.col("s").alias("node"), F.lower("o").alias("label"))
    return terms.join(labels, F.col("label").contains(F.lower("term"))).select("term", "node").distinct()


def related_labels(triples: DataFrame, terms: DataFrame, forward: tuple[str, ...] = (), backward: tuple[str, ...] = ()) -> DataFrame:
    """term, label: preferred labels of nodes s with s -forward-> node or node -backward-> s, for nodes of a term."""
    found = labelled(triples, terms)
    ahead = triples.filter(F.col("p").isin(*forward)).select("s", F.col("o").alias("node"))
    behind = triples.filter(F.col("p").isin(*backward)).select(F.col("o").alias("s"), F.col("s").alias("node"))
    names = triples.filter("p = 'prefLabel'").select("s", F.col("o").alias("label"))
    return found.join(ahead.union(behind).distinct(), "node").join(names, "s").select("term", "label").distinct()


def narrower(triples: DataFrame, terms: DataFrame) -> DataFrame:
    return related_labels(triples, terms, ("broader",), ("narrower",))


def broader(triples: DataFrame, terms: DataFrame) -> DataFrame:
    return related_labels(triples, terms, ("narrower",), ("broader",))


def close(triples: DataFrame, terms: DataFrame) -> DataFrame:
    return related_labels(triples, terms, ("exactMatch", "closeMatch"), ())


def one_hop(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """term, node: nodes with any relation to a node whose preferred label contains the term."""
    found = labelled(triples, terms, ("prefLabel",))
    return found.join(triples.select(F.col("s").alias("near"), F.col("o").alias("node")), "node").select("term", F.col("near").alias("node")).distinct()


def same_node(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """term, label: all labels of the nodes that a term finds."""
    names = triples.filter(F.col("p").isin("prefLabel", "altLabel")).select(F.col("s").alias("node"), F.col("o").alias("label"))
    return labelled(triples, terms).join(names, "node").select("term", "label").distinct()
