"""Registered queries of name rules, markup, annotations, vocabularies and small plan pieces.

Inputs that the tables lack (file names, titles, annotation lines) are made from their columns by expressions that both
engines read alike; the rules themselves are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import common, dedup, evaluate, expand, retrieve, stats, tagging, terms, vectors
from ..sources import readers, sinks
from . import sql as S
from . import store
from .search_queries import IDF, _items, _nearest, _vectors, bm25_sql
from .text_queries import PHRASES, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# File names and titles from keys.

NAME = """CASE k % 14 WHEN 0 THEN concat('BS EN ', k, '-1-', 2000 + k % 20, '+A1') WHEN 1 THEN concat('NA to BS EN ', k, '-2:', 1990 + k % 30, ' TC') WHEN 2 THEN concat(k, '-12 AB-3 x') WHEN 3 THEN concat('Eurocode ', k % 9, ' Part 1-', k)
WHEN 4 THEN concat('Approved Document B - ', k) WHEN 5 THEN concat('LPS 1181 part - ', k) WHEN 6 THEN concat('DD CEN TS 1187-', 2000 + k % 20, ' x') WHEN 7 THEN concat('CP 3-', k, ' Code') WHEN 8 THEN concat('CFPA E Guideline No ', k, ' Tracked')
WHEN 9 THEN concat('NT Build ', k, ' -') WHEN 10 THEN concat('PD CEN TR 12-', k, ' y') WHEN 11 THEN concat('PAS 9980-', k, ' z') WHEN 12 THEN concat('tracked note ', k) ELSE concat('other name ', k) END"""
TITLE = """CASE k % 12 WHEN 0 THEN concat('BS EN ', k, '-1:2005 # ring') WHEN 1 THEN concat('Licensed to X,BS 476-', k, ' # fire') WHEN 2 THEN 'Lic without a comma' WHEN 3 THEN concat('guide to BS 5588-', k, ':1990')
WHEN 4 THEN concat('D 12 P 34-', k) WHEN 5 THEN concat('Licensed,', k, '-AB 34') WHEN 6 THEN concat('Eurocode 5 - ', k) WHEN 7 THEN 'nothing here' WHEN 8 THEN concat('+A1 BS 12-', k) WHEN 9 THEN concat('see ICS 91-1 and BS 9999:', k) WHEN 10 THEN concat('LIC ICS ', k) ELSE name END"""
PARTS = "SELECT p_partkey AS k, p_name AS name FROM part"


def _keyed(spark: SparkSession, sf_dir: str, **exprs: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_name AS name").select("k", *(F.expr(e).alias(n) for n, e in exprs.items()))


def _identifier_sql(x: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'starts_with({x}, {S.lit(s)})' for s in starts)} THEN regexp_extract({x}, {S.lit('^' + p)}, 0)" for starts, p in T.FILE_NAMES)
    found = f"(CASE {cases} ELSE '' END)"
    return f"CASE WHEN {found} = '' THEN {x} ELSE regexp_replace(string_split({found}, '+A')[1], '[- :+]+$', '') END"


@query(f"SELECT k, {_identifier_sql('n')} AS identifier, regexp_matches(n, 'TC|[Tt]racked') AS tracked FROM (SELECT k, {NAME} AS n FROM ({PARTS}))")
def file_identifiers(spark, sf_dir):
    return _keyed(spark, sf_dir, n=NAME).select("k", T.file_identifier(F.col("n")).alias("identifier"), T.tracked_changes(F.col("n")).alias("tracked"))


FILE = "concat('/in/', k % 3, '/', CASE k % 5 WHEN 0 THEN concat('BS EN ', k, '-1') WHEN 1 THEN concat('BS EN ', k - 1, '-1:2005') WHEN 2 THEN concat('BS EN ', k - 2, '-1 Tracked') WHEN 3 THEN concat('BS EN ', k - 3, '-1') ELSE concat('PAS ', k, '-22 x') END, '.pdf')"


@query(f"""WITH f AS (SELECT path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '[.][^.]*$', '') AS n FROM (SELECT {FILE} AS path FROM ({PARTS}))), i AS (SELECT path, {_identifier_sql('n')} AS identifier, regexp_matches(n, 'TC|[Tt]racked') AS tracked FROM f),
u AS (SELECT DISTINCT identifier FROM i WHERE NOT tracked), d AS (SELECT identifier FROM u WHERE length(identifier) > 5 AND substr(identifier, 1, length(identifier) - 5) IN (SELECT identifier FROM u))
SELECT path, identifier, NOT tracked AND identifier NOT IN (SELECT identifier FROM d) AND path = min(CASE WHEN NOT tracked THEN path END) OVER (PARTITION BY identifier) AS keep FROM i""")
def file_dedup(spark, sf_dir):
    """One path of each identifier; tracked changes and identifiers with a year appended go."""
    return dedup.by_identifier(_keyed(spark, sf_dir, path=FILE).select("path"))


DOC = "CASE k % 4 WHEN 0 THEN concat('BS ', k, '--x_y.pdf') WHEN 1 THEN concat('PD', k, '_part1.pdf') WHEN 2 THEN concat('CP ', k, 'part 2.pdf') ELSE concat('LPS', k, '.old.pdf') END"
RAW = "CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('BS EN ', k, '-1:2005 Fire doors') WHEN 3 THEN concat(k, '-12 Roofs') WHEN 4 THEN concat('Eurocode 3-', k, ' Steel') WHEN 5 THEN 'BS 1 # done' ELSE concat('Plain ', name) END"


@query(f"""WITH t AS (SELECT k, {DOC} AS d, {RAW} AS t FROM ({PARTS})), n AS (SELECT *, CASE WHEN regexp_matches(t, '^(BS|NA|[+])') THEN regexp_extract(t, {S.lit('^' + T.STANDARD)}, 0) WHEN regexp_matches(t, '^[0-9]') THEN regexp_extract(t, {S.lit('^' + T.NUMBERED)}, 0) WHEN starts_with(t, 'Eurocode') THEN regexp_extract(t, {S.lit('^' + T.EUROCODE)}, 0) ELSE '' END AS number,
string_split(d, CASE WHEN contains(d, '--') THEN '--' WHEN contains(d, '_') THEN '_' WHEN contains(d, 'part') THEN 'part' ELSE '.' END)[1] AS id FROM t)
SELECT k, CASE WHEN contains(t, ' # ') THEN t WHEN coalesce(t, '') = '' THEN concat(id, ' # [Could not grab title]') WHEN number <> '' THEN concat(id, ' # ', substr(t, length(number) + 2)) ELSE concat(id, ' # ', t) END AS title FROM n""")
def document_titles(spark, sf_dir):
    return _keyed(spark, sf_dir, d=DOC, t=RAW).select("k", T.compose_title(F.col("d"), F.col("t")).alias("title"))


_STARTS = ", ".join(f"({i}, {S.lit(s)})" for i, s in enumerate(T.IDENTIFIER_STARTS))


@query(f"""WITH t AS (SELECT k, {TITLE} AS title FROM ({PARTS})), s(i, st) AS (VALUES {_STARTS}), r AS (SELECT k, i, st, substr(title, instr(title, st) + length(st)) AS rest FROM t JOIN s ON contains(title, st)),
b AS (SELECT k, arg_max(concat(st, rest), length(rest) * 100 - i) FILTER (rest <> '') AS best, bool_or(starts_with(title, st)) AS known FROM r JOIN t USING (k) GROUP BY k),
c AS (SELECT k, CASE WHEN starts_with(trim(title), 'Lic') THEN CASE WHEN contains(title, ',') THEN substr(title, instr(title, ',') + 1) END WHEN known THEN title ELSE best END AS x FROM t LEFT JOIN b USING (k))
SELECT k, nullif(CASE WHEN regexp_matches(x, '^(BS|NA|[+]|P|D)') THEN regexp_extract(x, {S.lit('^' + T.STANDARD)}, 0) WHEN regexp_matches(x, '^[0-9]') THEN regexp_extract(x, {S.lit('^' + T.NUMBERED)}, 0) WHEN starts_with(x, 'Eurocode') THEN regexp_extract(x, {S.lit('^' + T.EUROCODE)}, 0) END, '') AS identifier FROM c""")
def title_identifiers(spark, sf_dir):
    return _keyed(spark, sf_dir, title=TITLE).select("k", T.find_identifier(F.col("title")).alias("identifier"))


# Annotation lines from turns: contiguous spans, two halves in either order, and a kind of line that is left out.

ANN = """CASE turn % 4 WHEN 3 THEN concat('A', turn, chr(9), 'Confidence T', turn) WHEN 2 THEN concat('T', turn, chr(9), 'act ', turn * 7 + 40, ' ', turn * 7 + 41 + length(text) % 20, ';', turn * 7, ' ', turn * 7 + 5, chr(9), role)
WHEN 1 THEN concat('T', turn, chr(9), 'func ', turn * 7, ' ', turn * 7 + 5, ';', turn * 7 + 40, ' ', turn * 7 + 41 + length(text) % 20, chr(9), role) ELSE concat('T', turn, chr(9), 'obj ', turn * 7, ' ', turn * 7 + 1 + length(text) % 20, chr(9), role) END"""
SPANS = """SELECT conv_id AS doc, concat('T', turn) AS span_id, CASE turn % 4 WHEN 2 THEN 'act' WHEN 1 THEN 'func' ELSE 'obj' END AS span_type, (turn * 7)::INT AS span_start, CASE WHEN turn % 4 > 0 THEN (turn * 7 + 5)::INT END AS gap_start,
CASE WHEN turn % 4 > 0 THEN (turn * 7 + 40)::INT END AS gap_end, (turn * 7 + CASE WHEN turn % 4 > 0 THEN 41 ELSE 1 END + length(text) % 20)::INT AS span_end, role AS span_text FROM conversations WHERE turn % 4 < 3"""


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_annotations(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.expr(ANN).alias("value")))


@query(f"SELECT * REPLACE (coalesce(gap_start, -1) AS gap_start, coalesce(gap_end, -1) AS gap_end) FROM ({SPANS})")
def annotation_spans(spark, sf_dir):
    x = _annotated(spark, sf_dir)
    return x.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("gap_start", "gap_end")})


@query(f"SELECT span_type, count(*) AS n, sum(l)::BIGINT AS chars, round(avg(l), 6) AS mean_chars, count(gap_start) AS n_discontiguous FROM (SELECT *, span_end - span_start - coalesce(gap_end - gap_start, 0) AS l FROM ({SPANS})) GROUP BY span_type")
def span_statistics(spark, sf_dir):
    return stats.span_stats(_annotated(spark, sf_dir)).withColumn("mean_chars", F.round("mean_chars", 6))


_PART = "CASE WHEN k % {m} = 0 THEN -1 ELSE k % 50 + {n} END"


@query(f"""SELECT k, ss, CASE WHEN se < 0 THEN ss ELSE se END AS se, CASE WHEN es >= 0 THEN es WHEN se >= 0 THEN se ELSE ss END AS es, CASE WHEN ee >= 0 THEN ee WHEN es >= 0 THEN es WHEN se >= 0 THEN se ELSE ss END AS ee
FROM (SELECT k, k % 50 AS ss, {_PART.format(m=3, n=2)} AS se, {_PART.format(m=4, n=5)} AS es, {_PART.format(m=5, n=7)} AS ee FROM ({PARTS}))""")
def filled_indices(spark, sf_dir):
    x = _keyed(spark, sf_dir, ss="k % 50", se=_PART.format(m=3, n=2), es=_PART.format(m=4, n=5), ee=_PART.format(m=5, n=7))
    return x.select("k", tagging.fill_indices(*(F.col(c) for c in ("ss", "se", "es", "ee"))).alias("x")).select("k", "x.*")


# Word pieces, markup, labels, definitions, query lists.

_JOINED = f"array_to_string({S.tokens('text')}, ' ')"


@query(f"SELECT doc_id, md5({_JOINED}) AS joined, md5(regexp_replace({_JOINED}, '^(the|a|an) ', '')) AS bare FROM documents")
def word_pieces(spark, sf_dir):
    """Words cut into pieces of four letters and a rest are put together again."""
    cut = F.flatten(F.transform(T.tokens(F.col("text")), lambda w: F.when(F.length(w) > 4, F.array(F.substring(w, 1, 4), F.concat(F.lit("##"), w.substr(F.lit(5), F.length(w))))).otherwise(F.array(w))))
    x = table(spark, sf_dir, "documents").select("doc_id", cut.alias("p"))
    return x.select("doc_id", F.md5(T.join_pieces(F.col("p"))).alias("joined"), F.md5(T.join_pieces_bare(F.col("p"))).alias("bare"))


MARKED = "CASE turn % 5 WHEN 0 THEN concat('The #DEFINED#', role, '#TERM# and #DEFINED#x y#TERM# are ', text) WHEN 1 THEN concat('#QUOTE#', text, '#ENDQUOTE##') WHEN 2 THEN concat('#NOTE#', text, '#ENDNOTE##') WHEN 3 THEN concat('#Figure12#', role, '#EndFigure12#') ELSE text END"


@query(f"""SELECT conv_id, turn, md5(CASE turn % 5 WHEN 0 THEN concat('The ', role, ' and x y are ', text) WHEN 1 THEN substr(m, 8, length(m) - 18) WHEN 2 THEN substr(m, 7, length(m) - 16) WHEN 3 THEN role ELSE text END) AS digest,
CASE WHEN turn % 5 = 0 THEN concat(role, '|x y') ELSE '' END AS terms FROM (SELECT *, {MARKED} AS m FROM conversations)""")
def markup_strip(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(MARKED).alias("m"))
    return m.select("conv_id", "turn", F.md5(T.strip_markup(F.col("m"))).alias("digest"), F.array_join(T.defined_terms(F.col("m")), "|").alias("terms"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN md5(text) ELSE '' END AS label FROM conversations")
def blank_labels(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.blank_label(F.md5("text"), F.col("role") == "user").alias("label"))


_DEFINITION = "concat('  \"', p_name, '\"-', p_type, ' ')"


@query("SELECT p_partkey AS k, concat(lower(p_name), ' - ', lower(p_type)) AS term FROM part")
def definition_forms(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.normalise_definition(F.expr(_DEFINITION)).alias("term"))


@query(f"SELECT query, count(*) AS n FROM (SELECT {S.strip('x')} AS query FROM (SELECT unnest(string_split(text, '. ')) AS x FROM benchmark)) WHERE query <> '' GROUP BY query")
def query_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\. ")).alias("value"))
    return readers.query_lines(lines).groupBy("query").agg(F.count("*").alias("n"))


@query(f"WITH {IDF} SELECT token, CASE WHEN round(idf, 6) > 4 THEN round(round(idf, 6) * 0.8, 6) END AS weight FROM idf")
def idf_gate(spark, sf_dir):
    return store.idf(spark, sf_dir).select("token", F.round(stats.gate_tokens(F.round("idf", 6), 4.0, 0.8, 0.5), 6).alias("weight"))


@query("SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0")
def skip_sentences(spark, sf_dir):
    """Documents that count as figures and those that are annotated are left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("concat(CASE WHEN doc_id % 7 = 0 THEN 'all_figures' ELSE 'd' END, doc_id)").alias("doc"))
    return terms.skip_sentences(docs, "doc", gold=docs.filter("doc_id % 5 = 0")).select("doc_id")


# Joins of evaluation, vocabularies and stored work.


@query(f"SELECT g.doc_id, min(p.doc_id) AS found FROM (SELECT *, {S.tokens('text')} AS t FROM documents WHERE doc_id % 2 = 0) g JOIN (SELECT *, {S.tokens('text')} AS t FROM documents WHERE doc_id % 2 = 1) p ON g.t = p.t GROUP BY g.doc_id")
def token_list_join(spark, sf_dir):
    """Gold texts (even ids) with the first predicted one (odd ids) of the same tokens."""
    x = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return evaluate.align(x.filter("doc_id % 2 = 0"), x.filter("doc_id % 2 = 1"), "tokens", "doc_id").select("doc_id", "found")


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations below regions; each close to the next one, with a second label."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    node = F.concat(F.lit("n"), "n_nationkey")
    rows = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    parts = [
        rows(n, node, "prefLabel", F.col("n_name")),
        rows(n, node, "altLabel", F.concat("n_name", F.lit(" country"))),
        rows(n, node, "broader", F.concat(F.lit("r"), "n_regionkey")),
        rows(n, node, "closeMatch", F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string"))),
        rows(r, F.concat(F.lit("r"), "r_regionkey"), "prefLabel", F.col("r_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_FOUND = "f AS (SELECT x.n_name AS term, n.* FROM nation x JOIN nation n ON contains(lower(n.n_name), lower(x.n_name)) OR contains(lower(concat(n.n_name, ' country')), lower(x.n_name)))"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"))


@query("SELECT DISTINCT x.r_name AS term, concat('n', n_nationkey) AS node FROM region x JOIN region r ON contains(lower(r.r_name), lower(x.r_name)) JOIN nation n ON n.n_regionkey = r.r_regionkey")
def skos_one_hop(spark, sf_dir):
    return expand.one_hop(_vocabulary(spark, sf_dir), table(spark, sf_dir, "region").select(F.col("r_name").alias("term")))


@query(f"WITH {_FOUND} SELECT DISTINCT term, n.n_name AS label FROM f JOIN nation n ON (n.n_nationkey + 1) % 25 = f.n_nationkey")
def skos_close(spark, sf_dir):
    return expand.close(_vocabulary(spark, sf_dir), _nations(spark, sf_dir))


@query(f"WITH {_FOUND} SELECT DISTINCT term, unnest([n_name, concat(n_name, ' country')]) AS label FROM f")
def skos_same_node(spark, sf_dir):
    return expand.same_node(_vocabulary(spark, sf_dir), _nations(spark, sf_dir))


def _phrases_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.explode(T.phrases(F.col("text"))).alias("p")).select(F.lower("p").alias("term"))


_SEEN = f"SELECT lower(phrase) AS term FROM ({PHRASES})"


@query(f"SELECT DISTINCT lower(p) AS term FROM (SELECT unnest({S.phrases('text')}) AS p FROM benchmark) EXCEPT {_SEEN}")
def outstanding_definitions(spark, sf_dir):
    return terms.outstanding(_phrases_of(spark, sf_dir, "benchmark"), _phrases_of(spark, sf_dir, "documents"))


@query(f"SELECT DISTINCT lower(p) AS term FROM (SELECT unnest({S.phrases('text')}) AS p FROM conversations) WHERE lower(p) NOT IN ({_SEEN})")
def not_yet_embedded(spark, sf_dir):
    """Spans of conversations that aren't among those of documents: what an interrupted run still has to do."""
    return sinks.missing(_phrases_of(spark, sf_dir, "conversations").distinct(), _phrases_of(spark, sf_dir, "documents"), ["term"])


# Vectors, fields, neighbours, counts.


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, generate_subscripts(embedding, 1) AS d FROM embeddings), y AS (SELECT vec_id, a, a * a AS b, 0.5 - a AS c, d FROM x)
SELECT vec_id, round(sum(d * (a + b + c) / 3), 4) AS mean, round(sum(d * (a + b + c)), 4) AS total, round(sum(d * greatest(a, b, c)), 4) AS most FROM y GROUP BY vec_id""")
def layer_combination(spark, sf_dir):
    """Three layers (x, x squared, a half less x) combined in three ways."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    layers = [F.col("a"), F.transform("a", lambda v: v * v), F.transform("a", lambda v: 0.5 - v)]
    told = lambda how: F.round(F.aggregate(F.transform(vectors.combine_layers(layers, how), lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 4)
    return x.select("vec_id", told("avg").alias("mean"), told("sum").alias("total"), told("max").alias("most"))


@query("SELECT source, doc_id, md5(string_split(text, chr(10))[1]) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def title_field(spark, sf_dir):
    """Titles instead of contents: one row of each document."""
    x = table(spark, sf_dir, "documents").select("source", "doc_id", "text", F.substring_index("text", "\n", 1).alias("doc_title"), F.col("text").alias("content"))
    return retrieve.substitute_field(x, "doc_title", "source", "doc_id").select("source", "doc_id", F.md5("content").alias("digest"))


@query(f"""WITH {bm25_sql()}, {bm25_sql(name="titled", col="title")}, r AS (SELECT 'bm25' AS field, * FROM ranked UNION ALL SELECT 'doc_title', * FROM titled)
SELECT kind, field, count(*) AS n, round(sum(score), 4) AS total FROM r JOIN (VALUES ('hybrid'), ('sparse'), ('dense')) k(kind) ON kind = 'hybrid' OR (kind = 'sparse') = (field = 'bm25') GROUP BY kind, field""")
def retriever_kinds(spark, sf_dir):
    """Which fields' results a kind of search unites."""
    stored = store.searched(spark, sf_dir, _items(spark, sf_dir))
    runs = {"bm25": retrieve.bm25(stored, _items(spark, sf_dir)), "doc_title": retrieve.bm25(stored, _items(spark, sf_dir), field="doc_title")}
    out = None
    for kind in ("hybrid", "sparse", "dense"):
        one = retrieve.fan_out(runs, kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kind", "field").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


_BARE = "lower(regexp_replace({}, '^(?:the|a|The|A) ', ''))"
_X, _Y = _BARE.format("candidate"), _BARE.format("span")


@query(f"""WITH {_nearest(5, True)}, p AS (SELECT query_id, a.p_name AS span, b.p_name AS candidate, near.rank FROM near JOIN part a ON a.p_partkey = query_id JOIN part b ON b.p_partkey = id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, span ORDER BY rank, candidate) AS r FROM p WHERE NOT contains(lower(span), lower(candidate)) AND NOT (100 - levenshtein({_X}, {_Y}) / greatest(length({_X}), length({_Y})) * 100 > 70))
SELECT query_id, span, candidate, r AS rank FROM k WHERE r <= 2""")
def neighbour_candidates(spark, sf_dir):
    """The nearest spans that say something else: two candidates of each span."""
    v, q = _vectors(spark, sf_dir)
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    near = vectors.search(v, q, 5, "vec_id", "embedding").withColumn("a", F.col("query_id")).withColumn("b", F.col("id"))
    pairs = near.join(names.select(F.col("k").alias("a"), F.col("p_name").alias("span")), "a").join(names.select(F.col("k").alias("b"), F.col("p_name").alias("candidate")), "b")
    return expand.dissimilar_neighbours(pairs.select("query_id", "span", "candidate", "rank")).select("query_id", "span", "candidate", "rank")


@query(f"SELECT lang, phrase AS label, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, phrase) AS rank FROM (SELECT lang, phrase, count(*) AS n FROM ({PHRASES}) GROUP BY lang, phrase)) WHERE rank <= 3")
def top_labels(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("lang", F.explode(T.phrases(F.col("text"))).alias("label")).groupBy("lang", "label").agg(F.count("*").alias("n"))
    return terms.top_labels(x, ["lang"]).select("lang", "label", "n", "rank")


@query(f"SELECT doc_id, len({S.tokens('text')}) AS n_tokens, len({S.phrases('text')}) AS n_phrases FROM documents")
def phrase_counts(spark, sf_dir):
    return stats.phrase_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 64)::BIGINT AS chunk FROM documents")
def chunks(spark, sf_dir):
    return common.chunks(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 64)
