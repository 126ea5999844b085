"""Registered queries of tagging, vocabularies, set operations and stored forms."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, expand, stats, tagging, terms
from ..sources import readers, sinks
from . import sql as S
from . import store
from .search_queries import FEATURES, IDF
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


# Benchmark items as sentences, tagged by the default rule: words of five letters or more are objects.

_W = "w0 AS (SELECT item_id AS doc, string_split(replace(text, chr(10), ' '), ' ') AS words FROM benchmark), w AS (SELECT doc, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM w0), g AS (SELECT *, length(regexp_replace(word, '[^\\p{L}]', '', 'g')) >= 5 AS inside FROM w)"
_T = f"{_W}, t AS (SELECT doc, pos, word, inside, CASE WHEN NOT inside THEN 'PD-pad' WHEN coalesce(lag(inside) OVER (PARTITION BY doc ORDER BY pos), false) THEN 'IH-obj' ELSE 'BH-obj' END AS tag FROM g)"
_R = f"{_T}, r AS (SELECT *, sum(CASE WHEN tag = 'BH-obj' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS n FROM t WHERE inside), spans AS (SELECT doc, 'obj' AS type, min(pos) AS start, max(pos) AS \"end\" FROM r GROUP BY doc, n)"


def _tagged(spark: SparkSession, sf_dir: str):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("sentence"))
    return tagging.rule_tags(items)


@query(f"WITH {_T} SELECT doc, string_agg(tag, ' ' ORDER BY pos) AS tags FROM t GROUP BY doc")
def rule_tags(spark, sf_dir):
    return _tagged(spark, sf_dir).select("doc", F.array_join("tags", " ").alias("tags"))


@query(f'WITH {_R} SELECT doc, type, start::BIGINT AS start, "end"::BIGINT AS "end" FROM spans')
def tag_spans(spark, sf_dir):
    s = tagging.tags_to_spans(_tagged(spark, sf_dir))
    return s.select("doc", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"WITH {_T} SELECT tag, count(*) AS n FROM t WHERE pos > 0 AND pos < (SELECT max(pos) FROM t x WHERE x.doc = t.doc) GROUP BY tag")
def tag_counts(spark, sf_dir):
    return stats.tag_counts(_tagged(spark, sf_dir))


@query(f"WITH {_R} SELECT doc, string_agg(tag, ' ' ORDER BY pos) AS tags FROM t GROUP BY doc")
def span_tags(spark, sf_dir):
    """Tags to spans and back."""
    tagged = _tagged(spark, sf_dir)
    tokens = tagged.select("doc", F.posexplode("words").alias("pos", "token"))
    spans = tagging.tags_to_spans(tagged).select("doc", "type", F.col("start").alias("ss"), F.col("end").alias("se"), F.lit(None).cast("int").alias("es"), F.lit(None).cast("int").alias("ee"))
    return tagging.spans_to_tags(tokens, spans).select("doc", F.array_join("tags", " ").alias("tags"))


@query(f"""WITH {_R}, p AS (SELECT doc, type, start, "end" FROM spans WHERE "end" > start UNION ALL SELECT doc, type, start, start FROM spans WHERE "end" = start + 3),
c AS (SELECT type, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM (SELECT doc, type, start, "end", count(*) AS g FROM spans GROUP BY ALL) FULL JOIN (SELECT doc, type, start, "end", count(*) AS p FROM p GROUP BY ALL) USING (doc, type, start, "end")),
k AS (SELECT type, sum(least(g, p)) AS tp, sum(p - least(g, p)) AS fp, sum(g - least(g, p)) AS fn FROM c GROUP BY type UNION ALL SELECT 'overall', sum(least(g, p)), sum(p - least(g, p)), sum(g - least(g, p)) FROM c)
SELECT type, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp + 1e-13), 6) AS precision, round(tp / (tp + fn + 1e-13), 6) AS recall FROM k""")
def span_scores(spark, sf_dir):
    """Gold: all spans; predicted: those of several words, and a wrong one beside spans of four."""
    gold = tagging.tags_to_spans(_tagged(spark, sf_dir))
    wrong = gold.filter(F.col("end") == F.col("start") + 3).withColumn("end", F.col("start"))
    found = evaluate.span_scores(gold, gold.filter(F.col("end") > F.col("start")).unionByName(wrong), ["doc"])
    return found.select("type", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


# A tagger learnt from the documents' rule tags, and its tags of conversations.

_DT = _T.replace("SELECT item_id AS doc", "SELECT doc_id AS doc").replace("FROM benchmark", "FROM documents").replace("replace(text", "replace(coalesce(text, '')")
_HMM = f"""{_DT}, h AS (SELECT kind, value, tag, count(*) AS n FROM (SELECT 'word' AS kind, lower(word) AS value, tag FROM t UNION ALL SELECT 'end', right(lower(word), 3), tag FROM t) GROUP BY ALL),
st AS (SELECT a, b, count(*) AS n FROM (SELECT coalesce(lag(tag) OVER w, '^') AS a, tag AS b FROM t WINDOW w AS (PARTITION BY doc ORDER BY pos) UNION ALL SELECT tag, '$' FROM (SELECT tag, row_number() OVER (PARTITION BY doc ORDER BY pos DESC) AS r FROM t) WHERE r = 1) GROUP BY ALL)"""


def _document_tags(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("sentence"))
    return tagging.rule_tags(docs)


@query(f"WITH RECURSIVE {_HMM} SELECT kind, value, tag, n FROM h UNION ALL SELECT 'step', a, b, n FROM st")
def hmm_counts(spark, sf_dir):
    held, steps = tagging.hmm_counts(_document_tags(spark, sf_dir))
    return held.unionByName(steps.select(F.lit("step").alias("kind"), F.col("a").alias("value"), F.col("b").alias("tag"), "n"))


@query(f"""WITH RECURSIVE {_HMM}, tg AS (SELECT unnest(['PD-pad', 'BH-obj', 'IH-obj']) AS tag, unnest([1, 2, 3]) AS i), q AS (SELECT i, tag, count(t.tag) AS n, (SELECT count(*) FROM t) AS total FROM tg LEFT JOIN t USING (tag) GROUP BY i, tag),
v AS (SELECT kind, value, i, coalesce(n, 0)::DOUBLE AS n FROM (SELECT * FROM (SELECT DISTINCT kind, value FROM h), tg) LEFT JOIN h USING (kind, value, tag)), al AS (SELECT kind, value, sum(n) AS a FROM h GROUP BY ALL),
en AS (SELECT value, i, (v.n + q.n / q.total) / (a + 1) AS p FROM v JOIN al USING (kind, value) JOIN q USING (i) WHERE kind = 'end'),
wo AS (SELECT v.value, v.i, (v.n + en.p) / (a + 1) AS p FROM v JOIN al USING (kind, value) JOIN en ON en.value = right(v.value, 3) AND en.i = v.i WHERE kind = 'word'),
em AS (SELECT 'word' AS kind, value, list(round(ln(p) * 1000) - round(ln(q.n / q.total) * 1000) ORDER BY i) AS s FROM wo JOIN q USING (i) GROUP BY value UNION ALL SELECT 'end', value, list(round(ln(p) * 1000) - round(ln(q.n / q.total) * 1000) ORDER BY i) FROM en JOIN q USING (i) GROUP BY value),
tr AS (SELECT list(r ORDER BY x) AS m FROM (SELECT x, list(coalesce(round(1000 * ln(n / total)), -1e12) ORDER BY y) AS r FROM (SELECT * FROM (VALUES (1, 'PD-pad'), (2, 'BH-obj'), (3, 'IH-obj'), (4, '^')) u(x, a), (VALUES (1, 'PD-pad'), (2, 'BH-obj'), (3, 'IH-obj'), (4, '$')) w(y, b)) LEFT JOIN st USING (a, b) LEFT JOIN (SELECT a, sum(n) AS total FROM st GROUP BY a) USING (a) GROUP BY x)),
c AS (SELECT conv_id * 1000 + turn AS doc, string_split(replace(coalesce(text, ''), chr(10), ' '), ' ') AS words FROM conversations), cw AS (SELECT doc, lower(unnest(words)) AS value, generate_subscripts(words, 1) AS pos FROM c),
e AS (SELECT doc, pos, coalesce(a.s, b.s, [0.0, 0.0, 0.0]) AS s FROM cw LEFT JOIN em a ON a.kind = 'word' AND a.value = cw.value LEFT JOIN em b ON b.kind = 'end' AND b.value = right(cw.value, 3)),
r AS (SELECT doc, pos, list_transform([1, 2, 3], lambda j: m[4][j] + s[j]) AS best, ['0', '1', '2'] AS path FROM e, tr WHERE pos = 1
UNION ALL SELECT r.doc, e.pos, list_transform([1, 2, 3], lambda j: list_max(list_transform([1, 2, 3], lambda i: best[i] + m[i][j])) + s[j]),
list_transform([1, 2, 3], lambda j: concat(path[list_position(list_transform([1, 2, 3], lambda i: best[i] + m[i][j]), list_max(list_transform([1, 2, 3], lambda i: best[i] + m[i][j])))], (j - 1)::VARCHAR)) FROM r JOIN e ON e.doc = r.doc AND e.pos = r.pos + 1, tr),
z AS (SELECT doc, path, list_transform([1, 2, 3], lambda i: best[i] + m[i][4]) AS done, row_number() OVER (PARTITION BY doc ORDER BY pos DESC) AS last FROM r, tr)
SELECT doc, path[list_position(done, list_max(done))] AS path FROM z WHERE last = 1""")
def hmm_tags(spark, sf_dir):
    """Tags (0 outside, 1 begins, 2 goes on) of every turn by the tagger that the documents teach."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), " ").alias("words"))
    tagger = tagging.learn(_document_tags(spark, sf_dir))
    number = lambda t: F.array_position(F.array(*map(F.lit, tagger.tags)), t) - 1
    return tagger.tag(turns).select("doc", F.array_join(F.transform("tags", lambda t: number(t).cast("string")), "").alias("path"))


_HALVES = """w AS (SELECT conv_id * 1000 + turn AS doc, unnest(x) AS word, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), ' ') AS x FROM conversations)),
g AS (SELECT *, CASE WHEN length(word) >= 8 THEN 'B' WHEN length(word) = 7 THEN 'D' WHEN length(word) = 6 THEN 'I' END AS h FROM w),
o AS (SELECT *, CASE WHEN h IN ('B', 'D') OR lag(h) OVER (PARTITION BY doc ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS opens FROM g),
n AS (SELECT *, sum(CASE WHEN h IS NOT NULL THEN opens ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS n FROM o),
r AS (SELECT doc, n, min(pos) AS a, max(pos) AS z, arg_min(h, pos) AS h, string_agg(word, ' ' ORDER BY pos) AS words FROM n WHERE h IS NOT NULL GROUP BY doc, n),
b AS (SELECT *, sum(CASE WHEN h = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY n) AS anew, h = 'D' AND lag(n) OVER (PARTITION BY doc ORDER BY n) IS NOT NULL AS half FROM r),
k AS (SELECT *, half AND sum(CASE WHEN half THEN 1 ELSE 0 END) OVER (PARTITION BY doc, anew ORDER BY n) = 1 AS takes FROM b),
s AS (SELECT *, sum(CASE WHEN takes THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY n) AS span FROM k)"""


@query(f"WITH {_HALVES} SELECT doc, string_agg(words, ' ' ORDER BY n) AS words, arg_min(a, n)::BIGINT AS ss, arg_min(z, n)::BIGINT AS se, CASE WHEN count(*) > 1 THEN arg_max(a, n)::BIGINT ELSE -1 END AS es, CASE WHEN count(*) > 1 THEN arg_max(z, n)::BIGINT ELSE -1 END AS ee FROM s GROUP BY doc, span")
def discontiguous_spans(spark, sf_dir):
    """Spans with second halves in every turn: words of eight letters begin one, of seven a half, of six go on."""
    x = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("words"))
    n = lambda w: F.length(w)
    x = x.withColumn("tags", F.transform("words", lambda w: F.when(n(w) >= 8, "BH-obj").when(n(w) == 7, "BD-obj").when(n(w) == 6, "IH-obj").otherwise(tagging.OUTSIDE)))
    out = tagging.assemble_discontiguous(x, "obj")
    return out.select("doc", F.array_join("words", " ").alias("words"), *(F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c) for c in ("ss", "se", "es", "ee")))


@query(f"WITH {_W} SELECT doc, pos, word AS token, start::BIGINT AS start, (start + length(word))::BIGINT AS \"end\" FROM (SELECT doc, word, (row_number() OVER (PARTITION BY doc ORDER BY pos) - 1)::BIGINT AS pos, s AS start FROM (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w) WHERE word <> '')")
def token_offsets(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("sentence"))
    t = tagging.token_offsets(items)
    return t.select("doc", F.col("pos").cast("long").alias("pos"), "token", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# A small vocabulary: nations are narrower than their regions.

_V = "SELECT r.r_name AS term, n.n_name AS label FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"


def _triples(spark: SparkSession, sf_dir: str):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    node, up = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    return rows(n, node, "prefLabel", F.col("n_name")).union(rows(n, node, "broader", up)).union(rows(r, F.concat(F.lit("r"), "r_regionkey"), "prefLabel", F.col("r_name")))


@query(f"SELECT DISTINCT x.term, l.label FROM (SELECT r_name AS term FROM region) x JOIN ({_V}) l ON contains(lower(l.term), lower(x.term))")
def skos_narrower(spark, sf_dir):
    return expand.narrower(_triples(spark, sf_dir), table(spark, sf_dir, "region").select(F.col("r_name").alias("term")))


@query("SELECT DISTINCT x.n_name AS term, r.r_name AS label FROM nation x JOIN nation n ON contains(lower(n.n_name), lower(x.n_name)) JOIN region r ON n.n_regionkey = r.r_regionkey")
def skos_broader(spark, sf_dir):
    """Both directions are stored as broader; its inverse stands for narrower."""
    t = _triples(spark, sf_dir)
    down = t.filter("p = 'broader'").select(F.col("o").alias("s"), F.lit("narrower").alias("p"), F.col("s").alias("o"))
    return expand.broader(t.union(down), table(spark, sf_dir, "nation").select(F.col("n_name").alias("term")))


# Sets and joins of terms.

_EN = f"SELECT DISTINCT lower(phrase) AS term FROM ({PHRASES}) WHERE lang = 'en'"
_OTHER = f"SELECT DISTINCT lower(phrase) AS term FROM ({PHRASES}) WHERE lang <> 'en'"


def _terms(spark: SparkSession, sf_dir: str, english: bool):
    docs = table(spark, sf_dir, "documents").filter((F.col("lang") == "en") == F.lit(english))
    return docs.select(F.explode(T.phrases(F.col("text"))).alias("p")).select(F.lower("p").alias("term")).distinct()


@query(f"{_EN} UNION {_OTHER}")
def term_union(spark, sf_dir):
    return _terms(spark, sf_dir, True).unionByName(_terms(spark, sf_dir, False)).distinct()


@query(f"WITH {FEATURES} SELECT term FROM feat EXCEPT SELECT term FROM feat WHERE round(score, 6) >= 0.6")
def out_of_domain_terms(spark, sf_dir):
    from .search_queries import _features

    f = stats.domain_terms(_features(spark, sf_dir).withColumn("score", F.round("score", 6)))
    return f.select("term").exceptAll(f.filter("in_domain").select("term"))


@query(f"SELECT doc_id, string_agg(phrase, '|' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(l) AS phrase, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {S.phrases('text')} AS l FROM documents)) WHERE phrase IN (SELECT phrase FROM ({PHRASES}) GROUP BY phrase HAVING count(*) >= 2) GROUP BY doc_id")
def keep_cleaned_labels(spark, sf_dir):
    """A document's phrases that occur at least twice in the corpus; order and repeats stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.phrases(F.col("text"))).alias("i", "phrase"))
    often = docs.groupBy("phrase").agg(F.count("*").alias("n")).filter("n >= 2").select("phrase")
    kept = docs.join(often, "phrase", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "phrase"))).alias("x"))
    return kept.select("doc_id", F.array_join(F.transform("x", lambda p: p["phrase"]), "|").alias("kept"))


@query(f"WITH {IDF}, t AS (SELECT text AS term, unnest({S.tokens('text')}) AS token FROM (SELECT DISTINCT text FROM benchmark)) SELECT md5(term) AS term, round(avg(coalesce(idf, 0.5)), 6) AS weight FROM t LEFT JOIN idf USING (token) GROUP BY term")
def idf_weights(spark, sf_dir):
    idf = store.idf(spark, sf_dir)
    w = stats.idf_weights(table(spark, sf_dir, "benchmark").select(F.col("text").alias("term")), idf)
    return w.select(F.md5("term").alias("term"), F.round("weight", 6).alias("weight"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question FROM conversations")
def forward_fill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.md5("text")).otherwise("").alias("question"))
    return stats.forward_fill(c, ["conv_id"], "turn", "question").select("conv_id", "turn", "question")


@query("SELECT conv_id, role AS setting, turn AS rank FROM conversations")
def unpool_ranks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    lists = c.select("conv_id", F.transform("x", lambda p: p["role"]).alias("settings"), F.transform("x", lambda p: p["turn"].cast("string")).alias("ranks"))
    return evaluate.unpool(lists).select("conv_id", "setting", "rank")


@query("SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, 1 = row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]+)', 1) ORDER BY page_id) AS first FROM pages")
def first_per_host(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    low = p.groupBy("host").agg(F.min("page_id").alias("low"))
    return p.join(low, "host").select("page_id", "host", (F.col("page_id") == F.col("low")).alias("first"))


@query()
def annotator_reuse(spark, sf_dir):
    """Judgements of users' turns reused for like turns (sequence matching has no SQL)."""
    c = table(spark, sf_dir, "conversations")
    new = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("query"), "text")
    old = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("text").alias("query"), "text", F.col("role").alias("relevance")).filter("relevance = 'user'")
    return evaluate.reuse_judgements(new, old).select("row_id", "relevance")


@query("SELECT concat(conv_id, '##', turn) AS id, conv_id::VARCHAR AS doc, turn::INT AS page_nr, md5(text) AS digest FROM conversations")
def stored_round_trip(spark, sf_dir):
    """Passages to the stored nested form and back to typed columns."""
    none = F.array().cast("array<string>")
    p = table(spark, sf_dir, "conversations").select(F.col("text").alias("content"), "text", F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("page_nr"), F.lit(-1).alias("split_id"), F.col("role").alias("doc_title"), F.lit(100).alias("split_size"), T.sentences(F.col("text")).alias("sentences"), *(none.alias(c) for c in readers.LABELS))
    s = sinks.stored(p)
    json = s.select(F.to_json(F.struct("content", "content_type", "id", "meta")).alias("j")).select(F.from_json("j", readers.PASSAGE).alias("x")).select("x.*")
    return json.select("id", T.id_part(F.col("id"), 1).alias("doc"), T.id_part(F.col("id"), 2).cast("int").alias("page_nr"), F.md5("content").alias("digest"))


_DEFINED = f"SELECT DISTINCT lower(p) AS term FROM (SELECT unnest({S.phrases('text')}) AS p FROM benchmark)"


@query(f"""WITH t AS ({_DEFINED}), s AS (SELECT DISTINCT phrase AS span FROM ({PHRASES}))
SELECT span, CASE WHEN bool_or(lower(span) = term) THEN 'exact' WHEN count(term) > 0 THEN 'part' ELSE 'none' END AS how FROM s LEFT JOIN t ON contains(lower(span), term) GROUP BY span""")
def defined_term_check(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select(F.explode(T.phrases(F.col("text"))).alias("span"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(T.phrases(F.col("text"))).alias("term"))
    return terms.defined_term_check(spans, known)


@query(f"WITH t AS ({_DEFINED}), o AS (SELECT lower(phrase) AS term, count(*) AS n FROM ({PHRASES}) GROUP BY 1) SELECT term, coalesce(n, 0)::BIGINT AS n FROM t LEFT JOIN o USING (term)")
def definition_counts(spark, sf_dir):
    seen = table(spark, sf_dir, "documents").select(F.explode(T.phrases(F.col("text"))).alias("p")).select(F.lower("p").alias("term"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(T.phrases(F.col("text"))).alias("p")).select(F.lower("p").alias("term"))
    return terms.definition_counts(seen, known)


@query(f"SELECT conv_id, turn, array_to_string(list_transform({S.phrases('text')}, lambda p: md5(p)), '|') AS labels FROM conversations")
def scatter_labels(spark, sf_dir):
    """Each distinct label is computed once and put back where it came from."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("#", "conv_id", "turn").alias("k"), T.phrases(F.col("text")).alias("l"))
    out = terms.scatter(c, "k", "l", lambda d: d.withColumn("value", F.md5("label")), "u")
    return out.select("conv_id", "turn", F.array_join("u", "|").alias("labels"))
