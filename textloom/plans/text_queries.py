"""Registered queries over texts: scans, cleaning, splitting, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boundaries, stem
from ..functions import passages as P
from ..functions import text as T
from ..operators import dedup, stats
from ..sources import readers, sinks
from . import sql as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "lang", F.explode(T.phrases(F.col("text"))).alias("phrase"))


@query(f"SELECT doc_id, len({S.tokens('text')}) AS n_tokens, len(list_distinct({S.tokens('text')})) AS n_distinct FROM documents")
def token_count(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"""WITH s AS (SELECT unnest({S.sentences('text')}) AS x FROM documents), n AS (SELECT count(*) AS n FROM s),
d AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({S.tokens('x')})) AS token FROM s) GROUP BY token)
SELECT token, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM d, n""")
def idf_smooth(spark, sf_dir):
    units = _docs(spark, sf_dir).select(F.explode(T.sentences(F.col("text"))).alias("text"))
    return stats.smoothed_idf(units).withColumn("idf", F.round("idf", 6))


@query(f"SELECT doc_id, md5({S.char_normalise('text')}) AS digest FROM documents")
def char_normalise(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.char_normalise(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda p: {S.strip('p')}), chr(10)), '\\n\\n+', concat(chr(10), chr(10)), 'g')) AS digest FROM documents")
def whitespace_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.whitespace_clean(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({S.space_collapse('text')}) AS digest FROM documents")
def space_collapse(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.space_collapse(F.col("text"))).alias("digest"))


@query(f"""SELECT doc_id, len(x) AS n, md5(array_to_string(x, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(
string_split(CASE WHEN length(text) > 3000 THEN replace(text, ';', concat('.', chr(10))) ELSE replace(text, ';', chr(10)) END, chr(10)), lambda p: {S.strip('p')}), lambda p: length(p) > 10) AS x FROM documents)""")
def extraction_sentences(spark, sf_dir):
    x = T.extraction_sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(x).cast("long").alias("n"), F.md5(F.array_join(x, "|")).alias("digest"))


@query(f"SELECT doc_id, len(x) AS n, md5(array_to_string(x, '|')) AS digest FROM (SELECT doc_id, {S.sentences('text')} AS x FROM documents)")
def sentence_split(spark, sf_dir):
    x = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(x).cast("long").alias("n"), F.md5(F.array_join(x, "|")).alias("digest"))


@query(f"SELECT doc_id, sum(CASE WHEN upper(s) = s AND lower(s) <> s THEN 1 ELSE 0 END)::BIGINT AS n_caps, md5(string_agg(CASE WHEN upper(s) = s AND lower(s) <> s THEN lower(s) ELSE s END, '|' ORDER BY i)) AS digest FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {S.sentences('text')} AS x FROM documents)) GROUP BY doc_id")
def caps_lower(spark, sf_dir):
    x = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("x")).filter(F.size("x") > 0)
    low = F.transform("x", T.lower_all_caps)
    caps = F.size(F.filter("x", lambda s: (F.upper(s) == s) & (F.lower(s) != s)))
    return x.select("doc_id", caps.cast("long").alias("n_caps"), F.md5(F.array_join(low, "|")).alias("digest"))


@query(f"SELECT doc_id, len(t) AS n, len(CASE WHEN len(t) > 512 THEN list_concat(t[1:511], t[-1:]) ELSE t END) AS n_tagger, md5(array_to_string(CASE WHEN len(t) > 512 THEN list_concat(t[1:511], t[-1:]) ELSE t END, ' ')) AS tagger, md5(array_to_string(t[1:512], ' ')) AS embedder FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def token_truncation(spark, sf_dir):
    t = T.tokens(F.col("text"))
    a, b = T.truncate_tagger(t), T.truncate_embedder(t)
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.size(a).cast("long").alias("n_tagger"), F.md5(F.array_join(a, " ")).alias("tagger"), F.md5(F.array_join(b, " ")).alias("embedder"))


@query(f"SELECT item_id, nullif({S.strip("translate(text, " + S.lit(T.QUERY_DELETED) + ", '')")}, '') AS query, translate(text, {S.lit(T.CANDIDATE_DELETED)}, '') AS candidate FROM benchmark")
def query_sanitise(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.sanitise_query(F.col("text")).alias("query"), T.sanitise_candidate(F.col("text")).alias("candidate"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS digest, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))::BIGINT AS n FROM documents")
def ascii_fold(spark, sf_dir):
    t = T.drop_non_ascii(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


PHRASES = f"SELECT doc_id, lang, unnest({S.phrases('text')}) AS phrase FROM documents"
DISTINCT = f"SELECT phrase, phrase AS t, count(*) AS n FROM ({PHRASES}) GROUP BY phrase"


@query(f"SELECT t AS term, sum(n)::BIGINT AS n FROM ({S.chain(DISTINCT, S.determiner_steps())}) GROUP BY t")
def determiner_strip(spark, sf_dir):
    x = _phrases(spark, sf_dir).groupBy("phrase").agg(F.count("*").alias("n"))
    return x.groupBy(T.strip_determiners(F.col("phrase")).alias("term")).agg(F.sum("n").cast("long").alias("n"))


@query(f"SELECT phrase, coalesce(t, '') AS cleaned, n FROM ({S.chain(DISTINCT, S.clean_steps())})")
def span_clean_rules(spark, sf_dir):
    x = _phrases(spark, sf_dir).groupBy("phrase").agg(F.count("*").alias("n"))
    return x.select("phrase", F.coalesce(T.clean_span(F.col("phrase")), F.lit("")).alias("cleaned"), "n")


@query(f"SELECT phrase, t AS cleaned, n FROM ({S.chain(DISTINCT, S.number_steps())})")
def regex_span_filter(spark, sf_dir):
    x = _phrases(spark, sf_dir).groupBy("phrase").agg(F.count("*").alias("n"))
    return x.select("phrase", T.drop_numbers(F.col("phrase")).alias("cleaned"), "n")


TERMS = f"SELECT t AS term, phrase AS surface, n FROM ({S.chain(DISTINCT, [*S.number_steps(), *S.clean_steps(), "coalesce(t, '')", *S.determiner_steps()])}) WHERE t <> ''"


@query(f"SELECT term, sum(n)::BIGINT AS n FROM ({TERMS}) GROUP BY term HAVING sum(n) >= 2")
def term_min_count_intended(spark, sf_dir):
    return stats.frequent_terms(_phrases(spark, sf_dir).select("phrase"))


@query(f"SELECT term, count(*) AS n FROM ({TERMS}) GROUP BY term HAVING count(*) >= 2")
def term_min_count_compat(spark, sf_dir):
    return stats.frequent_terms(_phrases(spark, sf_dir).select("phrase"), mode="compat")


PASSAGES = f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {S.sentences(S.space_collapse('text'))} AS x FROM documents),
e AS (SELECT id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM d), m AS (SELECT id, s, i, len(string_split(s, ' ')) AS n FROM e),
r AS (SELECT id, i, n AS cum, 0 AS g FROM m WHERE i = 1 UNION ALL SELECT m.id, m.i, CASE WHEN r.cum + m.n > 100 THEN m.n ELSE r.cum + m.n END, r.g + CASE WHEN r.cum + m.n > 100 THEN 1 ELSE 0 END FROM r JOIN m ON m.id = r.id AND m.i = r.i + 1)"""


@query(f"""{PASSAGES}
SELECT r.id, g::BIGINT AS split_id, md5(string_agg(CASE WHEN n > 100 THEN substr(s, 1, 300) ELSE s END, ' ' ORDER BY m.i)) AS digest, count(*) AS n_sentences FROM r JOIN m ON r.id = m.id AND r.i = m.i GROUP BY r.id, g""")
def passages_greedy(spark, sf_dir):
    p = P.passages(_docs(spark, sf_dir), "doc_id", "text")
    return p.select("id", "split_id", F.md5("content").alias("digest"), "n_sentences")


@query(f"""{PASSAGES}, p AS (SELECT r.id, g, string_agg(CASE WHEN n > 100 THEN substr(s, 1, 300) ELSE s END, ' ' ORDER BY m.i) AS content, count(*) AS n_sentences FROM r JOIN m ON r.id = m.id AND r.i = m.i GROUP BY r.id, g)
SELECT source, count(DISTINCT id) AS n_docs, count(*) AS n_passages, count(DISTINCT md5(content)) AS n_unique, sum(length(content))::BIGINT AS n_chars, sum(n_sentences)::BIGINT AS n_sentences FROM p JOIN documents ON doc_id = id GROUP BY source""")
def passage_profile(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    p = P.passages(docs, "doc_id", "text").join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    return stats.passage_profile(p, "source")


@query("SELECT source, ((row_number() OVER (ORDER BY source, doc_id) - 1) // 16)::BIGINT AS block, doc_id FROM documents")
def inverted_blocks(spark, sf_dir):
    """Lists of a key in blocks of at most 16 values."""
    x = stats.inverted_blocks(_docs(spark, sf_dir), "source", "doc_id", 16)
    return x.select("source", "block", F.explode("values").alias("doc_id"))


def _plain_sql(x: str) -> str:
    for a, b in readers.ENTITIES:
        x = f"replace({x}, {S.lit(a)}, {S.lit(b)})"
    return S.char_normalise(x)


@query(f"""WITH b AS (SELECT page_id AS id, regexp_extract(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g'), '(?is)<body\\b[^>]*>(.*)</body>', 1) AS body FROM pages),
p AS (SELECT id, list_filter(list_transform(regexp_extract_all(body, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: {_plain_sql("regexp_replace(x, '<[^>]*>', '', 'g')")}), lambda x: {S.strip('x')} <> '') AS ps FROM b)
SELECT id, unnest(ps) AS text, generate_subscripts(ps, 1) AS page_nr FROM p""")
def page_paragraphs(spark, sf_dir):
    return readers.html_pages(table(spark, sf_dir, "pages"), "page_id", "html").select("id", "page_nr", "text")


#: Conversations as form-feed separated pages: the stand-in for extracted PDF text.
PAGED = "SELECT conv_id AS id, concat(string_agg(text, chr(12) ORDER BY turn), chr(12)) AS t FROM conversations GROUP BY conv_id"


@query(f"""SELECT id, i AS page_nr, regexp_replace(array_to_string(list_transform(l[2:len(l) - 2], lambda p: {S.strip('p')}), ' '), '{S.SP}+', ' ', 'g') AS text FROM (
SELECT id, i, string_split(x, chr(10)) AS l FROM (SELECT id, unnest(y) AS x, generate_subscripts(y, 1) AS i FROM (SELECT id, string_split(t, chr(12))[:-2] AS y FROM ({PAGED}))))""")
def pdf_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return readers.pdf_pages(turns.select("id", F.concat(F.array_join("t", "\f"), F.lit("\f")).alias("t")), "id", "t")


@query(f"""WITH d AS (SELECT doc_id, {S.phrases('text')} AS l FROM documents)
SELECT doc_id, 'on' AS tagger, len(l)::BIGINT AS n_labels, md5(array_to_string(l, '|')) AS digest FROM d UNION ALL SELECT doc_id, 'off', 0, md5('') FROM d""")
def tagger_switch(spark, sf_dir):
    """Label fields of all documents with the tagger on (a weight above 0) and off (none: nothing is tagged)."""
    from ..config import Settings
    from .pipelines import labelled

    docs = _docs(spark, sf_dir)
    runs = [labelled(docs, Settings().with_values(field_weights={"NER_labels": w})).withColumn("tagger", F.lit(name)) for name, w in (("on", 1.0), ("off", 0.0))]
    return runs[0].unionByName(runs[1]).select("doc_id", "tagger", F.size("NER_labels").cast("long").alias("n_labels"), F.md5(F.array_join("NER_labels", "|")).alias("digest"))


@query("""SELECT source, count(*) AS n_docs, count(DISTINCT md5(text)) AS n_texts, sum(length(text))::BIGINT AS n_chars, sum(s)::BIGINT AS n_sentences, sum(w)::BIGINT AS n_words, max(length(text))::BIGINT AS longest
FROM (SELECT source, text, len(%s) AS s, len(%s) AS w FROM documents) GROUP BY source""" % (S.sentences("text"), S.tokens("text")))
def corpus_profile(spark, sf_dir):
    return stats.corpus_profile(_docs(spark, sf_dir), "source")


@query(f"SELECT lang, count(*) AS n, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, min(w)::BIGINT AS least, max(w)::BIGINT AS most, round(100.0 * count(*) FILTER (w > 500) / count(*), 6) AS over FROM (SELECT lang, len({S.tokens('text')}) AS w FROM documents) GROUP BY lang")
def length_distribution(spark, sf_dir):
    x = _docs(spark, sf_dir).select("lang", F.size(T.tokens(F.col("text"))).cast("long").alias("w"))
    d = stats.distribution(x, "w", 500, ["lang"])
    return d.select("lang", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", "most", F.round("over", 6).alias("over"))


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS first_id, doc_id = min(doc_id) OVER (PARTITION BY text) AS keep FROM documents")
def doc_dedup_first(spark, sf_dir):
    return dedup.first_by_text(_docs(spark, sf_dir))


@query("""WITH p AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS host, page_id, trim(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]*>', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')) AS text FROM pages),
w AS (SELECT host, page_id, string_split(text, ' ') AS w FROM p), c AS (SELECT host, count(DISTINCT page_id) AS pages FROM w GROUP BY host HAVING count(DISTINCT page_id) > 1),
n AS (SELECT unnest(range(3, 30)) AS n), s AS (SELECT w.host, page_id, n, w.w, unnest(range(1, len(w.w) - n + 2)) AS i FROM w JOIN c USING (host), n WHERE len(w.w) >= n),
g AS (SELECT DISTINCT host, page_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM s), h AS (SELECT host, g, n, count(DISTINCT page_id) AS t FROM g GROUP BY host, g, n)
SELECT host AS doc, g AS ngram, n::BIGINT AS n FROM (SELECT h.*, row_number() OVER (PARTITION BY host ORDER BY n DESC, g) AS r FROM h JOIN c USING (host) WHERE t = pages) WHERE r = 1""")
def common_ngrams(spark, sf_dir):
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " "), r"[ \t\n\f\r]+", " "))
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("host"), "page_id", text.alias("text"))
    return dedup.common_ngrams(pages, "host", "page_id", "text")


@query(f"""WITH t AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents), o AS (SELECT doc_id, t, coalesce(sum(len(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t)
SELECT word, min(b + i)::BIGINT AS seen_at FROM (SELECT b, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM o) GROUP BY word""")
def vocab_growth(spark, sf_dir):
    return stats.vocabulary_growth(_docs(spark, sf_dir))


@query("SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END AS language, CASE WHEN starts_with(source, 'd') THEN 'domestic' ELSE 'non-domestic' END AS origin FROM documents")
def language_names(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang", T.language_name(F.col("lang")).alias("language"), T.origin(F.col("source")).alias("origin"))


@query("""SELECT source, block, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM (SELECT source, doc_id, ((row_number() OVER (ORDER BY source, doc_id) - 1) // 10000)::BIGINT AS block FROM (SELECT DISTINCT source, doc_id FROM documents)) GROUP BY source, block""")
def inverted_list(spark, sf_dir):
    """Documents by source, in lists of bounded length."""
    x = stats.inverted_blocks(_docs(spark, sf_dir), "source", "doc_id")
    return x.select("source", F.col("block").cast("long").alias("block"), "n", F.array_join("values", ",").alias("ids"))


@query(r"""SELECT lower(rtrim(w, '.')) AS word, count_if(ends_with(w, '.')) AS stopped, count_if(NOT ends_with(w, '.')) AS plain FROM (SELECT unnest(list_filter(list_slice(p, 1, len(p) - 1), lambda x: regexp_full_match(x, '\p{L}(?:\.?\p{L})*\.?'))) AS w
FROM (SELECT string_split(unnest(string_split(coalesce(text, ''), chr(10))), ' ') AS p FROM documents)) GROUP BY 1""")
def stop_counts(spark, sf_dir):
    """How often each word stands with a full stop behind it and without: what abbreviations are learnt from."""
    return boundaries.type_counts(_docs(spark, sf_dir))


@query()
def word_stems(spark, sf_dir):
    """Stems of all distinct words, with the number of words that share one (a chain of suffix rules has no short SQL)."""
    words = _docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return words.select(stem.stem(F.col("word")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(concat('14:', doc_id)) < 'x' AS known, CASE WHEN r <= 120 THEN 'train' WHEN r <= 160 THEN 'val' ELSE 'test' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('14:', doc_id)), doc_id) AS r FROM documents)")
def split_sets(spark, sf_dir):
    """Training, validation and test sets by a seeded hash order."""
    return sinks.split_sets(_docs(spark, sf_dir).select("doc_id"), "doc_id").select("doc_id", F.lit(True).alias("known"), "part")


@query("""SELECT doc_id, count(*) AS n FROM (SELECT ('0x' || substr(md5(concat('14:', i)), 1, 15))::BIGINT % (SELECT count(*) FROM documents) + 1 AS r FROM range(500) t(i)) JOIN (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('14:', doc_id)), doc_id) AS r FROM documents) USING (r) GROUP BY doc_id""")
def seeded_sample(spark, sf_dir):
    """500 draws with replacement (a sampling operator), and how often each document was drawn."""
    return sinks.sample(_docs(spark, sf_dir).select("doc_id"), "doc_id", 500).groupBy("doc_id").agg(F.count("*").alias("n"))


_LINES = "string_split(text, chr(10))"


@query(f"SELECT doc_id, md5(array_to_string(list_concat({_LINES}, ['end', 'elder'], {_LINES}, ['younger']), '|')) AS whole, md5(array_to_string(list_concat({_LINES}, ['end'], {_LINES}, ['younger']), '|')) AS compat FROM documents")
def nested_items(spark, sf_dir):
    """Items of lists in lists of every document: all of them, and as the surveyed system gives them."""
    lines = F.to_json(F.split("text", "\n"))
    told = F.concat(F.lit('["#Table 1",'), lines, F.lit(', "#Li1_2#end", 7, ["elder", '), lines, F.lit(', "#Li3#younger"]]'))
    x = _docs(spark, sf_dir).select("doc_id", F.parse_json(told).alias("v"))
    view = f"nested_{uuid.uuid4().hex}"
    x.createOrReplaceTempView(view)
    out = None
    for mode, name in (("intended", "whole"), ("compat", "compat")):
        function = readers.list_items(spark, mode, f"list_items_{mode}")
        rows = spark.sql(f"SELECT doc_id, t.pos, t.text FROM {view}, LATERAL {function}(v) t")
        one = rows.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "|")).alias(name))
        out = one if out is None else out.join(one, "doc_id")
    return out


@query(f"SELECT phrase, count(*) AS n FROM ({PHRASES}) GROUP BY phrase ORDER BY n DESC, phrase LIMIT 20")
def top_phrases(spark, sf_dir):
    return stats.most_common(_phrases(spark, sf_dir), "phrase", 20)


_fold = "list_reduce(list_prepend('', x), lambda a, t: CASE WHEN contains(a, t) THEN a ELSE concat(a, chr(10), t) END)"


@query(f"SELECT doc_id, md5(array_to_string(list_filter(string_split({_fold}, chr(10)), lambda p: p <> ''), '|')) AS digest FROM (SELECT doc_id, {S.sentences('text')} AS x FROM documents)")
def containment_dedup(spark, sf_dir):
    """Sentences that are part of an earlier kept one go (no sentence holds a line feed, so both folds agree)."""
    x = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(readers.drop_contained(x), "|")).alias("digest"))
