"""Registered queries of sources and sinks: rows go out through a sink, in the format of the source, and come back.

Files lie in the shared folder, below a name of their own for each run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import enabled_fields, expands_documents, is_off
from ..functions import text as T
from ..operators import embed, evaluate, terms, vectors
from ..operators.common import shared_dir
from ..sources import readers, sinks
from . import sql as S
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


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/files-{name}-{uuid.uuid4().hex}"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    labels = [T.phrases(F.col("text")).alias("NER_labels"), *(none.alias(c) for c in readers.LABELS[1:])]
    return _turns(spark, sf_dir).select(F.col("text").alias("content"), "text", F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("page_nr"), F.lit(0).alias("split_id"), F.col("role").alias("doc_title"), F.lit(100).alias("split_size"), T.sentences(F.col("text")).alias("sentences"), *labels)


@query(f"SELECT concat(conv_id, '##', turn, '##0') AS id, conv_id::VARCHAR AS doc, turn::INT AS page_nr, md5(text) AS digest, len({S.sentences('text')}) AS n_sentences, array_to_string({S.phrases('text')}, '|') AS labels FROM conversations")
def passage_files(spark, sf_dir):
    """Passages as JSON lines and back."""
    path = _path(spark, "passages")
    sinks.write_jsonl(_passages(spark, sf_dir), path)
    x = readers.passages_jsonl(spark, path)
    return x.select("id", "doc", "page_nr", F.md5("content").alias("digest"), F.size("sentences").cast("long").alias("n_sentences"), F.array_join("NER_labels", "|").alias("labels"))


@query("SELECT concat(conv_id, '##', turn, '##0') AS id, role AS doc_title, 100 AS split_size, md5(text) AS digest FROM conversations")
def flat_passages(spark, sf_dir):
    """The stored nested form with its inner fields beside the outer ones."""
    return sinks.flat(sinks.stored(_passages(spark, sf_dir))).select("id", "doc_title", "split_size", F.md5("text").alias("digest"))


_XML = "concat('<standard><std-ref type=\"undated\">no</std-ref><std-ref type=\"dated\">REF ', p_partkey, ':2005</std-ref><title-wrap xml:lang=\"en\">', p_name, '</title-wrap><title-wrap xml:lang=\"fr\">x</title-wrap><sec><p>', p_type, ' of ', p_name, '</p></sec><sec><p>', p_name, '</p><p>', p_brand, '</p></sec></standard>')"


@query("SELECT concat('REF ', p_partkey, ':2005 # ', p_name) AS doc_title, concat(p_type, ' of ', p_name, '|', p_brand) AS sections FROM part")
def xml_standards(spark, sf_dir):
    """Titles and sections of XML standards; a section within an earlier one goes."""
    x = readers.xml_standards(table(spark, sf_dir, "part").select(F.expr(_XML).alias("xml")))
    return x.select("doc_title", F.array_join("sections", "|").alias("sections"))


_REGULATION = """concat('{"Section ', p_size, '":{"A":{"a.1":["', p_name, '","', p_type, '"],"url":"u"},"url":"u","B":{"b.1":"', p_brand, '","b.2":null}},"url":"x","Appendix A. Terms":{"definitions":{"', p_name, '":1,"\\'', p_type, '\\'":2},"url":"y"}}')"""


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS name, concat('Section ', p_size) AS section, p_name, p_type, p_brand FROM part)
SELECT name, section, 'A' AS sub, 'a.1' AS subsub, p_name AS text FROM p UNION ALL SELECT name, section, 'A', 'a.1', p_type FROM p UNION ALL SELECT name, section, 'B', 'b.1', p_brand FROM p""")
def regulation_sentences(spark, sf_dir):
    """Strings of nested regulations; appendices and addresses are left out."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.expr(_REGULATION).alias("json"))
    return readers.regulation_sentences(files).select("name", "section", "sub", "subsub", "text")


@query("SELECT DISTINCT replace(lower(x), '-', ' - ') AS term FROM (SELECT p_name AS x FROM part UNION ALL SELECT p_type FROM part)")
def definition_list(spark, sf_dir):
    return readers.definitions(table(spark, sf_dir, "part").select(F.expr(_REGULATION).alias("json")))


@query("SELECT conv_id::VARCHAR AS doc_id, turn::INT AS turn, len(string_split(text, ' ')) AS n_words, md5(text) AS digest FROM conversations")
def prediction_files(spark, sf_dir):
    """Predictions as JSON lines and back."""
    path, words = _path(spark, "predictions"), F.split("text", " ")
    rows = _turns(spark, sf_dir).select(F.transform(words, lambda w: F.lit(True)).alias("mask"), F.transform(words, lambda w: F.lit("PD-pad")).alias("tags"), words.alias("words"), F.col("text").alias("sentence"), F.concat_ws("#", "conv_id", "turn").alias("doc_id"))
    rows.write.json(path)
    x = readers.predictions_jsonl(spark, path)
    return x.select(F.substring_index("doc_id", "#", 1).alias("doc_id"), F.substring_index("doc_id", "#", -1).cast("int").alias("turn"), F.size("words").cast("long").alias("n_words"), F.md5("sentence").alias("digest"))


@query("SELECT CASE WHEN turn % 2 = 0 THEN 'Yes' ELSE 'n' END AS relevance, md5(text) AS query, (turn + 1)::INT AS rank, conv_id::VARCHAR AS document_id FROM conversations WHERE turn < 3")
def judgement_files(spark, sf_dir):
    """The first three ranks of each query as CSV (line feeds and quotes in texts) and back."""
    path = _path(spark, "judgements")
    rows = _turns(spark, sf_dir).select(F.when(F.col("turn") % 2 == 0, "Yes").otherwise("n").alias("relevance"), F.col("text").alias("query"), (F.col("turn") + 1).cast("int").alias("rank"), F.col("conv_id").cast("string").alias("document_id"), F.col("role").alias("document_title"), F.lit("1").alias("page_nr"), F.concat(F.lit('"quoted",\n'), "text").alias("text"))
    sinks.write_results(rows, path)
    x = readers.judgements_csv(spark, path)
    return x.select("relevance", F.md5("query").alias("query"), "rank", "document_id")


@query("SELECT conv_id::VARCHAR AS query, count(*) AS n_docs, round(sum(turn + 0.5), 6) AS total FROM conversations GROUP BY conv_id")
def result_files(spark, sf_dir):
    """Results of searches as JSON and back."""
    path = _path(spark, "results")
    doc = F.struct(F.col("role").alias("doc_title"), F.lit(1).alias("times_retrieved"), (F.col("turn") + F.lit(0.5)).alias("sum_of_scores"), F.array(F.struct(F.lit("p").alias("id"), F.lit(1.0).alias("score"), F.col("text").alias("text"), F.array(F.lit("bm25")).alias("retrieved_by"))).alias("contents"))
    rows = _turns(spark, sf_dir).groupBy(F.col("conv_id").cast("string").alias("query")).agg(F.collect_list(F.struct((F.col("turn") + F.lit(0.5)).alias("score"), doc.alias("doc"))).alias("combined_prediction"))
    rows.write.json(path)
    x = readers.results_json(spark, path, one_per_line=True).select("query", F.explode("combined_prediction").alias("p"))
    return x.groupBy("query").agg(F.count("*").alias("n_docs"), F.round(F.sum("p.doc.sum_of_scores"), 6).alias("total"))


@query("SELECT concat('s', l_suppkey) AS src, concat('p', l_partkey) AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2")
def graph_files(spark, sf_dir):
    path = _path(spark, "graph")
    line = table(spark, sf_dir, "lineitem")
    sinks.write_table(line.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.count("*").cast("double").alias("weight")), path)
    return readers.graph_edges(spark, path)


@query("SELECT concat('n', n_nationkey) AS s, 'prefLabel' AS p, n_name AS o FROM nation UNION ALL SELECT concat('n', n_nationkey), 'broader', concat('r', n_regionkey) FROM nation")
def triple_files(spark, sf_dir):
    path, n = _path(spark, "triples"), table(spark, sf_dir, "nation")
    node = F.concat(F.lit("n"), "n_nationkey").alias("s")
    n.select(node, F.lit("prefLabel").alias("p"), F.col("n_name").alias("o")).union(n.select(node, F.lit("broader"), F.concat(F.lit("r"), "n_regionkey"))).write.option("sep", "\t").csv(path)
    return readers.triples(spark, path)


@query("SELECT conv_id::VARCHAR AS name, md5(string_agg(text, ' | ' ORDER BY turn)) AS digest, conv_id % 3 = 0 AS done FROM conversations GROUP BY conv_id")
def page_files(spark, sf_dir):
    """A folder of files, read as bytes; those that are done already are skipped."""
    path = _path(spark, "pages")
    rows = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " | ").alias("text"))
    sinks.write_samples(rows, "conv_id", "text", path)
    files = readers.file_scan(spark, path, "part-*")
    name = F.regexp_extract("path", "conv_id=([0-9]+)/", 1)
    left = readers.file_scan(spark, path, "part-*", files.filter(name.cast("long") % 3 == 0).select("path"))
    x = files.join(left.select("path", F.lit(False).alias("seen")), "path", "left")
    return x.select(name.alias("name"), F.md5(F.regexp_replace(F.col("content").cast("string"), "\n$", "")).alias("digest"), F.coalesce("seen", F.lit(True)).alias("done"))


@query(f"SELECT p_partkey AS k, p_name AS v, 'old' AS side FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, p_type, 'new' FROM part WHERE p_partkey % 3 = 0")
def upserted_rows(spark, sf_dir):
    """New rows replace old ones of their key; with skip they would not."""
    p = table(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"), F.lit("old").alias("side"))
    new = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("v"), F.lit("new").alias("side"))
    replaced = sinks.upsert(old, new, "k")
    return sinks.upsert(replaced, new.withColumn("side", F.lit("never")), "k", "skip")


@query("SELECT doc_id, CASE WHEN quality IS DISTINCT FROM toxic THEN concat_ws(' / ', quality, toxic) ELSE 'same' END AS agreement FROM labels")
def agreement(spark, sf_dir):
    x = table(spark, sf_dir, "labels")
    a, b = (x.select("doc_id", F.col(c).cast("string").alias("l")) for c in ("quality", "toxic"))
    return evaluate.agreement_column(a, b, ["doc_id"], "l").select("doc_id", "agreement")


@query("SELECT p_partkey AS k, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'content' END, CASE WHEN p_size % 3 = 0 THEN 'neighbours' END], lambda x: x IS NOT NULL), ',') AS fields, p_size % 3 = 0 AND p_size % 5 = 0 AS expands, p_size % 4 = 0 AS off FROM part")
def plan_switches(spark, sf_dir):
    """Switches that plans are made by: fields of weight, document expansion, services that are off."""
    def told(size: int) -> tuple:
        weights = {"content": float(size % 2 == 0), "neighbours": float(size % 3 == 0), "bm25": 1.0}
        both = {"filtered_NER_labels_domains": float(size % 5 == 0), "neighbours": weights["neighbours"]}
        return size, ",".join(enabled_fields(weights)), expands_documents(both), is_off("None" if size % 4 == 0 else "http://x")

    # All settings that there are, 60 rows; the table's rows stay where they are.
    plans = spark.createDataFrame([told(size) for size in range(60)], "size int, fields string, expands boolean, off boolean")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.pmod("p_size", F.lit(60)).cast("int").alias("size"))
    return parts.join(F.broadcast(plans), "size").drop("size")


@query(f"SELECT md5(word) AS word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(text, ' '))) AS word FROM benchmark) GROUP BY word)")
def unique_words(spark, sf_dir):
    """Queries with each word once."""
    x = table(spark, sf_dir, "benchmark").select(F.explode(F.split(T.unique_words(F.col("text")), " ")).alias("w"))
    return x.groupBy(F.md5("w").alias("word")).agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, array_to_string({S.phrases('text')}[1:3], '|') AS first FROM conversations")
def passage_preview(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(terms.preview(T.phrases(F.col("text"))), "|").alias("first"))


_SP = "SELECT conv_id AS k, CASE WHEN turn % 3 = 2 THEN 'C-x' ELSE 'x' END AS type, turn * 5 AS start, turn * 5 + CASE WHEN turn % 2 = 0 THEN 4 ELSE 3 END AS \"end\" FROM conversations"


@query(f"""WITH s AS ({_SP}), m AS (SELECT *, type = 'x' OR coalesce(start <> lag("end") OVER (PARTITION BY k ORDER BY start) + 1, true) AS opens FROM s), n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY k ORDER BY start) AS n FROM m)
SELECT k, min(start)::BIGINT AS start, max("end")::BIGINT AS "end" FROM n GROUP BY k, n""")
def merged_spans(spark, sf_dir):
    """Spans that continue the one right before them become one."""
    c = _turns(spark, sf_dir)
    s = c.select(F.col("conv_id").alias("k"), F.when(F.col("turn") % 3 == 2, "C-x").otherwise("x").alias("type"), (F.col("turn") * 5).alias("start"), (F.col("turn") * 5 + F.when(F.col("turn") % 2 == 0, 4).otherwise(3)).alias("end"))
    return terms.merge_continued(s, "k").select("k", "start", "end")


@query(f"""WITH w AS (SELECT role, string_split(text, ' ') AS w FROM conversations), x AS (SELECT CASE WHEN starts_with(role, 'u') THEN 'domestic' ELSE 'non-domestic' END AS origin, greatest(len(w) - 2, 0) AS n, list_filter(w[2:len(w) - 1], lambda v: length(v) > 4) AS b FROM w)
SELECT origin, count(*) AS n_sentences, sum(n)::BIGINT AS n_tokens, round(avg(n), 6) AS mean_tokens, sum(len(b))::BIGINT AS "BH" FROM x GROUP BY origin""")
def prediction_profile(spark, sf_dir):
    words = F.split("text", " ")
    p = _turns(spark, sf_dir).select(F.when(F.col("role").startswith("u"), "d1").otherwise("n1").alias("doc_id"), words.alias("words"), F.transform(words, lambda w: F.when(F.length(w) > 4, "BH-obj").otherwise("PD-pad")).alias("tags"))
    return terms.prediction_profile(p).select("origin", "n_sentences", "n_tokens", F.round("mean_tokens", 6).alias("mean_tokens"), "BH")


@query(f"SELECT phrase, count(*) AS n FROM ({PHRASES}) GROUP BY phrase")
def counter_cache(spark, sf_dir):
    """Counters are written once and loaded instead of counted again."""
    path = _path(spark, "counters")
    counts = table(spark, sf_dir, "documents").select(F.explode(T.phrases(F.col("text"))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))
    sinks.cached(counts, path)
    return sinks.cached(counts.limit(0), path)


@query("SELECT vec_id, chunk, true AS complete FROM (SELECT vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) // 100)::BIGINT AS chunk FROM embeddings)")
def embedding_parts(spark, sf_dir):
    """Vectors in numbered parts; an interrupted run goes on with the rows that no part holds yet."""
    from ..operators.common import chunks

    path = _path(spark, "parts")
    rows = chunks(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"], 100)
    sinks.write_table(rows.filter("chunk % 2 = 0"), path, ["chunk"])
    left = sinks.missing(rows, spark.read.parquet(path), ["vec_id"])
    left.write.mode("append").partitionBy("chunk").parquet(path)
    done = spark.read.parquet(path)
    whole = sinks.complete(rows.select("chunk").distinct().count(), done)
    return done.select("vec_id", F.col("chunk").cast("long").alias("chunk"), F.lit(whole).alias("complete"))


#: Codes of a made subset font: 256 above the code point, named by a range for each 256 codes.
_RANGES = "\n".join(f"<{n:02X}00> <{n:02X}FF> <{n - 1:02X}00>" for n in range(1, 256))
_FONT = f"""3 0 obj << /Type /Font /Subtype /Type0 /BaseFont /SUBSET+One /Encoding /Identity-H /ToUnicode 4 0 R >> endobj
4 0 obj << /Length 0 >>
stream
1 begincodespacerange <0000> <FFFF> endcodespacerange
255 beginbfrange
{_RANGES}
endbfrange
endstream
endobj
"""


@query(f"""SELECT id, 1 AS page_nr, regexp_replace(array_to_string(list_transform(l[2:len(l) - 2], lambda p: {S.strip('p')}), ' '), '{S.SP}+', ' ', 'g') AS text, NULL::VARCHAR AS error
FROM (SELECT concat(conv_id, '-', turn, '.pdf') AS id, string_split(trim(coalesce(text, ''), chr(10)), chr(10)) AS l FROM conversations)""")
def pdf_fonts(spark, sf_dir):
    """PDF files, one for each turn, in a font whose codes its ToUnicode map alone explains: pages as pdf_pages cleans them."""
    coded = lambda line: F.concat(F.lit("<"), F.array_join(F.transform(F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)), lambda c: F.lpad(F.hex(F.ascii(c) + 256), 4, "0")), ""), F.lit("> Tj"))
    shown = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), coded), " T* ")
    head = f"%PDF-1.7\n1 0 obj << /Type /Pages /Kids [2 0 R] /Count 1 /Resources << /Font << /F1 3 0 R >> >> >> endobj\n2 0 obj << /Type /Page /Parent 1 0 R /Contents 5 0 R >> endobj\n{_FONT}5 0 obj << /Length 0 >>\nstream\nBT /F1 12 Tf "
    made = F.concat(F.lit(head), shown, F.lit(" ET\nendstream\nendobj\n%%EOF"))
    files = _turns(spark, sf_dir).select(F.concat(F.lit("/"), "conv_id", F.lit("-"), "turn", F.lit(".pdf")).alias("path"), F.encode(made, "US-ASCII").alias("content"))
    return readers.reader_for("pdf")[1](files)


@query()
def learnt_vectors(spark, sf_dir):
    """Vectors of words, learnt from the company that they keep in all documents: their length (trained, so without SQL)."""
    words = embed.word_vectors(embed.ppmi(embed.cooccurrences(table(spark, sf_dir, "documents"))))
    return words.select("word", F.size("vec").alias("dims"), F.round(F.sqrt(vectors.dot(F.col("vec"), F.col("vec"))), 4).alias("length"))


@query()
def hashed_vectors(spark, sf_dir):
    """Vectors of distinct phrases by the default embedder (hashed trigrams have no SQL; tests hold it)."""
    spans = table(spark, sf_dir, "benchmark").select(F.explode(T.phrases(F.col("text"))).alias("span"))
    return vectors.embed(spans).select("span", F.size("vec").alias("dims"), F.round(F.aggregate(F.transform("vec", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x), 3).alias("norm"))
