"""Sources: explicit schemas, nothing is inferred, inputs are never deleted."""

from __future__ import annotations

import ast
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

PASSAGE = "content string, content_type string, id string, meta struct<text:string,doc_title:string,split_size:int,split_id:int,source_filepath:string,output_filepath:string,sentences:string,NER_labels:string,filtered_NER_labels:string,filtered_NER_labels_domains:string,neighbours:string>"
PREDICTION = "mask array<boolean>, tags array<string>, words array<string>, sentence string, doc_id string"
JUDGEMENT = "relevance string, query string, rank int, document_id string, document_title string, page_nr string, text string"
RESULT = "query string, combined_prediction array<struct<score:double,doc:struct<doc_title:string,times_retrieved:int,sum_of_scores:double,contents:array<struct<id:string,score:double,text:string,retrieved_by:array<string>>>>>>"
LABELS = ("NER_labels", "filtered_NER_labels", "filtered_NER_labels_domains", "neighbours")
# Entities decoded in HTML text, ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def file_scan(spark: SparkSession, path: str, pattern: str, done: DataFrame | None = None) -> DataFrame:
    """path, content of files below a folder; files whose path is in done(path) are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.join(done.select("path"), "path", "left_anti") if done is not None else files


def split_pages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, page_nr (from 1), text of form-feed separated pages; what follows the last form feed is dropped."""
    parts = F.split(F.col(text_col), "\f", -1)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", "text")).select("id", (F.col("pos") + 1).cast("long").alias("page_nr"), "text")


def pdf_pages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cleaned pages of extracted PDF text; text extraction itself is a function that the caller maps over files."""
    return split_pages(docs, id_col, text_col).withColumn("text", T.page_clean(F.col("text")))


def paragraphs(html: Column) -> Column:
    """Texts of the p elements in the body, blank ones dropped; scripts, styles and comments don't count."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    body = F.regexp_extract(bare, r"(?is)<body\b[^>]*>(.*)</body>", 1)
    inner = F.regexp_extract_all(body, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))

    def plain(x: Column) -> Column:
        t = F.regexp_replace(x, "<[^>]*>", "")
        return T.char_normalise(reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, t))

    return F.filter(F.transform(inner, plain), lambda p: T.strip(p) != "")


def html_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, page_nr (from 1), text: a row per paragraph."""
    return pages.select(F.col(id_col).alias("id"), F.posexplode(paragraphs(F.coalesce(F.col(html_col), F.lit("")))).alias("pos", "text")).select("id", (F.col("pos") + 1).cast("long").alias("page_nr"), "text")


def xml_standards(docs: DataFrame, xml_col: str = "xml") -> DataFrame:
    """doc_title (`reference # title`) and sections of XML standards, contained sections dropped."""
    title = F.expr(f"xpath_string({xml_col}, \"//title-wrap[@*[local-name()='lang']='en']\")")
    ref = F.expr(f"xpath_string({xml_col}, \"//std-ref[@type='dated']\")")
    secs = F.expr(f"xpath({xml_col}, '//sec/p/text()')")
    return docs.select(F.concat_ws(" # ", ref, title).alias("doc_title"), drop_contained(F.transform(secs, T.drop_non_ascii)).alias("sections"))


def drop_contained(sections: Column) -> Column:
    """Sections that are no part of an earlier kept one."""
    return F.aggregate(sections, F.array().cast("array<string>"), lambda a, t: F.when(F.exists(a, lambda x: F.contains(x, t)), a).otherwise(F.concat(a, F.array(t))))


def passages_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Stored passages as typed rows: id parts, lists instead of joined strings."""
    raw = spark.read.schema(PASSAGE).option("mode", "FAILFAST").json(path)
    items = lambda c, sep: F.filter(F.split(F.col(f"meta.{c}"), sep), lambda x: x != "")
    return raw.select("id", T.id_part(F.col("id"), 1).alias("doc"), T.id_part(F.col("id"), 2).cast("int").alias("page_nr"), T.id_part(F.col("id"), 3).cast("int").alias("split_id"), "content", "meta.text", "meta.doc_title", "meta.split_size", items("sentences", "###").alias("sentences"), *(items(c, ", ").alias(c) for c in LABELS))


def predictions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)


def judgements_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JUDGEMENT).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def results_json(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    return spark.read.schema(RESULT).option("multiLine", not one_per_line).json(path)


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """query: one per line, stripped; blank lines dropped."""
    return query_lines(spark.read.text(path))


def query_lines(lines: DataFrame) -> DataFrame:
    return lines.select(T.strip(F.col("value")).alias("query")).filter("query <> ''")


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src string, dst string, weight double").parquet(path)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of a vocabulary, stored as tab-separated lines."""
    return spark.read.schema("s string, p string, o string").option("sep", "\t").csv(path)


def parse_annotations(lines: DataFrame, doc: str = "doc", line: str = "value") -> DataFrame:
    """Span rows of standoff annotation lines; other kinds of line are left out.

    `T1 <tab> type start end <tab> text` or `type start end;start end`: of two halves the one that starts first comes
    first; halves that overlap raise.
    """
    f = F.split(F.col(line), "\t")
    x = lines.filter(F.col(line).rlike("^T[0-9]*\t")).select(F.col(doc).alias("doc"), f[0].alias("span_id"), f[1].alias("where"), F.get(f, F.lit(2)).alias("span_text"))
    number = lambda i: F.try_element_at(F.regexp_extract_all("where", F.lit(r"(?<= |;)([0-9]+)(?= |;|$)"), F.lit(1)), F.lit(i)).cast("int")
    x = x.select("doc", "span_id", "span_text", F.substring_index("where", " ", 1).alias("span_type"), *(number(i).alias(f"n{i}") for i in range(1, 5)))
    two = F.col("n3").isNotNull()
    swap = two & (F.col("n3") < F.col("n1"))
    a, b = F.when(swap, F.col("n3")).otherwise(F.col("n1")), F.when(swap, F.col("n4")).otherwise(F.col("n2"))
    c, d = F.when(swap, F.col("n1")).otherwise(F.col("n3")), F.when(swap, F.col("n2")).otherwise(F.col("n4"))
    bad = (a > b) | (two & ((b > c) | (c > d)))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("span out of order: "), "span_id"))).otherwise(a).cast("int")
    return x.select("doc", "span_id", "span_type", checked.alias("span_start"), F.when(two, b).alias("gap_start"), F.when(two, c).alias("gap_end"), F.when(two, d).otherwise(b).alias("span_end"), "span_text")


def annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sentences (doc, sentence) and spans of a folder of .txt and .ann files, joined by name; orphans get null."""
    name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), r"\.[^.]*$", "")
    read = lambda ext: spark.read.option("pathGlobFilter", f"*.{ext}")
    texts = read("txt").option("wholetext", True).text(path).select(name.alias("doc"), F.col("value").alias("sentence"))
    lines = read("ann").text(path).select(name.alias("doc"), "value")
    docs = texts.join(lines.select("doc", F.lit(True).alias("annotated")).distinct(), "doc", "full")
    return docs, parse_annotations(lines)


def entries(json: str | Column) -> Column:
    """An object's entries, inner values as JSON text; null for anything but an object (such as an address)."""
    text = F.col(json) if isinstance(json, str) else json
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def regulation_sentences(files: DataFrame, name: str = "name", json_col: str = "json") -> DataFrame:
    """name, section, sub, subsub, text of nested regulations: strings at any depth below a third-level key.

    Keys that start with `Appendix A.` and `url` are skipped.
    """
    x = files.select(F.col(name).alias("name"), F.explode(entries(json_col)).alias("section", "s")).filter("not startswith(section, 'Appendix A.') and section <> 'url'")
    x = x.select("name", "section", F.explode(entries("s")).alias("sub", "t")).filter("sub <> 'url'").select("name", "section", "sub", F.explode(entries("t")).alias("subsub", "v")).filter("subsub <> 'url' and v is not null")
    strings = F.when(F.col("v").rlike(r"^\s*\["), F.transform(F.regexp_extract_all("v", F.lit(r'"((?:\\.|[^"\\])*)"'), F.lit(1)), lambda q: F.get_json_object(F.concat(F.lit('{"x":"'), q, F.lit('"}')), "$.x"))).otherwise(F.array("v"))
    return x.select("name", "section", "sub", "subsub", F.posexplode(strings).alias("pos", "text"))


def _items(values: list, compat: bool, top: bool = True) -> list[str]:
    out: list[str] = []
    for v in values:
        if isinstance(v, list):
            inner = _items(v, compat, False)
            # compat: a list within a list takes the place of what stands before it; only at the top is it added.
            out = inner if compat and not top else out + inner
        elif isinstance(v, str):
            plain = re.sub("#Li[0-9_]*#", "", v)
            if top and v.startswith(("#EndTable", "#Table")):
                continue
            if not top and len(plain) > 4 and plain.startswith("['"):
                try:
                    told = ast.literal_eval(plain)  # a list that was written as text
                except (ValueError, SyntaxError):
                    told = None
                if isinstance(told, list):
                    inner = _items(told, compat, False)
                    out = inner if compat else out + inner
                    continue
            out.append(plain)
    return out


def list_items(spark: SparkSession, mode: str = "intended", name: str = "list_items") -> str:
    """Register a table function of a VARIANT: pos, text of the strings in a list of lists of any depth, in order.

    Item marks go, so do the marks of tables at the top; anything but lists and strings is left out, and a value that is no
    list gives no rows.  intended: all items.  compat: within a nested list a further list replaces its elder siblings.
    """
    if mode not in ("intended", "compat"):
        raise ValueError(mode)
    compat = mode == "compat"

    @F.udtf(returnType="pos int, text string")
    class Items:
        def eval(self, value):
            value = value.toPython() if value is not None else None
            if isinstance(value, list):
                yield from enumerate(_items(value, compat))

    spark.udtf.register(name, Items)
    return name


def definitions(files: DataFrame, json_col: str = "json") -> DataFrame:
    """term: distinct non-empty keys of the `definitions` below sections that start with `Appendix A.`."""
    x = files.select(F.explode(entries(json_col)).alias("section", "s")).filter("startswith(section, 'Appendix A.')")
    inner = x.select(F.explode(entries("s")).alias("sub", "v")).filter("sub <> 'url'")
    own = F.when(F.col("sub") == "definitions", F.col("v")).otherwise(entries("v")["definitions"])
    keys = F.map_keys(entries(own))
    return inner.select(F.explode(keys).alias("term")).select(T.normalise_definition(F.col("term")).alias("term")).filter("term <> ''").distinct()


def html_files(files: DataFrame) -> DataFrame:
    """id (the file's name), page_nr, text, error (null) of files(path, content) in UTF-8."""
    x = files.select(F.element_at(F.split("path", "/"), -1).alias("id"), F.col("content").cast("string").alias("html"))
    return html_pages(x, "id", "html").withColumn("error", F.lit(None).cast("string"))


def pdf_files(files: DataFrame) -> DataFrame:
    """id, page_nr, text, error of files(path, content): see sources/pdf.py."""
    from . import pdf

    return pdf.pages(files)


READERS = {"html": ("*.html", html_files), "pdf": ("*.pdf", pdf_files)}


def reader_for(kind: str):
    """The file pattern of a format and its function from files(path, content) to pages; others raise."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; known: {sorted(READERS)}")
    return READERS[kind]
