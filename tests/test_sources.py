import json

import pytest
from pyspark.sql import functions as F

from textloom import config
from textloom.sources import readers, sinks


def test_html(spark):
    html = '<html><head><script>var t="</p>"</script></head><body><p> </p><p>a <b>b</b> &amp; c</p><!-- <p>no</p> --><p class="x">d\ne</p></body></html>'
    rows = readers.html_pages(spark.createDataFrame([(1, html), (2, None)], "i int, h string"), "i", "h").collect()
    assert [(r.id, r.page_nr, r.text) for r in rows] == [(1, 1, "a b & c"), (1, 2, "d\ne")]


def test_pages(spark):
    df = spark.createDataFrame([(1, "h\nbody\nf1\nf2\fh\nx\ny\nf1\nf2\f")], "i int, t string")
    assert [r.text for r in readers.pdf_pages(df, "i", "t").orderBy("page_nr").collect()] == ["body", "x y"]


def test_annotations(spark, tmp_path):
    (tmp_path / "d_1.txt").write_text("some sentence with span a here")
    (tmp_path / "d_1.ann").write_text('T1\tObject_span 5 13\tsentence\nA1\tConfidence T1\n#1\tAnnotatorNotes T1\tnote\nT3\tObject_span 21 25;8 9\t"span a"\n')
    (tmp_path / "n_2.txt").write_text("orphan")
    docs, spans = readers.annotations(spark, str(tmp_path))
    assert {r.doc: r.annotated for r in docs.collect()} == {"d_1": True, "n_2": None}
    got = {r.span_id: (r.span_start, r.gap_start, r.gap_end, r.span_end) for r in spans.collect()}
    assert got == {"T1": (5, None, None, 13), "T3": (8, 9, 21, 25)}


def test_bad_annotation_raises(spark):
    lines = spark.createDataFrame([("d", "T1\tX 9 3\tx")], "doc string, value string")
    with pytest.raises(Exception, match="out of order"):
        readers.parse_annotations(lines).collect()


def test_regulations(spark):
    x = {"1": {"1.1": {"a": "one", "b": ["two", ["three"]], "c": None, "url": "no"}}, "Appendix A. Terms": {"definitions": {"Fire-door": "x", "": "y"}}, "url": {"u": {"v": "w"}}}
    df = spark.createDataFrame([("f", json.dumps(x))], "name string, json string")
    assert [r.text for r in readers.regulation_sentences(df).orderBy("subsub", "pos").collect()] == ["one", "two", "three"]
    assert [r.term for r in readers.definitions(df).collect()] == ["fire - door"]


def test_xml_and_containment(spark):
    xml = '<standard><title-wrap xml:lang="en">Fire</title-wrap><std-ref type="dated">BS 1:2020</std-ref><sec><p>alpha beta</p><p>beta</p><p>gamma</p></sec></standard>'
    r = readers.xml_standards(spark.createDataFrame([(xml,)], "xml string")).first()
    assert r.doc_title == "BS 1:2020 # Fire" and r.sections == ["alpha beta", "gamma"]


def test_stored_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("c", "t", "doc", 3, 1, "title", 100, ["s1", "s2"], ["a", "b"], [], ["a"], [])], "content string, text string, doc string, page_nr int, split_id int, doc_title string, split_size int, sentences array<string>, NER_labels array<string>, filtered_NER_labels array<string>, filtered_NER_labels_domains array<string>, neighbours array<string>")
    sinks.write_jsonl(rows, str(tmp_path / "p"))
    back = readers.passages_jsonl(spark, str(tmp_path / "p")).first()
    assert (back.id, back.doc, back.page_nr, back.split_id, back.sentences, back.NER_labels, back.neighbours) == ("doc##3##1", "doc", 3, 1, ["s1", "s2"], ["a", "b"], [])
    assert "text" in sinks.flat(sinks.stored(rows)).columns


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, "k").collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(tuple(r) for r in sinks.upsert(old, new, "k", "skip").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert [r.k for r in sinks.missing(new, old, ["k"]).collect()] == [3]
    parts = sinks.split_sets(spark.range(200).withColumnRenamed("id", "k"), "k").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 120, "val": 40, "test": 40}
    assert sinks.sample(old, "k", 7).count() == 7
    sinks.write_table(old, str(tmp_path / "t"), ["k"])
    with pytest.raises(Exception):
        sinks.write_table(old, str(tmp_path / "t"))
    ranked = old.withColumn("rank", F.col("k").cast("long"))
    sinks.write_results(ranked, str(tmp_path / "r"), 1)
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 1
    sinks.write_samples(old, "k", "v", str(tmp_path / "s"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "s")).collect()) == ["a", "b"]


def test_small_readers(spark, tmp_path):
    (tmp_path / "q.txt").write_text(" one \n\ntwo\n")
    assert [r.query for r in readers.query_list(spark, str(tmp_path / "q.txt")).collect()] == ["one", "two"]
    (tmp_path / "j.csv").write_text('relevance,query,rank,document_id,document_title,page_nr,text\nYes,q,1,d,t,3,"two\nlines ""x"""\n')
    assert readers.judgements_csv(spark, str(tmp_path / "j.csv")).first().text == 'two\nlines "x"'
    (tmp_path / "t.tsv").write_text("n1\tprefLabel\tRoof\n")
    assert readers.triples(spark, str(tmp_path / "t.tsv")).first().o == "Roof"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.html").write_text("<p>")
    (tmp_path / "f" / "b.txt").write_text("x")
    files = readers.file_scan(spark, str(tmp_path / "f"), "*.html")
    assert files.count() == 1 and readers.file_scan(spark, str(tmp_path / "f"), "*.html", files).count() == 0
    (tmp_path / "p.json").write_text('{"mask":[true],"tags":["PD-pad"],"words":["a"],"sentence":"a","doc_id":"d"}\n')
    assert readers.predictions_jsonl(spark, str(tmp_path / "p.json")).first().tags == ["PD-pad"]
    assert readers.reader_for("html")[0] == "*.html"
    with pytest.raises(ValueError):
        readers.reader_for("docx")


def test_settings():
    s = config.load_settings('{// note\n "search": {"top_k": 3, "url": "http://x//y",}, "unknown": 1,}')
    assert s.top_k == 3 and s.bm25_k1 == 1.2
    assert config.is_off("No") and config.is_off("") and not config.is_off("http://x")
    assert config.enabled_fields({"content": 1, "bm25": 2, "neighbours": 0}) == ["content"]
    assert not config.expands_documents({"neighbours": 1})


def test_addresses_beside_sections(spark):
    from textloom.sources import readers

    text = '{"url":"u","Part 1":{"url":"u","A":{"url":["u"],"a":["one",["two"],null],"b":"three","c":null}},"Appendix A. Terms":{"url":"u","x":{"definitions":{"Fire-Door":{"url":"u"},"":1}}}}'
    df = spark.createDataFrame([("f", text), ("g", "[1]"), ("h", None)], "name string, json string")
    assert sorted(r.text for r in readers.regulation_sentences(df).collect()) == ["one", "three", "two"]
    assert [r.term for r in readers.definitions(df).collect()] == ["fire - door"]
