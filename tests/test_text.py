from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import passages as P
from textloom.functions import text as T


def apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean_span(spark):
    want = {"the roof": "the roof", "roof": "roof", "ice": None, "UK": "UK", "U2": None, "a.b,c": None, "50%": None, "thethe wall": "wall", "floor floor": "floor", "[beam]": "beam", "a": None, "the ice": None, "The ABC": "The ABC", "x. y plan": "xy plan", "their house": "house", "": ""}
    got = apply(spark, T.clean_span, *want)
    assert [g for g, w in zip(got, want.values()) if w != ""] == [w for w in want.values() if w != ""]


def test_clean_span_compat_keeps_repeats(spark):
    assert apply(spark, lambda c: T.clean_span(c, "compat"), "floor floor") == ["floor floor"]


def test_determiners(spark):
    assert apply(spark, T.strip_determiners, "The the wall", "the ", "an apple", "those these x", "theatre", "a a a b") == ["wall", "", "apple", "these x", "theatre", "b"]


def test_numbers(spark):
    assert apply(spark, T.drop_numbers, "1.2.3 walls", "walls (3.4)", "A. 12 fire", "12/34", "plain") == ["walls", "walls ", "fire", "", "plain"]


def test_char_normalise(spark):
    assert apply(spark, T.char_normalise, "£5 m² 20° ½ é – ‘a’ “b” … âx") == ["pounds 5 m#SUP#2#SUP# 20 degrees  1/2 e - `a' ``b'' ... -x"]


def test_white_space(spark):
    assert apply(spark, T.whitespace_clean, " a \n\n\n b") == ["a\n\nb"]
    assert apply(spark, T.space_collapse, "a   b\n  c ") == ["a b\n c"]
    assert apply(spark, T.page_clean, "head\n a  b \nc\nfoot\n", "x", "") == ["a b c", "", ""]


def test_sentences(spark):
    assert apply(spark, T.sentences, "One. Two!  Three?\nFour 1.5", "") == [["One.", "Two!", "Three?", "Four 1.5"], []]


def test_query_and_markup(spark):
    assert apply(spark, T.sanitise_query, " 'roof' (flat) [a]/", "()") == ["roof flat a", None]
    assert apply(spark, T.strip_markup, "a #DEFINED#fire door#TERM# b", "#Figure12#text#EndFigure12#", "#QUOTE#hello#ENDQUOTE##") == ["a fire door b", "text", "hello"]
    assert apply(spark, T.defined_terms, "#DEFINED#x#TERM# #DEFINED#y#TERM#") == [["x", "y"]]


def test_titles_and_identifiers(spark):
    df = spark.createDataFrame([("BS_1234.pdf", "BS 1234:2020 Fire doors"), ("a--b", ""), ("x.pdf", "ready # made")], "d string, t string")
    assert [r[0] for r in df.select(T.compose_title(F.col("d"), F.col("t"))).collect()] == ["BS # Fire doors", "a # [Could not grab title]", "ready # made"]
    assert apply(spark, T.find_identifier, "x # BS 1234:2020 more", "no known start") == ["BS 1234:2020", None]
    assert apply(spark, T.file_identifier, "BS 1234-1+A1", "PAS 79-2020 x", "other") == ["BS 1234-1", "PAS 79-2020", "other"]
    assert apply(spark, T.tracked_changes, "BS TC 1", "plain") == [True, False]
    assert apply(spark, lambda c: T.id_part(c, 2), "doc##3##1", "doc") == ["3", None]


def test_small_ones(spark):
    assert apply(spark, T.lower_all_caps, "ALL CAPS 1", "Not All", "123") == ["all caps 1", "Not All", "123"]
    assert apply(spark, T.drop_non_ascii, "naïve") == ["nave"]
    assert apply(spark, T.normalise_definition, ' "Fire-Door" ') == ["fire - door"]
    assert apply(spark, T.origin, "d_1", "n_1") == ["domestic", "non-domestic"]
    assert apply(spark, T.unique_words, "a b a") == ["a b"]
    df = spark.createDataFrame([(["fire", "##door", "x"],)], "p array<string>")
    assert df.select(T.join_pieces(F.col("p"))).first()[0] == "firedoor x"
    assert df.select(T.join_pieces_bare(F.array(F.lit("the"), F.lit("x")))).first()[0] == "x"


def test_similarity(spark):
    df = spark.createDataFrame([("the roof", "roofs", True), ("roof", "wall", False), ("", "", True)], "a string, b string, w boolean")
    assert all(r[0] == r[1] for r in df.select(T.similar(F.col("a"), F.col("b")), "w").collect())


def pack(sentences, most=100):
    out, cur, cum = [], [], 0
    for s in sentences:
        n = len(s.split(" "))
        kept = s[:300] if n > most else s
        if cum + n > most:
            out.append(cur)
            cur, cum = [kept], n
        else:
            cur, cum = cur + [kept], cum + n
    return [c for c in [*out, cur] if c]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 140), max_size=12))
def test_passages_match_a_plain_loop(spark, sizes):
    sents = [" ".join(["word"] * n) for n in sizes]
    got = spark.createDataFrame([(sents,)], "s array<string>").select(P.pack(F.col("s"))).first()[0]
    assert got == pack(sents)


def test_passage_resets(spark):
    sents = [" ".join(["w"] * n) for n in (40, 70, 30, 120)]
    got = spark.createDataFrame([(sents,)], "s array<string>").select(P.pack(F.col("s"))).first()[0]
    assert [len(x) for x in got] == [1, 2, 1] and len(got[-1][0]) <= 300
    over = spark.createDataFrame([(sents[:3],)], "s array<string>").select(P.pack(F.col("s"), overlap=10)).first()[0]
    assert [len(x) for x in over] == [1, 2, 2]


def test_common_ngrams_and_dedup(spark):
    from textloom.operators import dedup

    pages = spark.createDataFrame([(1, 1, "page one of the book by A"), (1, 2, "page two of the book by B"), (2, 1, "alone here now")], "d int, p int, t string")
    assert [tuple(r) for r in dedup.common_ngrams(pages, "d", "p", "t").collect()] == [(1, "of the book by", 4)]
    files = spark.createDataFrame([("x/BS 1234.pdf",), ("y/BS 1234.pdf",), ("x/BS 1234 2020.pdf",), ("x/BS 9 TC.pdf",)], "path string")
    assert {r.path for r in dedup.by_identifier(files).collect() if r.keep} == {"x/BS 1234.pdf"}
