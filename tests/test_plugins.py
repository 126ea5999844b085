from pyspark.sql import functions as F

from textloom.functions import plugins


def test_list_column_and_words(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert [r.spans for r in plugins.with_spans(df, "t", lambda x: [t.split() for t in x]).collect()] == [["a", "b"], []]
    w = spark.createDataFrame([(["Doors", "classes", "Bodies", "bus", "gas"],)], "w array<string>")
    assert w.select(plugins.normalise_words(F.col("w"), "stem")).first()[0] == ["door", "class", "bodi", "bu", "ga"]
    assert w.select(plugins.normalise_words(F.col("w"))).first()[0][0] == "doors"


def test_sql_functions(spark):
    plugins.register(spark)
    r = spark.sql("SELECT tl_tokens('Ab, c1') AS a, tl_space_collapse('x  y') AS b, tl_similarity('roof', 'roofs') AS c, tl_id_part('d##2', 2) AS d").first()
    assert (r.a, r.b, r.c, r.d) == (["ab", "c1"], "x y", 80.0, "2")


def test_tagger_off(spark):
    from textloom.functions import plugins

    df = spark.createDataFrame([("a b",), (None,)], "text string")
    tagger = lambda texts: [t.split() for t in texts]
    assert [r.spans for r in plugins.with_spans(df, "text", tagger).collect()] == [["a", "b"], []]
    for off in (plugins.with_spans(df, "text", tagger, weight=0), plugins.with_spans(df, "text", None)):
        assert [r.spans for r in off.collect()] == [[], []]


def test_label_field_follows_its_weight(spark):
    from textloom.config import Settings
    from textloom.plans.pipelines import labelled

    df = spark.createDataFrame([(1, "Fire doors. Smoke", ["old"]), (2, None, None), (3, "", ["x"])], "doc_id long, text string, NER_labels array<string>")
    on, off = (labelled(df, Settings().with_values(field_weights=w)) for w in ({"NER_labels": 0.5}, {"content": 1.0}))
    assert [r.NER_labels for r in on.orderBy("doc_id").collect()] == [["Fire doors", "Smoke"], [], []]
    assert [r.NER_labels for r in off.collect()] == [[], [], []]
    assert labelled(df.limit(0)).count() == 0
