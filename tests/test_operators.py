import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import common, evaluate, expand, fuse, retrieve, stats, tagging, vectors


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_intermediate_tables_go(spark):
    before = common.made()
    one = common.materialise(spark.range(3), "kept")
    start = common.made()
    two = common.materialise(spark.range(4), "gone")
    path = two.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    common.forget(spark, start)
    assert one.count() == 3 and common.made() == before + 1 and not __import__("os").path.exists(path)


def test_common_ngrams_of_skewed_pages(spark):
    shared = "one two three four five six"
    pages = [("a", i, f"x{i} {shared} y{i}") for i in range(30)] + [("a", 99, f"{shared} {shared}"), ("b", 1, shared), ("c", 1, "p q r s"), ("c", 2, "q r s p q r"), ("d", 1, None), ("d", 2, "")]
    from textloom.operators import dedup

    got = dedup.common_ngrams(spark.createDataFrame(pages, "h string, p int, t string"), "h", "p", "t")
    assert rows(got, "doc") == [("a", shared, 6), ("c", "p q r", 3)]
    short = dedup.common_ngrams(spark.createDataFrame(pages, "h string, p int, t string"), "h", "p", "t", most=4)
    assert rows(short.filter("doc = 'a'"), "doc") == [("a", "one two three four", 4)]


def test_global_offsets(spark):
    df = spark.createDataFrame([(i * 7, i % 5 + 1) for i in range(400)], "k long, n long")
    got = {r.k: r.before for r in common.global_offsets(df, "k", "n", block=16).collect()}
    total = 0
    for i in range(400):
        assert got[i * 7] == total
        total += i % 5 + 1


def test_results_dedup(spark):
    docs = spark.createDataFrame([(1, "a", 1, "ID1", ["x", "y"]), (1, "b", 2, "ID1", ["z"]), (1, "c", 3, None, ["z"]), (1, "d", 4, None, ["w"]), (1, "e", 5, None, ["v", "v"]), (2, "f", 1, "ID1", ["x"])], "query_id int, doc_title string, ord int, identifier string, texts array<string>")
    assert rows(fuse.drop_duplicates(docs).select("query_id", "doc_title"), "query_id", "doc_title") == [(1, "a"), (1, "d"), (2, "f")]


def test_rank_compat_and_pages(spark):
    docs = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (1, "c", 1.0)], "query_id int, doc_title string, score double")
    assert [r[1] for r in rows(fuse.rank_documents(docs), "rank")] == ["a", "b", "c"]
    assert [r.doc_title for r in fuse.rank_documents(docs, mode="compat").orderBy("rank").collect()] == ["a", "c"]
    ranked = fuse.rank_documents(docs)
    assert fuse.page_count(ranked, 2).first().pages == 2 and fuse.page_count(ranked, 2, "compat").first().pages == 1


def test_weights(spark):
    r = spark.createDataFrame([("bm25", 1.0), ("content", 1.0), ("other", 1.0)], "field string, score double")
    w = {"bm25": 6.0, "content": 2.0}
    assert {x.field: x.score for x in fuse.weigh(r, w).collect()} == {"bm25": 6.0, "content": 2.0, "other": 1.0}
    assert {x.field: x.score for x in fuse.weigh(r, w, "compat").collect()}["bm25"] == 1.0


def test_label_counters(spark):
    r = spark.createDataFrame([(1, "t", "bm25", 1.0, ["a", "b"], ["c"]), (1, "t", "NER_labels", 1.0, ["a"], ["c"]), (1, "t", "content", 1.0, ["z"], ["z"])], "query_id int, doc_title string, field string, score double, NER_labels array<string>, neighbours array<string>")
    counts = fuse.label_counters(r, ["NER_labels", "neighbours"])
    assert rows(counts.select("label_type", "label", "n"), "label_type", "label") == [("NER_labels", "a", 2), ("NER_labels", "b", 1), ("neighbours", "c", 1)]
    assert fuse.counters_map(counts).first().counters == {"NER_labels": {"a": 2, "b": 1}, "neighbours": {"c": 1}}


def test_fan_out_and_substitution(spark):
    one = spark.createDataFrame([(1, 1.0)], "id int, score double")
    assert sorted(r.field for r in retrieve.fan_out({"bm25": one, "content": one}).collect()) == ["bm25", "content"]
    assert [r.field for r in retrieve.fan_out({"bm25": one, "content": one}, "dense").collect()] == ["content"]
    with pytest.raises(ValueError):
        retrieve.fan_out({"bm25": one}, "dense")
    p = spark.createDataFrame([("d", "T", 1, "x"), ("d", "T", 2, "y")], "doc string, doc_title string, o int, content string")
    assert rows(retrieve.substitute_field(p, "doc_title", "doc", "o").select("content", "o"), "o") == [("T", 1)]


def test_knn(spark):
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(60, 5)), 2)
    m[7] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<float>")
    got = vectors.search(df, df.filter("id % 3 = 0"), 4, "id", "v", exclude_self=True).collect()
    f = m.astype(np.float32).astype(float)
    for q in range(0, 60, 3):
        d = np.round(np.sqrt(((f - f[q]) ** 2).sum(1)), 6)
        want = [j for j in sorted(range(60), key=lambda j: (d[j], j)) if j != q][:4]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert vectors.search(df, df.filter("id < 0"), 4, "id", "v").count() == 0


def test_knn_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(9)], "id long, v array<float>")
    whole = rows(vectors.search(df, df, 2, "id", "v"), "query_id", "rank")
    monkeypatch.setattr(vectors, "BLOCK", 2)
    assert rows(vectors.search(df, df, 2, "id", "v"), "query_id", "rank") == whole
    monkeypatch.setattr(vectors, "PIVOTS", 1)
    assert rows(vectors.search(df, df, 2, "id", "v"), "query_id", "rank") == whole


@pytest.mark.parametrize("metric", ["euclidean", "dot"])
def test_knn_prunes_without_loss(spark, monkeypatch, metric):
    """Clusters, copies, a hot cell and rows without a vector: equal to brute force, from a part of all pairs."""
    rng = np.random.default_rng(9)
    m = np.round(np.concatenate([rng.normal(size=(40, 6)) * 0.3 + c for c in rng.normal(size=(12, 6)) * 9] + [np.ones((150, 6))]), 3)
    n = len(m)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(None, [0.0] * 6), (n, None)], "id long, v array<double>")
    asked = []
    met = vectors._met
    monkeypatch.setattr(vectors, "_met", lambda a, r, c, f: (asked.append((a, c)), met(a, r, c, f))[1])
    monkeypatch.setattr(vectors, "BLOCK", 64)
    got = rows(vectors.search(df, df.filter("id % 7 = 0 or id is null"), 9, "id", "v", metric, True).select("query_id", "rank", "id", "distance"), "query_id", "rank")
    want = []
    for q in range(0, n, 7):
        d = np.round(-(m @ m[q]) if metric == "dot" else np.sqrt(((m - m[q]) ** 2).sum(1)), 6)
        best = [j for j in sorted(range(n), key=lambda j: (d[j], j)) if j != q][:9]
        want += [(q, r + 1, j, pytest.approx(d[j])) for r, j in enumerate(best)]
    assert got == want
    read = sum(c.n[r.cell] for a, c in asked for r in a.select("cell").collect())
    assert read < (0.5 if metric == "euclidean" else 0.9) * n * len(range(0, n, 7))


def test_classify(spark):
    n = spark.createDataFrame([(1, 10, 0.0), (1, 11, 0.1), (2, 11, 0.5), (2, 12, 1.0), (2, 13, 1.0)], "query_id long, id long, distance double")
    labels = spark.createDataFrame([(10, "x"), (11, "y"), (12, "x"), (13, "x")], "id long, label string")
    assert rows(vectors.classify(n, labels).select("query_id", "label"), "query_id") == [(1, "x"), (2, "x")]


def test_standardise_constant_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id int, v array<double>")
    assert [r.v for r in vectors.standardise(df, "v").orderBy("id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]


def test_layers_and_embedding(spark):
    df = spark.createDataFrame([([1.0, 4.0], [3.0, 2.0])], "a array<double>, b array<double>")
    for how, want in (("avg", [2.0, 3.0]), ("sum", [4.0, 6.0]), ("max", [3.0, 4.0])):
        assert df.select(vectors.combine_layers([F.col("a"), F.col("b")], how)).first()[0] == want
    spans = spark.createDataFrame([("roof",), ("roof",), ("  ",)], "span string")
    got = vectors.embed(spans).collect()
    assert len(got) == 1 and abs(sum(x * x for x in got[0].vec) - 1) < 1e-5


def test_graph_modes(spark):
    e = expand.undirected(spark.createDataFrame([("hub", f"n{i}", 1.0) for i in range(80)] + [("a", "xxxx", 1.0), ("a", "yyyy", 2.0), ("a", "zzzz", 3.0), ("b", "qqqq", 1.0)], "src string, dst string, weight double"))
    spans = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "hub", 2), (1, "alone", 3)], "query_id int, span string, ord int")
    got = rows(expand.graph_candidates(spans, e).select("span", "candidate"), "span", "candidate")
    assert got == [("a", "xxxx"), ("a", "yyyy"), ("b", "qqqq")]
    assert expand.graph_candidates(spans, e, mode="compat").count() == 2


def test_feedback_and_selection(spark):
    labels = spark.createDataFrame([(1, "fire door", 3), (1, "fire doors", 3), (1, "wall", 5), (1, "once", 1), (1, "", 9), (1, "cable", 2)], "query_id int, label string, n long")
    spans = spark.createDataFrame([(1, "fire door", 0)], "query_id int, span string, ord int")
    got = rows(expand.feedback_candidates(labels, spans).select("candidate", "n"), "candidate")
    assert got == [("cable", 2), ("wall", 5)]
    idf = spark.createDataFrame([("wall", 2.0), ("cable", 3.0)], "token string, idf double")
    cand = spark.createDataFrame([(1, "prf", "wall", 0), (1, "kg", "wall", 1), (1, "prf", "cable", 2), (1, "kg", "fire door", 3), (1, "kg", "new", 4)], "query_id int, source string, candidate string, ord int")
    chosen = expand.select_terms(cand, spans, idf, {"prf": 1.0, "kg": 1.0}, k=3)
    assert rows(chosen.select("candidate", "score", "rank"), "rank") == [("wall", 4.0, 1), ("cable", 3.0, 2), ("new", 0.5, 3)]
    q = spark.createDataFrame([(1, "doors"), (2, "plain")], "query_id int, query string")
    out = expand.expanded_queries(q, spans, chosen)
    assert rows(out.select("query_id", "expanded"), "query_id") == [(1, "doors, fire door, wall, cable, new"), (2, "plain")]


def test_dissimilar_neighbours(spark):
    p = spark.createDataFrame([(1, "fire door", c, i) for i, c in enumerate(["fire", "fire doors", "wall", "roof", "beam"])], "query_id int, span string, candidate string, rank long")
    assert rows(expand.dissimilar_neighbours(p).select("candidate"), "candidate") == [("roof",), ("wall",)]


def test_skos(spark):
    t = spark.createDataFrame([("n1", "prefLabel", "Roof"), ("n1", "altLabel", "roofing"), ("n2", "prefLabel", "Flat roof"), ("n2", "broader", "n1"), ("n3", "prefLabel", "Building"), ("n3", "narrower", "n1"), ("n4", "prefLabel", "Cover"), ("n4", "closeMatch", "n1")], "s string, p string, o string")
    q = spark.createDataFrame([("roofing",)], "term string")
    label = lambda df: sorted(r[1] for r in df.collect())
    assert label(expand.narrower(t, q)) == ["Flat roof"]
    assert label(expand.broader(t, q)) == ["Building"]
    assert label(expand.close(t, q)) == ["Cover"]
    assert label(expand.same_node(t, q)) == ["Roof", "roofing"]
    assert label(expand.one_hop(t, spark.createDataFrame([("building",)], "term string"))) == []


def test_metrics(spark):
    x = spark.createDataFrame([("q1", 1, False), ("q1", 2, None), ("q1", 3, True), ("q1", 4, True), ("q2", 1, False), ("q3", 1, True)], "q string, rank int, relevant boolean")
    m = {r.q: r for r in evaluate.ranking_metrics(x, ["q"], 2).collect()}
    assert (m["q1"].n, m["q1"].precision, m["q1"].recall, m["q1"].rr) == (3, 0.5, 0.5, 0.5)
    assert math.isclose(m["q1"].ap, (1 / 2 + 2 / 3) / 2)
    assert m["q2"].f1 == m["q2"].rr == m["q2"].ap == 0 and m["q3"].ap == 1


def test_relevance_marks(spark):
    x = spark.createDataFrame([("Yes",), ("n",), ("h",), ("?",)], "m string")
    assert [r[0] for r in x.select(evaluate.relevance(F.col("m"))).collect()] == [True, False, False, None]
    assert [r[0] for r in x.select(evaluate.relevance(F.col("m"), False)).collect()] == [True, False, None, None]


def test_pooled_and_agreement(spark):
    p = spark.createDataFrame([("q", ["s1", "s2"], ["1", "3"])], "query string, settings array<string>, ranks array<string>")
    assert rows(evaluate.unpool(p).select("setting", "rank"), "setting") == [("s1", 1), ("s2", 3)]
    a = spark.createDataFrame([("q", "t1", "y"), ("q", "t2", "n")], "q string, t string, l string")
    b = spark.createDataFrame([("q", "t1", "n"), ("q", "t2", "n")], "q string, t string, l string")
    assert rows(evaluate.agreement_column(a, b, ["q", "t"], "l").select("t", "agreement"), "t") == [("t1", "y / n"), ("t2", "same")]
    new = spark.createDataFrame([(1, "fire door width", "the door must be wide"), (2, "other", "nothing")], "row_id long, query string, text string")
    old = spark.createDataFrame([(1, "fire door widths", "the door must be wide", "n"), (2, "fire door width", "the door must be wide.", "y")], "ord long, query string, text string, relevance string")
    assert rows(evaluate.reuse_judgements(new, old).select("row_id", "relevance"), "row_id") == [(1, "y"), (2, None)]


def test_reuse_against_brute_force(spark, sf_dir):
    import random
    from difflib import SequenceMatcher

    from textloom.plans import more_queries

    def want(new, old):
        like = lambda a, b: None not in (a, b) and 100 * SequenceMatcher(None, a, b, autojunk=False).ratio() > 70
        return {r: max(((o, x) for o, q2, t2, x in old if like(q, q2) and like(t, t2)), default=(0, None))[1] for r, q, t in new}

    rng = random.Random(3)

    def typo(t):
        return " ".join(w[:i] + rng.choice("xyz") + w[i + 1 :] for w in t.split(" ") for i in [rng.randrange(len(w))])

    base = ["".join(rng.choice("abcdefgh ") for _ in range(30)).replace("  ", " ").strip() for _ in range(12)]
    old = [(i, rng.choice(base), rng.choice(base), rng.choice("yn")) for i in range(60)] + [(90, "firedoors", "width", "y"), (91, "", "", "n"), (92, None, "a", "y")]
    new = [(i, typo(q), typo(t)) for i, q, t, _ in old if q and t] + [(100, "firedoor", "width"), (101, "", ""), (102, None, "a"), (103, "a", None)]
    a = spark.createDataFrame(new, "row_id long, query string, text string")
    b = spark.createDataFrame(old, "ord long, query string, text string, relevance string")
    expected = want(new, old)
    assert expected[100] == "y"
    for block in (200, 7):
        assert {r.row_id: r.relevance for r in evaluate.reuse_judgements(a, b, block=block).collect()} == expected
    c = [(r.conv_id * 1000 + r.turn, r.text, r.text, r.role) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = {r.row_id: r.relevance for r in more_queries.annotator_reuse(spark, sf_dir).collect()}
    assert got == want([x[:3] for x in c], [x for x in c if x[3] == "user"])


def test_subsequences_of_many_texts_at_once(monkeypatch):
    """Texts are compared with an old one together, and those that are old themselves with later ones alone."""
    import random

    import pandas as pd

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdé 🏠", k=rng.choice([0, 1, 7, 8, 31, 64, 90]))) for _ in range(150)]
    run = evaluate._lanes(texts)
    for y in [*texts[:6], "", "zz", "a" * 200]:
        assert run(y).tolist() == [longest(x, y) for x in texts]
    old = pd.DataFrame([(t, t, i, str(i)) for i, t in enumerate(texts[:50])], columns=["query", "text", "ord", "relevance"]).drop_duplicates("text")
    new = pd.DataFrame([(t, t, i if i < 50 else -1) for i, t in enumerate(texts)], columns=["query", "text", "known"]).drop_duplicates("text")
    want = evaluate._like(70)(new, old)
    assert len(want) and not (set(zip(want["text"], want["ord"])) & set(zip(old["text"], old["ord"])))
    for lanes, together, kept in ((3, 10**6, 10**9), (64, 300, 2000), (200, 10**6, 10**9)):
        monkeypatch.setattr(evaluate, "LANES", lanes)
        monkeypatch.setattr(evaluate, "TOGETHER", together)
        monkeypatch.setattr(evaluate, "KEPT", kept)
        got = evaluate._like(70)(new, old)
        assert set(got.itertuples(index=False, name=None)) == set(want.itertuples(index=False, name=None))


def test_span_scores(spark):
    g = spark.createDataFrame([(1, "obj", 0, 1), (1, "act", 2, 3), (2, "obj", 0, 0)], "s int, type string, start int, end int")
    p = spark.createDataFrame([(1, "obj", 0, 1), (1, "obj", 5, 6)], "s int, type string, start int, end int")
    got = {r.type: (r.tp, r.fp, r.fn) for r in evaluate.span_scores(g, p, ["s"]).collect()}
    assert got == {"obj": (1, 1, 1), "act": (0, 0, 1), "overall": (1, 1, 2)}


def test_tags(spark):
    sents = spark.createDataFrame([("d", "the big roof leaks now")], "doc string, sentence string")
    tok = tagging.token_offsets(sents)
    assert rows(tok.select("pos", "token", "start", "end"), "pos")[1] == (1, "big", 4, 7)
    idx = tagging.to_token_indices(spark.createDataFrame([("d", "T1", 4, 12), ("d", "T2", 5, 12)], "doc string, span_id string, start int, end int"), tok)
    assert rows(idx.select("span_id", "first", "last"), "span_id") == [("T1", 1, 2), ("T2", None, 2)]
    spans = spark.createDataFrame([("d", "obj", 0, 1, 3, 4), ("d", "act", 2, 2, None, None)], "doc string, type string, ss int, se int, es int, ee int")
    tagged = tagging.spans_to_tags(tok, spans)
    assert tagged.first().tags == ["BH-obj", "IH-obj", "BH-act", "BD-obj", "ID-obj"]
    assert rows(tagging.tags_to_spans(tagged).select("type", "start", "end"), "start") == [("obj", 0, 1), ("act", 2, 2), ("obj", 3, 4)]
    words = tagged.withColumn("words", F.split(F.lit("the big roof leaks now"), " "))
    assert [r.words for r in tagging.assemble_discontiguous(words, "obj").collect()] == [["the", "big", "leaks", "now"]]
    assert rows(stats.tag_counts(tagged), "tag") == [("BD-obj", 1), ("BH-act", 1), ("IH-obj", 1)]
    r = spark.range(1).select(tagging.fill_indices(F.lit(3), F.lit(-1), F.lit(-1), F.lit(-1)).alias("x")).first().x
    assert tuple(r) == (3, 3, 3, 3)


def test_assembly_of_two_halves(spark):
    t = spark.createDataFrame([("d", ["a", "b", "c", "e", "f"], ["BH-obj", "PD-pad", "BD-obj", "PD-pad", "BD-obj"])], "doc string, words array<string>, tags array<string>")
    assert sorted(r.words for r in tagging.assemble_discontiguous(t, "obj").collect()) == [["a", "c"], ["f"]]


@pytest.mark.parametrize(
    ("heads", "want"),
    [("BD . BD . BD", [[0, 2], [4]]), ("IH . BD", [[0, 2]]), ("BH . BD . IH . BD", [[0, 2], [4], [6]]), ("BH BH . BD . BD", [[0], [1, 3], [5]]), ("BH . BD . BH . BD ID", [[0, 2], [4, 6, 7]]), ("BD", [[0]]), (". .", [])],
)
def test_heads_that_halves_take(spark, heads, want):
    tags = ["PD-pad" if h == "." else f"{h}-obj" for h in heads.split()]
    t = spark.createDataFrame([("d", [str(i) for i in range(len(tags))], tags)], "doc string, words array<string>, tags array<string>")
    assert sorted(r.positions for r in tagging.assemble_discontiguous(t, "obj").collect()) == want


def _machine(words, tags, kind):
    """The surveyed system's way of reading spans, by its states: (words, [ss, se, es, ee]) in order."""
    spans, head, current, taken = [], None, None, None
    for i, (word, tag) in enumerate(zip(words, tags)):
        mark, type_ = tag[:2], tag[3:]
        if type_ != kind:
            if current and current["w"]:
                spans.append(current)
                if not taken:
                    head = current
            current = None
        elif mark == "BH":
            taken = None
            if current and current["w"]:
                spans.append(current)
                head = current
            current = {"w": [word], "i": [i, -1, -1, -1]}
        elif mark in ("IH", "ID"):
            current = current or {"w": [], "i": [-1] * 4}
            current["w"] = current["w"] + [word]
            current["i"][1 if mark == "IH" and current["i"][2] == -1 else 3] = i
        elif head and (taken or []) != head["w"] and any(s["w"] == head["w"] for s in spans):
            at = max(j for j, s in enumerate(spans) if s["w"] == head["w"])
            places = [s["i"] for s in spans]
            own = [j for j, s in enumerate(spans) if s is head or s["i"] is head["i"]][-1]
            del places[own]
            left = [s["w"] for j, s in enumerate(spans) if j != at]
            taken = head["w"]
            current = {"w": head["w"] + [word], "i": head["i"]}
            current["i"][2] = i
            spans = [{"w": w, "i": p} for w, p in zip(left, places)]
            head = None
        else:
            if current and current["w"]:
                spans.append(current)
                head = current
            current = {"w": [word], "i": [i, -1, -1, -1]}
    return [(s["w"], s["i"]) for s in spans]


@pytest.mark.parametrize(("heads", "want"), [("BH BD .", [(["0"], [0, -1, -1, -1]), (["1"], [1, -1, -1, -1])]), ("BH . BH BD .", [(["0", "3"], [0, -1, 3, -1])]), ("BH IH . BD ID .", [(["0", "1", "3", "4"], [0, 1, 3, 4])]), ("BH", []), (". .", [])])
def test_assembly_compat(spark, heads, want):
    tags = ["PD-pad" if h == "." else f"{h}-obj" for h in heads.split()]
    t = spark.createDataFrame([("d", [str(i) for i in range(len(tags))], tags)], "doc string, words array<string>, tags array<string>")
    got = [(r.words, [r.ss, r.se, r.es, r.ee]) for r in tagging.assemble_discontiguous(t, "obj", "compat").collect()]
    assert got == want == _machine(*t.first()[1:], "obj")
    with pytest.raises(ValueError):
        tagging.assemble_discontiguous(t, "obj", "other")


def test_assembly_compat_on_many(spark):
    import random
    from collections import defaultdict

    rng = random.Random(11)
    data = []
    for i in range(600):
        tags = [rng.choice(["PD-pad", "PD-pad", "BH-obj", "IH-obj", "BD-obj", "ID-obj", "BH-act"]) for _ in range(rng.randint(0, 12))]
        data.append((f"d{i}", [rng.choice("abc") for _ in tags], tags))
    t = spark.createDataFrame([*data, ("null", None, None)], "doc string, words array<string>, tags array<string>")
    got = defaultdict(list)
    for r in tagging.assemble_discontiguous(t, "obj", "compat").collect():
        got[r.doc].append((r.words, [r.ss, r.se, r.es, r.ee]))
    assert dict(got) == {d: m for d, w, g in data if (m := _machine(w, g, "obj"))}


def test_viterbi(spark):
    import itertools

    rng = np.random.default_rng(5)
    ok, n = tagging.allowed(), len(tagging.TAGS)
    scores = rng.normal(size=(4, n))
    best, want = -1e9, None
    for path in itertools.product(range(n), repeat=4):
        if ok[n, path[0]] and ok[path[-1], n] and all(ok[a, b] for a, b in itertools.pairwise(path)):
            v = sum(scores[i, t] for i, t in enumerate(path))
            if v > best:
                best, want = v, [tagging.TAGS[t] for t in path]
    df = spark.createDataFrame([("d", scores.tolist()), ("none", scores[:2].tolist()), ("one", scores[:1].tolist()), ("null", None), ("empty", [])], "doc string, scores array<array<double>>")
    out = tagging.decode(df)
    assert {r.doc: r.tags for r in out.collect()} == {"d": want, "none": ["PD-pad"] * 2, "one": ["PD-pad"], "null": [], "empty": []}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_best_path_against_all_paths(spark):
    """Weights and scores of few values: many ties, which go to the smaller state from the end on."""
    import itertools

    rng = np.random.default_rng(6)
    rows_, wants, n = [], {}, 3
    weights = rng.integers(-2, 2, size=(n + 1, n + 1)).astype(float)
    weights[0, 1] = weights[2, n] = tagging.NEVER
    for at in range(40):
        scores = rng.integers(-1, 2, size=(int(rng.integers(1, 6)), n)).astype(float)
        options = []
        for path in itertools.product(range(n), repeat=len(scores)):
            steps = [n, *path, n]
            v = sum(scores[i, t] for i, t in enumerate(path)) + sum(weights[a, b] for a, b in itertools.pairwise(steps))
            options.append((-v, path[::-1]))
        rows_.append((at, scores.tolist()))
        wants[at] = list(min(options)[1][::-1])
    df = spark.createDataFrame(rows_, "doc long, scores array<array<double>>")
    assert {r.doc: r.p for r in df.select("doc", tagging.best_path(F.col("scores"), weights).alias("p")).collect()} == wants


def test_learnt_tagger(spark):
    """A planted grammar: the tag of a word depends on the one before, new words follow their ends; held-out span F1."""
    import random

    from textloom.operators import evaluate

    rng = random.Random(4)
    nouns = [f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{i}ion" for i in range(60)]
    verbs = [f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{i}ing" for i in range(60)]
    small = ["the", "of", "a", "may", "light"]

    def sentence(new):
        words, tags = [], []
        for _ in range(rng.randint(1, 4)):
            words += rng.choices(small[:4], k=rng.randint(1, 2))
            tags += ["PD-pad"] * (len(words) - len(tags))
            if rng.random() < 0.6:
                two = rng.random() < 0.5
                words += (["light"] if two else []) + [rng.choice(nouns[new:])]
                tags += ["BH-obj", "IH-obj"] if two else ["BH-obj"]
            else:
                words += [rng.choice(verbs[new:]), "light"]
                tags += ["BH-act", "PD-pad"]
        return words + ["."], tags + ["PD-pad"]

    train = spark.createDataFrame([(f"t{i}", *sentence(20)) for i in range(300)] + [("none", [], []), ("null", None, None)], "doc string, words array<string>, tags array<string>")
    held = spark.createDataFrame([(f"h{i}", *sentence(0)) for i in range(100)], "doc string, words array<string>, tags array<string>")
    tagger = tagging.learn(train)
    assert tagger.tags == ["PD-pad", "BH-act", "BH-obj", "IH-obj"]
    found = tagger.tag(held.select("doc", "words"))
    score = {r.type: r.f1 for r in evaluate.span_scores(tagging.tags_to_spans(held), tagging.tags_to_spans(found), ["doc"]).collect()}
    assert score["overall"] > 0.97
    plain = tagging.rule_tags(held.select("doc", F.array_join("words", " ").alias("sentence")))
    rule = {r.type: r.f1 for r in evaluate.span_scores(tagging.tags_to_spans(held), tagging.tags_to_spans(plain), ["doc"]).collect()}
    assert rule["overall"] < 0.6
    assert tagging.learn(train.limit(0)).tag(held.limit(1).select("doc", "words")).first().tags[0] == "PD-pad"


def test_rule_tags(spark):
    s = spark.createDataFrame([("d", "the timber frame is ok")], "doc string, sentence string")
    assert tagging.rule_tags(s).first().tags == ["PD-pad", "BH-obj", "IH-obj", "PD-pad", "PD-pad"]


def test_span_stats_and_fill(spark):
    s = spark.createDataFrame([("Object", 0, None, None, 10), ("Object", 0, 4, 8, 12)], "span_type string, span_start int, gap_start int, gap_end int, span_end int")
    assert rows(stats.span_stats(s), "span_type") == [("Object", 2, 18, 9.0, 1)]
    f = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "b")], "i int, q string")
    assert [r.q for r in stats.forward_fill(f.withColumn("g", F.lit(1)), ["g"], "i", "q").orderBy("i").collect()] == ["a", "a", "a", "b"]


def test_terms_modes(spark):
    p = spark.createDataFrame([("the roof",), ("roof",), ("beam",), ("beam",)], "phrase string")
    assert rows(stats.frequent_terms(p), "term") == [("beam", 2), ("roof", 2)]
    assert rows(stats.frequent_terms(p, mode="compat"), "term") == [("roof", 2)]


def test_gate(spark):
    df = spark.createDataFrame([(2.0,), (0.1,)], "idf double")
    assert [r[0] for r in df.select(stats.gate_tokens(F.col("idf"), 0.5, 2.0, 0.5)).collect()] == [4.0, None]


def test_terms(spark):
    from textloom.operators import terms

    spans = spark.createDataFrame([("Fire door",), ("wide fire doors",), ("ab",), ("wall",)], "span string")
    known = spark.createDataFrame([("fire door",), ("b",), ("",)], "term string")
    assert rows(terms.defined_term_check(spans, known), "span") == [("Fire door", "exact"), ("ab", "part"), ("wall", "none"), ("wide fire doors", "part")]
    seen = spark.createDataFrame([("fire door",), ("fire door",)], "term string")
    assert rows(terms.definition_counts(seen, known), "term") == [("", 0), ("b", 0), ("fire door", 2)]
    assert rows(terms.outstanding(known, seen), "term") == [("",), ("b",)]
    lists = spark.createDataFrame([(1, ["b", "a", "", "b"]), (2, [])], "k int, l array<string>")
    out = terms.scatter(lists, "k", "l", lambda d: d.withColumn("value", F.upper("label")), "u")
    assert rows(out.select("k", "u"), "k") == [(1, ["B", "A", "B"]), (2, [])]
    p = spark.createDataFrame([("d1", ["a", "b", "c", "e"], ["PD-pad", "BH-obj", "IH-obj", "PD-pad"]), ("n1", ["a"], ["PD-pad"])], "doc_id string, words array<string>, tags array<string>")
    got = {r.origin: (r.n_sentences, r.n_tokens, r.BH, r.IH, r.PD) for r in terms.prediction_profile(p).collect()}
    assert got == {"domestic": (1, 2, 1, 1, 0), "non-domestic": (1, 0, 0, 0, 0)}
    s = spark.createDataFrame([(1, "x", 0, 1), (1, "C-x", 2, 3), (1, "C-x", 7, 8)], "k int, type string, start int, end int")
    assert rows(terms.merge_continued(s, "k").select("start", "end"), "start") == [(0, 3), (7, 8)]
    assert rows(terms.skip_sentences(p, "doc_id", "n").select("doc_id"), "doc_id") == [("d1",)]
    c = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 1)], "g string, label string, n long")
    assert rows(terms.top_labels(c, ["g"], 2).select("label"), "rank") == [("y",), ("x",)]


def test_knn_gives_k_rows_a_group(spark, monkeypatch):
    """A query gets k rows of each group of cells; it used to get k of each cell, so what was shuffled grew with the square."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(900, 8)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<float>")
    given = []
    met = vectors._met
    monkeypatch.setattr(vectors, "_met", lambda a, r, c, f: given.append(met(a, r, c, f)) or given[-1])
    for _ in range(2):
        got = rows(vectors.search(df, df.filter("id % 30 = 0"), 5, "id", "v", exclude_self=True), "query_id", "rank")
        d = {q: np.round(np.sqrt(((m - m[q]) ** 2).sum(1)), 6) for q in range(0, 900, 30)}
        assert [(r[0], r[1]) for r in got] == [(q, j) for q in d for j in [j for j in sorted(range(900), key=lambda j: (d[q][j], j)) if j != q][:5]]
        for name, value in (("LEAST", 100), ("MOST", 130), ("ROWS", 16), ("PAIRS", 40)):  # groups that share cells, small steps
            monkeypatch.setattr(vectors, name, value)
    assert given[1].count() <= 5 * 30 and given[3].count() <= 7 * 5 * 30


def test_only_rare_tokens_are_sent_to_the_idf(spark, monkeypatch):
    """Where the IDF is large its frequent tokens travel to the terms; a row per term and token used to be shuffled to it."""
    idf = spark.createDataFrame([("a", 9, 1.0), ("b", 9, 2.0), ("c", 3, 4.0), ("d", 1, 8.0)], "token string, df long, idf double")
    terms = spark.createDataFrame([("a b a", 1), ("a c", 2), ("d c x", 3), ("!", 4), ("x", 5)], "term string, n long")
    want = [("!", 4, 0.5), ("a b a", 1, 4 / 3), ("a c", 2, 2.5), ("d c x", 3, 12.5 / 3), ("x", 5, 0.5)]
    known = lambda df: [(t, n, pytest.approx(w)) for t, n, w in rows(df, "term")]
    assert known(stats.weighed(terms, idf)) == want
    monkeypatch.setattr(stats, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(stats, "hint_if_small", lambda df: lambda x: x)
    written, kept = {}, stats.materialise
    monkeypatch.setattr(stats, "materialise", lambda df, tag: written.setdefault(tag, kept(df, tag)))
    assert known(stats.weighed(terms, idf)) == want
    assert {r.term: sorted(r["__rare"]) for r in written["weights"].collect() if r["__rare"]} == {"a c": ["c"], "d c x": ["c", "d", "x"], "x": ["x"]}
