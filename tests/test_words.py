"""Stems, sentence ends and nested lists against plain versions."""

import json
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import boundaries, stem
from textloom.functions import text as T
from textloom.sources import readers


def _kinds(word):
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[i - 1] == "c") else "c"
    return out


def _measure(word):
    return len(re.findall("v+c+", _kinds(word)))


def _short(word):
    return _kinds(word)[-3:] == "cvc" and _measure(word) == 1 and _kinds(word)[:-3].strip("c") == "" and word[-1] not in "wxy"


def plain_stem(w):
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    vowel = lambda x: "v" in _kinds(x)
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz" and re.match("[a-z]", w[-1]):
            w = w[:-1]
        elif _short(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (stem.STEP_2, stem.STEP_3):
        for end in sorted(rules, key=len, reverse=True):
            if w.endswith(end):
                w = w[: -len(end)] + rules[end] if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(stem.STEP_4, key=len, reverse=True):
        if w.endswith(end):
            rest = w[: -len(end)]
            w = rest if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")) else w
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def test_stems(spark, sf_dir):
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "hopefulness": "hope", "adoption": "adopt", "controll": "control", "probate": "probat", "sky": "sky", "toys": "toi", "yes": "ye", "by": "by", "a": "a", "": ""}
    assert {w: plain_stem(w) for w in known} == known
    words = {r.w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct().collect()}
    words |= {r.w for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct().collect()}
    words |= known.keys() | {a + b for a in ("form", "happ", "y", "yell", "tri", "agre", "bb", "oscill", "x", "syzyg") for b in [*stem.STEP_2, *stem.STEP_3, *stem.STEP_4, "ed", "ing", "s", "y", "eed", "lling"]}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in df.select("w", stem.stem(F.col("w")).alias("s")).collect()} == {w: plain_stem(w) for w in words}
    assert spark.sql("SELECT CAST(NULL AS STRING) AS w").select(stem.stem(F.col("w"))).first()[0] is None


def test_abbreviations_do_not_end_sentences(spark):
    rows = [("The beam of approx. 3 m was set. Then dr. Smith came, e.g. the day after. All was well. It rained in May. May be.",)] * 12 + [("The day was long. The beam held well after all may come in. Nobody set it in may or may not. They set it after a long day as well",)] * 24 + [(None,), ("",)]
    docs = spark.createDataFrame(rows, "text string")
    known = boundaries.abbreviations(docs)
    assert {"approx", "dr", "e.g"} <= set(known) and not {"set", "well", "may", "after"} & set(known)
    cut = [r.s for r in docs.limit(1).select(boundaries.sentences(F.col("text"), known).alias("s")).collect()][0]
    assert cut == ["The beam of approx. 3 m was set.", "Then dr. Smith came, e.g. the day after.", "All was well.", "It rained in May.", "May be."]
    one = spark.createDataFrame([("Dr. A came. The xdr. B left! Ok? Yes",)], "text string")
    assert one.select(boundaries.sentences(F.col("text"), ["dr"])).first()[0] == ["Dr. A came.", "The xdr.", "B left!", "Ok?", "Yes"]
    assert one.select(boundaries.sentences(F.col("text"), [])).first()[0] == one.select(T.sentences(F.col("text"))).first()[0]
    assert boundaries.abbreviations(docs.limit(0)) == []


@pytest.mark.parametrize("mode", ["intended", "compat"])
def test_nested_lists(spark, mode):
    told = [(1, ["#Table1", "a", ["b", ["c", ["d"]], "e"], "#Li2_3#f", "#EndTable"]), (2, [["x", ["y"], ["z"]], [], 5, None, ["['p', ['q'], 'r']", "['broken"]]), (3, []), (4, "no list"), (5, {"a": ["b"]})]
    want = {"intended": {1: ["a", "b", "c", "d", "e", "f"], 2: ["x", "y", "z", "p", "q", "r", "['broken"]}, "compat": {1: ["a", "d", "e", "f"], 2: ["z", "q", "r", "['broken"]}}[mode]
    spark.createDataFrame([(i, json.dumps(x)) for i, x in told] + [(6, None)], "id int, j string").createOrReplaceTempView("told_lists")
    name = readers.list_items(spark, mode)
    got = {}
    for r in spark.sql(f"SELECT id, t.pos, t.text FROM told_lists, LATERAL {name}(parse_json(j)) t ORDER BY id, pos").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == want
    with pytest.raises(ValueError):
        readers.list_items(spark, "other")
