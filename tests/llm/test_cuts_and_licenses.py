"""Fill-in-middle and license scans against plain versions, with odd rows and odd tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import fim, license_scan, queries

from .brute import lower, sha

SCHEMA = "doc_id long, text string, kid long, n int, label string, template int, start long, words string, hit string, ordinal int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 4, "y", "z", 5) for i, t in rows], SCHEMA)


def cut(doc, text, seed=7, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed=5):
    rng = random.Random(seed)
    bits = ["\n", "\n\n", "a", "é", "𝔘x", "<", "<P", ">", "S>", " ", "word word", "<P>", "<M>", "\r\n", " "]
    out = [(0, None), (1, ""), (2, "\n"), (3, "one line"), (None, "null\nid\n"), (None, "null\nid\n"), (None, None), (4, "x\n" * 50_000), (5, "y" * 300_000), (6, "same\nrow\n"), (6, "same\nrow\n"), (6, "other\nrow\nof\nthe id"), (-3, "below\nzero\n\n")]
    return out + [(10 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))) for i in range(400)]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (0, 50)])
def test_fill_in_middle(spark, rate, spm):
    rows = texts()
    out = fim.transform(table(spark, rows), rate=rate, spm_rate=spm)
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert got == Counter((d, *cut(d, t, rate=rate, spm=spm)) for d, t in rows)
    back = out.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert Counter(map(tuple, back)) == Counter((d, t or "") for d, t in rows)


def test_one_hot_text_and_empty_table(spark):
    rows = [(None, "a\nb\nc\n")] * 500 + [(7, "")]
    assert Counter(r.output for r in fim.transform(table(spark, rows)).collect()) == Counter(cut(d, t)[4] for d, t in rows)
    assert fim.transform(table(spark, [])).count() == 0 and license_scan.scan(table(spark, [])).count() == 0


def test_texts_move_once(spark, sf_dir):
    """All uses of the dealt texts are one shuffle, and nothing is shuffled besides."""
    out = queries.op12_fim(spark, sf_dir)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert [("Reused" in line) for line in plan.split("\n") if "Exchange hashpartitioning" in line].count(False) == 1


def scanned(text, templates, threshold):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places = {}
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places[label] = [i for i in range(len(w)) if w[i : i + len(p)] == p]
    labels, best, blocks = {k for k, v in places.items() if v}, 0.5 if any(places.values()) else 0.0, set()
    base = sorted(labels)
    for number, (label, t) in enumerate(templates):
        tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        if not tokens:
            continue
        s = 1
        while s < len(tokens):
            s *= 2
        for b in range(0, len(w), s):
            n = len(set(w[b : b + 2 * s]) & set(tokens))
            if n >= threshold * len(set(tokens)) - 1e-9:
                labels.add(label)
                best = max(best, n / len(set(tokens)))
                blocks.add((number, b, n))
    every = sorted(i for v in places.values() for i in v)
    return len(w), len(every), every[0] if every else None, every[-1] if every else None, tuple(base), tuple(sorted(labels)), best, frozenset(blocks)


def compare(spark, rows, templates, threshold):
    out = license_scan.scan(table(spark, rows), templates, threshold).collect()
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels), tuple(r.labels), r.score, frozenset((m.template, m.start, m.overlap) for m in r.matches)) for r in out)
    assert got == Counter((d, *scanned(t, templates, threshold)) for d, t in rows)
    return got


def test_licenses_against_all_blocks(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["cc", "by", "all", "rights", "reserved", "general", "public", "license"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    templates = [(f"t{i}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 17, 40])))) for i in range(12)]
    rows = [(0, None), (1, ""), (2, "CC BY-cc by. CC\nBY cc by"), (3, "General Public License general public license"), (None, "all rights reserved"), (None, "all rights reserved"), (4, "cc by"), (5, "x cc by"), (6, "cc byx"), (7, "É cc by é")]
    for i in range(10, 90):
        w = rng.choices(vocabulary, weights, k=rng.randint(0, 120))
        if rng.random() < 0.5:
            t = rng.choice(templates)[1].split()
            at = rng.randint(0, len(w))
            w[at:at] = [x for x in t if rng.random() < 0.93]
        rows.append((i, " ".join(w)))
    rows.append((200, " ".join(rng.choices(vocabulary, weights, k=2_000))))
    for threshold in (0.6, 0.85, 1.0):
        assert any(g[-1] for g in compare(spark, rows, templates, threshold))
    compare(spark, rows, [], 0.8)
    compare(spark, rows, [("none", "...")], 0.8)


def test_notices_are_found(spark):
    notice = dict((k, t) for k, t in reversed(license_scan.TEMPLATES))
    rows = [(1, "first words " + notice["mit"] + " last"), (2, "Licensed under the Apache\n * License, Version 2.0"), (3, "a house under the sun, all rights reserved"), (4, "released under great pressure, the license was lost")]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(table(spark, rows)).collect()}
    assert got == {1: (["mit"], 1.0), 2: (["apache-2.0"], 1.0), 3: (["reserved"], 0.5), 4: ([], 0.0)}


def test_no_python_in_license_scan(spark, sf_dir):
    plan = queries.op13_licenses(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_digests(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in queries.op12_fim(spark, sf_dir).collect()}
    assert got == {d: (*(c := cut(d, t))[:4], sha(c[4]), sha(t or "")) for d, t in docs}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in queries.op13_licenses(spark, sf_dir).collect()}
    want = {d: scanned(t, license_scan.TEMPLATES, license_scan.THRESHOLD) for d, t in docs}
    assert got == {d: (*x[:4], ",".join(x[4]), ",".join(x[5]), x[6]) for d, x in want.items()}
