"""The registered queries against plain versions, over the smallest tables and a table of odd rows."""

import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from textloom.llm import bestfit, decontam, line_dedup, minhash, pii, quality_rules, queries, shared, substring_dedup, suffix_dedup, token_pack, tokens, toxicity  # noqa: E402

from . import brute  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kid long, th string, gone string, h1 int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", "y", 2) for i, t in rows], SCHEMA)


def odd_rows(seed=1):
    """Nulls, empty and long texts, ties, repeats, periodic texts, near copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, long = words(90), words(6000)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "a b c"), (5, "a " * 500), (6, "a " * 480), (7, "x" * 3000), (8, "x" * 2500)]
    for i in range(10, 40):
        out.append((i, " ".join(words(20) + shared + words(30))))
    base = words(300)
    for i in range(40, 70):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(300)] = rng.choice(vocabulary)
        out.append((i, "\n".join(" ".join(copy[j : j + 25]) for j in range(0, 300, 25))))
    out += [(i, " ".join(base)) for i in range(70, 80)]
    out += [(80, " ".join(long)), (81, " ".join(long[3000:] + words(40))), (82, "The line that many documents hold, word by word.\n" * 6), (83, "mail a@b.c_x@d.e-f.gh 1.2.3.4.5.6.7.8 999.1.1.1 +1 (234) 555-0199 4111 1111 1111 1111 IBAN DE89 3704 0044 0532 0130 00 token = \"abcDEF0123456789xyz\"")]
    return out


DOCS = odd_rows()
ITEMS = [(1, " ".join(DOCS[80 + 0 - 1 + 0][1].split()[100:140]) if DOCS[79][1] else "x"), (2, DOCS[20][1][:200]), (3, "a b c"), (4, None), (5, ""), (6, "never there at all"), (7, "A, B! c?"), (7, "A, B! c?")]


def compare(frame, want, cols):
    got = {r[0]: tuple(r[1:]) for r in frame.select("doc_id", *cols).collect()}
    assert got == {k: tuple(v) for k, v in want.items()}


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_op1(spark, sf_dir, real):
    want = {k: v[:5] for k, v in brute.pii(real).items()}
    compare(queries.op1_pii(spark, sf_dir), want, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"])


def test_op1_base_against_sql(spark, sf_dir):
    """Counts, places and digest of the base kinds by an engine with other expressions (its card's and phone's proofs aside)."""
    duckdb = pytest.importorskip("duckdb")
    found = duckdb.sql(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM read_parquet('{sf_dir}/documents.parquet')),
m AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS x, 'email' AS kind FROM d UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)')), 'ip' FROM d)
SELECT doc_id, count(*) FILTER (kind = 'email') AS e, count(*) FILTER (kind = 'ip' AND list_max(list_transform(string_split(x, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999))) <= 255) AS i FROM d LEFT JOIN m USING (doc_id) GROUP BY doc_id""").fetchall()
    got = {r.doc_id: (r.n_email, r.n_ip) for r in queries.op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip").collect()}
    assert got == {d: (e, i) for d, e, i in found} and sum(e + i for _, e, i in found) > 0


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(n, [rng.randint(0, 9) for _ in range(n)]) for n in (0, 1, 2, 3, 4, 5, 15, 16, 17, 99, 100, 101, 5000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "n int, x array<int>")
    got = {r.n: r.s for r in df.select("n", pii.running(F.col("x")).alias("s")).collect()}
    assert got == {n: [sum(x[: i + 1]) for i in range(n)] if x else [] for n, x in rows}


def test_many_spans_in_one_text(spark):
    """Time follows the spans of a text: four times as many take far less than sixteen times as long."""
    import time

    took = []
    for n in (10_000, 10_000, 40_000):
        text = " ".join(f"u{i}@h{i % 97}.org" for i in range(n))
        at = time.perf_counter()
        r = pii.find(table(spark, [(1, text)])).select(F.size("email").alias("n"), F.element_at("email", -1).alias("last")).first()
        took.append(time.perf_counter() - at)
        assert (r.n, r.last.end, r.last.start) == (n, len(text), len(text) - len(text.split()[-1]))
    assert took[2] < 8 * took[1]


def test_context_words_decide(spark):
    rows = [(1, "call me on (555) 123-4567 now"), (2, "part (555) 123-4567 now"), (3, "ssn 123-45-6789"), (4, "item 123-45-6789"), (5, 'token = "abcDEF0123456789xyz"'), (6, 'colour = "abcDEF0123456789xyz"'), (7, "+1 (555) 123-4567 tel"), (8, "tel 555-123-4567"), (9, "fax 1555-123-45678"), (10, None)]
    found = {r.doc_id: r for r in pii.find(table(spark, rows)).collect()}
    n = lambda i: tuple(len(found[i][k]) for k in ("phone", "secret", "local", "ident"))
    assert [n(i) for i in range(1, 11)] == [(0, 0, 1, 0), (0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert found[1]["local"][0]["score"] == pytest.approx(0.6) and found[8]["local"][0][1:3] == (4, 16)
    top = {r[0]: r[1] for r in pii.find(table(spark, rows)).select("doc_id", pii.likeliest(list(pii.KINDS))).collect()}
    assert top[10] == 0 and top[1] == pytest.approx(0.6) and top[2] == 0


def test_proofs_against_plain_versions(spark):
    """Account numbers with every rest, against a plain mod 97; every span lies where its text says."""
    rng = random.Random(8)

    def account(rest):
        body = "".join(rng.choice("0123456789") for _ in range(18))
        code = int("".join(str(int(c, 36)) for c in body + "DE00"))
        return f"DE{(98 - code % 97 + rest) % 97:02d}{body}"

    rows = [(i, f"iban {account(i)} end") for i in range(97)]
    right = {d for d, t in rows if int("".join(str(int(c, 36)) for c in t.split()[1][4:] + t.split()[1][:4])) % 97 == 1}
    found = pii.find(table(spark, rows)).select("doc_id", "iban").collect()
    assert {r.doc_id for r in found if r.iban} == right and 0 in right
    assert all((s.start, s.end) == (5, 27) for r in found for s in r.iban)


def test_op3(spark, sf_dir, real):
    compare(queries.op3_minhash(spark, sf_dir), brute.near(real), ["n_shingles", "component_id", "kept"])


def test_op4(spark, sf_dir, real):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    compare(queries.op4_decontaminate(spark, sf_dir), brute.contamination(real, items), ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def test_op7(spark, sf_dir, real):
    compare(queries.op7_substring_dedup(spark, sf_dir), brute.substrings(real), ["n_words", "n_removed", "kept_sha256"])


def test_op8(spark, sf_dir, real):
    compare(queries.op8_suffix_dedup(spark, sf_dir), brute.byte_runs(real), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_op9(spark, sf_dir, real):
    frame = queries.op9_quality_rules(spark, sf_dir)
    compare(frame, brute.quality(real), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert frame.filter("base_failed and kept").count() == 0


def test_op5(spark):
    docs = [(i, t) for i, t in DOCS]
    out = line_dedup.dedup_lines(table(spark, docs))
    compare(out.withColumn("sha", F.sha2("kept", 256)).withColumn("gone", F.array_join("removed", ",")), brute.lines(docs), ["n_lines", "n_removed", "sha", "gone"])


@pytest.mark.parametrize("edits", [0, 2, 3])
def test_line_edits(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randint(8, 14))) for _ in range(25)]
    lines = []
    for b in base:
        for _ in range(4):
            x = list(b)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(x))
                x[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "é"])
            lines.append("".join(x))
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 10 : i * 10 + 10])) for i in range(10)]
    out = line_dedup.dedup_lines(table(spark, docs), edits=edits, min_chars=6)
    compare(out.withColumn("gone", F.array_join("removed", ",")), {k: (v[3],) for k, v in brute.lines(docs, edits, 6).items()}, ["gone"])


def test_growing_edits_and_short_repeats(spark, sf_dir, real):
    first = {}
    for d, t in sorted(real):
        for i, x in enumerate((t or "").split("\n")):
            first.setdefault(x, (d, i))
    longs = [x for x in first if len(x) >= 30]
    points = {x: np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in longs}
    near = set()
    for n, x in enumerate(longs):
        for y in longs[:n]:
            most = min(5, min(len(x), len(y)) // 30)
            # Alike lines have nearly the same letters; the plain distance decides the rest.
            if abs(len(x) - len(y)) <= most and sum((Counter(x) - Counter(y)).values()) <= most and brute.edits(x, y) <= most:
                near.add(max(x, y, key=first.get))
    want = {}
    for d, t in real:
        lines = (t or "").split("\n")
        gone = [i for i, x in enumerate(lines) if x in near or first[x] != (d, i) and x.strip()]
        want[d] = (len(lines), len(gone), brute.sha("\n".join(x for i, x in enumerate(lines) if i not in gone)), ",".join(map(str, gone)))
    old = brute.lines(real)
    assert sum(w[1] for w in want.values()) > sum(w[1] for w in old.values())
    compare(queries.op5_line_dedup(spark, sf_dir), want, ["n_lines", "n_removed", "kept_sha256", "removed"])


def test_edits_grow_with_length(spark):
    rng = random.Random(7)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    lines = []
    for n in (30, 58, 59, 60, 61, 88, 89, 90, 91, 92, 93, 119, 120, 121, 148, 149, 150, 151, 153, 155, 180):
        x = line(n)
        lines.append(x)
        for k in range(1, 7):
            y = list(x)
            for at in sorted(rng.sample(range(n), k), reverse=True):
                y[at : at + rng.choice([0, 1])] = rng.choice(["", "X"])
            lines.append("".join(y))
    lines += ["short", "short", "  ", "  ", "", ""]
    rng.shuffle(lines)
    out = line_dedup.dedup_lines(table(spark, [(1, "\n".join(lines))]), edits=5, per=30, every=True).first().removed
    first = {}
    for i, x in enumerate(lines):
        first.setdefault(x, i)
    near = {x for x in first for y in first if len(x) >= 30 <= len(y) and first[y] < first[x] and brute.edits(x, y) <= min(5, min(len(x), len(y)) // 30)}
    assert out == [i for i, x in enumerate(lines) if x in near or first[x] != i and x.strip()]


@pytest.mark.parametrize("crowd", [2, 7])
def test_crowded_lines_are_dealt_in_blocks(spark, crowd):
    """Very many different lines share a segment; a few of them are near copies."""
    rng = random.Random(crowd)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    start = word(24)
    lines = [start + word(20) for _ in range(40)]
    for x in lines[:15]:
        at = rng.randrange(len(x))
        lines.append(x[:at] + "X" + x[at + rng.randint(0, 1) :])
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(11)]
    want = {k: (v[3],) for k, v in brute.lines(docs).items()}
    assert sum(len(v[0]) > 0 for v in want.values()) > 3
    compare(line_dedup.dedup_lines(table(spark, docs), crowd=crowd).withColumn("gone", F.array_join("removed", ",")), want, ["gone"])


def test_banded_distance():
    rng = random.Random(4)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(5, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        if len(b) > 4:
            pairs.append((a, "".join(b)))
    for k in (0, 1, 2, 3, 4):
        got = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], k)
        assert got.tolist() == [brute.edits(a, b) <= k for a, b in pairs]


def test_odd_rows(spark):
    t = table(spark, DOCS)
    compare(minhash.near_duplicates(t, k=4), brute.near(DOCS), ["n_shingles", "component_id", "kept"])
    compare(substring_dedup.remove_repeats(t).withColumn("sha", F.sha2("kept", 256)), brute.substrings(DOCS), ["n_words", "n_removed", "sha"])
    compare(suffix_dedup.remove_repeats(t).select("*", F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha")), brute.byte_runs(DOCS), ["n_bytes", "n_removed", "n", "sha"])
    compare(quality_rules.statistics(t), brute.quality(DOCS), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    found = pii.find(t).select("doc_id", *(F.size(k).cast("long").alias(k) for k in ("email", "ip", "card", "phone")), F.size("iban").alias("iban"), F.size("secret").alias("secret"))
    compare(found, {k: v[:4] for k, v in brute.pii(DOCS).items()}, ["email", "ip", "card", "phone"])
    assert found.filter("doc_id = 83").first()[5:] == (1, 1)


def test_hot_groups_take_the_other_way(spark):
    t = table(spark, DOCS)
    compare(substring_dedup.remove_repeats(t, group=3).withColumn("sha", F.sha2("kept", 256)), brute.substrings(DOCS), ["n_words", "n_removed", "sha"])
    compare(suffix_dedup.remove_repeats(t, group=3).select("*", F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha")), brute.byte_runs(DOCS), ["n_bytes", "n_removed", "n", "sha"])
    compare(minhash.near_duplicates(t, k=4, crowd=2), brute.near(DOCS), ["n_shingles", "component_id", "kept"])


@pytest.mark.parametrize("most", [decontam.MAX_WORDS, 0])
def test_contamination_both_ways(spark, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    compare(decontam.overlaps(table(spark, DOCS), items, most), brute.contamination(DOCS, ITEMS), ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def test_repeated_ids_are_one_document(spark):
    rng = random.Random(9)
    a, b = ([f"{c}{rng.randrange(10**6)}" for _ in range(200)] for c in "ab")
    near = lambda x: " ".join([*x[:100], "changed", *x[101:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (0, "alone " + " ".join(b[:30])), (None, " ".join(a))]
    want = None
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = sorted(map(str, minhash.near_duplicates(table(spark, order), k=4).collect()))
        assert want in (None, got)
        want = got
    assert sum("component_id=1" in x for x in want) == 4


@pytest.mark.parametrize("crowd", [2, 8])
def test_crowded_buckets_lose_no_link(spark, crowd, monkeypatch):
    """Every document shares one band; pairs and a chain beside a large component have no other way to meet."""
    rng = random.Random(crowd)
    word = lambda: f"w{rng.randrange(10**7)}"
    base = [word() for _ in range(120)]
    texts = [" ".join([*base[:i], word(), *base[i + 1 :]]) for i in range(20)]
    for _ in range(12):
        x = [word() for _ in range(120)]
        texts += [" ".join(x), " ".join([*x[:60], word(), *x[61:]])]
    docs = list(enumerate(rng.sample(texts, len(texts))))
    plain = minhash._signatures

    def one_band(k):
        run = plain(k)

        def go(batches):
            import pyarrow as pa

            for out in run(batches):
                own = [[] if x is None or not len(x) else [7, *x[1:]] for x in out.column("bands").to_pylist()]
                shared = [[x[0], *(hash((j, i, out.column("doc_id")[r].as_py())) for i, j in enumerate(x[1:]))] if x else [] for r, x in enumerate(own)]
                yield out.set_column(4, "bands", pa.array(shared, pa.list_(pa.int64())))

        return go

    monkeypatch.setattr(minhash, "_signatures", one_band)
    compare(minhash.near_duplicates(table(spark, docs), k=4, crowd=crowd), brute.near(docs), ["n_shingles", "component_id", "kept"])


def test_contamination_is_the_same_at_any_size(spark):
    long = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, long), (2, "three words here"), (3, " ".join(f"w{i}" for i in range(5, 25))), (None, "x")], "item_id long, text string")
    rows = [(None, f"before {long} after"), (None, None), (5, "clean text of its own"), (5, f"a three words here b {long}"), (6, "Three, WORDS... here!"), (7, ""), (7, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17")]
    t = table(spark, rows + rows[:2])
    cols = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]
    told = [sorted(map(str, decontam.overlaps(t, items, most).select("doc_id", *cols).collect())) for most in (decontam.MAX_WORDS, 0)]
    assert told[0] == told[1] and sum("contaminated=True" in x for x in told[0]) == 5
    left = [sorted(str(tuple(r)) for r in decontam.decontaminate(t, items, most).select("doc_id", "text").collect()) for most in (decontam.MAX_WORDS, 0)]
    assert left[0] == left[1] and len(left[0]) == 4


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a " * 30), (None, None), (5, "b " * 300), (5, "b " * 300), (5, "c d " * 200), (2, "b " * 300)]
    t = table(spark, rows)
    labels = spark.createDataFrame([(5, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, "b b b"), (1, "c d")], "item_id long, text string")
    path = tokens.public(queries.TOKENIZER)
    model = toxicity.fit([("bad words here", 1), ("good words here", 0)] * 5)
    for docs, n in ((t, len(rows)), (t.limit(0), 0)):
        assert pii.find(docs).count() == n
        assert minhash.near_duplicates(docs).count() == n
        assert decontam.overlaps(docs, items).count() == n and decontam.overlaps(docs, items, 0).count() == n and decontam.overlaps(docs, items.limit(0)).count() == n
        assert line_dedup.dedup_lines(docs).count() == n
        assert toxicity.scores(docs, model).count() == n
        assert substring_dedup.remove_repeats(docs).count() == n
        assert suffix_dedup.remove_repeats(docs).count() == n
        assert quality_rules.assess(docs, labels).count() == n and quality_rules.assess(docs, labels.limit(0)).count() == n
        assert bestfit.pack(docs, path).count() == n
        assert (token_pack.sequences(docs, path).count() > 0) == (n > 0)
        assert toxicity.train(docs, labels.limit(0)).weights == {}
        assert line_dedup.replace_lines(docs).columns == docs.columns
        assert toxicity.drop_toxic(docs, model).columns == docs.columns and minhash.drop_near_duplicates(docs).columns == docs.columns
        for most in (decontam.MAX_WORDS, 0):
            assert decontam.decontaminate(docs, items, most).columns == docs.columns
    left = [decontam.decontaminate(t, items, most).count() for most in (decontam.MAX_WORDS, 0)]
    assert left == [5, 5]  # the text of "c d" alone holds a benchmark window
    kept = {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(t).collect()}
    assert kept == {(None, 0), (5, 300), (5, 0), (2, 0)}


def test_tokens_and_packing(spark, sf_dir, real):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.public(queries.TOKENIZER))
    encode = lambda t: whole.encode(t, add_special_tokens=False).ids
    odd = [(900 + i, t) for i, t in enumerate(["J̌ Å Å ΣΑΣ. don't. they're, x.. ...a.", "<|endoftext|> <|STARTOFTEXT|> a<|endoftext|>. B", "É,  \t tab\x0b nb 12,3. İ. Straße. a.\n\nb,", "\r\nA.\r\n B", None])]
    docs = real + odd
    got = bestfit.pack(table(spark, docs), tokens.public(queries.TOKENIZER)).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == brute.pieces(docs, encode)
    x = got.sort_values(["sequence_id", "offset"])
    g = x.groupby("sequence_id").length
    assert (x.offset == g.cumsum() - x.length).all() and g.sum().max() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1
    # the packed matrices hold every document's ids again, in order
    seqs = token_pack.sequences(table(spark, docs), tokens.public(queries.TOKENIZER)).collect()
    parts = {}
    for s in seqs:
        ids, pos = np.frombuffer(s.input_ids, "<u4"), np.frombuffer(s.position_ids, "<u4")
        assert len(ids) == len(pos) == 4096 and s.cu_seqlens[-1] == s.n_tokens <= 4096 and not ids[s.n_tokens :].any()
        for d, start, a, b in zip(s.doc_ids, s.starts, s.cu_seqlens, s.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            parts[d, start] = ids[a:b].tolist()
    for d, t in docs:
        joined = [i for (e, _), p in sorted(parts.items()) if e == d for i in p]
        assert joined == [*encode(t or ""), 1]


def test_written_matrices(spark, tmp_path):
    import pyarrow.parquet as pq

    path, out = tokens.public(queries.TOKENIZER), str(tmp_path / "packed")
    docs = [(i, f"text number {i} " * (i * 40)) for i in range(30)] + [(None, None)]
    packed = token_pack.sequences(table(spark, docs), path, capacity=256, pool_tokens=3000)
    token_pack.write(packed, out)
    rows = pq.read_table(out)
    ids, positions = token_pack.matrix(rows), token_pack.matrix(rows, "position_ids")
    assert ids.shape == positions.shape == (packed.count(), 256)
    used = np.array(rows.column("n_tokens").to_pylist())
    assert used.sum() == sum(len(x) for x in (ids[i, : used[i]] for i in range(len(ids))))
    for row, ends in zip(positions, rows.column("cu_seqlens").to_pylist(), strict=True):
        assert all(row[a] == 0 and (np.diff(row[a:b].astype(int)) == 1).all() for a, b in zip(ends, ends[1:]))
    assert sum(len(x) for x in rows.column("doc_ids").to_pylist()) >= len(docs)


def test_packers():
    rng = random.Random(2)
    for n in (0, 1, 50, 400):
        lengths = [rng.choice([1, 7, 30, 55, 64, rng.randint(1, 64)]) for _ in range(n)]
        for pack in (lambda x: bestfit.minimum_bin_slack(x, 64), lambda x: token_pack.best_fit_decreasing(x, 64)):
            bins = pack(lengths)
            assert sorted(i for b in bins for i in b) == list(range(n))
            assert all(0 < sum(lengths[i] for i in b) <= 64 for b in bins)
            assert len(bins) <= 1.25 * -(-sum(lengths) // 64) + 1  # pieces of over half a bin keep few lengths from filling
    # best fit: each piece goes where the least room is left
    assert token_pack.best_fit_decreasing([50, 40, 24, 14], 64) == [[0, 3], [1, 2]]
    assert sum(a * b for a, b in bestfit.fullest({30: 2, 20: 3, 7: 1}, 64)) == 60


def test_toxicity_holds_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = queries.op6_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    x = out.merge(labels.toPandas(), on="doc_id")
    x = x[x.held_out]
    hit = x.predicted == x.toxic
    assert hit.mean() > 0.93 and x[x.toxic == 1].predicted.mean() > 0.75


def test_maximal_repeats():
    texts = [b"abcdeXabcdeY", b"Zabcde"]
    at = [(t, i) for t, x in enumerate(texts) for i in range(len(x))]  # the dense form: every suffix
    got = {}
    for members, e, depth in suffix_dedup.maximal_repeats([texts[t][i:] for t, i in at], [texts[t][:i][::-1] for t, i in at], 3):
        t, i = at[members[0]]
        got.setdefault(texts[t][i - e : i + depth], set()).add(tuple(sorted((at[m][0], at[m][1] - e) for m in members)))
    assert got == {b"abcde": {((0, 0), (0, 6), (1, 1))}}


def test_maximal_repeats_differ_on_both_sides():
    rng = random.Random(11)
    for _ in range(30):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 40)))
        want = set()
        for n in range(2, len(text)):
            where = {}
            for i in range(len(text) - n + 1):
                where.setdefault(text[i : i + n], []).append(i)
            for x, at in where.items():
                before, after = {text[i - 1 : i] if i else i for i in at}, {text[i + n : i + n + 1] or -1 for i in at}
                if len(at) > 1 and len(before) > 1 and len(after) > 1:
                    want.add((x, tuple(at)))
        got = set()
        for members, e, depth in suffix_dedup.maximal_repeats([text[i:] for i in range(len(text))], [text[:i][::-1] for i in range(len(text))], 2):
            got.add((text[members[0] - e : members[0] + depth], tuple(sorted(m - e for m in members))))
        assert got == want


def test_nodes_of_a_subtree():
    words = "x a b c d y a b c d e z a b c d e q a b c".split()
    ids = np.unique(words, return_inverse=True)[1]
    row = np.array([0] * 5 + [1] * 6 + [2] * 11)[: len(words)]
    tree = substring_dedup.DeepTree(ids, row, 3)
    nodes = {(" ".join(words[tree.at[f] : tree.at[f] + d]), n - f + 1, bool(m)) for d, f, n, m in zip(tree.depth, tree.first, tree.last, tree.maximal, strict=True)}
    assert nodes == {("a b c", 4, True), ("a b c d", 3, True), ("b c d", 3, False), ("a b c d e", 2, True), ("b c d e", 2, False), ("c d e", 2, False)}


@pytest.mark.parametrize(("group", "travel"), [(30, None), (5, None), (5, 0), (5, 30)])
def test_crowded_contexts(spark, group, travel, monkeypatch):
    """One long passage in more documents than a group holds, with differing words in it, and periodic texts.

    travel: crowded groups that go to the tasks as lists; those beyond come by a join.
    """
    crowds, mark = [], shared._marked
    monkeypatch.setattr(shared, "_marked", lambda *x: crowds.append(mark(*x)) or crowds[-1])
    if travel is not None:
        monkeypatch.setattr(shared, "CROWDED", travel)
    rng = random.Random(group)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    base = [word() for _ in range(160)]
    docs = [(1, "ab" * 700), (2, "abc" * 500), (3, "abc" * 300)]
    for i in range(10, 60):
        x = list(base)
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = word()
        docs.append((i, " ".join([word(), *x, word()])))
    docs += [(i, " ".join([word() for _ in range(20)] + base[40:130])) for i in range(60, 100)]
    t = table(spark, docs + [(None, docs[5][1]), (None, docs[5][1])])
    named = lambda df: df.filter("doc_id is not null")
    compare(named(substring_dedup.remove_repeats(t, group=group).withColumn("sha", F.sha2("kept", 256))), brute.substrings(docs), ["n_words", "n_removed", "sha"])
    compare(named(suffix_dedup.remove_repeats(t, group=group).select("*", F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha"))), brute.byte_runs(docs), ["n_bytes", "n_removed", "n", "sha"])
    assert max((c.marked for c in crowds), default=0) == 0 if travel is None else max(c.marked for c in crowds) > (1 if travel == 0 else 0)
    assert any(c.lists for c in crowds) == bool(travel)
    assert substring_dedup.remove_repeats(t, group=group).filter("doc_id is null").agg(F.sum("n_removed")).first()[0] == 0


def test_long_texts_come_in_pieces():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    raw = rng.integers(97, 123, 5_000_000).astype(np.uint8)
    seen = []
    for first, at, offs, buf in suffix_dedup.pieces(pa.array([raw.tobytes().decode(), "short"]), 400):
        assert len(buf) <= 2 * suffix_dedup.PIECE and (at > 0 or first in (0, 1))
        if first == 0:
            seen.append((at, at + len(buf)))
            assert (buf == raw[at : at + len(buf)]).all()
    assert seen[0][0] == 0 and seen[-1][1] == len(raw) and all(b - 399 == a for (_, b), (a, _) in zip(seen, seen[1:]))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    x, y = minhash.sketch(a), minhash.sketch(b)
    assert abs((x == y).mean() - 800 / 1200) < 0.2
    assert (minhash.sketch(a[:1]) == minhash.sketch(a[:1])).all() and len(np.unique(minhash.sketch(a[:1]))) == 128


def test_rules_find_a_planted_threshold(spark):
    rng = random.Random(3)
    rows = [tuple([int(s < 0.4)] + [rng.random() if f != "symbol_share" else s for f in quality_rules.FEATURES]) for s in (rng.random() for _ in range(600))]
    schema = "good int, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES)
    rules = quality_rules.learn(spark.createDataFrame(rows, schema))
    assert rules and rules[0].conditions[0].feature == "symbol_share" and rules[0].conditions[0].above and abs(rules[0].conditions[0].value - 0.4) < 0.06
    kept = spark.createDataFrame(rows, schema).withColumn("kept", quality_rules.verdict(rules))
    assert kept.filter("kept and good = 0").count() < 30 and kept.filter("not kept and good = 1").count() < 10


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if name == "line_dedup":
            want = brute.lines(list(before.items()))
            assert {d: brute.sha(t) for d, t in after.items()} == {d: w[2] for d, w in want.items()}
        if name == "near_dedup":
            assert set(after) == {d for d, w in brute.near(list(before.items()), 5).items() if w[2]}
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(after) == {d for d, w in brute.contamination(list(before.items()), items).items() if not w[4]}
        docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in after.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() <= len(before)


def test_stages_take_odd_documents(spark, sf_dir):
    import corpus_pipeline

    odd = table(spark, [*DOCS, (None, "text of no document"), (None, None), (3, "one"), (3, "two")])
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= n
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
