"""The registered queries of this subpackage: thin digests over the operators, whole tables in, whole results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, conversation, decontam, fim, license_scan, line_dedup, minhash, pii, quality_rules, substring_dedup, suffix_dedup, token_pack, tokens, toxicity
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base kinds, their digest, all spans and the largest score (none: 0)."""
    found = pii.find(table(spark, sf_dir, "documents"))
    base = ("email", "ip", "card", "phone")
    joined = lambda kinds: F.array_join(F.flatten(F.array(*(pii.told(F.col(k)) for k in kinds))), ",")
    size = lambda k: F.size(k).cast("long")
    total = sum((size(k) for k in list(pii.KINDS)[1:]), size(next(iter(pii.KINDS))))
    return found.select(
        "doc_id", *(size(k).alias(f"n_{k}") for k in base), F.sha2(joined(base), 256).alias("base_sha256"), joined(pii.KINDS).alias("spans"), *(size(k).alias(f"n_{k}") for k in pii.KINDS if k not in base), total.alias("n_spans"), pii.likeliest(list(pii.KINDS)).alias("score")
    )


def op2_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed sequences of 4096 ids; a null or empty text is its end mark alone."""
    return token_pack.sequences(table(spark, sf_dir, "documents"), tokens.public(TOKENIZER))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a similarity of 0.8 or more over 4-word shingles; texts without words stand alone."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in windows of benchmark items; null and empty texts have none and are clean."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines near an earlier one (an edit for each 30 characters, at most 5) and exact repeats."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), edits=5, per=30, every=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.array_join("removed", ",").alias("removed"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from labelled ones outside the held-out part; empty texts have one, too."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without words of 13-word windows that a smaller doc_id has; null texts have no words."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without bytes of 400-byte strings that start anywhere else; null texts have no bytes."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rule and learnt verdict of every document; null texts have no words and fail."""
    out = quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids; a null or empty text is a piece of one id."""
    return bestfit.pack(table(spark, sf_dir, "documents"), tokens.public(TOKENIZER))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged conversations' faults and cheapest repair; null roles and texts are one space."""
    return conversation.repair(conversation.damaged(table(spark, sf_dir, "conversations")), live="live")[0]


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-middle form and digests of it and of the text rebuilt from it; null texts are empty and plain."""
    out = fim.transform(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document; null texts have no words."""
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    told = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["start"], m["overlap"]))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.array_join(F.sort_array(told), ",").alias("blocks"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_token_pack, op3_minhash, op4_decontaminate, op5_line_dedup, op6_toxicity, op7_substring_dedup, op8_suffix_dedup, op9_quality_rules, op10_bestfit, op11_conversations, op12_fim, op13_licenses)}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB SQL for whole results, where SQL can express them: a trained model, a tokenizer, edit distances over code
#: points and look-behind expressions are beyond it; those queries are tested against brute force.
ORACLES: dict[str, str] = {
    "op12_fim": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
n AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, list_transform(range(0, 4), lambda i: ('0x' || substr(h, 1 + 8 * i, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM n),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256 FROM f""",
    "op3_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER.format("text"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS x FROM d),
u AS (SELECT doc_id, unnest(x) AS h FROM s), n AS (SELECT doc_id, len(x)::BIGINT AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS held FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * held >= 80 * (x.n + y.n - held)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN (SELECT node, min(reach) AS c FROM r GROUP BY node) ON node = doc_id""",
    "op4_decontaminate": f"""WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER.format("text"))} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_ALNUM.format(_LOWER.format("text"))} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS x FROM b WHERE len(w) > 0),
z AS (SELECT DISTINCT n FROM bw), dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'x': array_to_string(w[i:i + n - 1], ' ')}})) AS y FROM d, z WHERE len(w) >= n),
h AS (SELECT doc_id, item, dw.n, y.i AS i FROM dw JOIN bw ON dw.n = bw.n AND y.x = bw.x), c AS (SELECT doc_id, count(DISTINCT i + k) AS hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op7_substring_dedup": f"""WITH d AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) AS i FROM (SELECT doc_id, list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' '))) AS h FROM d WHERE len(w) >= 13)),
m AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h), f AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM g JOIN m USING (h) WHERE lo < doc_id)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d), k AS (SELECT doc_id, count(f.p) AS gone, string_agg(word, ' ' ORDER BY x.p) FILTER (f.p IS NULL) AS kept FROM x LEFT JOIN f USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op8_suffix_dedup": """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) - 1 AS i FROM (SELECT doc_id, list_transform(range(0, length(x) // 2 - 399), lambda i: md5(substr(x, 2 * i + 1, 800))) AS h FROM b WHERE length(x) >= 800)),
o AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1), f AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM g WHERE h IN (SELECT h FROM o)),
r AS (SELECT doc_id, i, sum(CASE WHEN j IS NULL OR i > j + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f), s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM r GROUP BY doc_id, run),
t AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT doc_id, count(*) AS n, sum(z - a) AS gone, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS tail FROM t JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN x ELSE concat(kept, substr(x, 2 * tail + 1)) END)) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)""",
}


def _licenses() -> str:
    """All blocks of all texts against all templates, and the phrases' places word by word."""
    words = _ALNUM.format(_LOWER.format("text"))
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(license_scan.TEMPLATES))
    phrases = ", ".join(f"({quoted(p)}, {quoted(label)})" for p, label in license_scan.PHRASES.items())
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents), t0 AS (SELECT template, label, {words} AS w FROM (VALUES {templates}) v(template, label, text)),
s AS (SELECT 1 AS s UNION ALL SELECT 2 * s FROM s WHERE s < 1024), t AS (SELECT template, label, list_distinct(w) AS tokens, (SELECT min(s) FROM s WHERE s >= len(w)) AS s FROM t0),
b AS (SELECT doc_id, s, i * s AS start, list_distinct(w[i * s + 1:i * s + 2 * s]) AS held FROM (SELECT doc_id, w, s, unnest(range(0, (len(w) - 1) // s + 1)) AS i FROM d, (SELECT DISTINCT s FROM t) WHERE len(w) > 0)),
m AS (SELECT doc_id, template, label, start, len(list_intersect(held, tokens)) AS n, len(tokens) AS size FROM b JOIN t USING (s)),
h AS (SELECT doc_id, max(n / size) AS share, list(DISTINCT label) AS labels, string_agg(concat(template, ':', start, ':', n), ',' ORDER BY concat(template, ':', start, ':', n)) AS blocks FROM m WHERE n >= greatest(1, ceil({license_scan.THRESHOLD} * size - 1e-9)) GROUP BY doc_id),
p AS (SELECT string_split(phrase, ' ') AS x, label FROM (VALUES {phrases}) v(phrase, label)),
a AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(x)] = x)) AS pos FROM d, p),
f AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS labels FROM a GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(f.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(array_to_string(list_sort(f.labels), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(f.labels, []), coalesce(h.labels, [])))), ','), '') AS labels,
greatest(coalesce(share, 0.0::DOUBLE), CASE WHEN f.n > 0 THEN {license_scan.BASE_SCORE}::DOUBLE ELSE 0.0::DOUBLE END) AS score, coalesce(blocks, '') AS blocks FROM d LEFT JOIN f USING (doc_id) LEFT JOIN h USING (doc_id)"""


ORACLES["op13_licenses"] = _licenses()
