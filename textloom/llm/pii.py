"""Personal data in texts: regular expressions propose spans, checksums confirm, context words adjust the score.

All of it is Spark SQL expressions.  A proposal's place comes from splitting the text at the expression: the pieces
between matches and the matches themselves alternate, so their lengths add up to code-point offsets.  Expressions are
written without nested backtracking (possessive, with a look-behind at runs), which matches the plain forms exactly and
stays linear on very long texts.

Kinds: email, ip, card (Luhn), phone, then the ones that need more proof: iban (mod 97), secret (a quoted value), local
(a telephone number without a country) and ident (an identity number by its shape).  Each span has a score: a base by
kind, more with a confirming word within CONTEXT characters before it.  Kinds with a checksum or an unmistakable shape
stand by themselves; secret, local and ident reach THRESHOLD with such a word alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: Characters before a span that are searched for context words, what such a word adds, and the score that is needed.
CONTEXT, BONUS, THRESHOLD = 40, 0.3, 0.5

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"  # shorter runs can't pass; runs are maximal either way
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<=[=:] ?[\"'])[A-Za-z0-9_+/=-]{16,200}+(?=[\"'])"
LOCAL = r"(?<![0-9+.()-])(?<![0-9+)] )(?:\([0-9]{3}\) ?|[0-9]{3}[ -])[0-9]{3}-[0-9]{4}(?![0-9-])"
IDENT = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: kind: (expression, a substring or class without which nothing can match, base score, context words)
KINDS: dict[str, tuple[str, str, float, str]] = {
    "email": (EMAIL, "@", 0.9, r"(?i)mail|contact|write"),
    "ip": (IP, r"[0-9]\.[0-9]", 0.6, r"(?i)\bip\b|host|server|address"),
    "card": (CARD, "[0-9](?:[ -]?[0-9]){12}", 0.7, r"(?i)card|visa|credit|payment"),
    "phone": (PHONE, r"\+[0-9]", 0.7, r"(?i)phone|tel|call|fax|mobile"),
    "iban": (IBAN, "[A-Z]{2}[0-9]{2}", 0.6, r"(?i)iban|account|konto|cuenta|compte|bank"),
    "secret": (SECRET, r"[=:] ?[\"']", 0.3, r"(?i)token|secret|password|passwd|api|key"),
    "local": (LOCAL, "[0-9]{3}-[0-9]{4}", 0.3, r"(?i)phone|tel|call|fax|mobile"),
    "ident": (IDENT, "-[0-9]{2}-", 0.3, r"(?i)ssn|social|identity|passport|\bid\b"),
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    n = F.length(x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: x.substr(i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; every second one from the right counts double."""
    value = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c > "4", 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes the ISO 7064 mod 97-10 check (four first characters moved to the end)."""
    plain = F.regexp_replace(iban, " ", "")
    codes = F.transform(_chars(F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4))), lambda c: F.ascii(c))
    rest = F.aggregate(codes, F.lit(0), lambda a, c: F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97))
    return rest == 1


def _confirmed(kind: str, x: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        d = _digits(x)
        return F.length(d).between(13, 19) & luhn(F.when(F.length(d) <= 19, d).otherwise(F.lit("1")))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(x, " ", "")).between(15, 34) & mod97(x)
    if kind == "secret":
        return x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: what a function of elements names otherwise runs for every element."""
    return F.transform(F.array(value), body)[0]


def running(sizes: Column) -> Column:
    """The running sums of an array of ints, in blocks of about as many as there are blocks.

    An array that grows by one element is copied each time, so only short ones grow here.
    """
    none = F.array().cast("array<int>")

    def sums(part: Column, start: Column) -> Column:
        add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
        return F.aggregate(part, F.struct(start.cast("int").alias("at"), none.alias("out")), add, lambda s: s["out"])

    def cut(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda i: F.slice(x, i * size + 1, size))
        return _let(blocks, joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        before = F.slice(F.concat(F.array(F.lit(0)), sums(totals, F.lit(0))), 1, F.size(blocks))
        return F.flatten(F.zip_with(blocks, before, sums))

    return F.when(F.size(sizes) > 0, _let(sizes, cut)).otherwise(none)


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of one kind: code points, end exclusive."""
    pattern, needs, base, words = KINDS[kind]
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def placed(found: Column) -> Column:
        between = F.split(text, pattern, -1)  # one piece more than matches
        pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return _let(pairs, lambda p: F.zip_with(p, running(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["match"]))), told_of))

    def told_of(pair: Column, end: Column) -> Column:
        near = F.substring(pair["gap"], -CONTEXT, CONTEXT).rlike(words)
        score = F.least(F.lit(1.0), F.lit(base) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0)))
        one = F.struct(F.lit(kind).alias("kind"), (end - F.length(pair["match"])).alias("start"), end.alias("end"), score.alias("score"))
        return F.when(_confirmed(kind, pair["match"]) & (score >= THRESHOLD), one)

    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    kept = F.filter(_let(found, placed), lambda x: x.isNotNull())
    return F.when(text.rlike(needs), kept).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and, per kind, an array of spans (kind, start, end, score) for each row of docs(doc_id, text).

    Null or empty texts have no spans; repeated rows are searched each; null doc_ids stay null; an empty table gives
    no rows.  Extra columns are ignored.
    """
    base = id_text(docs)
    return base.select("doc_id", *(spans_of(k, F.col("text")).alias(k) for k in KINDS))


def likeliest(found: list[str]) -> Column:
    """The largest score of all kinds' spans, 0 where there are none."""
    scores = F.transform(F.concat(*(F.col(k) for k in found)), lambda s: s["score"])
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def told(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
