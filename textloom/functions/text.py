"""Text operators as Column -> Column functions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must match them.
DETERMINERS = ["The ", "the ", "a ", "an ", "A ", "An ", "This ", "this ", "These ", "these ", "That ", "that ", "Those ", "those "]
CHARACTERS = [
    ("\u00a0", " "),
    ("\u00a3", "pounds "),
    ("\u00b2", "#SUP#2#SUP#"),
    ("\u00b3", "#SUP#3#SUP#"),
    ("\u00b0", " degrees "),
    ("\u00ba", " degrees "),
    ("\u00bd", "1/2"),
    ("\u00be", "3/4"),
    ("\u03bb", "lambda"),
    ("\u00e9", "e"),
    ("\u2013", "-"),
    ("\u2014", "-"),
    ("\u00e2", "-"),
    ("\u2018", "`"),
    ("\u201c", "``"),
    ("\u2019", "'"),
    ("\u201d", "''"),
    ("\u2026", "..."),
    ("\uf059", "PSI"),
    ("\u00f7", "/"),
    ("\u2028", "\n"),
]
DOUBLED = ["thethe", "thenthe", "thethat", "their "]
DELETED = [". ", " .", "'", '"', "`"]
EDGES = ":;-[()]{}/\\$&@"
GIBBERISH = "=+*@|<>\u00bb_%"
QUERY_DELETED = "'\"[]{}()\\/"
CANDIDATE_DELETED = "\"'()/\\"
IDENTIFIER_STARTS = ["BS ", "NA ", "+", "P ", "CP ", "D ", "Eurocode ", "ICS "]
STANDARD = r"[A-Z +]+(to)?[A-Z ]+([\d\-+:]+)([A-Z ]+[\d\-+:]+)?"
NUMBERED = r"[0-9: +]([\dA-Z\-+:]+)([A-Z ]+[\d\-+:]+)?"
EUROCODE = r"Euro([\w :])+([\d\-+:]+)([A-Z ]+[\d\-+:]+)?"
FILE_NAMES = [
    (("BS", "NA", "+"), STANDARD),
    (tuple("0123456789"), NUMBERED),
    (("Eurocode",), EUROCODE),
    (("Approved",), r"Approved([\w ])+[-]"),
    (("LPS",), r"LPS([\w ])+[-]"),
    (("DD",), r"DD[CENVTS -13678]+[210]+"),
    (("CP",), r"[CPa-z ]+([\d -])+"),
    (("CFPA",), r"CFPA([A-Za-z _]+[\d -_])+"),
    (("NT",), r"NT([Bbuild -]+)[\d -]+"),
    (("PD",), r"PD[A-Z ]+[\d -]+"),
    (("PAS",), r"PAS[\d -]+"),
]
LANGUAGES = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "nl": "dutch", "pt": "portuguese", "pl": "polish", "cs": "czech", "da": "danish", "et": "estonian", "fi": "finnish", "el": "greek", "no": "norwegian", "ru": "russian", "sl": "slovene", "sv": "swedish", "tr": "turkish"}

TOKEN = r"[\p{L}\p{N}]+"
#: White space as regular expressions of both engines see it.
SPACES = r"[ \t\n\f\r]"
# Character classes that both engines read alike.
WHITE, DIGIT, WORD = r" \t\n\f\r", r"\p{Nd}", r"[\p{L}\p{N}\p{M}_]"
MARKS = "_|\u2014|@|=|/|\\\\|~|\\.|,|<|>|:"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")


def char_normalise(text: Column) -> Column:
    """Ordered literal replacements; a later rule sees what earlier ones left."""
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), CHARACTERS, text)


def whitespace_clean(text: Column) -> Column:
    """Every line stripped; two or more line feeds become two."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.regexp_replace(F.array_join(lines, "\n"), "\n\n+", "\n\n")


def space_collapse(text: Column) -> Column:
    """Runs of spaces become one; line feeds stay."""
    return F.array_join(F.filter(F.split(text, " "), lambda x: x != ""), " ")


def page_clean(page: Column) -> Column:
    """First line and last two lines dropped, lines stripped and joined, white space collapsed."""
    lines = F.split(page, "\n")
    kept = F.slice(lines, 2, F.greatest(F.size(lines) - 3, F.lit(0)))
    return F.regexp_replace(F.array_join(F.transform(kept, strip), " "), f"{SPACES}+", " ")


def sentences(text: Column) -> Column:
    """Sentences of each line: a terminator followed by spaces ends one; blank ones are dropped."""
    marked = F.regexp_replace(text, r"([.!?]) +", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), strip), lambda s: s != "")


def extraction_sentences(text: Column) -> Column:
    """Pieces at semicolons and line feeds over 10 characters; texts over 3000 characters end a sentence at `;`."""
    pieces = F.split(F.when(F.length(text) > 3000, F.replace(text, F.lit(";"), F.lit(".\n"))).otherwise(F.replace(text, F.lit(";"), F.lit("\n"))), "\n")
    return F.filter(F.transform(pieces, strip), lambda s: F.length(s) > 10)


def lower_all_caps(s: Column) -> Column:
    return F.when((F.upper(s) == s) & (F.lower(s) != s), F.lower(s)).otherwise(s)


def truncate_tagger(tokens_: Column, most: int = 512) -> Column:
    """At most `most` tokens: the first ones and the last."""
    return F.when(F.size(tokens_) > most, F.concat(F.slice(tokens_, 1, most - 1), F.slice(tokens_, -1, 1))).otherwise(tokens_)


def truncate_embedder(tokens_: Column, most: int = 512) -> Column:
    return F.slice(tokens_, 1, most)


def sanitise_query(q: Column) -> Column:
    """Quotes, brackets and slashes deleted, trimmed; null if nothing is left."""
    out = strip(F.translate(q, QUERY_DELETED, ""))
    return F.when(out != "", out)


def sanitise_candidate(c: Column) -> Column:
    return F.translate(c, CANDIDATE_DELETED, "")


def strip_determiners(text: Column) -> Column:
    """Ordered passes: each determiner is removed from the front while it is there; alone, it leaves nothing."""

    def one(t: Column, d: str) -> Column:
        return F.regexp_replace(t, f"^(?:(?:{d})*{SPACES}*{d.strip()}{SPACES}*$|(?:{d})+)", "")

    return reduce(one, DETERMINERS, text)


def drop_numbers(text: Column) -> Column:
    """Three ordered patterns: numbering at the start, bracketed references, and runs of marks and digits.

    The third is written without a conditional group; its first group is mandatory, so the results are the same.
    """
    start = rf"^([A-Z][. ])?([ {DIGIT}.+-])*"
    reference = rf"[(]+([{DIGIT}{WHITE}.])*[)]?"
    gibberish = rf"^({WORD}|{MARKS}|\u00b0|\*|\||\(|\))([{WHITE}]?({DIGIT}|{MARKS}|%|\*|\||\(|\))[{WHITE}]?)+({WORD}(?!{WORD}))?"
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), (start, reference, gibberish), text)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_repeated(t: Column, mode: str = "intended") -> Column:
    """`floor floor` becomes `floor`; compat: nothing happens."""
    if mode == "compat":
        return t
    return F.regexp_replace(t, r"(?iu)^(\S+) \1(?: .*)?$", "$1")


def clean_span(span: Column, mode: str = "intended") -> Column:
    """A cleaned span, or null where a rule drops it."""
    t = span
    for d in DOUBLED:
        t = strip(F.regexp_replace(t, f"(?s)^(.*?){d}", "$1"))  # the first one alone
    for d in DELETED:
        t = strip(F.replace(t, F.lit(d), F.lit("")))
    edge = "[" + "".join("\\" + c for c in EDGES) + " \\t\\n\\f\\r]"
    t = F.regexp_replace(t, f"^{edge}+", "")
    t = F.regexp_replace(t, f"{edge}+$", "")
    return let(collapse_repeated(t, mode), _unless_dropped)


def _unless_dropped(t: Column) -> Column:
    n = F.length(t)
    upper = (F.upper(t) == t) & (F.lower(t) != t)
    marks = n - F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\p{M}_ \t\n\f\r]", ""))
    rest = t.substr(F.lit(5), n)
    lower_rest = (F.lower(rest) == rest) & (F.upper(rest) != rest)
    determined = t.rlike("^(the|The|a|A) ")
    drop = (
        (n == 1)
        | ((n < 4) & (~upper | t.rlike(r"[0-9 \t\n\f\r]")))
        | ((n < 6) & (marks > 1))
        | t.rlike("[" + "".join("\\" + c if c in "+*|<>" else c for c in GIBBERISH) + "]")
        | (determined & ((n == 5) | ((n < 8) & lower_rest)))
    )
    return F.when(~drop, t)


def compose_title(doc_id: Column, title: Column) -> Column:
    """`identifier # title`: the identifier from a file name, the title without a leading standard number."""
    cut = lambda sep: F.substring_index(doc_id, sep, 1)
    identifier = F.when(doc_id.contains("--"), cut("--")).when(doc_id.contains("_"), cut("_")).when(doc_id.contains("part"), cut("part")).otherwise(cut("."))
    number = F.when(title.rlike("^(BS|NA|\\+)"), F.regexp_extract(title, "^" + STANDARD, 0)).when(title.rlike("^[0-9]"), F.regexp_extract(title, "^" + NUMBERED, 0)).when(title.startswith("Eurocode"), F.regexp_extract(title, "^" + EUROCODE, 0)).otherwise("")
    rest = F.when(F.length(number) > 0, title.substr(F.length(number) + 2, F.length(title))).otherwise(title)
    missing = title.isNull() | (title == "")
    return F.when(title.contains(" # "), title).otherwise(F.concat(identifier, F.lit(" # "), F.when(missing, "[Could not grab title]").otherwise(rest)))


def find_identifier(title: Column) -> Column:
    """The document identifier in a composed title, or null: the known start that leaves the longest remainder counts."""
    known = reduce(lambda a, b: a | b, (title.startswith(s) for s in IDENTIFIER_STARTS))
    options = F.array(*(F.when(title.contains(s), F.struct(F.length(title.substr(F.instr(title, s) + len(s), F.length(title))).alias("n"), F.lit(-i).alias("i"), F.concat(F.lit(s), title.substr(F.instr(title, s) + len(s), F.length(title))).alias("t"))) for i, s in enumerate(IDENTIFIER_STARTS)))
    best = F.array_max(F.filter(options, lambda x: x.isNotNull() & (x["n"] > 0)))["t"]
    licensed = strip(title).startswith("Lic")
    t = F.when(licensed, F.when(title.contains(","), title.substr(F.instr(title, ",") + 1, F.length(title)))).when(known, title).otherwise(best)
    found = F.when(t.rlike("^(BS|NA|\\+|P|D)"), F.regexp_extract(t, "^" + STANDARD, 0)).when(t.rlike("^[0-9]"), F.regexp_extract(t, "^" + NUMBERED, 0)).when(t.startswith("Eurocode"), F.regexp_extract(t, "^" + EUROCODE, 0))
    return F.when(F.length(found) > 0, found)


def file_identifier(name: Column) -> Column:
    """The identifier in a file name: first known prefix, cut at `+A`, without trailing punctuation."""

    def first_known(n: Column) -> Column:
        found = F.lit("")
        for starts, pattern in reversed(FILE_NAMES):
            begins = reduce(lambda a, b: a | b, (n.startswith(s) for s in starts))
            found = F.when(begins, F.regexp_extract(n, "^" + pattern, 0)).otherwise(found)
        return let(found, lambda x: F.when(F.length(x) > 0, F.regexp_replace(F.substring_index(x, "+A", 1), r"[- :+]+$", "")).otherwise(n))

    return let(name, first_known)


def tracked_changes(name: Column) -> Column:
    return name.rlike("TC|Tracked|tracked")


def id_part(id_: Column, n: int) -> Column:
    """Part n (from 1) of doc##page##split."""
    return F.get(F.split(id_, "##"), F.lit(n - 1))


def drop_non_ascii(t: Column) -> Column:
    return F.regexp_replace(t, "[^\\x00-\\x7F]", "")


def join_pieces(pieces: Column) -> Column:
    """Word pieces to text: `##x` glues to what is before."""
    return F.replace(F.array_join(pieces, " "), F.lit(" ##"), F.lit(""))


def join_pieces_bare(pieces: Column) -> Column:
    return F.regexp_replace(join_pieces(pieces), "^(?:the|a|an) ", "")


def strip_markup(t: Column) -> Column:
    """Definition, quote, note and figure marks removed; the text that they mark stays."""
    t = F.regexp_replace(t, "#DEFINED#(.*?)#TERM#", "$1")
    figure = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"#Figure\d{1,2}#", ""), r"#EndFigure\d{1,2}", ""), "#$", "")
    inner = lambda a, b: t.substr(F.lit(a + 1), F.greatest(F.length(t) - a - b, F.lit(0)))
    return F.when(t.contains("#QUOTE"), inner(7, 11)).when(t.contains("#NOTE"), inner(6, 10)).when(t.contains("#Figure"), figure).otherwise(t)


def defined_terms(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit("#DEFINED#(.*?)#TERM#"), F.lit(1))


def expand_query(query: Column, spans: Column, top: Column) -> Column:
    """The query, then its spans and the chosen terms, separated by commas."""
    return F.concat_ws(", ", query, F.array_join(F.concat(spans, F.transform(top, sanitise_candidate)), ", "))


def unique_words(text: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(text, " ")), " ")


def blank_label(label: Column, in_domain: Column) -> Column:
    return F.when(in_domain, label).otherwise("")


def language_name(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[code]


def normalise_definition(t: Column) -> Column:
    return F.replace(F.translate(strip(F.lower(t)), "\"'", ""), F.lit("-"), F.lit(" - "))


def origin(doc: Column) -> Column:
    return F.when(doc.startswith("d"), "domestic").otherwise("non-domestic")


def bare_term(t: Column) -> Column:
    return F.lower(F.regexp_replace(t, "^(?:the|a|The|A) ", ""))


def similar(a: Column, b: Column, percent: float = 70.0) -> Column:
    """Whether two terms are alike: 100 - distance / longer length * 100 > percent, without their determiners.

    Two empty terms are alike.
    """
    return alike(bare_term(a), bare_term(b), percent)


def alike(x: Column, y: Column, percent: float = 70.0) -> Column:
    """The same of bare terms, for those that meet many others."""
    longest = F.greatest(F.length(x), F.length(y))
    return F.coalesce(100 - F.levenshtein(x, y) / F.nullif(longest, F.lit(0)) * 100 > percent, F.lit(True))


def phrases(text: Column) -> Column:
    """The default span tagger: stretches between punctuation marks and line feeds, of at most six words."""
    parts = F.transform(F.split(text, r"[.,;:|!?\n]+"), strip)
    return F.filter(parts, lambda p: (p != "") & (F.size(F.split(p, " ")) <= 6))
