"""Fragments of DuckDB SQL that several queries' oracles share."""

from __future__ import annotations

from ..functions import text as T

SP = r"[ \t\n\f\r]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'" if "\n" not in s else "concat(" + ", chr(10), ".join(lit(x) for x in s.split("\n")) + ")"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def char_normalise(x: str) -> str:
    for a, b in T.CHARACTERS:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def space_collapse(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda p: p <> ''), ' ')"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?]) +', concat('\1', chr(10)), 'g'), chr(10)), lambda p: {strip('p')}), lambda p: p <> '')"


def phrases(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '[.,;:|!?\n]+'), lambda p: {strip('p')}), lambda p: p <> '' AND len(string_split(p, ' ')) <= 6)"


def chain(first: str, steps: list[str], col: str = "t") -> str:
    """Nested selects: each step is an expression over `t` that replaces it; other columns stay."""
    out = first
    for s in steps:
        out = f"SELECT * REPLACE (({s}) AS {col}) FROM ({out})"
    return out


def determiner_steps() -> list[str]:
    return [f"CASE WHEN {strip(f'regexp_replace(t, {lit(f'^(?:{d})+')}, {lit('')})')} = {lit(d.strip())} THEN '' ELSE regexp_replace(t, {lit(f'^(?:{d})+')}, '') END" for d in T.DETERMINERS]


def clean_steps() -> list[str]:
    steps = [strip(f"CASE WHEN instr(t, {lit(d)}) > 0 THEN concat(substr(t, 1, instr(t, {lit(d)}) - 1), substr(t, instr(t, {lit(d)}) + {len(d)})) ELSE t END") for d in T.DOUBLED]
    steps += [strip(f"replace(t, {lit(d)}, '')") for d in T.DELETED]
    edge = "[" + "".join("\\" + c for c in T.EDGES) + r" \t\n\f\r]"
    steps += [f"regexp_replace(t, '^{edge}+', '')", f"regexp_replace(t, '{edge}+$', '')"]
    steps.append("CASE WHEN len(string_split(t, ' ')) > 1 AND string_split(t, ' ')[1] <> '' AND lower(string_split(t, ' ')[1]) = lower(string_split(t, ' ')[2]) THEN string_split(t, ' ')[1] ELSE t END")
    marks = r"(length(t) - length(regexp_replace(t, '[^\p{L}\p{N}\p{M}_ \t\n\f\r]', '', 'g')))"
    rest = "substr(t, 5)"
    drop = [
        "length(t) = 1",
        rf"(length(t) < 4 AND (NOT (upper(t) = t AND lower(t) <> t) OR regexp_matches(t, '[0-9 \t\n\f\r]')))",
        f"(length(t) < 6 AND {marks} > 1)",
        f"regexp_matches(t, '[=+*@|<>»_%]')",
        f"(regexp_matches(t, '^(the|The|a|A) ') AND (length(t) = 5 OR (length(t) < 8 AND lower({rest}) = {rest} AND upper({rest}) <> {rest})))",
    ]
    steps.append(f"CASE WHEN {' OR '.join(drop)} THEN NULL ELSE t END")
    return steps


def number_steps() -> list[str]:
    w = T.WORD
    start = rf"^([A-Z][. ])?([ {T.DIGIT}.+-])*"
    reference = rf"[(]+([{T.DIGIT}{T.WHITE}.])*[)]?"
    head = rf"^({w}|{T.MARKS}|°|\*|\||\(|\))([{T.WHITE}]?({T.DIGIT}|{T.MARKS}|%|\*|\||\(|\))[{T.WHITE}]?)+"
    cut = f"regexp_replace(t, {lit(head)}, '')"
    third = f"CASE WHEN regexp_matches(t, {lit(head)}) AND regexp_matches({cut}, '^{w}([^{w[1:]}|$)') THEN substr({cut}, 2) ELSE {cut} END"
    return [f"CASE WHEN t = '' THEN t ELSE {s} END" for s in (f"regexp_replace(t, {lit(start)}, '')", f"regexp_replace(t, {lit(reference)}, '', 'g')", third)]
