"""Stems of English words by suffix rules with measure conditions, as column expressions.

A word is a chain of consonant and vowel runs; its measure is how often a vowel run is followed by a consonant run.  A rule
takes the longest ending of its step and changes it where what is left has the measure that the rule asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rules of the suffix-stripping algorithm of 1980.  Ending: replacement.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# y is a vowel behind a consonant, else a consonant: a consonant run begins with anything but a plain vowel.
_CONSONANTS, _VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_HEAD = f"^(?:{_CONSONANTS}|(?=[aeiou]))"
_VOWEL = f"{_HEAD}[aeiouy]"
_OVER_0 = f"{_HEAD}{_VOWELS}{_CONSONANTS}"
_ONE = f"{_HEAD}{_VOWELS}{_CONSONANTS}(?:{_VOWELS})?$"
_OVER_1 = f"{_HEAD}{_VOWELS}{_CONSONANTS}{_VOWELS}{_CONSONANTS}"
#: Consonant, vowel, consonant (not w, x, y) at the end, the first one heading the word or not.
_SHORT = f"^{_CONSONANTS}[aeiouy][^aeiouwxy]$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for all places where it stands."""
    return F.transform(F.array(value), body)[0]


def _less(w: Column, ending: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(ending))


def _changed(w: Column, rules: dict[str, str], needs: str) -> Column:
    """The longest ending of the rules replaced, if what is left has the measure."""
    found = F.regexp_extract(w, f"^.*?({'|'.join(rules)})$", 1)
    new = F.create_map(*(F.lit(x) for rule in rules.items() for x in rule))

    def replaced(x: Column) -> Column:
        rest = F.substring(w, F.lit(1), F.length(w) - F.length(x))
        return F.when((x != "") & rest.rlike(needs), F.concat(rest, new[x])).otherwise(w)

    return _let(found, replaced)


def _plurals(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _less(w, "es")).when(w.endswith("s") & ~w.endswith("ss"), _less(w, "s")).otherwise(w)


def _participles(w: Column) -> Column:
    bare = F.when(w.endswith("ed") & _less(w, "ed").rlike(_VOWEL), _less(w, "ed")).when(w.endswith("ing") & _less(w, "ing").rlike(_VOWEL), _less(w, "ing"))

    def mended(x: Column) -> Column:
        again = F.when(x.rlike("(?:at|bl|iz)$"), F.concat(x, F.lit("e"))).when(x.rlike(r"([^aeiouylsz])\1$"), _less(x, "?")).when(x.rlike(_SHORT), F.concat(x, F.lit("e"))).otherwise(x)
        return F.when(x.isNull(), w).otherwise(again)

    return F.when(w.endswith("eed"), F.when(_less(w, "eed").rlike(_OVER_0), _less(w, "d")).otherwise(w)).otherwise(_let(bare, mended))


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _less(w, "y").rlike(_VOWEL), F.concat(_less(w, "y"), F.lit("i"))).otherwise(w)


def _endings(w: Column) -> Column:
    found = F.regexp_extract(w, f"^.*?({'|'.join(STEP_4)})$", 1)

    def cut(x: Column) -> Column:
        rest = F.substring(w, F.lit(1), F.length(w) - F.length(x))
        return F.when((x != "") & rest.rlike(_OVER_1) & ((x != "ion") | rest.rlike("[st]$")), rest).otherwise(w)

    return _let(found, cut)


def _final_e(w: Column) -> Column:
    rest = _less(w, "e")
    return F.when(w.endswith("e") & (rest.rlike(_OVER_1) | (rest.rlike(_ONE) & ~rest.rlike(_SHORT))), rest).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & _less(w, "l").rlike(_OVER_1), _less(w, "l")).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-cased word; words of one or two letters, and nulls, stay."""
    steps = [_plurals, _participles, _final_y, lambda w: _changed(w, STEP_2, _OVER_0), lambda w: _changed(w, STEP_3, _OVER_0), _endings, _final_e, _final_l]
    out = word
    for step in steps:
        out = _let(out, step)
    return F.when(F.length(word) > 2, out).otherwise(word)
