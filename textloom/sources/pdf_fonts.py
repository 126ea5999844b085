"""What the codes of a PDF font stand for: by its ToUnicode map, else by its encoding and differences, else by a base.

A code that no map names becomes the replacement character, so that a text that can't be read shows as such.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field

UNKNOWN = "�"
HEX = rb"<([0-9A-Fa-f\s]*)>"
BLOCK = re.compile(rb"begin(codespacerange|bfchar|bfrange)(.*?)end\1", re.S)
BASES = {b"WinAnsiEncoding": "cp1252", b"MacRomanEncoding": "mac_roman", b"StandardEncoding": "latin-1", b"PDFDocEncoding": "latin-1"}

# Names of glyphs that are neither one letter nor a letter with an accent.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı", "lslash": "ł", "Lslash": "Ł",
    "sterling": "£", "Euro": "€", "cent": "¢", "yen": "¥", "section": "§", "paragraph": "¶", "degree": "°", "copyright": "©", "registered": "®", "plusminus": "±", "multiply": "×", "divide": "÷", "mu": "µ", "nbspace": " ",
}
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}


def glyph(name: str) -> str:
    """The text of a glyph's name: listed, one letter, a letter with an accent, uniXXXX, uXXXXX, parts joined by `_`."""
    out = ""
    for part in name.split(".")[0].split("_"):
        coded = re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", part)
        if part in GLYPHS:
            out += GLYPHS[part]
        elif len(part) == 1:
            out += part
        elif coded:
            units = bytes.fromhex(coded[1]) if coded[1] else int(coded[2], 16).to_bytes(4, "big")
            out += units.decode("utf-16-be" if coded[1] else "utf-32-be", "replace")
        elif part[:1].isalpha() and part[1:] in ACCENTS:
            out += unicodedata.normalize("NFC", part[0] + ACCENTS[part[1:]])
        else:
            out += UNKNOWN
    return out or UNKNOWN


def _raw(digits: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", digits)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


@dataclass
class CodeMap:
    """A ToUnicode map: code lengths, single codes, and ranges that stay ranges whatever they span."""

    spaces: list[tuple[bytes, bytes]] = field(default_factory=list)
    chars: dict[bytes, str] = field(default_factory=dict)
    ranges: list[tuple[int, bytes, bytes, bytes]] = field(default_factory=list)

    @classmethod
    def read(cls, source: bytes) -> CodeMap:
        out = cls()
        for kind, body in BLOCK.findall(source):
            if kind == b"codespacerange":
                out.spaces += [(_raw(a), _raw(b)) for a, b in re.findall(HEX + rb"\s*" + HEX, body)]
            elif kind == b"bfchar":
                out.chars.update((_raw(a), _raw(b).decode("utf-16-be", "replace")) for a, b in re.findall(HEX + rb"\s*" + HEX, body))
            else:
                for a, b, to, listed in re.findall(HEX + rb"\s*" + HEX + rb"\s*(?:" + HEX + rb"|\[([^\]]*)\])", body):
                    low, high = _raw(a), _raw(b)
                    if listed:
                        first = int.from_bytes(low, "big")
                        for i, x in enumerate(re.findall(HEX, listed)):
                            out.chars[(first + i).to_bytes(len(low) + 1, "big")[1:]] = _raw(x).decode("utf-16-be", "replace")
                    else:
                        out.ranges.append((len(low), low, high, _raw(to)))
        out.ranges.sort(key=lambda r: r[:2])
        return out

    def width(self, raw: bytes, at: int, usual: int) -> int:
        """Bytes of the code at a place: those of the first code space that holds it."""
        for low, high in sorted(self.spaces, key=lambda s: len(s[0])):
            code = raw[at : at + len(low)]
            if len(code) == len(low) and all(a <= c <= b for a, c, b in zip(low, code, high, strict=False)):
                return len(low)
        return usual

    def text(self, code: bytes) -> str | None:
        if code in self.chars:
            return self.chars[code]
        at = bisect_right(self.ranges, (len(code), code), key=lambda r: r[:2]) - 1
        if at >= 0:
            width, low, high, to = self.ranges[at]
            if width == len(code) and low <= code <= high and to:
                value = int.from_bytes(to, "big") + int.from_bytes(code, "big") - int.from_bytes(low, "big")
                return value.to_bytes(len(to) + 1, "big")[1:].decode("utf-16-be", "replace")
        return None


@dataclass
class Font:
    """codes: the ToUnicode map if there is one; names: single bytes by their glyphs; base: a codec, None where codes are glyph numbers."""

    codes: CodeMap | None = None
    names: dict[int, str] = field(default_factory=dict)
    base: str | None = "cp1252"

    def text(self, raw: bytes) -> str:
        if self.codes is None and not self.names and self.base:
            return raw.decode(self.base, "replace")
        out, at, usual = [], 0, 1 if self.base else 2
        while at < len(raw):
            n = self.codes.width(raw, at, usual) if self.codes else usual
            code = raw[at : at + n]
            told = self.codes.text(code) if self.codes else None
            if told is None and self.base:
                told = self.names.get(code[-1]) or code[-1:].decode(self.base, "replace")
            out.append(UNKNOWN if told is None else told)
            at += n
        return "".join(out)


def differences(array: bytes) -> dict[int, str]:
    """Codes by the array of a font's differences: a number starts a run of names."""
    out, code = {}, 0
    for number, name in re.findall(rb"(?<![^\s\]\[/])(\d+)|/([^\s/\[\]<>()]+)", array):
        if number:
            code = int(number)
        else:
            out[code] = glyph(name.decode("latin-1"))
            code += 1
    return out
