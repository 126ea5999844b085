"""Token ids of whole texts by a public tokenizer file, with a cache of white-space separated pieces.

The tokenizers of this kind (lower case, words apart) never merge across white space, so a text's ids are those of its
pieces in order; tests compare with whole-text encoding.  Pieces are cut at spaces and line feeds alone; other white
space stays inside a piece, where the tokenizer sees it.  ASCII letters are lower-cased first, which changes no id but
where a combining mark or a special token's text is present; such texts keep their case.  Ids travel as little-endian
unsigned 32-bit bytes.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textnum import LOWER, slices

#: Pieces of a generation of the cache; a worker remembers this and the one before.
REMEMBERED = 400_000
#: ASCII marks that no rule joins to a letter or digit before them (the apostrophe is one that does).
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
BETWEEN = "\x01"
#: How byte-level vocabularies show bytes: printable Latin-1 as itself, the rest from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
END = (1).to_bytes(4, "little")
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[10] = 32
_LOWERED = LOWER[_SPACED]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.between,) = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.model = self.tokenizer.model
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.direct = all(self._plain(t) == whole(t) for t in ("a", "thanedble", "größe", "réeuxment", "ñaçãoœ"))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empties the cache: at the end of a task, so idle workers hold little."""
        self.known, self.before = {}, {}

    def _plain(self, piece: str) -> bytes:
        """Ids of a piece of small Latin letters: one word to the tokenizer, so its model alone is asked."""
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SHOWN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _encode(self, pieces: list[str]) -> None:
        """Letters by the model; the rest many in a call, told apart by a control character that is a token of its own."""
        apart, known = [], self.known
        for p in pieces:
            if self.direct and p.isalpha() and max(p) < "\u0180" and p.islower():
                known[p] = self._plain(p)
            elif BETWEEN in p:
                known[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                apart.append(p)
        for j in range(0, len(apart), 2_000):
            part = apart[j : j + 2_000]
            text = f" {BETWEEN} ".join(part) + f" {BETWEEN}"
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.between)
            assert len(ends) == len(part)
            raw, at = ids.tobytes(), 0
            for p, end in zip(part, ends.tolist(), strict=True):
                known[p] = raw[4 * at : 4 * end]
                at = end + 1

    def _learn(self, new: list[str]) -> None:
        known, before = self.known, self.before
        ended, rest = [], set()
        for p in new:
            found = before.get(p)
            if found is not None:
                known[p] = found
                continue
            base = p.rstrip(MARKS) if "<|" not in p else ""
            if base and len(base) < len(p) and base[-1].isascii() and base[-1].isalnum():
                ended.append((p, base, p[len(base) :]))  # a letter or digit and the marks after it are apart
                rest.update(ended[-1][1:])
            else:
                rest.add(p)
        self._encode([p for p in rest if p not in known])
        for p, base, marks in ended:
            known[p] = known[base] + known[marks]

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text.

        A slice of texts is split and its distinct pieces are found by Arrow; Python sees each distinct piece once.
        """
        for _, offs, buf in slices(texts, 1 << 23):
            raw, low = _SPACED[buf], _LOWERED[buf]
            whole = raw.tobytes()
            if b"\xcc" in whole or b"\xcd" in whole or b"<|" in whole:
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    own = whole[a:b]
                    if b"\xcc" in own or b"\xcd" in own or b"<|" in own:
                        low[a:b] = raw[a:b]
            plain = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(offs, dtype=np.int64)), pa.py_buffer(low))
            parts = pc.split_pattern(plain, " ")
            pieces = parts.values.dictionary_encode()
            names = pieces.dictionary.to_pylist()
            if len(self.known) > REMEMBERED:
                self.before, self.known = self.known, {}
            found = list(map(self.known.get, names))
            new = [i for i, x in enumerate(found) if x is None]
            if new:
                self._learn([names[i] for i in new])
                for i in new:
                    found[i] = self.known[names[i]]
            values = pa.array(found, pa.large_binary()).take(pieces.indices)
            ends = np.frombuffer(values.buffers()[1], dtype=np.int64)[np.asarray(parts.offsets)].tolist()
            data = values.buffers()[2].to_pybytes() if values.buffers()[2] is not None else b""
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield data[a:b]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
