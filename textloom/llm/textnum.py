"""Vectorised word and n-gram hashing over Arrow string batches.

A batch is walked in slices of about SLICE bytes (a longer document is a slice of its own), so memory stays
bounded by the longest document.  All hashes are 64-bit and depend on content alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
TILE = 1 << 20
U = np.uint64
_R = 0x9E3779B97F4A7C15
_C1, _C2, _C3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * _C1
    x = (x ^ (x >> U(27))) * _C2
    return x ^ (x >> U(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    return mix((np.arange(start, start + n, dtype=U) * U(_R)) ^ _C3)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_R, -1, 1 << 64)
    one = np.ones(1, dtype=U)
    return (np.concatenate([one, np.cumprod(np.full(n, _R, dtype=U))]), np.concatenate([one, np.cumprod(np.full(n, inverse, dtype=U))]))


def byte_class(chars: str) -> np.ndarray:
    """256 booleans: True for bytes of words, given the ASCII separators."""
    t = np.ones(256, dtype=bool)
    t[[ord(c) for c in chars]] = False
    return t


SPACE_WORD = byte_class(" \t\n\x0b\x0c\r")
ALNUM_WORD = byte_class("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(text: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets of the rows, from 0, and their bytes), documents kept whole."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if not len(text):
        return
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    raw = text.buffers()
    offs = np.frombuffer(raw[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, offs[at : end + 1] - offs[at], data[offs[at] : offs[end]]
        at = end


def words(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and row of each word."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = kind[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, side="right") - 1


def _span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lo, hi = int(starts[0]), int(ends.max())
    size = 1 << max(21, (hi - lo - 1).bit_length())
    up, down = _powers(size)
    c = np.zeros(hi - lo + 1, dtype=U)
    np.cumsum((buf[lo:hi].astype(U) + U(1)) * up[: hi - lo], out=c[1:])
    return mix((c[ends - lo] - c[starts - lo]) * down[starts - lo] + (ends - starts).astype(U) * _C3)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span (ordered by start)."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    out, at = np.empty(len(starts), dtype=U), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + TILE, side="right")))
        out[at:end] = _span_hash(buf, starts[at:end], ends[at:end])
        at = end
    return out


def hasher(buf: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """span_hashes for several sets of spans (in any order) of one buffer, whose running sums are taken once."""
    if len(buf) > 2 * TILE:

        def long_way(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            order, out = np.argsort(starts, kind="stable"), np.empty(len(starts), dtype=U)
            out[order] = span_hashes(buf, starts[order], ends[order])
            return out

        return long_way
    up, down = _powers(2 * TILE)
    c = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=c[1:])
    return lambda starts, ends: mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U) * _C3)


def byte_grams(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes of up to 2 * TILE bytes, from running sums."""
    if len(buf) < k:
        return np.zeros(0, dtype=U)
    up, down = _powers(2 * TILE)
    c = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=c[1:])
    return mix((c[k:] - c[:-k]) * down[: len(buf) - k + 1])


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values, by doubling; position i covers i..i+n-1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    out, off, size, block, rest = None, 0, 1, h, n
    while rest:
        if rest & 1:
            part = block[off : off + m]
            out = part if out is None else mix(out * _C1 + part)
            off += size
        rest >>= 1
        if rest:
            block = mix(block[: len(block) - size] * _C2 + block[size:])
            size *= 2
    return out


def minimizers(h: np.ndarray, group: np.ndarray, w: int) -> np.ndarray:
    """For each position i the leftmost position of the smallest hash in i..i+w-1 (-1: the window leaves its group).

    The choice depends on the window's content alone, so equal windows choose alike.
    """
    m = len(h) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    bits = U(max(28, int(len(h) - 1).bit_length()))  # fixed, or ties would depend on the batch
    best = ((h >> bits) << bits) | np.arange(len(h), dtype=U)
    size = 1
    while size * 2 <= w:
        best = np.minimum(best[: len(best) - size], best[size:])
        size *= 2
    if size < w:
        best = np.minimum(best[:m], best[w - size : w - size + m])
    at = (best[:m] & ((U(1) << bits) - U(1))).astype(np.int64)
    at[group[:m] != group[w - 1 : w - 1 + m]] = -1
    return at


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))
