"""Near-duplicate lines by a segment-partition edit join.

A line is a text between line feeds.  Lines within `edits` edits (code points) of an earlier line are removed, exact
repeats included; lines under `min_chars` characters are left alone, or with `every` lose exact repeats where they are
not blank.  With `per` the threshold grows: one edit for each `per` characters of the shorter line, at most `edits`.
"Earlier" is by (doc_id, line number) of a line's first occurrence, and links count directly, without chains.

Lines of a class of lengths have edits + 1 segments at the same places, the first half counted from the start and the
others from the end.  Of two lines within `edits` edits, some segment i of the shorter one is intact in the other, with
at most i edits before and edits - i behind it; so a line indexes its segments and probes, in its own class and those
of lines shorter by up to `edits`, the substrings that this allows.  Keys (hashes of class, segment and substring) held
by one line alone go first, in one shuffle of the keys (in packs by their leading bits); only lines with a shared key ship their text, once per key, and
are verified by banded bit-parallel edit distance, many pairs at a time, after bounds that no near pair escapes (lengths,
counts of neighbouring code points, common ends).  Pairs never leave a task.

A key that more than CROWD lines share is split by a further segment: before and behind the shared one i and k - i edits
are left, so of i + 1 (or k - i + 1) segments of what lies there, one is intact again.  Lines whose further keys nobody
shares are done.  What is crowded after DEPTH splits (lines of a template, say, where nearly all segments are common) is
dealt in blocks: each two blocks meet in a group of their own, up to COPIES for each line while blocks hold at most WIDE
lines.  All lines of such a key are compared with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import by_id, id_text, lean, materialise, only_named, some_named, tasks
from .substring_dedup import whole_groups

EDITS, MIN_CHARS = 1, 30
#: Pairs that are verified at a time, and code points of one side.
PAIRS, CELLS = 20_000, 2_000_000
#: Counters of pairs of neighbouring code points by which lines are told apart first.
BINS = 64
#: Lines of a key beyond which it is split, how often that is done, and the least length of a further segment.
CROWD, DEPTH, SEGMENT = 4_000, 3, 4
#: Blocks of a key that stays crowded: this many while they hold at most WIDE lines.
COPIES, WIDE = 8, 32_000
#: Lengths in a class.
WIDTH = 30
#: Buckets of keys for each task, and keys that a task packs at a time (more where there are many buckets, up to MOST).
BUCKETS, PACK, MOST = 16, 1 << 18, 1 << 21
U = np.uint64
TOLD = U(7)
#: By code point, the last for all above: whether it is white space.
BLANK = np.array([chr(c).isspace() for c in range(0x3002)])


def allowed(length: np.ndarray, edits: int, per: int) -> np.ndarray:
    """The edits that lines of these lengths may be away from longer ones."""
    return np.minimum(edits, length // per) if per else np.full_like(length, edits)


def filled(cp: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether each line holds more than white space."""
    solid = lambda x: ~BLANK[np.minimum(x, len(BLANK) - 1)]
    out = np.zeros(len(start), bool)
    some = np.flatnonzero(stop > start)
    out[some] = solid(cp[start[some]])
    some = some[~out[some]]  # begin with white space
    if len(some):
        n = np.concatenate([[0], np.cumsum(solid(cp))])
        out[some] = n[stop[some]] > n[start[some]]
    return out


def lines_of(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, code points, line starts, line ends, row of each line) of slices of the texts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < tn.SLICE // 2):
            size += len(texts[end])
            end += 1
        cp = np.frombuffer("\n".join(texts[at:end]).encode("utf-32-le"), dtype=np.uint32)
        stop = np.append(np.flatnonzero(cp == 10), len(cp))
        start = np.concatenate([[0], stop[:-1] + 1])
        n = np.array([t.count("\n") + 1 for t in texts[at:end]])
        yield at, cp, start, stop, np.repeat(np.arange(end - at), n)
        at = end


def lowest(length: np.ndarray, per: int) -> np.ndarray:
    """The least length of the class of lines of each length; a class is WIDTH lengths, and has one threshold."""
    block = length // per * per if per else np.zeros_like(length)
    return block + (length - block) // WIDTH * WIDTH


def keys_of(cp: np.ndarray, start: np.ndarray, stop: np.ndarray, edits: int, per: int, min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int]]]:
    """(line, key, told, (edits, segment, shift)): the segments that each line indexes and the substrings that it probes.

    The low TOLD bits of keys are 0; told has the line's length over that of its class there, then whether it indexes.
    """
    own = stop - start
    hashes = tn.hasher(cp)
    lines, lows, indexed = [np.arange(len(own))], [lowest(own, per)], [np.ones(len(own), bool)]
    for less in range(1, edits + 1):
        low = lowest(own - less, per)
        j = np.flatnonzero((own - less >= min_chars) & (low != lowest(own - less + 1, per)) & (allowed(own - less, edits, per) >= less))
        lines.append(j)
        lows.append(low[j])
        indexed.append(np.zeros(len(j), bool))
    line, low, index = np.concatenate(lines), np.concatenate(lows), np.concatenate(indexed)
    order = np.argsort(line, kind="stable")
    line, index = line[order], index[order]
    low = np.maximum(low[order], min_chars)
    most = allowed(low, edits, per)
    for k in np.unique(most).tolist():
        at = np.flatnonzero(most == k)
        j, size = line[at], low[at] // (k + 1)
        for i in range(k + 1):
            place = i * size if i <= k - i else own[j] - (k + 1 - i) * size
            reach = min(i, k - i)
            for shift in range(-reach, reach + 1):
                begin = place + shift
                ok = (begin >= 0) & (begin + size <= own[j])
                b = start[j[ok]] + begin[ok]
                key = tn.mix(hashes(b, b + size[ok]) + tn.mix(low[at[ok]].astype(U) * U(64) + U(i)))
                told = (own[j[ok]] - low[at[ok]]) * 2 + (index[at[ok]] & (shift == 0))
                yield j[ok], key >> TOLD << TOLD, told.astype(U), (k, i, shift)


def halves(begin: np.ndarray, size: np.ndarray, start: np.ndarray, stop: np.ndarray, low: np.ndarray, k: int, i: int) -> np.ndarray:
    """Columns (start, stop, least length in lines that index, edits) of what is before and behind segment i at `begin`."""
    far = i > k - i  # counted from the end
    left = low - (k + 1 - i) * size if far else i * size
    right = (k - i) * size if far else low - (i + 1) * size
    full = np.full(len(begin), i)
    return np.stack([start, begin, left, full, begin + size, stop, right, k - full], axis=1)


def further_keys(cp: np.ndarray, at: np.ndarray, key: np.ndarray, indexed: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, indexed, state) of the keys that rows of crowded keys have with one more segment.

    A row's line starts at `at` in cp; its state has four columns (see halves) for each stretch that is still open.  The
    stretch with the longest segments is cut, the same one in all rows of a key; where those are shorter than SEGMENT
    the row keeps its key and its state is filled up.
    """
    least, most = state[:, 2::4], state[:, 3::4]
    size = least // (most + 1)
    chosen = size.argmax(axis=1)
    rows = np.arange(len(key))
    size, low, most = (x[rows, chosen] for x in (size, least, most))
    hashes = tn.hasher(cp)
    done = size < SEGMENT
    if done.any():
        x = np.flatnonzero(done)
        yield x, tn.mix(key[x]) >> TOLD << TOLD, indexed[x], np.pad(state[x], ((0, 0), (0, 4)))
    what = np.unique(np.stack([chosen, most], axis=1)[~done], axis=0)
    for c, k in what.tolist():
        x = np.flatnonzero(~done & (chosen == c) & (most == k))
        a, b = state[x, 4 * c], state[x, 4 * c + 1]
        for i in range(k + 1):
            place = a + i * size[x] if i <= k - i else b - (k + 1 - i) * size[x]
            reach = min(i, k - i)
            for shift in range(-reach, reach + 1):
                begin = place + shift
                ok = np.flatnonzero((begin >= a) & (begin + size[x] <= b))
                r, begin = x[ok], begin[ok]
                part = tn.mix(hashes(at[r] + begin, at[r] + begin + size[r]) + U(i + 1))
                new = halves(begin, size[r], a[ok], b[ok], low[r], k, i)
                yield r, tn.mix(key[r] ^ part) >> TOLD << TOLD, indexed[r] & (shift == 0), np.concatenate([np.delete(state[r], np.s_[4 * c : 4 * c + 4], axis=1), new], axis=1)


def _occurrences(min_chars: int, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, cp, start, stop, row in lines_of(batch.column(1).to_pylist()):
                digest = tn.span_hashes(cp, start, stop)
                number = np.arange(len(row)) - np.searchsorted(row, row)
                long = stop - start >= min_chars
                if every:
                    long |= filled(cp, start, stop)
                yield pa.RecordBatch.from_arrays([tn.long(digest[long]), batch.column(0).take(pa.array(first + row[long])), pa.array(number[long].astype(np.int32))], ["digest", "doc_id", "line"])

    return lean(run)


def _keys(edits: int, min_chars: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, cp, start, stop, _ in lines_of(batch.column(1).to_pylist()):
                long = stop - start >= min_chars
                start, stop = start[long], stop[long]
                if len(start):
                    digest = tn.span_hashes(cp, start, stop)
                    once = np.sort(np.unique(digest, return_index=True)[1])
                    start, stop, digest = start[once], stop[once], digest[once]
                    for j, key, told, _ in keys_of(cp, start, stop, edits, per, min_chars):
                        yield pa.RecordBatch.from_arrays([tn.long(key | told), tn.long(digest[j])], ["key", "digest"])

    return lean(run)


def _packed(keys: Callable, buckets: int):
    """(bucket, pack): the rows of keys(batches) by the leading bits of their keys, those of a bucket in one binary value."""
    bits = buckets.bit_length() - 1
    size = min(max(PACK, 128 * buckets), MOST)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = np.stack([np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)], axis=1)
        bucket = (both[:, 0].view(U) >> U(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64) if bits else np.zeros(len(both), np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket, both = bucket[order], both[order]
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(heads, len(both)).astype(np.int32) * 16
        packs = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(both.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int32)), packs], ["bucket", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in keys(batches):
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= size:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)

    return lean(run)


def _unpacked(shared: Callable):
    """shared over the rows of packs, which come sorted by bucket: rows of whole buckets, sorted by key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in t.column("pack")])
            key = both[:, 0]
            order = np.argsort(key)
            key = key[order]
            yield pa.RecordBatch.from_arrays([pa.array(key & ~np.int64(127)), pa.array(key & np.int64(127)), pa.array(both[order, 1])], ["key", "told", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            yield from shared(iter([batch]))

    return lean(run)


def groups_of(key: np.ndarray, digest: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, group): the groups in which each row (of distinct lines, ordered by key) meets the others of its key."""
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(key)))
    n = np.repeat(size, size)
    half = max(1, crowd // 2)
    blocks = np.where(n > crowd, np.maximum(np.minimum(-(-n // half), COPIES), -(-n // max(half, WIDE))), 1)
    row = np.repeat(np.arange(len(key)), blocks)
    other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = (tn.mix(digest.view(U)) % blocks.astype(U)).astype(np.int64)[row]
    pair = np.minimum(own, other) * (1 << 20) + np.maximum(own, other) + 1
    whole = key.view(U)[row]
    return row, np.where(blocks[row] > 1, tn.mix(whole ^ tn.mix(pair.astype(U))), whole).view(np.int64)


def _shared(edits: int, crowd: int, final: bool):
    """The rows (sorted by key) whose key another line holds, of a length within the edits; one of them must index it.

    Rows of a key that more than `crowd` lines hold are marked, or after the final split dealt in groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            key, told, digest = (t.column(c).to_numpy() for c in ("key", "told", "digest"))
            alike = key[1:] == key[:-1]
            some = np.append(alike, False) | np.append(False, alike)  # most keys have one row
            if not some.any():
                continue
            key, told, digest = key[some], told[some], digest[some]
            order = np.lexsort((told & 1, digest, told >> 1, key))
            key, told, digest = key[order], told[order], digest[order]
            last = np.append((key[1:] != key[:-1]) | (told[1:] >> 1 != told[:-1] >> 1) | (digest[1:] != digest[:-1]), True)
            key, off, digest, own = key[last], told[last] >> 1, digest[last], (told[last] & 1).astype(np.int64)
            place = np.cumsum(np.append(False, key[1:] != key[:-1])) * 256 + off + 64
            low, high = np.searchsorted(place, place - edits), np.searchsorted(place, place + edits, side="right")
            indexed = np.append(0, np.cumsum(own))
            held = np.where(own > 0, high - low > 1, indexed[high] > indexed[low])
            key, digest = key[held], digest[held]
            if final:
                row, group = groups_of(key, digest, crowd)
                crowded = np.zeros(len(row), bool)
            else:
                size = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))) if len(key) else key
                row, group, crowded = np.arange(len(key)), key, np.repeat(size, size) > crowd
            yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(group), pa.array(digest[row]), pa.array(crowded)], ["key", "group", "digest", "crowded"])

    return lean(run)


def _candidates(edits: int, per: int, min_chars: int):
    """Lines that first occur in the document and have shared keys: a row per key of each (per place of it, if crowded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, told = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(texts):  # lines of many documents at a time
                own, line, digest, chosen, size = [], [], [], [], 0
                keys: list[tuple[int, int, int, bool]] = []
                while at < len(texts) and (not size or size + len(texts[at]) < tn.SLICE // 2):
                    lines = texts[at].split("\n")
                    for x in told[at]:
                        if x["line"] < len(lines):
                            keys += [(len(chosen), k["key"], k["group"], k["crowded"]) for k in x["keys"]]
                            own.append(docs[at])
                            line.append(x["line"])
                            digest.append(x["digest"])
                            chosen.append(lines[x["line"]])
                    size += len(texts[at])
                    at += 1
                if keys:
                    yield from _rows_of(own, line, np.array(digest, np.int64), chosen, np.array(keys, np.int64), edits, per, min_chars)

    return lean(run)


#: Rows of lines: without the last three once their key is not crowded.
ROW = "key long, digest long, doc_id long, line int, indexed boolean, text string"
OPEN = f"{ROW}, crowded boolean, off int, state array<int>"


class Asked:
    """Finds the rows of keys(line, key, group, crowded) that some lines and keys match."""

    def __init__(self, keys: np.ndarray):
        code = self._code(keys[:, 0], keys[:, 1])
        self.order = np.argsort(code)
        self.code = code[self.order]

    @staticmethod
    def _code(line: np.ndarray, key: np.ndarray) -> np.ndarray:
        return tn.mix(key.view(U) + tn.mix(line.astype(U)))

    def find(self, line: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the pairs, row of keys)."""
        c = self._code(line, key)
        lo, hi = np.searchsorted(self.code, c), np.searchsorted(self.code, c, side="right")
        n = hi - lo
        return np.repeat(np.arange(len(n)), n), self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _once(row: np.ndarray, mark: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """Positions that stay: one for each row (an indexing one, if any), all for those of crowded keys."""
    by = np.lexsort((~mark, row))
    return by[np.append(True, row[by][1:] != row[by][:-1]) | crowded[by]]


def _states(state: np.ndarray) -> pa.Array:
    offsets = np.arange(len(state) + 1, dtype=np.int32) * (state.shape[1] if state.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(state.ravel().astype(np.int32)))


def _rows_of(own: list, line: list, digest: np.ndarray, chosen: list[str], keys: np.ndarray, edits: int, per: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows of lines and keys, marked where the line indexes the key; those of crowded keys say what is left of the line."""
    cp = np.frombuffer("\n".join(chosen).encode("utf-32-le"), dtype=np.uint32)
    size = np.array([len(x) for x in chosen])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    good = tn.span_hashes(cp, start, start + size).view(np.int64) == digest
    asked = Asked(keys)
    found = []
    for j, key, told, (k, i, shift) in keys_of(cp, start, start + size, edits, per, min_chars):
        which, row = asked.find(j, key)
        which, row = which[good[j[which]]], row[good[j[which]]]
        j, told = j[which], told[which].astype(np.int64)
        low = size[j] - (told >> 1)
        part = low // (k + 1)
        begin = (i * part if i <= k - i else size[j] - (k + 1 - i) * part) + shift
        found.append((row, (told & 1).astype(bool), told >> 1, halves(begin, part, np.zeros_like(begin), size[j], low, k, i)))
    if not found:
        return
    row, mark, off, state = (np.concatenate(x) for x in zip(*found, strict=True))
    once = _once(row, mark, keys[row, 3] > 0)
    for i in range(0, len(once), 4096):
        at = once[i : i + 4096]
        n = keys[row[at], 0].tolist()
        crowded = keys[row[at], 3] > 0
        held = _states(state[at]) if crowded.any() else pa.nulls(len(at), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[row[at], 2]), pa.array(digest[n]), pa.array([own[x] for x in n], pa.int64()), pa.array([line[x] for x in n], pa.int32()), pa.array(mark[at]), pa.array([chosen[x] for x in n], pa.string()), pa.array(crowded), pa.array(off[at].astype(np.int32)), held],
            ["key", "digest", "doc_id", "line", "indexed", "text", "crowded", "off", "state"],
        )


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """(digests, further keys) of rows of crowded keys."""
    num = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
    size = np.array([len(x) for x in texts])
    state = np.array(batch.column(batch.schema.get_field_index("state")).to_pylist(), np.int64)
    return num("digest"), further_keys(cp, np.cumsum(size + 1) - size - 1, num("key").view(U), num("indexed"), state)


def _further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key with told, digest) of rows of crowded keys, as _keys."""
    for batch in batches:
        if batch.num_rows:
            digest, keys = _opened(batch)
            off = batch.column(batch.schema.get_field_index("off")).to_numpy().astype(np.int64)
            for row, key, indexed, _ in keys:
                yield pa.RecordBatch.from_arrays([tn.long(key | (off[row] * 2 + indexed).astype(U)), pa.array(digest[row])], ["key", "digest"])


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of crowded keys, with `keys` (those of the line's further keys that are shared): a row per further key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        wanted = batch.column(batch.schema.get_field_index("keys")).to_pylist()
        keys = np.array([(r, k["key"], k["group"], k["crowded"]) for r, x in enumerate(wanted) for k in x], np.int64).reshape(-1, 4)
        asked, found = Asked(keys), []
        for r, key, indexed, state in _opened(batch)[1]:
            which, row = asked.find(r, key)
            found.append((row, indexed[which], state[which]))
        if not sum(len(x[0]) for x in found):
            continue
        row, mark, state = (np.concatenate(x) for x in zip(*found, strict=True))
        for at in np.array_split(once := _once(row, mark, keys[row, 3] > 0), 1 + len(once) // 4096):
            taken = batch.take(pa.array(keys[row[at], 0]))
            col = lambda c: taken.column(taken.schema.get_field_index(c))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[row[at], 2]), col("digest"), col("doc_id"), col("line"), pa.array(mark[at]), col("text"), pa.array(keys[row[at], 3] > 0), col("off"), _states(state[at])],
                ["key", "digest", "doc_id", "line", "indexed", "text", "crowded", "off", "state"],
            )


class Lines:
    """Code points of some lines, one after another."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(x) for x in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)

    def pairs_of_points(self) -> np.ndarray:
        """For each line how often each of BINS hashed pairs of neighbouring code points occurs.

        An edit takes away at most two such pairs and brings at most two, so lines k edits apart differ by at most 4 k.
        """
        p, last = self.points.astype(U), np.cumsum(self.size) - 1
        if len(p) < 2:
            return np.zeros((len(self.size), BINS), np.int32)
        line = np.repeat(np.arange(len(self.size)), self.size)
        inside = np.ones(len(p) - 1, bool)
        inside[last[(self.size > 0) & (last < len(p) - 1)]] = False
        bins = (tn.mix(p[:-1] * U(1 << 21) + p[1:]) % U(BINS)).astype(np.int64)
        return np.bincount(line[:-1][inside] * BINS + bins[inside], minlength=len(self.size) * BINS).reshape(-1, BINS).astype(np.int32)

    def common(self, p: np.ndarray, q: np.ndarray, size: np.ndarray, back: bool = False) -> np.ndarray:
        """How many code points from places p and q on (before them if back) are alike, of `size` at most."""
        out, live, width = np.zeros(len(p), np.int64), np.flatnonzero(size > 0), 16
        while len(live):
            more = []
            for x in np.array_split(live, 1 + len(live) * width // CELLS):
                at = out[x][:, None] + np.arange(width)
                left, right = ((z[x][:, None] - 1 - at if back else z[x][:, None] + at) for z in (p, q))
                differ = (self.points.take(left, mode="clip") != self.points.take(right, mode="clip")) | (at >= size[x][:, None])
                whole = ~differ.any(axis=1)
                out[x] += np.where(whole, width, differ.argmax(axis=1))
                more.append(x[whole])
            live, width = np.concatenate(more), min(2 * width, 256)
        return out

    def alike(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether the edit distance of each pair of lines is <= its limit; every length must exceed the largest one.

        A common beginning and a common end leave the distance as it is: what is between them decides.
        """
        out, edits = np.zeros(len(a), bool), int(limit.max(initial=0))
        some = np.flatnonzero(np.abs(self.size[a] - self.size[b]) <= limit)
        for x in np.array_split(some, 1 + len(some) // PAIRS):
            left, right, most = a[x], b[x], limit[x]
            least = np.minimum(self.size[left], self.size[right])
            head = self.common(self.start[left], self.start[right], least)
            tail = self.common(self.start[left] + self.size[left], self.start[right] + self.size[right], least - head, back=True)
            near = np.maximum(self.size[left], self.size[right]) - head - tail <= most
            head = np.minimum(head, least - edits - 1)  # as long as the band needs it
            tail = np.minimum(tail, least - head - edits - 1)
            p, m, q, n = (z[~near] for z in (self.start[left] + head, self.size[left] - head - tail, self.start[right] + head, self.size[right] - head - tail))
            near[~near] = banded(self, p, m, q, n, edits) <= most[~near]
            out[x] = near
        return out


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Whether the edit distance of each pair of texts is <= edits; every length must exceed edits."""
    return Lines([*a, *b]).alike(np.arange(len(a)), np.arange(len(a), 2 * len(a)), np.full(len(a), edits))


def banded(lines: Lines, p: np.ndarray, m: np.ndarray, q: np.ndarray, n: np.ndarray, edits: int) -> np.ndarray:
    """Edit distances of pairs of stretches (m code points from place p on, n from q) where they are <= edits; else larger numbers.

    Bit-parallel over the 2 * edits + 1 diagonals of the band.  Bit d of a column j (of the second stretch) stands for row
    j - edits + d.  The distance is followed along the lowest diagonal, then along the last row.

    Where the distances of a column rise by one with each diagonal from one on, to both sides, the next column has the same
    ones if code points on that diagonal match, whatever the others do: such runs are measured and passed over.
    """
    out = np.full(len(p), 1 << 30, np.int64)
    band = 2 * edits + 1
    ones = U((1 << band) - 1)
    bit = (U(1) << np.arange(band, dtype=U))[:, None]
    offset = np.arange(-edits, edits + 1)[:, None]
    live, j, turn = np.flatnonzero(n > 0), np.zeros(int((n > 0).sum()), np.int64), 0  # j: columns done
    p, m, q, n = (z[live] for z in (p, m, q, n))
    vp, vn, dist = np.full(len(live), ((1 << (edits + 1)) - 1) << edits, U), np.zeros(len(live), U), np.full(len(live), edits, np.int64)
    while len(live):
        row = j + offset
        same = (lines.points.take(p + row, mode="clip") == lines.points[q + j]) & (row >= 0) & (row < m)
        pm = (same * bit).sum(axis=0, dtype=U)
        j += 1
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn) & ones
        hp = (vn | ~(d0 | vp)) & ones
        hn = d0 & vp
        at = m - j
        last = np.minimum(np.maximum(at + edits, 0), band - 1).astype(U)
        dist += np.where(at >= edits, 1 - ((d0 >> U(band - 1)) & U(1)).astype(np.int64), ((hp >> last) & U(1)).astype(np.int64) - ((hn >> last) & U(1)).astype(np.int64))
        vp, vn = (hn | ~((d0 >> U(1)) | hp)) & ones, (d0 >> U(1)) & hp
        done = n == j
        turn += 1
        if turn % 4 == 0 or done.any():
            out[live[done]] = dist[done]
            stay = ~done & (dist <= 2 * edits + n - m)
            live, p, m, q, n, j, vp, vn, dist = (z[stay] for z in (live, p, m, q, n, j, vp, vn, dist))
        if turn % 4 == 0:
            most = np.bitwise_count(vn).astype(np.int64) - edits  # the diagonal of the least distance
            room = np.minimum(m - edits, n - 1) - j
            run = np.flatnonzero((vp == ones ^ vn) & (vn & (vn + U(1)) == 0) & (vn < ones) & (j + most >= 0) & (room > 0))
            if len(run):
                j[run] += lines.common(p[run] + j[run] + most[run], q[run] + j[run], room[run])
    return out


def later_of_pairs(key: np.ndarray, place: np.ndarray, line: np.ndarray, indexed: np.ndarray, texts: list[str], edits: int, per: int = 0) -> np.ndarray:
    """Numbers of lines that have an earlier line of one of their keys within `edits` edits; one of a pair must be indexed.

    A row per key and line: place orders the lines (equal ones are one line), line numbers them from 0.  Each turn takes
    the next lines of every group against those after them that are not found yet, so a group whose lines are near its
    first one is done after a turn.
    """
    order = np.lexsort((place, key))
    key, place, line, indexed = key[order], place[order], line[order], indexed[order]
    of_line = np.zeros(int(line.max(initial=-1)) + 1, np.int64)
    of_line[line] = order
    lines = Lines([texts[i] for i in of_line.tolist()])
    most, bins = allowed(lines.size, edits, per), lines.pairs_of_points()
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    head = np.repeat(heads, np.diff(np.append(heads, len(key))))
    found = np.zeros(len(of_line), bool)
    target, turn, step, told = np.arange(len(key)), 0, 1, np.zeros(0, np.int64)
    while len(target):
        target = target[(target > head[target] + turn) & ~found[line[target]]]
        # Lines turn .. turn + step - 1 of each group against its targets, PAIRS at a time.
        n = np.minimum(step, target - head[target] - turn)
        each = np.repeat(np.arange(len(target)), n)
        i = head[target[each]] + turn + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        j = target[each]
        pairs = []
        for x in range(0, len(i), PAIRS):
            p, q = i[x : x + PAIRS], j[x : x + PAIRS]
            a, b = line[p], line[q]
            limit = np.minimum(most[a], most[b])
            ok = np.flatnonzero((indexed[p] | indexed[q]) & (place[p] < place[q]) & (np.abs(lines.size[a] - lines.size[b]) <= limit))
            ok = ok[np.abs(bins[a[ok]] - bins[b[ok]]).sum(axis=1) <= 4 * limit[ok]]
            pairs.append(a[ok] * len(of_line) + b[ok])
        pair = np.unique(np.concatenate(pairs)) if pairs else told[:0]
        pair = pair[~np.isin(pair, told)]  # a pair often shares several keys
        before = int(found.sum())
        if len(pair):
            a, b = pair // len(of_line), pair % len(of_line)
            found[b[lines.alike(a, b, np.minimum(most[a], most[b]))]] = True
            if turn < 8:
                told = np.concatenate([told, pair])
        turn += step
        # While turns find much, later ones wait for it; then several go together.
        step = 1 if int(found.sum()) - before > len(target) // 20 else min(2 * step, 256, max(1, 1_000_000 // max(1, len(target))))
    return np.flatnonzero(found)


def _verified(edits: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            doc, number, digest = (t.column(c).to_numpy() for c in ("doc_id", "line", "digest"))
            # Digests number the lines, first occurrences order them.
            lines, line = np.unique(digest, return_inverse=True)
            order = np.lexsort((number, doc))
            new = np.append(False, (doc[order][1:] != doc[order][:-1]) | (number[order][1:] != number[order][:-1]))
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new)
            found = later_of_pairs(t.column("key").to_numpy(), place, line, t.column("indexed").to_numpy(zero_copy_only=False), t.column("text").to_pylist(), edits, per)
            yield pa.RecordBatch.from_arrays([pa.array(lines[found], pa.int64())], ["digest"])

    return lean(run)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, kept = [], [], []
        for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = text.split("\n")
            drop = sorted({i for i in drop or [] if i < len(lines)})
            out = set(drop)
            n.append(len(lines))
            gone.append(drop)
            kept.append("\n".join([x for i, x in enumerate(lines) if i not in out]) if out else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([len(x) for x in gone], pa.int64()), pa.array(kept, pa.string()), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "n_lines", "n_removed", "kept", "removed"])


def _shared_keys(rows: DataFrame, keys: Callable, edits: int, crowd: int, last: bool) -> DataFrame:
    """Those of keys(rows), with told and digest, that lines share, written.  They are shuffled in packs, not row by row."""
    n = tasks(rows.sparkSession)
    packs = rows.mapInArrow(_packed(keys, 1 << (BUCKETS * n - 1).bit_length()), "bucket int, pack binary").repartitionById(n, "bucket").sortWithinPartitions("bucket")  # evenly
    return materialise(packs.mapInArrow(_unpacked(_shared(edits, crowd, last)), "key long, group long, digest long, crowded boolean"), "shared")


def _keys_of_line(shared: DataFrame) -> DataFrame:
    """digest, keys: a bounded number for each line, as it has segments (and blocks of those that stay crowded)."""
    return shared.groupBy("digest").agg(F.collect_set(F.struct("key", "group", "crowded")).alias("keys"))


def _split(rows: DataFrame, edits: int, crowd: int) -> DataFrame:
    """Rows of lines whose crowded keys are replaced by keys of further segments that are not."""
    done = rows.filter("not crowded")
    for level in range(1, DEPTH + 1):
        rows = rows.filter("crowded")
        shared = _shared_keys(rows, _further, edits, crowd, level == DEPTH)
        rows = materialise(rows.join(_keys_of_line(shared), "digest").mapInArrow(_split_rows, OPEN), "rows")
        done = done.unionByName(rows.filter("not crowded"))
        if level < DEPTH and shared.filter("crowded").isEmpty():
            break
    return done


def _removed(base: DataFrame, texts: DataFrame, edits: int, min_chars: int, per: int, every: bool, crowd: int) -> DataFrame:
    """(gone_id, gone): the numbers of the lines that each document loses."""
    spark = base.sparkSession
    if min_chars <= edits:
        raise ValueError("min_chars must exceed edits")
    if WIDTH + edits > 63:
        raise ValueError("edits must leave the length in a class below 64")
    named = base.filter("doc_id is not null")
    places = named.mapInArrow(_occurrences(min_chars, every), "digest long, doc_id long, line int")
    first = materialise(places.groupBy("digest").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")), "lines")
    shared = _shared_keys(named, _keys(edits, min_chars, per), edits, crowd, False)  # the shuffle of all keys can go before the texts are dealt
    told = _keys_of_line(shared).join(first, "digest").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "digest", "keys")).alias("told"))
    rows = texts.join(told.withColumnRenamed("doc_id", "kid"), "kid").filter(some_named("told")).select("doc_id", "text", "told").mapInArrow(_candidates(edits, per, min_chars), OPEN)
    if not shared.filter("crowded").isEmpty():
        rows = _split(materialise(rows, "rows"), edits, crowd)
    near = rows.drop("crowded", "off", "state").repartition(tasks(spark), "key").sortWithinPartitions("key").mapInArrow(_verified(edits, per), "digest long").distinct()
    decided = first.join(near.withColumn("near", F.lit(True)), "digest", "left").filter("n > 1 or near").select("digest", F.when(F.col("near").isNull(), F.col("first")).alias("spared"))
    # Written, so that the join can split the places of a very common line.
    gone = places.join(materialise(decided, "decided"), "digest").filter("spared is null or spared.doc_id <> doc_id or spared.line <> line")
    return gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, per: int = 0, every: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (text of the remaining lines), removed (line numbers) for each row of docs.

    per: one edit for each so many characters of the shorter line, at most edits (0: edits at any length).  every: lines
    under min_chars lose their exact repeats too, but for blank ones.
    Null or empty texts have one empty line.  Rows with a null doc_id take no part and keep all lines.  Rows that share
    a doc_id count as one document: its first occurrence of a line is spared in each.  An empty table gives no rows.
    Extra columns are ignored.
    """
    base = id_text(docs)
    texts = by_id(base)
    both = texts.join(_removed(base, texts, edits, min_chars, per, every, crowd), F.col("kid") == F.col("gone_id"), "left")
    return both.select("doc_id", "text", only_named("gone")).mapInArrow(_kept, "doc_id long, n_lines long, n_removed long, kept string, removed array<int>")


def replace_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, per: int = 0, every: bool = False) -> DataFrame:
    """docs with `text` (and n_chars, where there is one) without near-duplicate lines; all rows and columns stay."""
    base = id_text(docs)
    gone = _removed(base, by_id(base), edits, min_chars, per, every, CROWD)
    # The whole row travels as one struct: no column of docs can clash with a working name.
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    both = rows.join(gone, rows["row"]["doc_id"].cast("long") == gone["gone_id"], "left")
    lines = F.split(F.col("row.text"), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(text))
    return both.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
