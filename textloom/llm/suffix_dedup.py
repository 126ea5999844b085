"""Substring dedup over bytes: the common-prefix interval tree of an enhanced suffix array.

Suffixes start at anchors (content-chosen byte positions, see shared.py: each window of `width` bytes has one, and equal
windows have equal ones), so the array is sparse but loses no repeat of `width` bytes.  Suffixes whose anchor gram occurs
once are left out.  Within a task, the suffixes of whole groups are sorted with their longest common prefixes, and a
stack scan yields the common-prefix intervals.  The members of an interval are sorted by what stands before them, and a
second stack scan finds the sets that agree on as many bytes to the left as possible: the byte before differs, so a set
is left-diverse; if its members lie in several children of the interval, they differ to the right, too.  Such a set is a
maximal repeat with all its occurrences (as far as contexts reach), and what is removed is the union of those.

Equal contexts collapse before the scan.  Crowded grams (shared.py) meet the scan with one context of each kind; a context
of a crowded gram that occurs again is known to repeat as a whole from its count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import by_id, copies_of, id_text, lean, materialise, only_named, some_named, tasks
from .shared import Contexts, Crowd, anchors, counted, crowded_groups, listed, split, union
from .substring_dedup import whole_groups

WIDTH, K = 400, 32
#: Bytes that are hashed at a time.
PIECE = 1 << 17
#: Contexts up to which those of one gram meet in one task.
GROUP = 10_000

KEY = "gram long, digest long, doc_id long, n long"
CONTEXT = "gram long, doc_id long, th long, off int, starts array<int>, context binary"
SPANS = "array<struct<start: int, end: int>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def pieces(text: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, start in its text, byte offsets, bytes): slices of a batch; a long text comes in overlapping pieces.

    Every window of `width` bytes lies in one piece.
    """
    for first, offs, buf in tn.slices(text, PIECE):
        if len(buf) <= 2 * PIECE:
            yield first, 0, offs, buf
        else:
            for at in range(0, len(buf) - width + 1, PIECE):
                part = buf[at : at + PIECE + width - 1]
                yield first, at, np.array([0, len(part)]), part


def _contexts_of(buf: np.ndarray, offs: np.ndarray, width: int, k: int, crowded: list[np.ndarray]) -> tuple[np.ndarray, Contexts]:
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    g = tn.byte_grams(buf, k)
    at, lo, hi = anchors(g, row, k, width)
    named = tn.hasher(buf) if crowded and len(at) else None
    return row, split(Contexts(g[at], at, lo, hi), crowded, named, width - k, width)


def _keys(width: int, k: int, levels: Callable[[pa.RecordBatch], list[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crowded = levels(batch)
            for first, _, offs, buf in pieces(batch.column(1), width):
                row, x = _contexts_of(buf, offs, width, k, crowded)
                if len(x.at):
                    (of, gram, digest), n = counted(row[x.at].astype(np.int64), x.group, x.digest)
                    yield pa.RecordBatch.from_arrays([tn.long(gram), tn.long(digest), batch.column(0).take(pa.array(first + of)), tn.long(n)], ["gram", "digest", "doc_id", "n"])

    return lean(run)


def _contexts(width: int, k: int, levels: Callable[[pa.RecordBatch], list[np.ndarray]]):
    """Contexts for the scan, equal ones of a text in one row; those that repeat as a whole: their spans, no context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crowded = levels(batch)
            for first, shift, offs, buf in pieces(batch.column(1), width):
                row, x = _contexts_of(buf, offs, width, k, crowded)
                if not len(x.at):
                    continue
                of = row[x.at]
                usual = x.digest == 0
                wanted = usual & listed(x.group, of, batch.column(3), first)
                whole = np.zeros(len(of), bool)
                if crowded:
                    wanted |= ~usual & listed(x.digest, of, batch.column(4), first)
                    whole = ~usual & listed(x.digest, of, batch.column(5), first)
                raw, seen = buf.tobytes(), {}
                y = x.take(wanted)
                for r, gram, at, lo, hi in zip(of[wanted].tolist(), y.group.view(np.int64).tolist(), y.at.tolist(), y.lo.tolist(), y.hi.tolist(), strict=True):
                    seen.setdefault((r, gram, at - lo, raw[lo : hi + width]), []).append(lo + shift - int(offs[r]))
                rows = [(r, gram, off, starts, text) for (r, gram, off, text), starts in seen.items()]
                y = x.take(whole)
                for r in np.unique(of[whole]).tolist():
                    own = of[whole] == r
                    a, b = union(y.lo[own] + shift - offs[r], y.hi[own] + width + shift - offs[r])
                    rows.append((r, int(tn.mix(np.array([r + shift, first], np.uint64))[0].view(np.int64)), 0, np.stack([a, b], axis=1).ravel().tolist(), None))
                for i in range(0, len(rows), 4096):  # keeps a batch of contexts small
                    r, gram, off, starts, text = zip(*rows[i : i + 4096], strict=True)
                    at = pa.array(np.array(r, np.int64) + first)
                    yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), batch.column(0).take(at), batch.column(2).take(at), pa.array(off, pa.int32()), pa.array(starts, pa.list_(pa.int32())), pa.array(text, pa.binary())], ["gram", "doc_id", "th", "off", "starts", "context"])

    return lean(run)


def common_lengths(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each pair."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 8192):
        x, y = a[i : i + 8192], b[i : i + 8192]
        n = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)])
        w = int(n.max(initial=0))
        if w:
            left = np.frombuffer(b"".join([p[:w].ljust(w, b"\0") for p in x]), np.uint8).reshape(len(x), w)
            right = np.frombuffer(b"".join([q[:w].ljust(w, b"\0") for q in y]), np.uint8).reshape(len(y), w)
            diff = left != right
            first = np.where(diff.any(axis=1), diff.argmax(axis=1), w)
            out[i : i + len(x)] = np.minimum(first, n)
    return out


def prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of the common-prefix intervals with depth >= least; lcp[i] is of suffixes i-1 and i, lcp[0] = 0."""
    stack: list[tuple[int, int]] = []
    for i, d in enumerate([*lcp, 0]):
        left = i - 1
        while stack and stack[-1][1] > d:
            left, depth = stack.pop()
            if depth >= least:
                yield left, i - 1, depth
        if d and (not stack or stack[-1][1] < d):
            stack.append((left, d))


def left_diverse(back: list[bytes], least: int) -> Iterator[tuple[list[int], int]]:
    """(members, extension): sets of two or more that agree on `extension` >= least bytes to the left and no more.

    back[i] is what stands before member i, reversed.  The byte before such a set's common extension differs.
    """
    some = [i for i in range(len(back)) if len(back[i]) >= least]
    if len(some) == 2:
        e = int(common_lengths([back[some[0]]], [back[some[1]]])[0]) if back[some[0]][:least] == back[some[1]][:least] else -1
        if e >= least:
            yield some, e
    elif len(some) > 2:
        some.sort(key=back.__getitem__)
        ext = [0, *common_lengths([back[i] for i in some[:-1]], [back[i] for i in some[1:]]).tolist()]
        for first, last, e in prefix_intervals(ext, max(1, least)):
            yield some[first : last + 1], e
        if not least and not min(ext[1:]):
            yield some, 0


def maximal_repeats(right: list[bytes], back: list[bytes], width: int) -> Iterator[tuple[list[int], int, int]]:
    """(members, extension, depth): the maximal repeats of `width` bytes or more around the anchors.

    Member i reads right[i] from its anchor on and back[i] before it, reversed; a repeat spans extension + depth bytes.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    if len(order) < 2:
        return
    lcp = [0, *common_lengths([right[i] for i in order[:-1]], [right[i] for i in order[1:]]).tolist()]
    for first, last, depth in prefix_intervals(lcp, max(1, width - max(map(len, back)))):
        members = order[first : last + 1]
        for own, e in left_diverse([back[i] for i in members], max(0, width - depth)):
            # Of several children of the interval: what follows differs as well.
            if len(own) == len(members) or any(d == depth for d in lcp[first + min(own) + 1 : first + max(own) + 1]):
                yield [members[i] for i in own], e, depth


def repeats(context: list[bytes], off: list[int], times: list[int], width: int) -> dict[int, list[tuple[int, int]]]:
    """Spans of contexts (of one or more grams) that occur again, by context; times: how often each row's text has it."""
    same: dict[tuple[bytes, int], list[int]] = {}
    for i, x in enumerate(zip(context, off, strict=True)):
        same.setdefault(x, []).append(i)
    out: dict[int, list[tuple[int, int]]] = {}
    for (text, _), members in same.items():
        if sum(times[i] for i in members) > 1:
            out.update((i, [(0, len(text))]) for i in members)
    own = [m[0] for m in same.values()]
    for members, e, depth in maximal_repeats([context[i][off[i] :] for i in own], [context[i][: off[i]][::-1] for i in own], width):
        for m in members:
            out.setdefault(own[m], []).append((off[own[m]] - e, off[own[m]] + depth))
    return out


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            t = t.combine_chunks()
            starts, texts, off = t.column("starts").to_pylist(), t.column("context").to_pylist(), t.column("off").to_pylist()
            at, spans = [], []
            for i, x in enumerate(texts):
                if x is None:  # known to repeat
                    at.append(i)
                    spans.append([{"start": a, "end": b} for a, b in zip(starts[i][::2], starts[i][1::2], strict=True)])
            some = [i for i, x in enumerate(texts) if x is not None]
            for i, own in repeats([texts[i] for i in some], [off[i] for i in some], [len(starts[i]) for i in some], width).items():
                n = np.array(starts[some[i]], np.int64)[:, None]
                a, b = union((n + [x for x, _ in own]).ravel(), (n + [x for _, x in own]).ravel())
                at.append(some[i])
                spans.append([{"start": p, "end": q} for p, q in zip(a.tolist(), b.tolist(), strict=True)])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().take(rows), t.column("th").combine_chunks().take(rows), pa.array(spans, SPAN_TYPE)], ["doc_id", "th", "spans"])

    return lean(run)


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, kept, spans = [], [], [], []
            copies, found, ths = batch.column(3).to_pylist(), batch.column(4), batch.column(2).to_pylist()
            for i, raw in enumerate(batch.column(1).cast(pa.binary())):
                text = raw.as_py()
                n = len(text)
                own = [(x["start"], x["end"]) for f in found[i].as_py() or [] if f["th"] == ths[i] for x in f["spans"]]
                if copies[i]:
                    own = [(0, n)] if n >= width else []
                a, b = union(np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64))
                out, at = [], 0
                for p, q in zip(a.tolist(), b.tolist(), strict=True):
                    out.append(text[at:p])
                    at = q
                out.append(text[at:])
                kept.append(b"".join(out))
                n_bytes.append(n)
                n_removed.append(n - len(kept[-1]))
                spans.append([{"start": p, "end": q} for p, q in zip(a.tolist(), b.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, SPAN_TYPE)], ["doc_id", "n_bytes", "n_removed", "kept", "spans"])

    return lean(run)


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = K, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (remaining UTF-8 bytes, binary: a cut may split a character) and spans.

    A byte goes where a string of `width` bytes over it also starts anywhere else, in the same document or another,
    judged on the input.  Null or empty texts have no bytes; repeated rows are occurrences of their own; rows with a
    null doc_id take no part and keep all; an empty table gives no rows.  spans are the maximal removed runs in bytes.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    base = id_text(docs)
    texts = by_id(base)
    named = base.filter("doc_id is not null")
    keys = lambda crowd: crowd.on(named).select("doc_id", "text", *crowd.columns()).mapInArrow(_keys(width, k, crowd.levels()), KEY)
    shared = materialise(keys(Crowd()).groupBy("gram").agg(F.sum("n").alias("m")).filter("m > 1"), "grams")
    crowd, classes = crowded_groups(keys, shared, group)
    usual = shared.select("gram", F.lit(0).cast("long").alias("digest"), F.lit(False).alias("whole"), F.lit(None).cast("long").alias("first"))
    known = usual if classes is None else usual.unionByName(classes.select("gram", "digest", (F.col("n") > 1).alias("whole"), "first"))
    hits = keys(crowd).select("gram", "digest", "doc_id").join(known, ["gram", "digest"])
    # A context of a crowded gram is scanned once, for the first document that has it.
    lists = {"usual": (F.col("digest") == 0, "gram"), "scanned": ((F.col("digest") != 0) & (F.col("doc_id") == F.col("first")), "digest"), "whole": ((F.col("digest") != 0) & F.col("whole"), "digest")}
    per_doc = hits.groupBy("doc_id").agg(*(F.collect_set(F.when(cond, F.col(c))).alias(name) for name, (cond, c) in lists.items()))
    copies = named.select("doc_id", F.md5("text").alias("digest")).join(copies_of(named), "digest")
    copies = copies.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"), F.collect_set(F.when(F.col("doc_id") > F.col("rep"), F.col("digest"))).alias("later"))
    told = crowd.on(per_doc).join(copies, "doc_id", "full")
    both = texts.join(told.withColumnRenamed("doc_id", "kid"), "kid").filter("later is null or not array_contains(later, md5(text))")
    wanted = some_named("usual") | some_named("scanned") | some_named("whole")
    rows = both.filter(wanted).select("doc_id", "text", F.xxhash64("text").alias("th"), *lists, *crowd.columns()).mapInArrow(_contexts(width, k, crowd.levels()), CONTEXT)
    spans = rows.repartition(tasks(spark), "gram").sortWithinPartitions("gram").mapInArrow(_scan(width), f"doc_id long, th long, spans {SPANS}")
    found = spans.groupBy("doc_id").agg(F.collect_list(F.struct("th", "spans")).alias("found"))
    last = texts.join(found.join(copies.select("doc_id", "digests"), "doc_id", "full").withColumnRenamed("doc_id", "kid"), "kid", "left")
    is_copy = F.coalesce(F.array_contains(only_named("digests"), F.md5("text")), F.lit(False))
    return last.select("doc_id", "text", F.xxhash64("text").alias("th"), is_copy.alias("copy"), only_named("found")).mapInArrow(_cut(width), f"doc_id long, n_bytes long, n_removed long, kept binary, spans {SPANS}")
