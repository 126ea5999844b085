"""Substring dedup over words: prefix-partitioned suffix trees.

Suffixes are word positions of whole texts; a repeat is a window of `width` words that also starts in a document with a
smaller doc_id.  Only suffixes whose first `width` words have an anchor (their smallest k-word gram, see shared.py) that
occurs in several documents can repeat; the others are left out by an exact argument, not by sampling.

The suffixes are split by what their first `width` words have in common: the anchor's gram of k words, and where that
is too frequent more words around it, up to all `width` (shared.py), so the prefix that names a group varies in length
and each group fits into memory.  Suffixes that are equal for `width` words are always in one group, so the part of the
suffix tree below that depth falls into one subtree per group.  A subtree is built by sorting its suffixes (ranks of
`width` words by prefix doubling, then the words beyond); its internal nodes are intervals of the sorted suffixes, and
those whose members differ in the word before are maximal repeats (as far as contexts reach).  A member goes where its
node holds a smaller document.

A context of a crowded gram is in one document's subtree alone; documents that hold it after the first one lose it whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import by_id, copies_of, id_text, lean, materialise, only_named, some_named, tasks
from .shared import Contexts, Crowd, anchors, counted, crowded_groups, listed, split, union

WIDTH, K = 13, 5
#: Contexts up to which the suffixes of one gram are a single group.
GROUP = 10_000
#: Bytes of contexts that a subtree pass takes at a time (whole groups).
PASS = 8 << 20

KEY = "gram long, digest long, doc_id long, n long"
CONTEXT = "gram long, doc_id long, th long, start int, end int, context string"
SPAN = "doc_id long, th long, start int, end int"


def _contexts_of(buf: np.ndarray, offs: np.ndarray, width: int, k: int, crowded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Contexts]:
    s, e, row = tn.words(buf, offs, tn.SPACE_WORD)
    h = tn.span_hashes(buf, s, e)
    g = tn.ngrams(h, k)
    at, lo, hi = anchors(g, row, k, width)
    # 48 bits name a gram: they only sort and group suffixes, whose words are compared.
    whole = Contexts(g[at] >> np.uint64(16), at, lo, hi)
    return s, e, row, split(whole, crowded, tn.hasher(h) if crowded and len(at) else None, width - k, width)


def _keys(width: int, k: int, levels: Callable[[pa.RecordBatch], list[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crowded = levels(batch)
            for first, offs, buf in tn.slices(batch.column(1)):
                _, _, row, x = _contexts_of(buf, offs, width, k, crowded)
                if len(x.at):
                    (of, gram, digest), n = counted(row[x.at], x.group, x.digest)
                    yield pa.RecordBatch.from_arrays([tn.long(gram), tn.long(digest), batch.column(0).take(pa.array(first + of)), tn.long(n)], ["gram", "digest", "doc_id", "n"])

    return lean(run)


def _contexts(width: int, k: int, levels: Callable[[pa.RecordBatch], list[np.ndarray]]):
    """Contexts for the subtrees: the words of all windows that an anchor serves; those that go whole: their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crowded = levels(batch)
            for first, offs, buf in tn.slices(batch.column(1)):
                s, e, row, x = _contexts_of(buf, offs, width, k, crowded)
                if not len(x.at):
                    continue
                of, heads = row[x.at], np.searchsorted(row, np.arange(len(offs)))
                usual = x.digest == 0
                wanted = usual & listed(x.group, of, batch.column(3), first)
                gone = np.zeros(len(of), bool)
                if crowded:
                    wanted |= ~usual & listed(x.digest, of, batch.column(4), first)
                    gone = ~usual & listed(x.digest, of, batch.column(5), first)
                y, raw = x.take(wanted), buf.tobytes()
                text = [b" ".join(raw[a:b].split()) for a, b in zip(s[y.lo].tolist(), e[y.hi + width - 1].tolist(), strict=True)]
                own, start = of[wanted], y.lo - heads[of[wanted]]
                group, end = y.group, np.zeros(len(start), np.int64)
                if gone.any():
                    y = x.take(gone)
                    a, b = union(y.lo + of[gone], y.hi + width + of[gone])  # a gap of one between texts
                    r = np.searchsorted(heads + np.arange(len(offs)), a, side="right") - 1
                    own, text = np.concatenate([own, r]), text + [None] * len(r)
                    start, end = np.concatenate([start, a - r - heads[r]]), np.concatenate([end, b - r - heads[r]])
                    group = np.concatenate([group, tn.mix((first + r).astype(np.uint64) ^ tn.mix(a.astype(np.uint64)))])
                if len(own):
                    rows = pa.array(first + own)
                    yield pa.RecordBatch.from_arrays([tn.long(group), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(text, pa.binary()).cast(pa.string())], ["gram", "doc_id", "th", "start", "end", "context"])

    return lean(run)


def ranks(ids: np.ndarray, width: int) -> np.ndarray:
    """For each position the rank of its `width` words among all such runs (prefix doubling, exact)."""
    rank, size = ids.astype(np.int64), 1
    while size < width:
        step = min(size, width - size)
        if len(rank) <= step:
            return rank[:0]
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        size += step
    return rank


class DeepTree:
    """The part of a suffix tree that lies `width` or more words deep.

    ids: word numbers of the texts one after another; row: the text of each.  at: suffixes below deep nodes, sorted;
    each of depth, first, last, maximal describes a node: its members are at[first..last], they share `depth` words, and
    it is maximal if what stands before them differs, too.
    """

    def __init__(self, ids: np.ndarray, row: np.ndarray, width: int):
        rank = ranks(ids, width)
        at = np.flatnonzero(row[: len(rank)] == row[width - 1 : width - 1 + len(rank)]) if len(rank) else np.zeros(0, np.int64)
        rank = rank[at]
        often = np.bincount(rank)[rank] > 1 if len(at) else np.zeros(0, bool)
        at, rank = at[often], rank[often]
        end = np.searchsorted(row, row[at], side="right")
        most = int((end - at).max(initial=width)) - width
        beyond = [np.where(at + width + t < end, ids[np.minimum(at + width + t, len(ids) - 1)], -1) for t in range(most)]
        order = np.lexsort([*beyond[::-1], rank]) if len(at) else at
        self.at, rank, beyond = at[order], rank[order], [b[order] for b in beyond]
        same = rank[1:] == rank[:-1]
        lcp = np.where(same, width, 0)
        for b in beyond:
            same = same & (b[1:] == b[:-1]) & (b[1:] >= 0)
            lcp += same
        before = np.where((self.at > 0) & (row[self.at - 1] == row[self.at]), ids[self.at - 1], -1 - np.arange(len(self.at)))
        nodes = []
        for d in range(width, width + most + 1):
            inside = np.concatenate([[False], lcp >= d, [False]])
            first, last = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
            equal = np.concatenate([[0], np.cumsum(lcp == d)])
            own = equal[last] > equal[first]  # else all its members share more
            nodes.append((np.full(own.sum(), d), first[own], last[own]))
        self.depth, self.first, self.last = (np.concatenate(x) for x in zip(*nodes, strict=True))
        self.maximal = self.least(before) != -self.least(-before)

    def least(self, value: np.ndarray) -> np.ndarray:
        """The smallest value of each node's members (value: by sorted suffix)."""
        if not len(self.first):
            return np.zeros(0, np.int64)
        return np.minimum.reduceat(np.append(value, value[-1]), np.stack([self.first, self.last + 1], axis=1).ravel())[::2]


def subtree(context: pa.Array, doc: np.ndarray, start: np.ndarray, th: np.ndarray, width: int) -> pa.RecordBatch:
    """Spans of members of maximal nodes that also hold a smaller document."""
    parts = pc.split_pattern(context, " ")
    ids = np.asarray(pc.dictionary_encode(parts.values).indices)
    bounds = np.asarray(parts.offsets).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    tree = DeepTree(ids, row, width)
    low = tree.least(doc[row[tree.at]])
    reach = np.zeros(len(tree.at), np.int64)
    for d in np.unique(tree.depth).tolist():  # the deepest node of a member counts
        own = np.flatnonzero(tree.maximal & (tree.depth == d))
        n = tree.last[own] - tree.first[own] + 1
        member = np.repeat(tree.first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        reach[member[np.repeat(low[own], n) < doc[row[tree.at[member]]]]] = d
    hit = np.flatnonzero(reach)
    place = tree.at[hit] + row[tree.at[hit]]  # a gap of one between contexts
    a, b = union(place, place + reach[hit])
    own = np.searchsorted(bounds + np.arange(len(bounds)), a, side="right") - 1
    begin = start[own] + a - own - bounds[own]
    return pa.RecordBatch.from_arrays([tn.long(doc[own]), tn.long(th[own]), pa.array(begin.astype(np.int32)), pa.array((begin + b - a).astype(np.int32))], ["doc_id", "th", "start", "end"])


def whole_groups(batches: Iterator[pa.RecordBatch], limit: int = PASS) -> Iterator[pa.Table]:
    """Tables of about `limit` bytes from batches sorted by their first column, never splitting a group."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            whole = pa.Table.from_batches(held)
            key = whole.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield whole.slice(0, cut)
            rest = whole.slice(cut).combine_chunks()
            held, size = rest.to_batches(), 0 if cut else rest.nbytes // 2
    if held:
        yield pa.Table.from_batches(held)


def _subtrees(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            x = t.combine_chunks().to_batches()[0]
            known = x.column("context").is_null()
            yield x.filter(known).select(["doc_id", "th", "start", "end"])
            x = x.filter(pc.invert(known))
            num = lambda c: x.column(c).to_numpy()  # noqa: E731, B023
            yield subtree(x.column("context"), num("doc_id"), num("start").astype(np.int64), num("th"), width)

    return lean(run)


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            copies, found, ths = batch.column(3).to_pylist(), batch.column(4), batch.column(2).to_pylist()
            i = 0
            for _, offs, buf in tn.slices(batch.column(1)):
                s, e, row = tn.words(buf, offs, tn.SPACE_WORD)
                edge = np.searchsorted(row, np.arange(len(offs)))
                raw = buf.tobytes()
                for r in range(len(offs) - 1):
                    n = int(edge[r + 1] - edge[r])
                    own = [(x["start"], x["end"]) for x in found[i].as_py() or [] if x["th"] == ths[i]]
                    if copies[i]:
                        own = [(0, n)] if n >= width else []
                    a, b = union(np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64))
                    words = raw[offs[r] : offs[r + 1]].split()
                    out, at = [], 0
                    for p, q in zip(a.tolist(), b.tolist(), strict=True):
                        out += words[at:p]
                        at = q
                    out += words[at:]
                    n_words.append(n)
                    n_removed.append(n - len(out))
                    kept.append(b" ".join(out))
                    spans.append([{"start": p, "end": q} for p, q in zip(a.tolist(), b.tolist(), strict=True)])
                    i += 1
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return lean(run)


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = K, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept (remaining words, joined by a space) and spans (removed word positions).

    A word goes where a window of `width` words over it also starts in a document with a smaller doc_id, judged on the
    input.  Null or empty texts have no words.  Rows with a null doc_id take no part and keep all words; rows that
    share a doc_id never remove each other's words, but each loses what smaller doc_ids hold.  Extra columns are
    ignored.
    """
    spark = docs.sparkSession
    base = id_text(docs)
    texts = by_id(base)
    named = base.filter("doc_id is not null")
    keys = lambda crowd: crowd.on(named).select("doc_id", "text", *crowd.columns()).mapInArrow(_keys(width, k, crowd.levels()), KEY)
    shared = materialise(keys(Crowd()).groupBy("gram").agg(F.count("*").alias("docs"), F.sum("n").alias("m")).filter("docs > 1").select("gram", "m"), "grams")
    crowd, classes = crowded_groups(keys, shared, group)
    usual = shared.select("gram", F.lit(0).cast("long").alias("digest"), F.lit(None).cast("long").alias("first"))
    known = usual if classes is None else usual.unionByName(classes.select("gram", "digest", "first"))
    hits = keys(crowd).select("gram", "digest", "doc_id").join(known, ["gram", "digest"])
    hot = F.col("digest") != 0
    lists = {"usual": (~hot, "gram"), "scanned": (hot & (F.col("doc_id") == F.col("first")), "digest"), "whole": (hot & (F.col("doc_id") > F.col("first")), "digest")}
    per_doc = hits.groupBy("doc_id").agg(*(F.collect_list(F.when(cond, F.col(c))).alias(name) for name, (cond, c) in lists.items()))
    copies = named.select("doc_id", F.md5("text").alias("digest")).join(copies_of(named).filter("rep < last"), "digest").filter("doc_id > rep")
    copies = copies.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))
    told = crowd.on(per_doc).join(copies, "doc_id", "full")
    both = texts.join(told.withColumnRenamed("doc_id", "kid"), "kid").filter("digests is null or not array_contains(digests, md5(text))")
    wanted = some_named("usual") | some_named("scanned") | some_named("whole")
    rows = both.filter(wanted).select("doc_id", "text", F.xxhash64("text").alias("th"), *lists, *crowd.columns()).mapInArrow(_contexts(width, k, crowd.levels()), CONTEXT)
    spans = rows.repartition(tasks(spark), "gram").sortWithinPartitions("gram").mapInArrow(_subtrees(width), SPAN)
    found = spans.groupBy("doc_id").agg(F.collect_list(F.struct("th", "start", "end")).alias("found"))
    last = texts.join(found.join(copies, "doc_id", "full").withColumnRenamed("doc_id", "kid"), "kid", "left")
    is_copy = F.coalesce(F.array_contains(only_named("digests"), F.md5("text")), F.lit(False))
    return last.select("doc_id", "text", F.xxhash64("text").alias("th"), is_copy.alias("copy"), only_named("found")).mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: int, end: int>>")
