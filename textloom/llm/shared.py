"""Anchors: content-chosen positions by which repeated windows of texts are found without shuffling every window.

Of each window (`width` units: words or bytes) the leftmost smallest k-gram hash is its anchor.  Equal windows have
equal anchors at equal offsets, so a window can only repeat if the hash of its anchor occurs again.

The windows that an anchor serves, taken together, are its context.  Contexts meet by group, which is the anchor's gram
as long as at most `most` contexts hold it.  A gram above that is crowded: its contexts carry a digest, equal ones are
counted by partial aggregation, and one of them stands for all.  Where a group still holds more than `most` different
contexts, it is split: the windows are divided by where their anchor lies, each half again is one context, and its group
is what all its windows have in common, a longer string.  After a few halvings that string is a whole window, of which
there is one context alone.  So no group grows with the data, and nothing is left out.

Crowded groups travel to the tasks while they are few (CROWDED); what is found beyond that is written as a table of the
crowded groups that each document holds, and comes to the texts by a join.  Contexts are the same either way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import materialise

U = np.uint64
#: Crowded groups of all levels that travel to the tasks at most (8 bytes each).
CROWDED = 2_000_000


@dataclass
class Crowd:
    """Crowded groups by level: the first levels as lists; `marked` further ones as marks (doc_id, hot), where hot holds a list
    for each level of the groups in that document."""

    lists: list[np.ndarray] = field(default_factory=list)
    marked: int = 0
    marks: DataFrame | None = None

    def on(self, texts: DataFrame) -> DataFrame:
        """texts with the marks of their doc_id."""
        return texts if self.marks is None else texts.join(self.marks, "doc_id", "left")

    def columns(self) -> list[str]:
        return [] if self.marks is None else ["hot"]

    def levels(self) -> Callable[[pa.RecordBatch], list[np.ndarray]]:
        """The crowded groups that matter to a batch, by level: a function that tasks can hold."""
        lists, marked = self.lists, self.marked

        def of(batch: pa.RecordBatch) -> list[np.ndarray]:
            if not marked:
                return lists
            flat = batch.column(batch.schema.get_field_index("hot")).flatten()
            own = [np.unique(flat.take(pa.array(np.arange(i, len(flat), marked))).flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(U) for i in range(marked)]
            return lists + own if lists or len(own[0]) else []

        return of


def anchors(grams: np.ndarray, unit_row: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor positions, first and last window start that each serves).

    grams: hashes of the k-grams of a batch; unit_row: the text of each unit.  An anchor's windows are consecutive.
    """
    n = len(unit_row) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    at = tn.minimizers(grams, unit_row, width - k + 1)[:n]
    at = np.where(unit_row[:n] == unit_row[width - 1 : width - 1 + n], at, -1)
    new = np.flatnonzero((at >= 0) & np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.flatnonzero((at >= 0) & np.concatenate([at[1:] != at[:-1], [True]]))
    return at[new], new, ends


def counted(*cols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, ordered by the first, and how often each occurs."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    heads = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])) if len(order) else order
    return [c[heads] for c in cols], np.diff(np.append(heads, len(order)))


def listed(own: np.ndarray, row: np.ndarray, lists: pa.Array, first: int) -> np.ndarray:
    """Whether each value of `own` (its row ascending) is in the list of its row."""
    flat, bounds = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
    out = np.zeros(len(own), bool)
    order = np.argsort(row, kind="stable")
    rows, heads = np.unique(row[order], return_index=True)
    for r, x in zip(rows.tolist(), np.split(order, heads[1:]), strict=True):
        out[x] = np.isin(own[x], flat[bounds[first + r] : bounds[first + r + 1]])
    return out


class Contexts:
    """Contexts of a batch: group, digest (0: not crowded), anchor position, first and last window start."""

    def __init__(self, group: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.group, self.digest, self.at, self.lo, self.hi = group, np.zeros(len(at), U), at, lo, hi

    def take(self, which: np.ndarray) -> Contexts:
        out = Contexts(self.group[which], self.at[which], self.lo[which], self.hi[which])
        out.digest = self.digest[which]
        return out


def joined(parts: list[Contexts]) -> Contexts:
    out = Contexts(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("group", "at", "lo", "hi")))
    out.digest = np.concatenate([p.digest for p in parts])
    return out


def split(whole: Contexts, crowded: list[np.ndarray], span_hash: Callable[[np.ndarray, np.ndarray], np.ndarray], reach: int, width: int) -> Contexts:
    """Contexts with crowded groups treated: crowded[0] holds grams, crowded[i] groups that i - 1 halvings left too large.

    span_hash(starts, ends) names the units between; reach is the farthest that an anchor lies from its window's start.
    """
    if not crowded or not len(whole.at):
        return whole
    hot = np.isin(whole.group, crowded[0])
    done, ranges = [whole.take(~hot)], [(whole.take(hot), 0, reach)]
    for groups in crowded[1:]:
        halves = []
        for x, a, b in ranges:
            deep = np.isin(x.group, groups) if a < b else np.zeros(len(x.at), bool)
            halves.append((x.take(~deep), a, b))
            x, mid = x.take(deep), (a + b) // 2
            for p, q in ((a, mid), (mid + 1, b)):
                lo, hi = np.maximum(x.lo, x.at - q), np.minimum(x.hi, x.at - p)
                some = lo <= hi
                at = x.at[some]
                group = tn.mix(x.group[some] ^ span_hash(at - p, at - q + width)) if len(at) else at.astype(U)
                halves.append((Contexts(group, at, lo[some], hi[some]), p, q))
        ranges = halves
    for x, _, _ in ranges:
        if len(x.at):
            x.digest = tn.mix(span_hash(x.lo, x.hi + width) + tn.mix((x.at - x.lo).astype(U))) | U(1)
        done.append(x)
    return joined(done)


def crowded_groups(keys_of: Callable[[Crowd], DataFrame], shared: DataFrame, most: int) -> tuple[Crowd, DataFrame | None]:
    """(crowded groups, their different contexts: gram, digest, n, first); none where no gram is crowded.

    keys_of(crowd) gives gram, digest, doc_id, n; shared has gram, m.  A gram is crowded above `most` occurrences, a group
    above `most` different contexts, at any size of the corpus.
    """
    crowd, classes = Crowd(), None
    found = shared.filter(F.col("m") > most).select("gram")
    while True:
        room = CROWDED - sum(map(len, crowd.lists))
        some = _longs(found.limit(room + 1)) if not crowd.marked else None
        if some is not None and len(some) <= room:
            if not len(some):
                return crowd, classes
            crowd = Crowd([*crowd.lists, some])
        else:
            found = materialise(found, "crowded")
            if found.isEmpty():
                return crowd, classes
            crowd = _marked(crowd, keys_of(crowd).filter("digest = 0" if classes is None else "digest <> 0"), found)
        classes = materialise(keys_of(crowd).filter("digest <> 0").groupBy("gram", "digest").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first")), "contexts")
        found = classes.groupBy("gram").agg(F.count("*").alias("m")).filter(F.col("m") > most).select("gram")


def _marked(crowd: Crowd, keys: DataFrame, found: DataFrame) -> Crowd:
    """The crowd with one more level of marks: the found groups that each document holds."""
    new = keys.select("gram", "doc_id").join(found, "gram").groupBy("doc_id").agg(F.collect_set("gram").alias("level"))
    if crowd.marks is None:
        marks = new.select("doc_id", F.array("level").alias("hot"))
    else:  # documents of a further level are among those of the levels before it
        level = F.coalesce("level", F.array().cast("array<long>"))
        marks = crowd.marks.join(new, "doc_id", "left").select("doc_id", F.concat("hot", F.array(level)).alias("hot"))
    return Crowd(crowd.lists, crowd.marked + 1, materialise(marks, "marks"))


def _longs(df: DataFrame) -> np.ndarray:
    return np.sort(df.toPandas().iloc[:, 0].to_numpy(dtype=np.int64)).view(U)


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([new[1:], [True]])
    return s[new], e[last]
