"""Benchmark decontamination by winnowing.

Both sides are fingerprinted alike: the minimum k-gram hash of every run of 13 - k + 1 consecutive k-grams, so a shared
span of 13 words always shares a fingerprint.  An item of fewer words is one window, looked up by the hash of its whole
sequence among all grams of that length.  A hit is extended to whole windows of words, which are compared as text, so
hash collisions never count.

The fingerprints travel to the tasks with the function only if the benchmark is proven small (MAX_WORDS).  Beyond that
texts and items meet in joins: first on fingerprints, then the windows of texts around shared fingerprints on the windows
themselves.  Either way each row is judged by its own text, with the same result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import id_text, lean, materialise

WINDOW, K = 13, 5
#: Words of the benchmark up to which its windows travel with the function (about 100 bytes a word).
MAX_WORDS = 500_000

OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: int, end: int>>, items array<string>"


class Windows:
    """The windows of some items: by word sequence, with fingerprints by which texts are scanned."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]]):
        self.of: dict[bytes, set[str]] = defaultdict(set)
        grams: dict[int, set[bytes]] = defaultdict(set)
        for item, words in items:
            n = min(WINDOW, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                self.of[b" ".join(words[i : i + n])].add(item)
            if n:
                grams[n].add(b" ".join(words))
        self.sizes = sorted(grams)
        #: Winnowed fingerprints for whole windows; for shorter items the hash of their whole sequence.
        self.prints = {n: np.unique(np.concatenate([winnow(_hashes(x), n) for x in texts])) for n, texts in grams.items()}


def _hashes(text: bytes) -> np.ndarray:
    buf = np.frombuffer(text, dtype=np.uint8)
    s, e, _ = tn.words(buf, np.array([0, len(buf)]), tn.ALNUM_WORD)
    return tn.span_hashes(buf, s, e)


def winnow(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of a word-hash sequence for windows of n words."""
    if n < WINDOW:
        return tn.ngrams(h, n)
    g = tn.ngrams(h, K)
    at = tn.minimizers(g, np.zeros(len(g), np.int8), WINDOW - K + 1)
    return g[np.unique(at)]


def fingerprints(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(word positions, fingerprints, gram length) of a batch of texts for windows of n words."""
    k = K if n == WINDOW else n
    g = tn.ngrams(h, k)
    same = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
    if n == WINDOW:
        at = tn.minimizers(g, row, WINDOW - K + 1) if len(g) else np.zeros(0, np.int64)
        # a window of k-grams must lie in one text: its last word, too
        if len(at):
            last = np.arange(len(at)) + WINDOW - 1
            at = at[(at >= 0) & (row[: len(at)] == row[np.minimum(last, len(row) - 1)])]
        at = np.unique(at)
    else:
        at = np.flatnonzero(same)
    return at, g[at], k


def _report(item_words: Windows, text: bytes, s: np.ndarray, e: np.ndarray, near: dict[int, np.ndarray]) -> tuple[int, list, list]:
    """Extend hits: exact windows around the word positions in near[n] (relative to the text's first word)."""
    words = [text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    spans, items = [], set()
    for n, at in near.items():
        starts = sorted({i for p in at.tolist() for i in range(max(0, p - (n - 1)), min(p, len(words) - n) + 1)})
        for i in starts:
            found = item_words.of.get(b" ".join(words[i : i + n]))
            if found:
                items |= found
                spans.append((i, i + n))
    merged = _merged(spans)
    return sum(b - a for a, b in merged), merged, sorted(items)


def _merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _row(n: int, hit: int, spans: list, items: list) -> tuple:
    return (n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 20 * hit >= n, [{"start": a, "end": b} for a, b in spans], items)


def _batch(doc_id: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([doc_id, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", *names])


def _scan(found: Windows):
    """Fingerprint, look up, extend: all within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows: list[tuple] = []
            for _, offs, buf in tn.slices(batch.column(1)):
                buf = tn.LOWER[buf]
                s, e, row = tn.words(buf, offs, tn.ALNUM_WORD)
                h = tn.span_hashes(buf, s, e)
                ends = np.cumsum(np.bincount(row, minlength=len(offs) - 1))
                heads = ends - np.bincount(row, minlength=len(offs) - 1)
                hits: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
                for n in found.sizes:
                    at, prints, _ = fingerprints(h, row, n)
                    at = at[np.isin(prints, found.prints[n])]
                    for r in np.unique(row[at]).tolist():
                        hits[r][n] = at[row[at] == r] - heads[r]
                for r in range(len(offs) - 1):
                    n = int(ends[r] - heads[r])
                    if r in hits:
                        x = slice(int(heads[r]), int(ends[r]))
                        rows.append(_row(n, *_report(found, bytes(buf[offs[r] : offs[r + 1]]), s[x] - offs[r], e[x] - offs[r], hits[r])))
                    else:
                        rows.append((n, 0, 0, clean, False, [], []))
            yield _batch(batch.column(0), rows)

    return run


def _words_of(text: str) -> list[bytes]:
    buf = tn.LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    s, e, _ = tn.words(buf, np.array([0, len(buf)]), tn.ALNUM_WORD)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def overlaps(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per row of docs(doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    benchmark(item_id, text).  Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z; a
    window is 13 consecutive words of an item, or the whole of a shorter one.  Null or empty texts have no words and
    are never contaminated; items without words or without an id never occur; repeated items count once; extra columns
    are ignored.  spans are word positions.
    """
    base, items = id_text(docs), _items(benchmark)
    found = _windows(items, max_words)
    if found is not None:
        return base.mapInArrow(lean(_scan(found)), OUT)
    keyed = base.withColumn("key", F.md5("text"))
    rows = keyed.join(_hits(keyed.select("key", "text"), items), "key", "left")
    return rows.select("doc_id", "text", "hits", "items").mapInArrow(lean(_judge), OUT)


def _windows(items: DataFrame, max_words: int) -> Windows | None:
    """The items' windows if they can't have more than max_words words, or none."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 2 * max_words:  # a word takes two characters with what separates it
        return None
    return Windows((i, _words_of(t)) for i, t in items.select("item", "text").toLocalIterator())


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(benchmark["item_id"].cast("string").alias("item"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text")).filter("item is not null").distinct()


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, size and text of each window of the items."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = _words_of(text)
            n = min(WINDOW, len(words))
            found = sorted({b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}) if n else []
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()), pa.array(found, pa.binary()).cast(pa.string())], ["item", "size", "window"])


def _prints(text: pa.Array, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """(first row, offsets, bytes, word starts, word ends, row of each word, [(size, positions, prints, gram length)])."""
    for first, offs, buf in tn.slices(text):
        buf = tn.LOWER[buf]
        s, e, row = tn.words(buf, offs, tn.ALNUM_WORD)
        h = tn.span_hashes(buf, s, e)
        found = []
        for n in sizes:
            at, prints, k = fingerprints(h, row, n)
            found.append((n, at, tn.mix(prints + np.uint64(n)), k))
        yield first, offs, buf, s, e, row, found


def _text_prints(sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, _, _, _, row, found in _prints(batch.column(1), sizes):
                for _, at, prints, _ in found:
                    if len(at):
                        pair = np.unique(np.stack([first + row[at], prints.view(np.int64)], axis=1), axis=0)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair[:, 0])), tn.long(pair[:, 1])], ["key", "print"])

    return lean(run)


def _candidates(sizes: list[int]):
    """Windows of a text around the fingerprints that it shares with items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(2)
            for first, _, buf, s, e, row, found in _prints(batch.column(1), sizes):
                raw, count = buf.tobytes(), np.bincount(row)
                ends = np.cumsum(count)
                for n, at, prints, k in found:
                    for r in np.unique(row[at]).tolist():
                        own = row[at] == r
                        hit = at[own][np.isin(prints[own].view(np.int64), np.asarray(shared[first + r].as_py(), np.int64))]
                        lo, hi = int(ends[r] - count[r]), int(ends[r]) - n
                        starts = sorted({i for p in hit.tolist() for i in range(max(lo, p - (n - k)), min(p, hi) + 1)})
                        windows = [b" ".join(raw[a:b] for a, b in zip(s[i : i + n].tolist(), e[i : i + n].tolist(), strict=True)) for i in starts]
                        if starts:
                            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[first + r].as_py()] * len(starts), pa.string()), pa.array([n] * len(starts), pa.int32()), pa.array([i - lo for i in starts], pa.int32()), pa.array(windows, pa.binary()).cast(pa.string())], ["key", "size", "start", "window"])

    return lean(run)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        counts: list[int] = []
        for _, offs, buf in tn.slices(batch.column(1)):
            _, _, row = tn.words(tn.LOWER[buf], offs, tn.ALNUM_WORD)
            counts += np.bincount(row, minlength=len(offs) - 1).tolist()
        for n, hits, items in zip(counts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            merged = _merged((x["start"], x["start"] + x["size"]) for x in hits or [])
            rows.append(_row(n, sum(b - a for a, b in merged), merged, sorted(items or [])))
        yield _batch(batch.column(0), rows)


def _hits(texts: DataFrame, items: DataFrame) -> DataFrame:
    """key, hits, items of the texts (key, text) that hold windows: the way for benchmarks of any size."""
    theirs = materialise(items.select("item", "text").mapInArrow(lean(_item_windows), "item string, size int, window string"), "windows")
    sizes = sorted(r.size for r in theirs.select("size").distinct().collect())  # at most WINDOW numbers
    prints = materialise(theirs.select(F.lit("").alias("key"), "window").mapInArrow(_text_prints(sizes), "key string, print long").select("print").distinct(), "prints")
    # Texts that share a print, once each; a print that very many hold is split by the engine.
    shared = texts.mapInArrow(_text_prints(sizes), "key string, print long").join(prints, "print").groupBy("key").agg(F.collect_set("print").alias("prints"))
    held = texts.join(materialise(shared, "shared"), "key").dropDuplicates(["key"])
    near = materialise(held.select("key", "text", "prints").mapInArrow(_candidates(sizes), "key string, size int, start int, window string"), "near")
    hits = near.join(theirs.select("size", "window").distinct(), ["size", "window"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("hits"))
    found = near.select("key", "size", "window").distinct().join(theirs, ["size", "window"]).groupBy("key").agg(F.collect_set("item").alias("items"))
    return materialise(hits.join(found, "key"), "held")


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """docs without contaminated rows; columns unchanged.

    Each row is judged by its own text: rows with a null doc_id or with one that others have, too.  Null or empty texts
    stay; an empty table stays empty.
    """
    items = _items(benchmark)
    found = _windows(items, max_words)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    if found is not None:
        scan = _scan(found)

        @F.pandas_udf("boolean")
        def contaminated(texts: pd.Series) -> pd.Series:
            text = pa.array(texts, pa.string())
            batch = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text], ["doc_id", "text"])
            return next(scan(iter([batch]))).column("contaminated").to_pandas()

        return docs.filter(~contaminated(text))
    keyed = docs.select(F.md5(text).alias("key"), text.alias("text"))
    held = keyed.join(_hits(keyed, items), "key").dropDuplicates(["key"])
    judged = held.select(F.col("key").alias("doc_id"), "text", "hits", "items").mapInArrow(lean(_judge), OUT.replace("doc_id long", "doc_id string"))
    bad = judged.filter("contaminated").select(F.col("doc_id").alias("bad_key"))
    return docs.join(bad, F.md5(text) == bad["bad_key"], "left_anti")
