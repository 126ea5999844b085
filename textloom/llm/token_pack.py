"""Token-id sequences for training: best-fit-decreasing packing with a segment tree over free capacities.

A task tokenizes its documents, splits those that exceed the capacity losslessly, and packs every POOL tokens of them
by best-fit decreasing: a segment tree holds how many open bins have each free capacity, so the tightest bin that
takes a piece is found in O(log capacity).  No row is shuffled; what a pool leaves unfilled is at most the tail of its
last bins.  Sequences carry a fixed-width id row (padded with `pad`), cumulative segment lengths and positions that
restart at 0 in each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textnum as tn
from .common import id_text, lean
from .tokens import END, encoder

CAPACITY = 4096
#: Tokens that a task gathers before it packs (4 bytes each).
POOL = 8_000_000
#: Bytes of text that are encoded at a time (a longer text by itself).
PORTION = 2 << 20

SCHEMA = "sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class FreeCapacity:
    """Open bins by free capacity 0..capacity; tightest(n) finds one with the least free capacity >= n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, free: int, by: int) -> None:
        i = self.size + free
        while i:
            self.tree[i] += by
            i >>= 1

    def add(self, free: int, which: int) -> None:
        self.bins[free].append(which)
        self._change(free, 1)

    def tightest(self, n: int) -> tuple[int, int] | None:
        """(free, bin), taken out of the tree."""
        tree, i = self.tree, self.size + n
        while not tree[i]:
            while i & 1:  # nothing more below this parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        free = i - self.size
        which = self.bins[free].pop()
        self._change(free, -1)
        return free, which


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in lengths (each in 1..capacity)."""
    free, bins = FreeCapacity(capacity), []
    for i in sorted(range(len(lengths)), key=lambda j: (-lengths[j], j)):
        found = free.tightest(lengths[i])
        if found is None:
            found = (capacity, len(bins))
            bins.append([])
        bins[found[1]].append(i)
        free.add(found[0] - lengths[i], found[1])
    return bins


def _rows(pool: list[tuple[int, int, bytes]], capacity: int, first: int, pad: int) -> Iterator[pa.RecordBatch]:
    bins = best_fit_decreasing([len(raw) // 4 for _, _, raw in pool], capacity)
    for at in range(0, len(bins), 256):
        out: list[list] = [[] for _ in range(8)]
        for b, members in enumerate(bins[at : at + 256], first + at):
            length = np.array([len(pool[i][2]) // 4 for i in members])
            ends = np.cumsum(length)
            n = int(ends[-1])
            ids = np.full(capacity, pad, dtype="<u4")
            ids[:n] = np.frombuffer(b"".join(pool[i][2] for i in members), dtype="<u4")
            positions = np.zeros(capacity, dtype="<u4")
            positions[:n] = np.arange(n) - np.repeat(ends - length, length)
            row = (b, n, len(members), [pool[i][0] for i in members], [pool[i][1] for i in members], [0, *ends.tolist()], ids.tobytes(), positions.tobytes())
            for col, x in zip(out, row, strict=True):
                col.append(x)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["sequence_id", "n_tokens", "n_segments", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids"])


def _sequences(path: str, capacity: int, pool_tokens: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, first = encoder(path), TaskContext.get().partitionId() << 40
        pool: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            texts = batch.column(1)
            for at, offs, _ in tn.slices(texts, PORTION):
                n = len(offs) - 1
                for doc, raw in zip(batch.column(0).slice(at, n).to_pylist(), code.ids(texts.slice(at, n)), strict=True):
                    raw += END
                    pool += [(doc, i // 4, raw[i : i + 4 * capacity]) for i in range(0, len(raw), 4 * capacity)]
                    size += len(raw) // 4
                if size >= pool_tokens:
                    yield from _rows(pool, capacity, first, pad)
                    first += len(pool)
                    pool, size = [], 0
        if pool:
            yield from _rows(pool, capacity, first, pad)
        code.forget()

    return lean(run)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, pool_tokens: int = POOL, pad: int = 0) -> DataFrame:
    """A row per packed sequence of docs(doc_id, text).

    input_ids and position_ids are `capacity` little-endian unsigned 32-bit numbers; segment j spans
    cu_seqlens[j]..cu_seqlens[j+1], comes from doc_ids[j] and begins at that document's id starts[j].  Each document
    ends with id 1.  Null or empty texts are a segment of that id alone; repeated rows are packed each; null doc_ids
    stay null; an empty table gives no rows.  Extra columns are ignored.
    """
    return id_text(docs).mapInArrow(_sequences(tokenizer_path, capacity, pool_tokens, pad), SCHEMA)


def write(sequences_df: DataFrame, path: str) -> None:
    """The packed matrices as Parquet: one fixed-width row per sequence."""
    sequences_df.write.option("compression", "zstd").parquet(path)


def matrix(rows: pa.Table, column: str = "input_ids") -> np.ndarray:
    """The ids (or positions) of written sequences as a matrix: a row per sequence."""
    raw = rows.column(column).to_pylist()
    return np.frombuffer(b"".join(raw), "<u4").reshape(len(raw), -1)
