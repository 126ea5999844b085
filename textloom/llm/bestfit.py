"""Best-fit packing by minimum bin slack.

Pieces of documents are dealt by hash into groups of about GROUP pieces (light rows: no token travels), and each group
is packed on its own.  Per bin: the largest piece left is placed, a bitset subset-sum dynamic programme over the lengths
still available finds the fullest feasible combination for the rest, and that combination is removed.  Full pieces are
sequences already.  A group leaves at most its last bins unfilled, so the loss does not grow with the data.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, lean, materialise
from .tokens import END, encoder

CAPACITY = 4096
GROUP = 40_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard long"


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, copies) of a combination with the largest total <= capacity."""
    reach, layers, target, mask = 1, [], 1 << capacity, (1 << (capacity + 1)) - 1
    for length in counts:
        copies = min(counts[length], capacity // length)
        if copies <= 0:
            continue
        layers.append((length, copies, reach))
        step = 1
        while copies > 0:
            take = min(step, copies)
            reach |= (reach << (length * take)) & mask
            copies -= take
            step *= 2
        if reach & target:
            break
    total, out = reach.bit_length() - 1, []
    for length, copies, before in reversed(layers):
        used = 0
        while not (before >> total) & 1:
            total -= length
            used += 1
        assert used <= copies
        if used:
            out.append((length, used))
    return out


def minimum_bin_slack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions in lengths; lengths are in 1..capacity."""
    places: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        places.setdefault(lengths[i], []).append(i)
    counts = {n: len(places[n]) for n in sorted(places, reverse=True)}  # kept in descending order
    bins = []
    while counts:
        largest = next(iter(counts))
        parts = [(largest, 1)]
        counts[largest] -= 1
        if not counts[largest]:
            del counts[largest]
        if largest < capacity:
            more = fullest(counts, capacity - largest)
            for n, used in more:
                counts[n] -= used
                if not counts[n]:
                    del counts[n]
            parts += more
        bins.append([places[n].pop() for n, used in parts for _ in range(used)])
    return bins


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        code = encoder(path)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc, raw in zip(ids, code.ids(batch.column(1)), strict=True):
                raw += END
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), (task << 32) + serial))
                    serial += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "piece", "start", "length", "ids_crc32", "shard"])
        code.forget()

    return lean(run)


def _packed(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["shard"], kind="stable").reset_index(drop=True)
        length = frame["length"].tolist()
        sequence, offset = [0] * len(length), [0] * len(length)
        first = int(frame["group"].iloc[0]) << 32
        for b, members in enumerate(minimum_bin_slack(length, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = first + b, at
                at += length[i]
        return frame.assign(sequence_id=sequence, offset=offset).drop(columns=["group", "shard"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """A row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are the tokenizer's and a closing 1; only documents over `capacity` ids are cut.  Null or empty
    texts give one piece of one id; repeated rows are packed each; null doc_ids stay null; an empty table gives no
    rows.  Extra columns are ignored.  The bins of any two groups are numbered apart.
    """
    pieces = materialise(id_text(docs).mapInArrow(_pieces(tokenizer_path, capacity), PIECES), "pieces")
    n = pieces.filter(F.col("length") < capacity).count()
    groups = max(1, math.ceil(n / group))
    own = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("shard")).withColumn("offset", F.lit(0).cast("long")).drop("shard")
    rest = pieces.filter(F.col("length") < capacity).withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return rest.groupBy("group").applyInPandas(_packed(capacity), schema).unionByName(own)
