"""Vector operators: standardisation, exact top-k search by pivots, kNN graph and classifier, hashed embeddings.

Search deals rows to pivots and sends each query to the cells that triangle inequalities cannot rule out.  Blocks of queries
meet groups of cells of bounded size, both dealt by key; a task gives the best k per query over all its cells, so only
partial results are shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, top

#: Queries of a block (at 1,000 dimensions 32 MB), most pivots, and what bounds allow for rounding.
BLOCK, PIVOTS, SLACK = 4_000, 256, 1e-9
#: Least and most rows of a group, tasks that are wanted; rows and queries that are multiplied at a time, pairs that are kept.
LEAST, MOST, TASKS, ROWS, PAIRS = 1 << 14, 1 << 18, 32, 1 << 10, 1 << 18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def moments(vectors: DataFrame, vec: str) -> DataFrame:
    """dim, mean, std (population) of each dimension."""
    return vectors.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def standardise(vectors: DataFrame, vec: str, state: DataFrame | None = None) -> DataFrame:
    """vectors with `vec` z-scored per dimension; a constant dimension becomes 0.  The state is one row of two arrays."""
    state = moments(vectors, vec) if state is None else state
    arrays = state.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("__s")).select(F.col("__s.mean").alias("__mean"), F.col("__s.std").alias("__std"))
    z = F.transform(F.col(vec), lambda x, i: F.coalesce((x.cast("double") - F.get("__mean", i)) / F.nullif(F.get("__std", i), F.lit(0.0)), F.lit(0.0)))
    return vectors.crossJoin(F.broadcast(arrays)).withColumn(vec, z).drop("__mean", "__std")


def mean_vector(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """key, vec: the mean of a key's vectors."""
    parts = rows.select(key, F.posexplode(vec).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias(vec))


def combine_layers(layers: list[Column], how: str = "avg") -> Column:
    """Element-wise combination of layer vectors: avg, sum or max."""
    out = layers[0]
    for x in layers[1:]:
        out = F.zip_with(out, x, lambda a, b: F.greatest(a, b) if how == "max" else a + b)
    return F.transform(out, lambda a: a / len(layers)) if how == "avg" else out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A row per vector of a list column."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.asarray(c.flatten()).astype(np.float64).reshape(len(c), -1) for c in parts if len(c)]
    return np.concatenate(parts) if parts else np.zeros((0, 0))


def _far(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows of x by points; from differences, without cancellation, so ties stay ties."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in points], axis=1) if len(points) else np.zeros((len(x), 0))


@dataclass(frozen=True)
class Cells:
    """Pivots with the number, the least and the largest distance of the rows that are nearest to them: what travels."""

    pivots: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    #: For each cell the groups that its rows are dealt to; none: a group of its own.
    dealt: tuple[tuple[int, ...], ...] | None = None

    def groups(self) -> tuple[tuple[int, ...], ...]:
        return self.dealt or tuple((c,) for c in range(len(self.n)))

    def grouped(self, queries: int) -> Cells:
        """The same cells in few groups of about as many rows: each gives k rows for a query, so few are wanted.

        At least LEAST and at most MOST rows a group, and between them as many as make TASKS tasks.
        """
        total = int(self.n.sum())
        wanted = max(1, -(-total // MOST), min(-(-total // LEAST), -(-TASKS // max(1, -(-queries // BLOCK)))))
        size, ends = -(-total // wanted), np.cumsum(self.n).astype(int)
        return replace(self, dealt=tuple(tuple(range((e - int(n)) // size, (e - 1) // size + 1)) for n, e in zip(self.n, ends, strict=True)))

    def bounds(self, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest distance that a row of each cell can have from each row of x."""
        far = _far(x, self.pivots)
        if metric == "dot":  # a row is its pivot and a step of at most `high`
            middle, reach = -(x @ self.pivots.T), np.sqrt((x**2).sum(axis=1))[:, None] * self.high
            return middle - reach - SLACK * (1 + np.abs(middle)), middle + reach + SLACK * (1 + np.abs(middle))
        # Triangle inequality from the pivot; and no row of a cell is nearer to another cell's pivot than to its own.
        near = np.maximum.reduce([far - self.high, self.low - far, (far - far.min(axis=1, keepdims=True)) / 2, np.zeros_like(far)])
        return near - SLACK * (1 + far), far + self.high + SLACK * (1 + far)

    def chosen(self, x: np.ndarray, metric: str, need: int, known: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """(row, cell): the cells of the least bounds that hold `need` rows; with known distances, all others in reach."""
        least, most = self.bounds(x, metric)
        for i in range(len(x)):
            order = np.argsort(most[i], kind="stable")
            enough = int(np.searchsorted(np.cumsum(self.n[order]), need)) + 1
            first = order[:enough]
            if known is None:
                yield from ((i, int(c)) for c in first)
            else:
                limit = min(known[i] + SLACK * (1 + abs(known[i])), most[i][first[-1]] if enough <= len(order) else np.inf) + 1e-6
                yield from ((i, int(c)) for c in np.flatnonzero(least[i] <= limit) if c not in first)


def _dealt(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                far = _far(_matrix(part.column(1)), pivots)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["id", "v", "cell", "far"])

    return run


def _asked(cells: Cells, metric: str, need: int, later: bool):
    """Rows (row, query_id, v, cell, part, most) for the cells that a query meets, by the groups that hold their rows.

    most: the k-th distance known so far, or infinity.  A query brings its vector once for each group.
    """
    of = cells.groups()
    number, (cell, part) = 1 + max(map(max, of)), np.array([(c, g) for c, gs in enumerate(of) for g in gs]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                known = np.nan_to_num(some.column(3).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=np.inf) if later else None
                met = np.array(list(cells.chosen(_matrix(some.column(2)), metric, need, known)), np.int64).reshape(-1, 2)
                reached = np.zeros((some.num_rows, len(of)), bool)
                reached[met[:, 0], met[:, 1]] = True
                row, unit = np.nonzero(reached[:, cell])
                order = np.argsort(row * number + part[unit], kind="stable")
                row, unit = row[order], unit[order]
                first = np.diff(row * number + part[unit], prepend=-1) != 0
                vector = some.column(2).take(pa.array(row, mask=~first))
                columns = [some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row)), vector, pa.array(cell[unit].astype(np.int32)), pa.array(part[unit].astype(np.int32)), pa.array(known[row] if later else np.full(len(row), np.inf))]
                out = pa.RecordBatch.from_arrays(columns, ["row", "query_id", "v", "cell", "part", "most"])
                yield from (out.slice(i, 2048) for i in range(0, out.num_rows, 2048))

    return run


def _best(query: np.ndarray, id_: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query, ties by id."""
    order = np.lexsort((id_, d, query))
    query, id_, d = query[order], id_[order], d[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    kept = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
    return query[kept], id_[kept], d[kept]


def _nearest(k: int, metric: str, exclude_self: bool):
    """The k nearest rows of a group to each query of a block, of those that its known k-th distance lets in.

    Products of matrices rule out the rows that are too far for certain; the distances of the others come from differences.
    A query's k-th distance falls while the rows are read, so a task keeps about k rows of each query.
    """

    def far(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.round(-(x * q).sum(axis=1) if metric == "dot" else np.sqrt(((x - q) ** 2).sum(axis=1)), 6)

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, own = queries.column("query_id").to_numpy(), rows.column("id").to_numpy()
        pool = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ids) and len(own):
            most, of = queries.column("most").to_numpy(), np.arange(len(ids))
            cells, cell = np.zeros(len(ids), np.int32), np.zeros(len(own), np.int32)
            if "row" in queries.column_names:  # a row for each cell that a query meets, one of them with its vector
                row, cells, cell = queries.column("row").to_numpy(), queries.column("cell").to_numpy(), rows.column("cell").to_numpy()
                queries = queries.filter(pc.is_valid(queries.column("v")))
                one = queries.column("row").to_numpy()
                order = np.argsort(one)
                of, ids, most = order[np.searchsorted(one[order], row)], queries.column("query_id").to_numpy(), queries.column("most").to_numpy()
            q, most = _matrix(queries.column("v")), most.copy()
            square, held = (q**2).sum(axis=1), 0
            order, by = np.argsort(cell, kind="stable"), np.argsort(cells, kind="stable")
            for c in np.unique(cell):
                asking = of[by[slice(*np.searchsorted(cells[by], [c, c + 1]))]]
                inside = order[slice(*np.searchsorted(cell[order], [c, c + 1]))]
                for i in range(0, len(inside) if len(asking) else 0, ROWS):
                    some = inside[i : i + ROWS]
                    x = _matrix(rows.column("v").take(pa.array(some)))
                    size = (x**2).sum(axis=1)
                    for j in range(0, len(asking), ROWS):
                        who = asking[j : j + ROWS]
                        limit = most[who] + 1e-6  # distances are rounded to six places
                        near = q[who] @ x.T
                        room = SLACK * (1 + square[who][:, None] + size)
                        if metric == "dot":
                            near = -near - room <= limit[:, None]
                        else:
                            near = square[who][:, None] + size - 2 * near - room <= np.where(limit < 0, -np.inf, limit**2)[:, None]
                        if exclude_self:
                            near &= ids[who][:, None] != own[some]
                        a, b = np.nonzero(near)
                        for at in range(0, len(a), PAIRS):
                            m, n = who[a[at : at + PAIRS]], b[at : at + PAIRS]
                            d = far(q[m], x[n])
                            good = d <= most[m]
                            pool.append((m[good], own[some[n[good]]], d[good]))
                            held += len(pool[-1][0])
                            if held > PAIRS + 2 * k * len(ids):
                                pool = [_best(*(np.concatenate(p) for p in zip(*pool, strict=True)), k)]
                                held = len(pool[0][0])
                                last = np.full(len(ids), -np.inf)
                                np.maximum.at(last, pool[0][0], pool[0][2])
                                full = np.bincount(pool[0][0], minlength=len(ids)) >= k
                                most[full] = last[full]
        at, id_, d = _best(*(np.concatenate(p) for p in zip(*pool, strict=True)), k)
        return pa.Table.from_arrays([pa.array(ids[at]), pa.array(id_), pa.array(d)], names=["query_id", "id", "distance"])

    return run


def _met(asked: DataFrame, rows: DataFrame, cells: Cells, run) -> DataFrame:
    """The nearest rows for asked(row, query_id, v, cell, part, most) among rows(id, v, cell): blocks of queries meet groups of rows."""
    counted = {r.part: r.n for r in asked.groupBy("part").agg(F.count("v").alias("n")).collect()}  # a number per group
    groups = cells.groups()
    blocks = F.element_at(F.array(*(F.lit(max(1, -(-counted.get(g, 0) // BLOCK))) for g in range(1 + max(map(max, groups))))), F.col("part") + 1)
    of_cell = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), F.col("cell") + 1)
    part = F.element_at(of_cell, (F.pmod(F.xxhash64("id"), F.size(of_cell)) + 1).cast("int"))
    left = asked.withColumn("q", F.pmod(F.xxhash64("query_id", "row"), blocks).cast("int"))
    right = rows.select("id", "v", "cell", part.alias("part")).filter(F.col("part").isin(list(counted))).withColumn("q", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keys = ["part", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: run(a, b), "query_id long, id long, distance double")


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec: str, metric: str = "euclidean", exclude_self: bool = False) -> DataFrame:
    """query_id, id, distance, rank: the k nearest rows of each query row; ties by id.  dot: distance is the negative.

    queries has the columns of vectors.  Exact: rows are dealt to their nearest pivot (PIVOTS rows of the least id hashes);
    each query meets the cells that hold k rows for certain, then those that its k-th distance can reach, in few groups of
    cells (see Cells.grouped).  About BLOCK queries and MOST rows meet in a task, or a cell's in the first step; the driver reads
    pivots and a few numbers of each.
    """
    kind = "array<float>" if vectors.schema[vec].dataType.simpleString() == queries.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"
    columns = [F.col(id_col).cast("long").alias("id"), F.col(vec).cast(kind).alias("v")]
    asked = queries.select(*columns).filter("id is not null and v is not null").withColumnRenamed("id", "query_id")
    data = vectors.select(*columns).filter("id is not null and v is not null")
    total = data.count()
    none = data.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("rank"))
    if not total:
        return none
    n = max(1, min(PIVOTS, math.isqrt(total)))
    pivots = data.orderBy(F.xxhash64("id"), "id").limit(n).toArrow()
    rows = materialise(data.mapInArrow(_dealt(_matrix(pivots.column("v"))), f"id long, v {kind}, cell int, far double"), "cells")
    held = {r.cell: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    order = sorted(held)
    again = {c: i for i, c in enumerate(order)}  # pivots that are copies of others hold no row
    cells = Cells(_matrix(pivots.column("v"))[order], *(np.array([held[c][f] for c in order], float) for f in ("n", "low", "high")))
    if len(order) < n:
        rows = rows.withColumn("cell", F.element_at(F.create_map(*(F.lit(x) for p in again.items() for x in p)), F.col("cell")))
    need, out = k + int(exclude_self), f"row long, query_id long, v {kind}, cell int, part int, most double"
    run, row = _nearest(k, metric, exclude_self), F.monotonically_increasing_id().alias("row")
    first = materialise(_met(asked.select(row, "query_id", "v").mapInArrow(_asked(cells, metric, need, False), out), rows, cells, run), "nearest")
    kth = top(first, ["query_id"], [F.col("distance"), F.col("id")], k).groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("most"))
    reach = kth.select(F.col("query_id").alias("of"), F.when(F.col("n") >= k, F.col("most")).alias("most"))
    few = cells.grouped(asked.count())
    more = asked.join(reach, F.col("query_id") == F.col("of"), "left").select(row, "query_id", "v", "most").mapInArrow(_asked(few, metric, need, True), out)
    later = _met(materialise(more, "reached"), rows, few, run)
    return top(first.unionByName(later), ["query_id"], [F.col("distance"), F.col("id")], k)


def search_fields(store: DataFrame, queries: DataFrame, fields: list[str], k: int) -> DataFrame:
    """query_id, field, id, score, rank: dense retrieval by dot product from vectors(field, id, vec) of each field."""
    parts = [search(store.filter(F.col("field") == f).select("id", "vec"), queries, k, "id", "vec", metric="dot").withColumn("field", F.lit(f)) for f in fields]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("query_id", "field", "id", (-F.col("distance")).alias("score"), "rank")


def classify(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, label: inverse-distance vote of neighbours(query_id, id, distance); at distance 0 only those vote."""
    x = neighbours.join(labels, "id")
    w = Window.partitionBy("query_id")
    x = x.withColumn("zero", F.min("distance").over(w) == 0).filter("not zero or distance = 0")
    votes = x.groupBy("query_id", "label").agg(F.round(F.sum(F.when(F.col("zero"), 1.0).otherwise(1 / F.col("distance"))), 6).alias("vote"))
    return top(votes, ["query_id"], [F.desc("vote"), F.col("label")], 1).drop("rank")


# A default embedder, so that every pipeline runs without a model: any callable from texts to a matrix fits.


def hashed_vectors(texts: list[str], dims: int = 64) -> np.ndarray:
    """Deterministic vectors of hashed character trigrams, of unit length (zero for blank texts)."""
    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            for g in (f"^{w}$"[j : j + 3] for j in range(len(w))):
                h = zlib.crc32(g.encode())
                out[i, h % dims] += 1 if h & 0x80000000 else -1
        n = np.linalg.norm(out[i])
        if n:
            out[i] /= n
    return out


def embed(spans: DataFrame, col: str = "span", embedder=hashed_vectors, dims: int = 64) -> DataFrame:
    """span, vec for distinct spans; blank ones never enter.  Each span is computed once, callers join the result."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(x.tolist(), dims).astype(np.float32)))

    return spans.select(F.col(col).alias("span")).filter("trim(span) <> ''").distinct().select("span", run("span").alias("vec"))
