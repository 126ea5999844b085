"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch has `size` coordinates.  Round i hashes every shingle once: in the first `size` rounds a shingle falls
into a hashed bin, in the next `size` rounds round size+j sends all shingles to bin j, so every coordinate fills.
A coordinate keeps the smallest hash of the first round that reached it; rounds stop once all are filled.

Scale: documents with equal shingle sets collapse to one class first, buckets are expanded to a star around their
smallest class instead of all pairs.  Buckets that stars leave in several components are looked at again as a whole: a
pair of different components whose sketches agree in too few coordinates is ruled out by the concentration of the sketch
(MARGIN standard deviations: at the threshold a chance of 1e-9), the rest is verified on full sets until the components
are linked, and one link for each two components leaves the task.  A bucket over CROWD members is divided into blocks:
members of its largest component meet those of others block by block, and the others each other, so every pair of
different components meets in some task and no task holds more than two blocks.  No document, link or component is
collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import id_text, lean, materialise, tasks
from .substring_dedup import whole_groups

BANDS, ROWS = 32, 4
#: Standard deviations below the expected agreement at the threshold at which a pair is ruled out.
MARGIN = 6.0
#: Members of an open bucket that meet in a task at most; larger ones are dealt in blocks of half as many.
CROWD = 4_000
U = np.uint64


def sketch(elements: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit elements."""
    out = np.zeros(size, dtype=U)
    empty = np.ones(size, dtype=bool)
    seed = tn.seeds(2 * size)
    top = ~U(0)
    for i in range(2 * size):
        v = tn.mix(elements ^ seed[i])
        if i < size:
            low = np.full(size, top, dtype=U)
            np.minimum.at(low, (v % U(size)).astype(np.int64), v // U(size))
            new = empty & (low != top)
            out[new] = tn.mix(low[new] + seed[i])
            empty &= ~new
        elif empty[i - size]:
            out[i - size] = tn.mix(v.min(keepdims=True) // U(size) + seed[i])[0]
            empty[i - size] = False
        if not empty.any():
            break
    return out


def shingle_sets(text: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingle hashes) of each row: k words, or the whole sequence where there are fewer."""
    for first, offs, buf in tn.slices(text):
        buf = tn.LOWER[buf]
        s, e, row = tn.words(buf, offs, tn.SPACE_WORD)
        h = tn.span_hashes(buf, s, e)
        grams = tn.ngrams(h, k)
        ends = np.cumsum(np.bincount(row, minlength=len(offs) - 1))
        begin = 0
        for r, end in enumerate(ends.tolist()):
            if end - begin >= k:
                yield first + r, np.unique(grams[begin : end - k + 1])
            elif end > begin:
                yield first + r, tn.mix(tn.ngrams(h[begin:end], end - begin) + np.full(1, end - begin, U))
            else:
                yield first + r, h[:0]
            begin = end


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, bands, sketches = [], [], [], [], []
            for _, x in shingle_sets(batch.column(1), k):
                n.append(len(x))
                m = tn.mix(x)
                d1.append(int(m.sum(dtype=U)))
                d2.append(int(tn.mix(m ^ U(0x5BD1E995)).sum(dtype=U)))
                if len(x):
                    c = sketch(x).reshape(BANDS, ROWS)
                    b = tn.seeds(BANDS, 7777)
                    for j in range(ROWS):
                        b = tn.mix(b + c[:, j])
                    bands.append(b.view(np.int64))
                    sketches.append((c.ravel() >> U(20)).astype("<u2").tobytes())
                else:
                    bands.append(np.zeros(0, np.int64))
                    sketches.append(b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), tn.long(np.array(n, np.int64)), tn.long(np.array(d1, U)), tn.long(np.array(d2, U)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n", "d1", "d2", "bands", "sketch"])

    return lean(run)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, x in shingle_sets(batch.column(1), k)]
            d1 = [int(tn.mix(x).sum(dtype=U)) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), tn.long(np.array(d1, U)), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["doc_id", "d1", "shingles"])

    return lean(run)


def _crossing(percent: int):
    """One verified link for each two components of an open bucket that have any.

    Pairs that sizes or sketches rule out are skipped, as are pairs that share an earlier band (its bucket has them)
    and pairs of components that this bucket has linked already; likelier pairs come first.
    """
    size, p = BANDS * ROWS, percent / 100
    least = size * p - MARGIN * (size * p * (1 - p)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            t = t.combine_chunks()
            key, band, side, x, n, c = (t.column(k).to_numpy() for k in ("key", "band", "side", "x", "n_x", "c"))
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(-1, size)
            own = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            sets = t.column("shingles").combine_chunks()
            bounds, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1]), [True]]))
            out: list[tuple[int, int]] = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                place = np.flatnonzero(own[lo] == band[lo])
                root = {int(k): int(k) for k in np.unique(c[lo:hi])}

                def find(k: int, root: dict[int, int] = root) -> int:
                    while root[k] != k:
                        root[k] = k = root[root[k]]
                    return k

                step = max(1, 100_000 // (hi - lo))
                for i in range(lo, hi, step):
                    j = slice(i, min(i + step, hi))
                    ok = (c[j, None] != c[None, lo:hi]) & (x[j, None] < x[None, lo:hi])
                    ok &= (side[j, None] != side[None, lo:hi]) | (side[j, None] == 0)
                    ok &= 100 * np.minimum(n[j, None], n[None, lo:hi]) >= percent * np.maximum(n[j, None], n[None, lo:hi])
                    p1, p2 = np.nonzero(ok)
                    p1, p2 = p1 + i, p2 + lo
                    agree = (sketches[p1] == sketches[p2]).sum(axis=1)
                    good = agree >= least
                    if len(place):
                        good &= ~(own[p1, : place[0]] == own[p2, : place[0]]).any(axis=1)
                    p1, p2, agree = p1[good], p2[good], agree[good]
                    for k in np.argsort(-agree, kind="stable").tolist():
                        u, v = int(p1[k]), int(p2[k])
                        ru, rv = find(int(c[u])), find(int(c[v]))
                        if ru == rv:
                            continue
                        both = len(np.intersect1d(flat[bounds[u] : bounds[u + 1]], flat[bounds[v] : bounds[v + 1]], assume_unique=True))
                        if 100 * both >= percent * (int(n[u]) + int(n[v]) - both):
                            root[max(ru, rv)] = min(ru, rv)
                            out.append((int(x[u]), int(x[v])))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], ["a", "b"])

    return lean(run)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), by alternating large and small stars.

    Each round is a few grouped aggregations over the links; only the number and sum of the links are read back.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        # Smallest neighbours are written: a join whose sides come straight from their shuffles can split a node of many links.
        lows = materialise(both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lows")
        large = both(edges).filter("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = materialise(large.filter("a > b"), "stars")
        lows = materialise(down.groupBy("a").agg(F.min("b").alias("m")), "lows")
        edges = materialise(down.join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lows.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "links")
    own = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.union(edges.select(F.col("b"), F.col("b"))).groupBy("node").agg(F.min("component").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text).

    Words are runs of non-white-space (ASCII) after lower-casing A-Z.  Two documents are linked where
    100 * |intersection| >= percent * |union| of their k-word shingle sets, compared as 64-bit hashes.
    Candidates share one of 32 bands of 4 coordinates: a pair at 0.8 is missed with probability 5e-8.
    Null or empty texts have no shingles and form components of their own; rows that share a doc_id are one document, so
    what is linked to one of them is linked to all; null doc_ids get a null component and are kept; an empty table gives
    no rows.  Extra columns are ignored.
    """
    base = id_text(docs)
    sig = materialise(base.mapInArrow(_signatures(k), "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch binary"), "sketches")
    key = ["n", "d1", "d2"]
    some = sig.filter("n > 0 and doc_id is not null")
    classes = some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "classes")
    # A class is named by its smallest doc_id; where ids are repeated, d1 tells classes of one name apart.
    member = classes.select("rep", "n", "d1", F.explode("bands").alias("band"))
    hubs = member.groupBy("band").agg(F.min(F.struct("rep", "n", "d1")).alias("hub"), F.count("*").alias("size")).filter("size > 1").select("band", F.col("hub.rep").alias("a"), F.col("hub.n").alias("n_a"), F.col("hub.d1").alias("d_a"))
    hubs = materialise(hubs, "hubs")  # so that the join can split a band of many members
    bucket = materialise(member.join(hubs, "band").select("band", "a", "n_a", "d_a", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("d1").alias("d_b")), "buckets")

    near_in_size = F.lit(100) * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    star = bucket.filter(((F.col("a") != F.col("b")) | (F.col("d_a") != F.col("d_b"))) & near_in_size).select("a", "d_a", "b", "d_b").distinct()
    sets = _shingles_of(base, bucket.select(F.col("b").alias("rep"), F.col("d_b").alias("d1")).distinct(), k)
    links = materialise(_similar(star, sets, percent), "verified").unionByName(_same_document(some, classes))
    comp = materialise(components(links), "components")

    # What stars leave apart inside a bucket.
    near = bucket.join(comp.select(F.col("node").alias("b"), "component"), "b", "left").select("band", F.col("b").alias("x"), F.col("d_b").alias("d1"), F.col("n_b").alias("n_x"), F.coalesce("component", F.col("b")).alias("c"))
    open_ = materialise(near.join(materialise(_open_buckets(near), "parted"), "band").join(classes.select(F.col("rep").alias("x"), "d1", "bands", "sketch"), ["x", "d1"]), "open")
    rows = _dealt(open_, crowd).join(sets.withColumnRenamed("rep", "x"), ["x", "d1"]).select("key", "band", "side", "x", "n_x", "c", "sketch", "bands", "shingles")
    more = rows.repartition(tasks(docs.sparkSession), "key").sortWithinPartitions("key", "band").mapInArrow(_crossing(percent), "a long, b long")
    more = materialise(more.distinct(), "crossing")
    if not more.isEmpty():
        comp = materialise(components(links.unionByName(more)), "components")

    final = classes.select(*key, "rep").join(comp, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", *key).join(final, key, "left")
    cid = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), cid).alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))


def _same_document(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the names of classes that rows of one doc_id are in (none where ids are not repeated)."""
    row = some.select("doc_id", "n", "d1", "d2", F.xxhash64("n", "d1", "d2").alias("h"))
    again = materialise(row.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("doc_id"), "repeated")
    found = row.join(again, "doc_id").join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"])
    return found.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()


def _open_buckets(near: DataFrame) -> DataFrame:
    """band, m (members), giant (its largest component), m_giant of the buckets that hold several components."""
    parts = near.groupBy("band", "c").agg(F.count("*").alias("n"))
    found = parts.groupBy("band").agg(F.sum("n").alias("m"), F.count("*").alias("parts"), F.max(F.struct("n", "c")).alias("most"))
    return found.filter("parts > 1").select("band", "m", F.col("most.c").alias("giant"), F.col("most.n").alias("m_giant"))


def _dealt(open_: DataFrame, crowd: int) -> DataFrame:
    """Members with `key`, the group that they meet in, and `side`: 0 meets all of the group, 1 and 2 only each other.

    Up to crowd members a bucket is one group.  Beyond, its members are in blocks of crowd // 2: each block of the largest
    component (side 1) meets each block of the rest (side 2), and the blocks of the rest meet in pairs.
    """
    half = max(1, crowd // 2)
    blocks = lambda n: F.ceil(n / half).cast("int")
    group = lambda *parts: F.xxhash64("band", *parts)
    small = open_.filter(F.col("m") <= crowd).select("*", group(F.lit(-1)).alias("key"), F.lit(0).alias("side"))
    big = open_.filter(F.col("m") > crowd).withColumn("g", blocks(F.col("m_giant"))).withColumn("s", blocks(F.col("m") - F.col("m_giant")))
    big = big.withColumn("block", F.pmod(F.xxhash64("x", "d1"), F.when(F.col("c") == F.col("giant"), F.col("g")).otherwise(F.col("s"))).cast("int"))
    inside = big.filter("c = giant").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    outside = big.filter("c <> giant").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rest = big.filter("c <> giant").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    parts = [
        inside.withColumn("key", group("block", "other")).withColumn("side", F.lit(1)),
        outside.withColumn("key", group("other", "block")).withColumn("side", F.lit(2)),
        rest.withColumn("key", group(F.lit(-2), F.least("block", "other"), F.greatest("block", "other"))).withColumn("side", F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)),
    ]
    out = small
    for p in parts:
        out = out.unionByName(p.select(small.columns))
    return out


def _shingles_of(base: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep, d1, shingles: the shingle hashes of the classes that are in some bucket, from a document of each name."""
    found = base.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(k), "doc_id long, d1 long, shingles array<long>")
    return materialise(found.withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "d1"]), "shingles")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b): the pairs whose full sets are similar.  Each member's set goes to its hub, never a hub's to all."""
    x, y = sets.select(F.col("rep").alias("a"), F.col("d1").alias("d_a"), F.col("shingles").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("d1").alias("d_b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(y, ["b", "d_b"]).join(x, ["a", "d_a"]).select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("both"))
    return found.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document (the smallest doc_id) of each near-duplicate component; columns unchanged."""
    gone = near_duplicates(docs, k, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
