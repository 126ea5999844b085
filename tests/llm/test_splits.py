"""Crowded keys of the line join, step by step without a session."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import line_dedup as ld

from . import brute


def joined(batches):
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches) if batches else None


def shared_of(keys, edits, crowd, final):
    key = keys.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    t = pa.table({"key": key[order] & ~127, "told": key[order] & 127, "digest": keys.column("digest").to_numpy()[order]})
    return joined(ld._shared(edits, crowd, final)(iter(t.to_batches())))


def keys_by_line(shared):
    out = {}
    for r in shared.to_pylist() if shared else []:
        out.setdefault(r["digest"], []).append({c: r[c] for c in ("key", "group", "crowded")})
    return out


def near_lines(lines, edits, crowd, per=0, min_chars=30):
    """(lines with an earlier near one, rows that meet in groups) of distinct lines of one document."""
    text = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["\n".join(lines)])], ["doc_id", "text"])
    first = joined(ld._occurrences(min_chars, False)(iter([text]))).to_pylist()
    keys = keys_by_line(shared_of(joined(ld._keys(edits, min_chars, per)(iter([text]))), edits, crowd, False))
    told = [{"line": r["line"], "digest": r["digest"], "keys": keys[r["digest"]]} for r in first if r["digest"] in keys]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["\n".join(lines)]), pa.array([told])], ["doc_id", "text", "told"])
    rows = joined(ld._candidates(edits, per, min_chars)(iter([batch])))
    done = []
    for level in range(1, ld.DEPTH + 1):
        if rows is None:
            break
        done += [r for r in rows.to_pylist() if not r["crowded"]]
        rows = rows.filter(rows.column("crowded"))
        if not rows.num_rows:
            rows = None
            break
        further = joined(ld._further(iter(rows.combine_chunks().to_batches())))
        keys = keys_by_line(shared_of(further, edits, crowd, level == ld.DEPTH))
        wanted = pa.array([keys.get(d, []) for d in rows.column("digest").to_pylist()], pa.list_(pa.struct({"key": pa.int64(), "group": pa.int64(), "crowded": pa.bool_()})))
        rows = joined(ld._split_rows(iter(rows.append_column("keys", wanted).combine_chunks().to_batches())))
    done += rows.to_pylist() if rows else []
    done.sort(key=lambda r: r["key"])
    if not done:
        return set(), 0
    cols = ("key", "digest", "doc_id", "line", "indexed", "text")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    t = pa.table({c: pa.array([r[c] for r in done], x) for c, x in zip(cols, types, strict=True)})
    found = joined(ld._verified(edits, per)(iter(t.to_batches())))
    line = {r["digest"]: r["line"] for r in first}
    return {line[d] for d in found.column("digest").to_pylist()} if found else set(), len(done)


def edited(rng, x, n):
    y = list(x)
    for _ in range(n):
        at = rng.randrange(len(y))
        y[at : at + rng.choice([0, 1])] = rng.choice(["", "X", "é"])
    return "".join(y)


@pytest.mark.parametrize("edits", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("crowd", [2, 6])
def test_split_keys_lose_no_pair(edits, crowd):
    """Lines of one template, of phrases in common and of neither, with copies at every distance."""
    rng = random.Random(edits * 10 + crowd)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    head, tail, middle = word(22), word(18), word(14)
    lines = [head + word(rng.randint(14, 18)) for _ in range(10)] + [word(16) + tail for _ in range(8)]
    lines += [head[:15] + word(3) + middle + word(2) + tail for _ in range(8)] + [head + str(n).zfill(3) + tail for n in range(10)]
    lines += ["ab" * 20 + word(2) for _ in range(4)]
    lines += [edited(rng, rng.choice(lines), rng.randint(1, edits + 1)) for _ in range(20)]
    lines = [x for x in dict.fromkeys(lines) if len(x) >= 30]
    rng.shuffle(lines)
    want = {j for j, y in enumerate(lines) if any(brute.edits(x, y) <= edits for x in lines[:j])}
    assert near_lines(lines, edits, crowd)[0] == want
    assert near_lines(lines, edits, 4_000)[0] == want


def test_rows_of_a_crowded_key_grow_with_its_lines():
    """Lines that share a phrase and nothing else: split keys have no further line, but for the near copies."""
    took = {}
    for n in (4_000, 8_000, 40_000):
        rng = random.Random(n)
        lines = ["the phrase that all of them share" + "".join(rng.choices("abcdefghijklmnop", k=30)) for _ in range(n)]
        lines = list(dict.fromkeys(lines + [edited(rng, x, 1) for x in lines[:50]]))
        found, took[n] = near_lines(lines, 1, 2_000)
        assert found == set(range(n, len(lines))) and found
    assert all(rows < 2 * n for n, rows in took.items()), took


def test_blocks_of_what_stays_crowded_are_few():
    for n in (4_000, 8_000, 40_000, 80_000):
        row, _ = ld.groups_of(np.zeros(n, np.int64), np.random.default_rng(1).integers(0, 1 << 62, n), ld.CROWD)
        assert len(row) <= ld.COPIES * n


def calls(run):
    n = 0

    def count(*_):
        nonlocal n
        n += 1

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


def test_verification_passes_over_runs():
    """The steps of the banded distance follow the edits of lines, not their lengths."""
    rng = random.Random(3)
    work = []
    for size in (300, 6_000):
        x = "".join(rng.choice("abcdefgh ") for _ in range(size))
        y = list(x)
        for k in range(1, 5):
            y[size * k // 5] = "X"
        a, b = [x] * 20, ["".join(y)] * 20
        assert ld.within(a, b, 4).all() and not ld.within(a, b, 3).any()
        work.append(calls(lambda: ld.within(a, b, 4)))  # noqa: B023
    assert work[1] < 2 * work[0], work


@pytest.mark.parametrize("edits", [1, 2, 3, 5, 8])
def test_distances_of_lines_with_runs(edits):
    """Long common stretches, periodic lines and edits side by side or at the ends, against the plain distance."""
    rng = random.Random(edits)
    a, b = [], []
    for i in range(300):
        base = rng.choice(["ab", "a", "abc" * 7 + "d", "abcdefgh klmnop"])
        x = [rng.choice(base) for _ in range(rng.randint(20, 90))] if i % 3 else list((base * 90)[: rng.randint(20, 90)])
        y = list(x)
        for _ in range(rng.randint(0, edits + 2)):
            at = rng.randrange(len(y)) if i % 2 else rng.choice([0, len(y) // 2, len(y) - 1])
            y[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "é"])
            y = y or ["a"]
        if min(len(x), len(y)) > edits:
            a.append("".join(x))
            b.append("".join(y))
    want = [brute.edits(x, y) <= edits for x, y in zip(a, b, strict=True)]
    assert ld.within(a, b, edits).tolist() == want and 0 < sum(want) < len(want)


def test_keys_are_shuffled_in_packs():
    """Packs hold every key once, come back by whole keys, and there are far fewer of them than keys."""
    rng = random.Random(6)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 200))) for _ in range(3_000)]
    text = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["\n".join(lines + [x + "X" for x in lines[:50]])])], ["doc_id", "text"])
    keys = joined(ld._keys(5, 30, 30)(iter([text])))
    packs = joined(ld._packed(ld._keys(5, 30, 30), 64)(iter([text, text])))
    assert 20 * packs.num_rows < keys.num_rows
    packs = packs.sort_by("bucket")
    got = joined(ld._unpacked(ld._shared(5, 4_000, False))(iter(packs.to_batches(max_chunksize=7)))).to_pylist()
    want = shared_of(keys, 5, 4_000, False).to_pylist()
    order = lambda rows: sorted((r["key"], r["group"], r["digest"], r["crowded"]) for r in rows)
    assert order(got) == order(want) and want
    alone = pa.table({"key": [128, 256], "told": [1, 1], "digest": [5, 6]})
    assert joined(ld._shared(5, 4_000, False)(iter(alone.to_batches()))) is None
