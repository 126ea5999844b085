"""Conversation repair against a plain search over whole label strings."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from textloom.llm import conversation, queries

SCHEMA = "conv_id long, turn long, role string, text string, part int, block int, at int, seen int, label string, conv string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x", "y") for r in rows], SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = [" " if x is None else x for x in (conv, turn, role, text)]
        role, text = told[2:]
        harm = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return out


def repair(rows):
    """rows(turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        held = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        """(cost, labels, output) from row i, by whole strings; three insertions in a row are never needed."""
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            c, s, o = best(i, role[0], inserted + 1)
            options.append((c + 5, "I" + s, (f"{role}:", *o)))
        if i < len(rows):
            c, s, o = best(i + 1, state, 0)
            options.append((c + 2, "D" + s, o))
            _, role, text = rows[i]
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] and role[:1] in after[state]:
                    c, s, o = best(i + 1, role[0], 0)
                    options.append((c + more, "K" + s, (f"{role}:{text}", *o)))
                for new in ("user", "assistant"):
                    if new[0] in after[state]:
                        c, s, o = best(i + 1, new[0], 0)
                        options.append((c + more + 1, "R" + s, (f"{new}:{text}", *o)))
        return min(options, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # short stacks
        for state in after:
            best(i, state, 0)
    cost, labels, out = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(out)
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, labels, hashlib.sha256(text.encode()).hexdigest()), text


def wanted(rows, harmed=False):
    by = defaultdict(list)
    for r in damage(rows) if harmed else [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]:
        by[r[0]].append(r[1:])
    return {conv: repair(by[conv]) for conv in {r[0] for r in rows}}


def odd_rows(seed=2, conversations=60, hot=400):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]
    texts = ["fine.", "Fine!", "cut", "", " \t", "é?", "a\nb.", None, "x. \x0b", "long " * 300 + "."]
    row = lambda c, t: (c, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randint(0, 99)}{rng.choice(['.', '!', ''])}")
    out = []
    for c in range(conversations):
        n = rng.randint(1, 12)
        for t in range(n):
            out.append(row(c, rng.choice([t, t, t, t + 2, None, 2**60 + t])))
    for c in (None, 77, 78):
        t = 0
        for _ in range(hot):
            t += rng.choice([0, 1, 1, 1, 3])
            role = ["user", "assistant"][t % 2] if rng.random() < 0.8 else rng.choice(roles)
            out.append((c, t, role, f"t{rng.randint(0, 300)}{rng.choice(['.', '.', '.', ''])}"))
    out += [(79, t, "user", "again and again.") for t in range(200)] + [(80, 5, "user", "one row.")] * 300
    rng.shuffle(out)
    return out


def compare(frame, want):
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}
    assert got.keys() == want.keys()
    for conv, x in want.items():
        assert got[conv] == x[0], conv


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_odd_conversations(spark, block):
    rows = odd_rows()
    verdicts, texts = conversation.repair(table(spark, rows), block=block)
    want = wanted(rows)
    compare(verdicts, want)
    assert verdicts.count() == len(want)
    pieces = defaultdict(list)
    for r in sorted(texts.collect(), key=lambda r: (r.part, r.block) if r.part is not None else (-1, -1)):
        if r.repaired is not None:
            pieces[r.conv_id].append(r.repaired)
    assert {c: "\n".join(pieces[c]) for c in want} == {c: x[1] for c, x in want.items()}


def test_damaged(spark):
    rows = odd_rows(4, conversations=200, hot=60)
    compare(conversation.repair(conversation.damaged(table(spark, rows)), live="live")[0], wanted(rows, True))
    lost = next(i for i in range(10**4) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    compare(conversation.repair(conversation.damaged(table(spark, [(lost, 0, "user", "gone.")])), live="live")[0], {lost: ((0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()), "")})
    assert conversation.repair(table(spark, []))[0].count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.op11_conversations(spark, sf_dir), wanted(rows, True))


def test_paths_of_blocks_join_to_the_whole():
    rng = random.Random(1)
    for _ in range(300):
        symbols = "".join(conversation.symbol(rng.choice("suax"), rng.choice(conversation.FAULTS)) for _ in range(rng.randint(0, 9)))
        cost, labels = conversation.audit(symbols)
        assert labels.count("D") + labels.count("K") + labels.count("R") == len(symbols)
        cut = rng.randint(0, len(symbols))
        inner = {(p, q): v for q in conversation.GRAMMAR for p, v in conversation.paths(symbols[:cut], (q,), False).items()}
        outer = conversation.paths(symbols[cut:])
        assert (cost, labels) == min((c + outer[q][0], s + outer[q][1]) for (p, q), (c, s) in inner.items() if p == conversation.START and q in outer)


def test_counts():
    assert Counter(conversation.fault_of(t) for t in ("", " \n", "a.", "a. ", "a", "!\x0c", "a\xa0")) == Counter(["blank", "blank", "", "", "truncated", "", "truncated"])
