"""Repair of conversation structure as a shortest path through a composition of three weighted automata.

The input acceptor spells a conversation's rows, one symbol each: the role's initial (s, u, a or any other) and whether
the row must go (blank or duplicate), stays at a price (truncated) or is sound.  The edit transducer keeps, reroles or
deletes a row, or inserts one.  The grammar acceptor takes `(s?(ua)+)?`.  Their states are composed as they are reached;
weights are (cost, labels), compared in that order, and the best path is found backwards along the rows.  Labels of the
paths behind the grammar's states are compared by rank, so a row costs the same at any length.

Rows are dealt by ranges of (conv_id, turn, role, text), so a conversation of any length is spread over tasks.  A task
repairs the conversations that lie whole in its range; rows of its first and last one, which may go on in the next
range, are written, and repaired by blocks of BLOCK rows: every block gives the best path from each state to each other
one (insertions stand before rows, so no two of these are prefixes of each other, and their order is decided within the
block), costs and orders of the blocks are composed per conversation, and each block then writes its own stretch.  The
digest of a repaired conversation is read piece by piece: its one task holds a state of fixed size, not the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, tasks

BLOCK = 1024
START, SYSTEM, USER, ASSISTANT = range(4)
#: state: {initial: next state}
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTING = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
#: The only role that can be inserted, or given, in each state.
GIVEN = {q: next(x for x in to if x in ROLES) for q, to in GRAMMAR.items()}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
FAR = 1 << 60
#: A symbol is one character: the place of its initial, times 3, and of its fault in these.
INITIALS, FAULTS = "sua-", "sound truncated goes".split()
BLANKS = " \t\n\x0b\x0c\r"


def symbol(role: str, fault: str) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
    return chr(65 + 3 * INITIALS.index(initial) + FAULTS.index(fault))


def _edits(symbol: str) -> list[tuple[str, str | None, int]]:
    """(label, role's initial or nothing, cost) of each way in which the edit transducer reads a symbol."""
    initial, fault = divmod(ord(symbol) - 65, 3)
    out: list[tuple[str, str | None, int]] = [("D", None, DELETE)]
    if FAULTS[fault] != "goes":
        price = TRUNCATED if FAULTS[fault] == "truncated" else 0
        out.append(("K", INITIALS[initial], price))
        out += [("R", x, price + REROLE) for x in ROLES]
    return out


@lru_cache(maxsize=4096)
def _arcs(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(label, next grammar state, cost) of the composed arcs that read a symbol in a state."""
    return [(label, state if out is None else GRAMMAR[state][out], cost) for label, out, cost in _edits(symbol) if out is None or out in GRAMMAR[state]]


def _with_insertions(best: dict) -> None:
    """Relax the arcs that insert a row, which lead from state to state before the same symbol; all cost more than 0."""
    for _ in GRAMMAR:
        for q in GRAMMAR:
            to = GRAMMAR[q][GIVEN[q]]
            if to in best:
                cost, key, _ = best[to]
                option = (cost + INSERT, ("I", key), ("I", to, False))
                if q not in best or option[:2] < best[q][:2]:
                    best[q] = option


def paths(symbols: str, exits: tuple[int, ...] = ACCEPTING, closing: bool = True) -> dict[int, tuple[int, str]]:
    """{entry state: (cost, labels)} of the best path through the symbols from each state to one of the exits.

    closing: whether rows may be inserted behind the last symbol.
    """
    best: dict = {q: (0, ("", 0), None) for q in exits}
    if closing:
        _with_insertions(best)
    steps = [best]
    for x in reversed(symbols):
        rank = {key: i for i, key in enumerate(sorted({b[1] for b in best.values()}))}
        ahead, best = best, {}
        for q in GRAMMAR:
            options = [(ahead[to][0] + cost, (label, rank[ahead[to][1]]), (label, to, True)) for label, to, cost in _arcs(x, q) if to in ahead]
            if options:
                best[q] = min(options)
        _with_insertions(best)
        steps.append(best)
    out = {}
    for q in steps[-1]:
        labels, at, state = [], len(steps) - 1, q
        while (step := steps[at][state][2]) is not None:
            label, state, read = step
            labels.append(label)
            at -= read
        out[q] = (steps[-1][q][0], "".join(labels))
    return out


@lru_cache(maxsize=1 << 16)
def audit(symbols: str) -> tuple[int, str]:
    return paths(symbols)[START]


def edited(labels: str, rows: list[tuple[str, str]], state: int = START) -> list[str]:
    """The repaired rows, as role:text, of a stretch of rows(role, text) that is entered in a state."""
    out, at = [], 0
    for label in labels:
        role, text = rows[at] if label != "I" else ("", "")
        at += label != "I"
        if label == "D":
            continue
        if label != "K":
            role = ROLES[GIVEN[state]]
        state = GRAMMAR[state][role[:1]]
        out.append(f"{role}:{text}")
    return out


def fault_of(text: str) -> str:
    """blank, truncated or nothing, by the last character that is no blank."""
    held = text.rstrip(BLANKS)
    return "blank" if not held else "" if held[-1] in ".!?" else "truncated"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live: the rows of conversations, each harmed by a checksum of its place, or not.

    Of twenty rests 0 drops the row (it stays as a mark that is not live), 1 empties its text, 2 takes its marks of
    sentence ends, 3 repeats it, 4 makes it the user's.  Null roles and texts are one space, and so are null places in
    the checksum.
    """
    told = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    x = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20).alias("harm"))
    harm = F.col("harm")
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(harm == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(harm != 0)))
    return x.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("live"))


VERDICT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
DONE = f"conv_id long, whole boolean, {VERDICT}, repaired_sha256 string, repaired string, part int, block int, at int, turn long, role string, live boolean, seen boolean, told binary"


def _counts(rows: list[tuple[int | None, str, str]], faults: list[str]) -> tuple[int, int, int, int, int]:
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = zip(rows, rows[1:], strict=False)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in pairs)


def _whole(rows: list[tuple[int | None, str, str]]) -> dict:
    """The verdict on all live rows(turn, role, text) of a conversation."""
    seen, faults = set(), []
    for _, role, text in rows:
        fault = fault_of(text)
        if fault != "blank" and (role, text) in seen:
            fault = "duplicate"
        seen.add((role, text))
        faults.append(fault)
    cost, labels = audit("".join(symbol(r[1], _kind(f)) for r, f in zip(rows, faults, strict=True)))
    text = "\n".join(edited(labels, [r[1:] for r in rows]))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal")
    return dict(zip(names, _counts(rows, faults), strict=True)) | {"cost": cost, "audit": labels, "repaired": text, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _kind(fault: str) -> str:
    return "goes" if fault in ("blank", "duplicate") else fault or "sound"


def _by_range(block: int):
    """Verdicts of whole conversations, rows of the first and last one of the task."""
    schema = pa.schema([("conv_id", pa.int64()), ("whole", pa.bool_()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("at", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("live", pa.bool_()), ("seen", pa.bool_()), ("told", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        conv, first, held, met, number, at = None, True, [], set(), -1, 0
        started = False

        def edge(part, conv, turn, role, text, live):
            nonlocal number, at
            told = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest() if live else None
            seen = told in met
            if live:
                met.add(told)
            number += at % block == 0
            at += 1
            return {"conv_id": conv, "whole": False, "part": part, "block": number, "at": at - 1, "turn": turn, "role": role, "repaired": text, "live": live, "seen": seen, "told": told}

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started:
                    started, conv = True, row[0]
                elif row[0] != conv:
                    if not first:
                        out.append({"conv_id": conv, "whole": True} | _whole([r[1:4] for r in held if r[4]]))
                    conv, first, held, met, at = row[0], False, [], set(), 0
                if first:
                    out.append(edge(row[5], *row[:5]))
                else:
                    held.append(row)
                if len(out) >= 2048:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        out += [edge(r[5], *r[:5]) for r in held]
        for i in range(0, len(out), 2048):
            yield pa.RecordBatch.from_pylist(out[i : i + 2048], schema)

    return lean(run)


BLOCKS = "conv string, part int, block int, symbols string, blank long, duplicate long, truncated long, illegal long, opens string, closes string, low string, high string, turns long, costs array<long>, ranks array<int>"


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of a block, and for each two states the cost and the order of the best path between them."""
    rows = rows.sort_values("at")
    live = rows[rows["live"]]
    faults = live["fault"].tolist()
    roles = live["role"].tolist()
    symbols = "".join(symbol(r, _kind(f)) for r, f in zip(roles, faults, strict=True))
    costs, ranks = [], []
    if symbols:
        to = {q: paths(symbols, (q,), False) for q in GRAMMAR}
        for p in GRAMMAR:
            order = sorted({to[q][p][1] for q in GRAMMAR if p in to[q]})
            costs += [to[q][p][0] if p in to[q] else FAR for q in GRAMMAR]
            ranks += [order.index(to[q][p][1]) if p in to[q] else 0 for q in GRAMMAR]
    turns = sorted({int(t) for t in live["turn"].tolist() if t is not None})
    top = rows.iloc[0]
    illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    out = (top["conv"], top["part"], top["block"], symbols, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, roles[0][:1] if roles else None, roles[-1][:1] if roles else None, str(turns[0]) if turns else None, str(turns[-1]) if turns else None, len(turns), costs, ranks)
    return pd.DataFrame([out], columns=names)  # turns as text: numbers beside nulls would become floating ones


PLAN = "conv string, part int, block int, enters int, exits int, closing boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _composed(blocks: pd.DataFrame) -> pd.DataFrame:
    """For each block of a conversation where its best path enters and leaves; the conversation's counts with the last one."""
    blocks = blocks.sort_values(["part", "block"])
    some = blocks[blocks["symbols"] != ""]
    total = {c: int(blocks[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")}
    distinct, last_turn, before, low = 0, None, None, None
    for b in some.itertuples():
        if before is not None:
            total["illegal"] += before + b.opens not in LEGAL
        before = b.closes
        if b.turns:
            distinct += int(b.turns) - (last_turn is not None and int(b.low) == last_turn)
            low = int(b.low) if low is None else low
            last_turn = int(b.high)
    gaps = last_turn - low + 1 - distinct if distinct else 0
    ahead = {q: p[0] for q, p in paths("").items()}
    legs = []
    for b in reversed(list(some.itertuples())):
        costs, ranks = list(b.costs), list(b.ranks)
        leg = {p: min((costs[4 * p + q] + ahead[q], ranks[4 * p + q], q) for q in GRAMMAR) for p in GRAMMAR}
        ahead = {p: leg[p][0] for p in GRAMMAR}
        legs.append(leg)
    state, out = START, []
    for i, b in enumerate(some.itertuples()):
        exits = legs[-1 - i][state][2]
        out.append((b.conv, b.part, b.block, state, exits, i == len(some) - 1))
        state = exits
    cost = ahead[START] if len(some) else 0
    names = [c.split()[0] for c in PLAN.split(", ")]
    rows = [(*r, 0, 0, 0, 0, 0, 0) for r in out]
    rows.append((blocks["conv"].iloc[0], None, None, None, None, None, gaps, *(total[c] for c in ("blank", "duplicate", "truncated", "illegal")), cost))
    return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names if c not in ("conv", "closing")})


PIECES = "conv string, part int, block int, audit string, repaired string"


def _pieces(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    """The labels and the repaired rows of a block; null where no row is left."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    if not len(plan):
        return pd.DataFrame([], columns=names)
    leg = plan.iloc[0]
    labels = paths(leg["symbols"], (int(leg["exits"]),), False)[int(leg["enters"])][1]
    if leg["closing"]:
        labels += paths("")[int(leg["exits"])][1]
    live = rows[rows["live"]].sort_values("at")
    lines = edited(labels, list(zip(live["role"].tolist(), live["text"].tolist(), strict=True)), int(leg["enters"]))
    return pd.DataFrame([(leg["conv"], leg["part"], leg["block"], labels, "\n".join(lines) if lines else None)], columns=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, audit and digest of pieces that come in order, one after another."""
    schema = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    conv, labels, digest, begun = None, [], hashlib.sha256(), False
    for batch in batches:
        for name, audit_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != conv:
                if conv is not None:
                    yield pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(labels), "repaired_sha256": digest.hexdigest()}], schema)
                conv, labels, digest, begun = name, [], hashlib.sha256(), False
            labels.append(audit_)
            if text is not None:
                digest.update(("\n" if begun else "").encode() + text.encode())
                begun = True
    if conv is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(labels), "repaired_sha256": digest.hexdigest()}], schema)


def _fault(text: Column) -> Column:
    held = F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", "")
    return F.when(held == "", "blank").when(held.rlike(r"[.!?]\z"), "").otherwise("truncated")


def repair(turns: DataFrame, live: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(verdicts, texts) on the conversations of turns(conv_id, turn, role, text).

    verdicts: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, a row per conversation.
    texts: conv_id, part, block, repaired: the repaired rows (role:text) in order; a long conversation has several pieces.

    live: a column that says which rows count; others only name their conversation, whose verdict is zeros where no row
    counts.  Null roles and texts are one space; rows without a conv_id are one conversation, of a null id.  Rows are
    taken by turn (nulls first), then by role and md5 of the text; rows that repeat are duplicates.  An empty table gives
    no rows.  Extra columns are ignored.
    """
    spark = turns.sparkSession
    told = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), (F.coalesce(turns[live], F.lit(False)) if live else F.lit(True)).alias("live"))
    order = ["conv_id", "turn", "role", "digest", "copy"]
    # Equal rows may part: their own number is the last key.
    dealt = rows.withColumn("digest", F.md5("text")).withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
    done = materialise(dealt.select("conv_id", "turn", "role", "text", "live", F.spark_partition_id().alias("part")).mapInArrow(_by_range(block), DONE), "conversations")
    verdict = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    whole = done.filter("whole")
    edges = done.filter("not whole").withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    # A message that an earlier range has, too: one row of each range is looked at.
    met = edges.filter("live and not seen").groupBy("conv", "told").agg(F.min("part").alias("earliest"), F.count("*").alias("n")).filter("n > 1")
    later = edges.filter("live and not seen").select("conv", "told", "part", "at", "block").join(met, ["conv", "told"]).filter("part > earliest").select("part", "block", "at", F.lit(True).alias("later"))
    fault = _fault(F.col("repaired"))
    small = edges.select("conv", "part", "block", "at", "turn", "role", "live", "seen", fault.alias("fault")).join(later, ["part", "block", "at"], "left")
    repeats = (F.col("seen") | F.coalesce("later", F.lit(False))) & (F.col("fault") != "blank")
    small = small.select("conv", "part", "block", "at", F.col("turn").cast("string").alias("turn"), F.substring("role", 1, 1).alias("role"), "live", F.when(repeats, "duplicate").otherwise(F.col("fault")).alias("fault"))
    blocks = materialise(small.groupBy("part", "block").applyInPandas(_block, BLOCKS), "blocks")
    plan = materialise(blocks.groupBy("conv").applyInPandas(_composed, PLAN), "legs")
    legs = plan.filter("part is not null").select("part", "block", "enters", "exits", "closing").join(blocks.select("conv", "part", "block", "symbols"), ["part", "block"])
    texts = edges.select("part", "block", "at", "role", F.col("repaired").alias("text"), "live").groupBy("part", "block")
    pieces = materialise(texts.cogroup(legs.groupBy("part", "block")).applyInPandas(_pieces, PIECES), "pieces")
    ordered = pieces.repartition(tasks(spark), "conv").sortWithinPartitions("conv", "part", "block")
    digests = ordered.select("conv", "audit", "repaired").mapInArrow(_digests, "conv string, audit string, repaired_sha256 string")
    conv_id = F.when(F.col("conv") != "", F.col("conv").cast("long"))
    joined = plan.filter("part is null").join(digests, "conv", "left")
    parted = joined.select(conv_id.alias("conv_id"), *verdict[:6], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    out = whole.select("conv_id", *verdict).unionByName(parted)
    return out, whole.select("conv_id", "part", "block", "repaired").unionByName(pieces.select(conv_id.alias("conv_id"), "part", "block", "repaired"))
