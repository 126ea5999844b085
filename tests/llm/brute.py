"""Plain versions of the contracts, one document or pair at a time, to hold the operators against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE = r"[^\x20\x09-\x0D]+"
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def pii(docs):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    out = {}
    for doc, text in docs:
        found = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in kinds.items()}
        told = ",".join(f"{k}:{a}:{b}" for k, x in found.items() for a, b in x)
        out[doc] = (*(len(x) for x in found.values()), sha(told), told)
    return out


def shingles(text, k):
    w = re.findall(SPACE, lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(docs, k=4, percent=80):
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    both = Counter()
    for ds in held.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def contamination(docs, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(word, lower(t or ""))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for d, t in docs:
        w = re.findall(word, lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                x = windows.get(tuple(w[j : j + n]))
                if x:
                    found |= x
                    hit |= set(range(j, j + n))
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def substrings(docs, width=13):
    first = {}
    words = {d: re.findall(SPACE, t or "") for d, t in docs}
    for d, w in words.items():
        for i in range(len(w) - width + 1):
            x = tuple(w[i : i + width])
            first[x] = min(first.get(x, d), d)
    out = {}
    for d, w in words.items():
        gone = {p for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for p in range(i, i + width)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), sha(" ".join(kept)))
    return out


def byte_runs(docs, width=400):
    raw = {d: (t or "").encode() for d, t in docs}
    n = Counter(b[i : i + width] for b in raw.values() for i in range(len(b) - width + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if n[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def quality(docs):
    out = {}
    for d, t in docs:
        t = t or ""
        w = re.findall(SPACE, t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {p for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        out[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lines(docs, most=1, least=30):
    first = {}
    for d, t in sorted(docs):
        for i, x in enumerate((t or "").split("\n")):
            if len(x) >= least:
                first.setdefault(x, (d, i))
    by_len = defaultdict(list)
    for x in first:
        by_len[len(x)].append(x)
    near = {x for x in first for n in range(len(x) - most, len(x) + most + 1) for y in by_len[n] if first[y] < first[x] and edits(x, y) <= most}
    out = {}
    for d, t in docs:
        w = (t or "").split("\n")
        gone = [i for i, x in enumerate(w) if len(x) >= least and (x in near or first[x] != (d, i))]
        out[d] = (len(w), len(gone), sha("\n".join(x for i, x in enumerate(w) if i not in gone)), ",".join(map(str, gone)))
    return out


def pieces(docs, encode, capacity=4096):
    out = {}
    for d, t in docs:
        ids = [*encode(t or ""), 1]
        for p, i in enumerate(range(0, len(ids), capacity)):
            part = ids[i : i + capacity]
            out[d, p] = (i, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    return out
