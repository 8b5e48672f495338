"""Brute-force versions and awkward inputs for the operators of shotweave.llm."""

from __future__ import annotations

import hashlib
import random
import re

SPACE = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(SPACE, text or "")


def prose(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    stems = ["ka", "lo", "mi", "ter", "on", "us", "ra", "ne", "vi", "sto"]
    out = []
    for _ in range(n):
        k = min(rnd.randrange(vocabulary), rnd.randrange(vocabulary))
        out.append(stems[k % 10] + stems[k // 10 % 10] + stems[k // 100 % 10])
    return " ".join(out)


def awkward_docs():
    """Nulls, empties, blanks, a very long text, exact and near copies, ties and a repeated row."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(0, base), (1, near), (2, base), (3, None), (4, ""), (5, " \n\t \x0b"), (6, "one two"), (7, "ONE two"), (8, prose(2, 40_000)),
            (9, prose(3, 80) + "\n" + base[:200] + "\n" + prose(4, 60)), (10, "é" * 70 + " x\u0000y"), (11, "a" * 500), (12, "a" * 300),
            (13, "Ünïcode " * 30), (None, base), (14, "<|endoftext|> it's <|startoftext|>ok"), (14, "<|endoftext|> it's <|startoftext|>ok"),
            (15, prose(5, 70) + "\n" + prose(6, 12) + "\n" + prose(6, 12)), (16, prose(7, 30) + "\n" + prose(6, 12))]
    return [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def jaccard_percent(a, b):
    shared = len(a & b)
    return 100 * shared, len(a) + len(b) - shared


def shingles(text, n=5):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(sets, percent):
    """Least reachable id of every key of ``sets`` (id -> set), all pairs compared."""
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b]:
                shared, union = jaccard_percent(sets[a], sets[b])
                if shared >= percent * union:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def removed_bytes(docs, length=50):
    """doc_id -> mask of removed bytes, every window compared."""
    first, raw = {}, {d: (t or "").encode() for d, t in docs if d is not None}
    out = {}
    for d in sorted(raw):
        b, gone = raw[d], bytearray(len(raw[d]))
        for i in range(len(b) - length + 1):
            if first.setdefault(b[i:i + length], d) < d:
                gone[i:i + length] = b"\1" * length
        out[d] = gone
    return out
