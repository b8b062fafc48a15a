"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

SPACED = re.compile("[^\x20\x09-\x0d]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def substring(docs: dict, size: int) -> dict:
    words = {k: SPACED.findall(t or "") for k, t in docs.items()}
    first: dict = {}
    for k in sorted(words):
        for i in range(len(words[k]) - size + 1):
            first.setdefault(tuple(words[k][i : i + size]), k)
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone.update(range(i, i + size))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def jaccard(docs: dict) -> dict:
    sets = {}
    for k, t in docs.items():
        w = SPACED.findall(low(t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in docs}


def contamination(docs: dict, items: dict) -> dict:
    windows = collections.defaultdict(set)
    for k, t in items.items():
        w = ITEM.findall(low(t or ""))
        for i in range(max(len(w) - 12, 1)) if w else ():
            windows[tuple(w[i : i + 13])].add(str(k))
    out = {}
    for k, t in docs.items():
        w, hit, ids = ITEM.findall(low(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        out[k] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def base_rules(docs: dict) -> dict:
    out = {}
    for k, t in docs.items():
        t = t or ""
        w = SPACED.findall(t)
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        times = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in range(3)}
        out[k] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))
    return out


def _near(a: list[str], b: list[str]) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 8:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def lines(docs: dict) -> dict:
    before: list[list[str]] = []
    out = {}
    for k in sorted(docs):
        if docs[k] is None:
            out[k] = (0, 0, None)
            continue
        own, kept = docs[k].split("\n"), []
        for line in own:
            w = SPACED.findall(low(line))
            if not w or not any(_near(w, x) for x in before):
                kept.append(line)
            if w:
                before.append(w)
        out[k] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out
