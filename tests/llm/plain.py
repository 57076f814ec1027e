"""Plain versions of what the operators compute, on lists in memory."""

import hashlib
import math
import re
from collections import Counter

import xxhash

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def size(text):
    return len(WORD.findall(text or ""))


def fingerprint(text):
    w = (text or "").encode().translate(LOW).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def one_of_each_group(rows):
    """Rows (doc_id, text, ...) of which fingerprints link: the one of the least id of each group."""
    prints, group = [fingerprint(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r), r, key=lambda r: r[0])
    return list(best.values())


def clean(rows, items, window=13):
    """Rows without a full window of an item and with few hit words."""
    windows = set()
    for t in items:
        w = ALNUM.findall(t.encode().translate(LOW).decode())
        k = min(window, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k}
    out = []
    for r in rows:
        w = ALNUM.findall((r[1] or "").encode().translate(LOW).decode())
        hit, full = set(), False
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    full |= k == window
        if not full and not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), share * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return goal | {s: level * weight[s] for s in open_}
        for s in over:
            goal[s] = float(most * sizes[s])
            left -= goal[s]
            open_.remove(s)


def mix(rows, buckets):
    """Rows (doc_id, text, source, ...): how many copies of each (by its place) the mix holds."""
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    goal = targets(sizes)
    key = lambda i: hashlib.md5(f"{'null' if rows[i][0] is None else rows[i][0]}|mix-1|{rows[i][1] or ''}".encode()).hexdigest()
    begin, at = {}, Counter()
    for i in sorted(range(len(rows)), key=lambda i: (int(key(i)[:8], 16) % buckets, key(i))):
        begin[i] = at[rows[i][2]]
        at[rows[i][2]] += size(rows[i][1])
    packets = []
    for i, r in enumerate(rows):
        for p in (0, 1):
            first = begin[i] + p * sizes[r[2]]
            for a, z in ((first, min(first + size(r[1]), int(goal[r[2]]))), (max(first, int(goal[r[2]])), first + size(r[1]))):
                if z > a:
                    packets.append((z / goal[r[2]], r[2] is None, r[2] or "", a, z - a, i, p))
    left, taken, copies = int(1.5 * sum(sizes.values())), Counter(), Counter()
    for *_, n, i, p in sorted(packets):
        taken[i, p] += min(n, left)
        left -= min(n, left)
    for (i, _), n in taken.items():
        copies[i] += 2 * n >= size(rows[i][1])
    return copies


def shard(doc_id, tree):
    key = "null" if doc_id is None else str(doc_id)

    def pick(children):
        def draw(c):
            u = ((xxhash.xxh64_intdigest(c[0].encode(), xxhash.xxh64_intdigest(key.encode(), 42)) >> 11) + 0.5) * 2.0**-53
            return -math.log(u) / c[1], c[0]

        return min(children, key=draw)[2]

    region = pick([(f"region {r[0][0][0]}", sum(w for rack in r for _, w in rack), r) for r in tree])
    rack = pick([(f"rack {k[0][0]}", sum(w for _, w in k), k) for k in region])
    return pick([(f"shard {s}", w, s) for s, w in rack])
