"""Plain statements of the operators' results, over small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from math import log, log10
from zlib import crc32

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def substring_dedup(rows):
    first: dict[tuple, int] = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


def fingerprint(text: str | None) -> int:
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """Smallest id reachable from each id."""
    out = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if linked(a, b) and out[b] < out[a]:
                    out[a] = out[b]
                    changed = True
    return out


def contamination(rows, items):
    windows = defaultdict(set)
    for j, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        if w:
            n = min(13, len(w))
            for p in range(len(w) - n + 1):
                windows[tuple(w[p : p + n])].add(str(j))
    sizes = {len(x) for x in windows}
    out = []
    for i, text in rows:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p : p + n])):
                    ids |= found
                    hit.update(range(p, p + n))
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def unigram_base(rows):
    counts: Counter = Counter()
    for i, text in rows:
        if crc32(str(i).encode()) % 7 != 2:
            counts.update([*words((text or "").translate(LOWER)), ""])
    total, types = sum(counts.values()), len(counts)
    out = {}
    for i, text in rows:
        own = [*words((text or "").translate(LOWER)), ""]
        out[i] = (crc32(str(i).encode()) % 7 == 2, len(own), sum(counts[x] > 0 for x in own), total, sum(log10((counts[x] + 1) / (total + types + 1)) for x in own))
    return out


def _f(x):
    return x * log(x) if x > 0 else 0.0


def _likelihood(cells, real):
    """Of class bigrams, up to a constant; ``real`` classes are those that words may join."""
    out, into = Counter(), Counter()
    for (a, b), n in cells.items():
        out[a] += n
        into[b] += n
    return sum(map(_f, cells.values())) - sum(_f(out[c]) + _f(into[c]) for c in real)


def class_scores(rows, seeds, classes):
    """log10 probability of each text under the class model, with every class choice tried by its whole likelihood."""
    token_rows = {i: [*words((text or "").translate(LOWER)), ""] for i, text in rows}
    train = [t for i, t in token_rows.items() if crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t)
    ends = counts.pop("", 0)
    top = sorted(counts, key=lambda w: (-counts[w], xxhash.xxh3_64_intdigest(w.encode())))[:seeds]
    k = max(1, min(classes, len(top)))
    label = {w: i % k for i, w in enumerate(top)} | {"": "end"}
    pairs = [(a, b) for t in train for a, b in zip(["", *t[:-1]], t, strict=True)]

    def cells():
        return Counter((label.get(a, "open"), label.get(b, "open")) for a, b in pairs)

    moved = True
    while moved:
        moved = False
        for w in top:
            was, tried = label[w], []
            for c in range(k):
                label[w] = c
                tried.append(round(_likelihood(cells(), range(k)), 9))
            best = tried.index(max(tried))
            label[w] = best if tried[best] > tried[was] + 1e-6 else was
            moved |= label[w] != was
    held, new = cells(), {}
    for w in counts.keys() - set(top):
        tried = []
        for c in range(k):
            more = Counter(held)
            for a, b in pairs:
                if b == w:
                    more[label.get(a, "open"), c] += 1
                    more[label.get(a, "open"), "open"] -= 1
                if a == w:
                    more[c, label.get(b, "open")] += 1
                    more["open", label.get(b, "open")] -= 1
            tried.append(round(_likelihood(more, range(k)), 9))
        new[w] = tried.index(max(tried))
    label |= new
    size, types = Counter(), Counter()
    for w, n in counts.items():
        size[label[w]] += n
        types[label[w]] += 1
    joint = Counter((label[a], label[b]) for a, b in pairs)
    joint.update(("new", label[b]) for a, b in pairs if counts[a] == 1)
    once, twice = (sum(n == m for n in counts.values()) for m in (1, 2))
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    unseen = max(1.0, once * (once - 1) / (2 * (twice + 1)))
    live = [*(c for c in range(k) if size[c]), "end"] if size else [0, "end"]
    into = {c: sum(n for (a, b), n in joint.items() if b == c and a != "new") + 1 for c in live}

    def step(a, c):
        row = {b: n for (x, b), n in joint.items() if x == a}
        kinds = max(len(row), 1)
        return (row.get(c, 0) + kinds * into[c] / sum(into.values())) / (sum(row.values()) + kinds)

    def word(w, a):
        if w == "":
            return step(a, "end")
        if counts[w]:
            return step(a, label[w]) * (counts[w] - discount) / size[label[w]]
        return sum(step(a, c) * (discount * types[c] / size[c] if size[c] else 1.0) for c in live if c != "end") / unseen

    out = {}
    for i, t in token_rows.items():
        before = ["end", *(label.get(w, "new") for w in t[:-1])]
        out[i] = sum(log10(word(w, a)) for w, a in zip(t, before, strict=True))
    every = {a: sum(word(w, a) for w in counts) + unseen * word("\0", a) + word("", a) for a in {*label.values(), "new"}}
    assert ends and all(abs(x - 1) < 1e-9 for x in every.values())  # a distribution after any context
    return out
