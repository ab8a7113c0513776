"""Plain, slow versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter
from functools import cache

import numpy as np

ASSIGN = re.compile(r"""(?a:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def cut(text, spans, mark="[SECRET]"):
    merged = []
    for s, _, e, _ in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in reversed(merged):
        text = text[:s] + mark + text[e:]
    return text


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def words(text):
    # a letter whose lower case is two characters stays as it is
    low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text or "")
    return re.findall(r"[^\W_]+", low)


def shingles(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    return Counter(grams)


def weighted_jaccard(a, b, idf):
    weight = lambda c, g: (1 + math.log(c[g])) * idf(g) if c[g] else 0.0
    every = set(a) | set(b)
    low = sum(min(weight(a, g), weight(b, g)) for g in every)
    high = sum(max(weight(a, g), weight(b, g)) for g in every)
    return low / high if high else 0.0


def near_classes(docs, idf, least=0.8):
    """{doc_id: class_id} by all pairs. docs: {doc_id: text}."""
    idf = cache(idf)
    sets = {i: shingles(t) for i, t in docs.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if docs[a] == docs[b] or sets[a].keys() & sets[b].keys() and weighted_jaccard(sets[a], sets[b], idf) >= least
    ]
    return components(sorted(docs), links)


def plain(text):
    return " ".join(words(text))


def edits_within(pattern, text):
    """Least edits of the whole pattern against any part of text: the full table, a row at a time."""
    codes = np.array([ord(c) for c in text], np.int64)
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(pattern, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (codes != ord(c)))
        new[0] = i
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def segments(item, width=80, stride=40, least=24):
    n = len(item)
    if n < least:
        return []
    return [item[s : s + width] for s in sorted({*range(0, max(n - width, 0) + 1, stride), max(n - width, 0)})]


def leaks(docs, items):
    found = set()
    for d, text in docs.items():
        text = plain(text)
        for i, item in items.items():
            if 8 <= len(plain(item)) < 24 and f" {plain(item)} " in f" {text} ":
                found.add((d, i))
            for part in segments(plain(item)):
                budget = min(int(0.1 * len(part)), (len(part) - 8) // 8)
                if part in text or edits_within(part, text) <= budget:
                    found.add((d, i))
                    break
    return found


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """{source: target} by clamping one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, out, left = share * sum(sizes.values()), {}, set(order)
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in left}
        for s in over:
            out[s] = most * sizes[s]
        left -= set(over)
    return out


def mix(rows, seed="mix-1"):
    """[taken] for rows of (doc_id, source, text)."""
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += size(t)
    target = targets(sizes)
    taken = [0] * len(rows)
    for source, whole_size in sizes.items():
        whole = math.floor(target[source] / whole_size) if whole_size else 0
        rest = int(math.floor(target[source] + 0.5)) - whole * whole_size
        mine = [k for k, r in enumerate(rows) if r[1] == source]
        key = lambda k: (hashlib.md5(f"{seed}:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest(), size(rows[k][2]))
        for k in sorted(mine, key=key):
            n = size(rows[k][2])
            extra = max(0, min(n, rest))
            rest -= n
            taken[k] = whole * n + extra
    return taken
