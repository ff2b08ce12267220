"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def embeddings(rows, threshold=0.98):
    """id to (n_links, component, kept) of rows (id, vector, label)."""
    good = collections.defaultdict(list)
    for i, v, label in rows:
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, float)
        v = v / np.abs(v).max()
        good[label, len(v)].append((i, v / np.linalg.norm(v)))
    links = []
    for group in good.values():
        x = np.stack([v for _, v in group])
        links += [(group[a][0], group[b][0]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)))]
    count = collections.Counter(i for pair in links for i in pair)
    return {i: (count[i], c, i == c) for i, c in union([r[0] for r in rows], links).items()}


def substrings(docs, width=13):
    first, out = {}, {}
    for d, text in docs:
        w = WORD.findall(text or "")
        for i in range(len(w) - width + 1):
            x = tuple(w[i : i + width])
            first[x] = min(first.get(x, d), d)
    for d, text in docs:
        w, gone = WORD.findall(text or ""), set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def jaccard(docs):
    """id to (n_shingles, component)."""
    sets = {}
    for d, text in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders = collections.defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    common = collections.Counter((a, b) for h in holders.values() for i, b in enumerate(h) for a in h[:i])
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)]
    return {d: (len(sets[d]), c) for d, c in union(sorted(sets), links).items()}


def private(text):
    """Base spans (kind, start, end) in order."""
    text, out = text or "", []
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])[::-1]
        check = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d))
        if 13 <= len(d) <= 19 and check % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD.findall(text)
    grams = [*zip(w, w[1:], w[2:])]
    times = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def _sound(vector):
    return bool(vector) and all(x is not None and np.isfinite(x) for x in vector)


def _dot(a, b):
    total = a[0] * 0
    for x, y in zip(a, b):
        total += x * y
    return total


def nearest(rows, k=20, every=20):
    """Sorted (query, rank, id, score) of rows (id, vector)."""
    good = [(i, [float(x) for x in v]) for i, v in rows if _sound(v) and any(v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i is None or i % every:
            continue
        others = [(-_dot(v, w), j is None, j or 0, b) for b, (j, w) in enumerate(good) if b != a and len(w) == len(v)]
        out += [(i, r + 1, None if none else j, 0.0 - s) for r, (s, none, j, _) in enumerate(sorted(others)[:k])]
    return sorted(out, key=str)


def hard_negatives(rows, positives=5, negatives=5, low=80, scale=256, every=100):
    """Sorted result of rows (id, vector, label)."""
    good = [(i, [int(np.floor(scale * float(x))) for x in v], g) for i, v, g in rows if g is not None and _sound(v)]
    out = []
    for a, (i, v, g) in enumerate(good):
        if i is None or i % every:
            continue
        pairs = sorted((-_dot(v, w), h != g, j is None, j or 0) for b, (j, w, h) in enumerate(good) if b != a and len(w) == len(v))
        for s, _, none, p in [x for x in pairs if not x[1]][:positives]:
            fit = [x for x in pairs if x[1] and low * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(i, None if none else p, r + 1, None if x[2] else x[3], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out, key=str)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, k=20):
    """Sorted (item, rank, doc, score)."""
    terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m = 75 + 25 * b.total() * n // length
            score = sum(int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[t] + 1)))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            if score:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)
