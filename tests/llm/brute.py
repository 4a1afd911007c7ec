"""Brute-force versions that the tests compare operators with."""

import re
import zlib

import numpy as np


def smallest_reachable(ids, links):
    """The smallest id that each id reaches over links."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def cosine_links(rows, least=0.95):
    """Ordered pairs of row numbers whose vectors, of equal length, have a cosine of at least `least`; rows are (id, vector)."""
    good = []
    for n, (_, v) in enumerate(rows):
        if v and None not in v:
            x = np.array(v, float)
            if np.isfinite(x).all() and x.any():
                x = x / np.abs(x).max()
                good.append((n, x / np.linalg.norm(x)))
    return [(i, j) for i, u in good for j, v in good if i != j and len(u) == len(v) and u @ v >= least]


def shingles(text):
    """Distinct runs of five words; the whole sequence of a shorter text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar_pairs(docs, percent):
    """Pairs a < b of ids whose sets of runs have at least this similarity; docs are (id, text)."""
    sets, holders = [(d, shingles(t)) for d, t in docs if d is not None], {}
    for n, (_, x) in enumerate(sets):
        for run in x:
            holders.setdefault(run, []).append(n)
    pairs = {(m, n) for held in holders.values() for m in held for n in held if m < n}
    like = [(sets[m], sets[n]) for m, n in pairs]
    return [(min(a, b), max(a, b)) for (a, x), (b, y) in like if a != b and 100 * len(x & y) >= percent * len(x | y)]


def mined_negatives(rows, anchor=lambda i: i % 50 == 0, positives=5, negatives=3, low=50, high=95):
    """Sorted (anchor, positive, rank, negative, positive score, negative score); rows are (id, label, whole-number vector)."""
    out = []
    for n, (i, label, x) in enumerate(rows):
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, m) for m, (j, _, y) in enumerate(rows) if m != n and len(y) == len(x))
        same = [(s, j) for s, j, m in scored if rows[m][1] == label][:positives]
        other = [(s, j) for s, j, m in scored if rows[m][1] != label]
        for p, j in same:
            fit = [(s, k) for s, k in other if low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def variants(docs, shortest=5, fewest=3, every=97):
    """{word: (form, root, n, near words, form's n)} of docs (id, text), from the neighbours that one edit can make."""
    counts = {}
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= shortest:
                counts[word] = counts.get(word, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= fewest}
    letters, form, near = sorted({c for w in counts for c in w}), {}, {}
    for w in counts:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = sorted((-counts[v], v) for v in edits - {w} if v in counts)
        form[w] = near[w][0][1] if near[w] and -near[w][0][0] >= 2 * counts[w] else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def without_repeats(docs, window=13):
    """For each of docs (id, text): flags of the words to remove, and the words."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (doc, _), w in zip(docs, words, strict=True):
        for i in range(len(w) - window + 1 if doc is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if doc is not None else 0):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((gone, w))
    return out
