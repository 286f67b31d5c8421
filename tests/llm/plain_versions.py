"""Plain versions of the operators, for tests."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from gridlore.llm import near_duplicates, quality


def plain_quality(net, text):
    """One text by itself, window by window."""
    q = quality
    tiles = max(1, -(-(len(text) + q.WIDTH) // q.TILE))
    raw = text + bytes((tiles + 1) * q.TILE - len(text))
    peaks = []
    for t in range(tiles):
        at = range(t * q.TILE, (t + 1) * q.TILE, q.STRIDE)
        peaks.append(np.max([net.embed[list(raw[p : p + q.WIDTH])].ravel() @ net.filters for p in at], 0))
    chunks, t = [], 0
    while True:
        chunks.append(np.maximum(np.max(peaks[t : t + q.CHUNK], 0) + net.bias, 0))
        if t + q.CHUNK >= tiles:
            break
        t += q.STEP
    features = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)])
    return 1 / (1 + math.exp(-float(features @ net.out + net.out_bias)))


def brute_hits(texts, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for item, it in items:
            iw = split(it)
            for a in range(max(0, len(iw) - width) + 1 if iw else 0):
                win = iw[a : a + width]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids.add(str(item))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def brute_spans(t):
    t = t or ""
    luhn = lambda d: sum(x - 9 if x > 9 else x for x in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]


def plain_model(texts):
    """p(word | word before), by plain counts quantised to powers of two, the training vocabulary, and the sequences."""
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    seqs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [0] for t in texts]
    train = [s for k, s in enumerate(seqs) if not held(k)]
    c, c2 = Counter(w for s in train for w in s), Counter(p for s in train for p in zip([1, *s], s))
    n, v = sum(c.values()), len(c)
    before = Counter(c)
    before[1] = len(train)

    def p(a, b):
        p1 = (c[b] + 0.1) / (n + 0.1 * (v + 1))
        level = 2 ** int(math.log2(c2[a, b])) if c2[a, b] else 0
        return 0.7 * level / before[a] + 0.3 * p1 if before[a] else p1

    return p, list(c), seqs, c2


def plain_scores(texts):
    """Scores of all texts, and the least count of a bigram in training."""
    p, _, seqs, c2 = plain_model(texts)
    return [sum(math.log10(p(a, b)) for a, b in zip([1, *s], s)) for s in seqs], min(c2.values(), default=0)


def brute_classes(texts, similarity=0.8):
    doc, ids, tf, digest = near_duplicates.weighted_sets([(t or "").encode() for t in texts], 5)
    n = len(texts)
    df = np.zeros(near_duplicates.BUCKETS, int)
    low = np.uint64(near_duplicates.BUCKETS - 1)
    for d in range(n):
        np.add.at(df, np.unique((ids[doc == d] & low).astype(int)), 1)
    idf = near_duplicates.idf_table(df, n)
    sets = [(ids[doc == d], tf[doc == d] * idf[(ids[doc == d] & low).astype(int)].astype(float)) for d in range(n)]
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(n):
        for b in range(a):
            if len(sets[a][0]) and len(sets[b][0]) and near_duplicates.jaccard(sets[a], sets[b]) >= similarity:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [root(k) for k in range(n)]


def brute_passages(texts, length):
    """Spans of words in runs of length words that another text holds too, by row; rows without any are left out."""
    split = [re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower()) for t in texts]
    held = Counter(w for s in split for w in {tuple(s[i : i + length]) for i in range(len(s) - length + 1)})
    out = {}
    for row, s in enumerate(split):
        spans = []
        for i in range(len(s) - length + 1):
            if held[tuple(s[i : i + length])] > 1:
                if spans and spans[-1][1] >= i:
                    spans[-1] = (spans[-1][0], i + length)
                else:
                    spans.append((i, i + length))
        if spans:
            out[row] = spans
    return out
