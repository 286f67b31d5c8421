"""Merging Burrows-Wheeler transforms of text shards by iterative interleave refinement, in numpy.

The named method for repeats, for bounded collections: it needs one pass over all suffixes for each byte of
the repeat length and all shards at hand, which is why ``repeats`` works on anchors instead (figures in
the README).  Tests hold one against the other.
"""

from __future__ import annotations

import numpy as np


def shard_bwt(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Transform (0 ends a text, bytes count from 1) of a shard, and the text position of every suffix in its order.

    Suffixes are sorted by prefix doubling; ends of texts differ by the texts' order.
    """
    raw = np.concatenate([np.concatenate([np.frombuffer(t, np.uint8).astype(np.int64) + 1, [0]]) for t in texts]) if texts else np.zeros(0, np.int64)
    n = len(raw)
    ends = np.flatnonzero(raw == 0)
    rank = raw + len(ends)
    rank[ends] = np.arange(len(ends))
    h, base = 1, max(n, 257 + len(ends)) + 1
    while True:
        key = rank * base + np.concatenate([rank[h:], np.zeros(min(h, n), np.int64)])[:n] + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            break
        h *= 2
    start = np.concatenate([[0], ends[:-1] + 1]) if n else ends
    before = np.concatenate([[0], raw[:-1]])
    before[start] = 0  # what stands before a text is its own end
    return before[order], order


def refine(bwts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of every suffix in merged order by the first depth symbols, and where each block of equal prefixes begins.

    One round sorts the current interleave stably by the transforms' next symbols; a block splits where
    symbols or former blocks differ, so the round number of a split is the common prefix there.  No suffix is
    compared with another.
    """
    z = np.repeat(np.arange(len(bwts)), [len(b) for b in bwts])
    first = np.concatenate([[0], np.cumsum([len(b) for b in bwts])[:-1]]).astype(np.int64)
    flat = np.concatenate(bwts) if bwts else np.zeros(0, np.int64)
    block = np.zeros(len(z), np.int64)
    for _ in range(depth):
        by_shard = np.argsort(z, kind="stable")
        place = np.empty(len(z), np.int64)
        place[by_shard] = np.arange(len(z))  # shards lie one after another in flat, each in its own order
        symbol = flat[place].astype(np.int16)
        order = np.argsort(symbol, kind="stable")
        symbol, z, former = symbol[order], z[order], block[order]
        begins = (np.diff(symbol, prepend=-1) != 0) | (np.diff(former, prepend=-1) != 0) | (symbol == 0)
        new = np.cumsum(begins) - 1
        if len(new) and new[-1] == len(new) - 1:  # every suffix is alone: nothing repeats
            block = new
            break
        block = new
    return z, np.flatnonzero(np.diff(block, prepend=-1))


def repeated_starts(shards: list[list[bytes]], length: int) -> list[np.ndarray]:
    """For each shard, the positions in its concatenated texts (each followed by one end) where a string of length bytes starts that starts elsewhere too."""
    built = [shard_bwt(s) for s in shards]
    z, begins = refine([b for b, _ in built], length)
    size = np.diff(np.append(begins, len(z)))
    many = np.repeat(size > 1, size)
    out = []
    for s, (_, order) in enumerate(built):
        out.append(np.sort(order[many[z == s]]))
    return out
