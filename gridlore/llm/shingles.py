"""Words and word shingles of whole texts as 64-bit hashes, in numpy passes over many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multiplier of the byte polynomial modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def table_of(seed: int, n: int = 256) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | U(1)


#: A word is a run of digits, ASCII letters and bytes above 127.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = table_of(11)[_FOLD]  # A-Z take the values of a-z
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n (at least)."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(m, base, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def is_word(byte: int) -> bool:
    return bool(_WORD[byte])


def words(texts: list[bytes], kind: str = "word") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words start (one more than texts).

    kind "word": A-Z fold to a-z and words are alphanumeric runs; kind "token": runs without
    white space, folded alike.
    """
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    inside = (_WORD if kind == "word" else _SPACE)[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))  # every text ends outside a word
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    return h, np.searchsorted(start, at)


_TURN = table_of(12, 64)


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words, and where each text's runs start.

    A text with fewer words, but not none, has one shingle: all of them.
    """
    n = np.diff(first)
    total = len(h)
    if total >= width:
        s = np.zeros(total - width + 1, U)
        for j in range(width):
            s += h[j : total - width + 1 + j] * _TURN[j]
        s = mix(s)
    else:
        s = np.zeros(0, U)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(many, out=out_first[1:])
    doc = np.repeat(np.arange(len(n)), many)
    at = first[:-1][doc] + np.arange(len(doc)) - out_first[:-1][doc]
    out = np.empty(len(doc), U)
    full = n[doc] >= width
    out[full] = s[at[full]]
    for d in np.flatnonzero((n > 0) & (n < width)):
        w = h[first[d] : first[d + 1]]
        out[out_first[d]] = mix(np.array([(w * _TURN[: len(w)]).sum(dtype=U) + U(len(w))], U))[0]
    return out, out_first


def batches(texts: list[bytes], most: int = 1 << 20):
    """(start, stop) ranges of texts with about so many bytes, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
