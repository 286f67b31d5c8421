"""The merged transforms find the repeats that a plain count finds."""

import random
from collections import Counter

import numpy as np
import pytest

from gridlore.llm import interleave


@pytest.mark.parametrize("seed", range(4))
def test_repeats_equal_plain_counts(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 60))).encode() for _ in range(12)] + [b"", b"a" * 30, b"abc" * 9]
    cut = r.randint(0, len(texts))
    shards = [texts[:cut], texts[cut : cut + 3], texts[cut + 3 :]]
    for length in (1, 3, 7, 20):
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for shard, got in zip(shards, interleave.repeated_starts(shards, length)):
            at, want = 0, []
            for t in shard:
                want += [at + i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1]
                at += len(t) + 1
            assert got.tolist() == want


def test_shard_transform_is_the_sorted_one():
    bwt, order = interleave.shard_bwt([b"banana", b"ana"])
    raw = b"banana\0ana\0"
    key = lambda i: [(raw[j], j if raw[j] == 0 else 0) for j in range(i, len(raw))]
    assert order.tolist() == sorted(range(len(raw)), key=key)
    assert len(bwt) == len(raw) and np.count_nonzero(bwt == 0) == 2
