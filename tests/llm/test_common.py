"""Shared pieces: components, numbering, hashing, commits to the shared folder."""

import numpy as np
from pyspark.sql import functions as F

from gridlore.llm import shingles as S
from gridlore.llm.common import fold_ascii, numbered, shared_dir, stored
from gridlore.llm.components import components


def union_find(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (7000, 7000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == union_find(links)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


def test_numbering_is_gapless_also_in_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, None).otherwise("b").alias("g"), (F.col("id") % 100).alias("k"))
    out = numbered(df, "g", ["k"], "i", "t").collect()
    for g in ("hot", "b", None):
        mine = sorted((r.i, r.k) for r in out if r.g == g)
        assert [i for i, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for _, k in mine)


def test_shared_folder_is_the_session_s(spark):
    df = stored(spark.range(5), "five")
    assert df.count() == 5 and all(f.removeprefix("file://").startswith(shared_dir(spark).removeprefix("file://")) for f in df.inputFiles())


def test_fold_is_ascii_only(spark):
    df = spark.createDataFrame([("ABC xyz",), ("ÀÉ AbC",), (None,)], "t string")
    assert [r[0] for r in df.select(fold_ascii(F.col("t"))).collect()] == ["abc xyz", "ÀÉ abc", None]


def test_word_hashes_depend_on_the_word_only():
    h, first = S.words([b"The cat, the DOG", b"", "éà cat".encode(), b"dog"])
    assert first.tolist() == [0, 4, 4, 6, 7]
    assert h[0] == h[2] and h[1] == h[5] and h[3] == h[6] and len(set(h.tolist())) == 4


def test_shingles_of_short_texts():
    h, first = S.words([b"a b c", b"a b c d e f", b"", b"a b c"])
    s, at = S.shingles(h, first, 5)
    assert at.tolist() == [0, 1, 3, 3, 4] and s[0] == s[3] and len(set(s.tolist())) == 3
