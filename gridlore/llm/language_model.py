"""Language-model scoring with a log-frequency Bloom filter.

Documents are packed into blocks.  Each block's distinct tokens go, as sorted 64-bit hashes, to
slots that split the hash range evenly; a slot adds the counts of all blocks and returns to each
block the counts of its tokens.  That gives exact unigram counts without a vocabulary on any one
machine.  Bigram counts meet in the same slots and are quantised to
floor(log2 count), and level j of a bigram is put into a Bloom filter as (bigram, j) for all j from
0 (seen once) to its level.  Each slot holds its own segment of the filter, sized by what is put into it, so the
filter grows with the input and its error rate doesn't.  A count is read back by probing levels
until one is missing; a slot returns to each block the levels of its bigrams, seen in training or
not, and the block mixes the bigram estimate with the smoothed unigram:
p(w | v) = SHARE * 2^level(v, w) / c(v) + (1 - SHARE) * p1(w).  A level is never above its count, so over all
words (and one unknown) this sums to one at most; what is short of one is what quantising gave away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ship, stored, table, trim
from .shingles import U, batches, mix, table_of, words

#: Text bytes of a block and of the texts whose tokens share a slot.
BLOCK_BYTES, SLOT_BYTES = 2 << 20, 8 << 20
#: A segment has ROOM bits for each bit set in it, a multiple of eight; PROBES bits a level.  One in 2000 unseen pairs passes.
ROOM, PROBES = 6, 4
#: Share of the bigram estimate in a probability; added count of the unigram.
SHARE, ADD = 0.7, 0.1
BIGRAM_BITS = 48

_END, _START = (int(x) for x in table_of(41, 2))
_TURN = table_of(42, 64)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(10)) == 0


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each followed by the end token, and where each text starts (one more than texts)."""
    parts, counts = [], []
    for a, b in batches(texts):
        h, first = words(texts[a:b], "token")
        n = np.diff(first)
        out = np.full(len(h) + (b - a), U(_END))
        out[np.arange(len(h)) + np.repeat(np.arange(b - a), n)] = h
        parts.append(out)
        counts.append(n + 1)
    at = np.zeros(len(texts) + 1, np.int64)
    if texts:
        np.cumsum(np.concatenate(counts), out=at[1:])
    return np.concatenate(parts) if parts else np.zeros(0, U), at


def bigrams(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of every token with the one before it (the first: with the start)."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = U(_START)
    return mix(before * _TURN[0] + h * _TURN[1]) >> U(64 - BIGRAM_BITS)


def squeeze(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as byte planes of their differences: the upper planes are zeros, which the shuffle's codec removes."""
    d = np.diff(sorted_hashes, prepend=U(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unsqueeze(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def _split(sorted_hashes: np.ndarray, slots: int, bits: int) -> np.ndarray:
    """Borders of the slots in a sorted array."""
    edges = np.arange(1, slots, dtype=U) << U(bits - (slots - 1).bit_length()) if slots > 1 else np.zeros(0, U)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored: block, keys, held, lengths, raw (texts one after another, compressed: they are shuffled once more)."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        keys, held, texts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, keys, held, texts, size
            row = [pa.array([number], pa.int64()), pa.array([keys], pa.list_(key_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pa.compress(b"".join(texts), codec="zstd", asbytes=True)], pa.binary())]
            number, keys, held, texts, size = number + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(row, ["block", "keys", "held", "lengths", "raw"])

        for part in parts:
            key_type = part.column(0).type
            for k, h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                t = b"" if t is None else t
                if texts and size + len(t) > BLOCK_BYTES:
                    yield block()
                keys.append(k)
                held.append(h)
                texts.append(t)
                size += len(t)
        if texts:
            yield block()

    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held"), F.col(text).cast("binary").alias("text"))
    return stored(rows.mapInArrow(pack, f"block long, keys array<{kind}>, held array<boolean>, lengths array<long>, raw binary"), "blocks")


def _texts(raw: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths)
    raw = pa.decompress(raw, int(ends[-1]), codec="zstd", asbytes=True) if len(ends) and ends[-1] else b""
    return [raw[e - n : e] for e, n in zip(ends.tolist(), np.asarray(lengths).tolist())]


def _training(at: np.ndarray, held: np.ndarray) -> np.ndarray:
    return np.repeat(~held, np.diff(at))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token.

    Learns from the rows that are not held out.  Null texts are empty: one token, the end.  A
    null key is hashed as the empty string.  Without training rows nothing is known.  Repeated rows count and
    are scored one by one, equal texts alike; extra columns are dropped; an empty table gives an empty one.
    score is a sum over the text, score_per_token its mean, which tells texts of different lengths apart.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks = _blocks(docs, key, text)
    total = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    slots = 1 << max(4, int(total // SLOT_BYTES).bit_length())

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                number, held, lengths = part.column(0)[i].as_py(), part.column(1)[i].values.to_numpy(zero_copy_only=False).astype(bool), part.column(2)[i].values.to_numpy()
                h, at = sequences(_texts(part.column(3)[i].as_py(), lengths))
                train = _training(at, held)
                known, n_all = np.unique(h, return_counts=True)
                in_train, n_train = np.unique(h[train], return_counts=True)
                n = np.zeros(len(known), np.int64)
                n[np.searchsorted(known, in_train)] = n_train
                both = bigrams(h, at)
                pairs = np.unique(both)
                in_train, n_train = np.unique(both[train], return_counts=True)
                n_pairs = np.zeros(len(pairs), np.int64)
                n_pairs[np.searchsorted(pairs, in_train)] = n_train
                for what, values, counts, bits in (("one", known, n, 64), ("two", pairs, n_pairs, BIGRAM_BITS)):
                    edge = _split(values, slots, bits)
                    full = np.flatnonzero(np.diff(edge))
                    m = len(full)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([what] * m, pa.string()),
                            pa.array(full, pa.int32()),
                            pa.array([number] * m, pa.int64()),
                            pa.array([squeeze(values[edge[s] : edge[s + 1]]) for s in full], pa.binary()),
                            pa.array([counts[edge[s] : edge[s + 1]].astype("<i4").tobytes() for s in full], pa.binary()),
                        ],
                        ["what", "slot", "block", "hashes", "counts"],
                    )
                trim()

    counted = blocks.select("block", "held", "lengths", "raw").mapInArrow(count, "what string, slot int, block long, hashes binary, counts binary")

    def together(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        each = [unsqueeze(x) for x in pdf.hashes]
        h = np.concatenate(each)
        n = np.concatenate([np.frombuffer(x, "<i4") for x in pdf.counts]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.diff(h, prepend=h[:1] ^ U(1)))
        return each, h[first], np.add.reduceat(n, first), order

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        what, slot = pdf.what.iloc[0], int(pdf.slot.iloc[0])
        each, known, n, _ = together(pdf)
        if what == "one":
            back = [n[np.searchsorted(known, x)].astype("<i8").tobytes() for x in each]
        else:
            filled = bloom_size(n)
            bits = np.frombuffer(bloom_segment(known[n > 0], n[n > 0], filled), np.uint8)
            back = [bloom_levels(bits, x, 1, filled).tobytes() for x in each]
        rows = list(zip([what] * len(back), pdf.block, pdf.slot, back, [0] * len(back), [0] * len(back)))
        rows.append((what, -1, slot, b"", int((n > 0).sum()), int(n.sum())))
        trim()
        return pd.DataFrame(rows, columns=["what", "block", "slot", "counts", "distinct", "tokens"])

    back = stored(counted.groupBy("what", "slot").applyInPandas(gather, "what string, block long, slot int, counts binary, distinct long, tokens long"), "gathered")
    sums = back.where("block < 0 and what = 'one'").agg(F.sum("distinct"), F.sum("tokens")).first()
    distinct, tokens = sums[0] or 0, sums[1] or 0
    starts = blocks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    floor = tokens + ADD * (distinct + 1)

    def rate(block: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        held = np.asarray(b["held"], bool)
        h, at = sequences(_texts(b["raw"], np.asarray(b["lengths"])))
        counts = counts.sort_values("slot")
        n = np.concatenate([np.frombuffer(x, "<i8") for x in counts.counts[counts.what == "one"]])
        levels = np.concatenate([np.frombuffer(x, np.int8) for x in counts.counts[counts.what == "two"]])
        known = np.unique(h)
        c = n[np.searchsorted(known, h)]
        p1 = (c + ADD) / floor
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[at[:-1]] = starts
        pairs, of = np.unique(bigrams(h, at), return_inverse=True)
        c2 = level_counts(levels)[of]
        p2 = np.minimum(1, c2 / np.maximum(before, 1))  # above 1 only where the filter errs
        p = np.where(before > 0, SHARE * p2 + (1 - SHARE) * p1, p1)
        add = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every text has its end token
        trim()
        return pd.DataFrame({"key": b["keys"], "held_out": held, "n_tokens": np.diff(at), "n_known": add((c > 0).astype(np.int64)), "train_tokens": tokens, "base_score": add(np.log10(p1)), "score": add(np.log10(p)), "score_per_token": add(np.log10(p)) / np.diff(at)})

    kind = docs.select(key).schema[0].dataType.simpleString()
    out = blocks.select("block", "keys", "held", "lengths", "raw").groupBy("block").cogroup(back.where("block >= 0").select("what", "block", "slot", "counts").groupBy("block"))
    return out.applyInPandas(rate, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_per_token double").withColumnRenamed("key", key)


def _probe(pairs: np.ndarray, level: int, probe: int, segment: int) -> np.ndarray:
    h = mix(pairs * _TURN[2] + U(level * PROBES + probe))
    return (((h >> U(32)) * U(segment)) >> U(32)).astype(np.int64)


def bloom_size(counts: np.ndarray) -> int:
    """Bits of the segment for these counts."""
    some = counts[counts > 0]
    return 8 * (ROOM * PROBES * int((np.floor(np.log2(some)) + 1).sum()) // 8 + 1)


def bloom_segment(pairs: np.ndarray, counts: np.ndarray, segment: int) -> bytes:
    """The bits of one slot: (pair, level) for every level up to floor(log2 count)."""
    out = np.zeros(segment, bool)
    top = np.floor(np.log2(counts)).astype(int) if len(counts) else np.zeros(0, int)
    for level in range(int(top.max(initial=-1)) + 1):
        for probe in range(PROBES):
            out[_probe(pairs[top >= level], level, probe, segment)] = True
    return np.packbits(out, bitorder="little").tobytes()


def bloom_levels(bits: np.ndarray, pairs: np.ndarray, slots: int, segment: int) -> np.ndarray:
    """The highest level reached without a miss; -1 where there is none."""
    out = np.full(len(pairs), -1, np.int8)
    base = (pairs >> U(BIGRAM_BITS - (slots - 1).bit_length())).astype(np.int64) * segment
    alive, level = np.arange(len(pairs)), -1
    while len(alive) and level < 62:
        level += 1
        for probe in range(PROBES):
            at = base[alive] + _probe(pairs[alive], level, probe, segment)
            alive = alive[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out[alive] = level
    return out


def level_counts(levels: np.ndarray) -> np.ndarray:
    """The least count of each level; 0 where there is none."""
    return np.where(levels >= 0, 2.0**levels, 0.0)


def bloom_counts(bits: np.ndarray, pairs: np.ndarray, slots: int, segment: int) -> np.ndarray:
    """Counts read back."""
    return level_counts(bloom_levels(bits, pairs, slots, segment))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
