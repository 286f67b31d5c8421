"""Exact repeats: removes every byte that a LENGTH-byte string covers which starts anywhere else too.

Each LENGTH-byte window is owned by one anchor: the KGRAM inside it with the least hash (the last
of equals).  Equal windows own equal anchors at equal offsets, and an anchor owns a run of
windows, so windows need be compared only within the group of an anchor's hash, and only one
anchor in about LENGTH / 2.4 bytes is stored.  An anchor's context is all bytes of the windows it
owns.  Contexts that occur twice are repeats as a whole, and only one copy of a context goes on; of the
rest, groups with different contexts meet, and their windows are compared by hash.  Windows of one
anchor all contain it, so what is removed around it is one stretch: first to last repeated window.

Groups with more than GROUP contexts are dealt out in parts.  Parts first tell each other which window
hashes they hold, by range of hash, so a group of any size is compared whole in bounded memory.

The same anchors over words instead of bytes find the passages of PASSAGE words or more that documents
share with each other, whatever their bytes (``shared_passages``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import join_groups, release, ship, steady, stored, table, trim
from .shingles import U, is_word, mix, powers, table_of, words

LENGTH, KGRAM = 400, 64
#: Words of a shared passage and of its anchors.
PASSAGE, GRAM = 50, 8
#: Contexts of a group that one task takes; ranges of hash in which larger groups meet.
GROUP, RANGES = 2000, 64
#: Contexts that are compared in one pass, whole groups at a time.
STEP = 4096
#: Text bytes that are scanned at a time; a longer text is scanned in overlapping pieces.
PIECE = 1 << 19

_VALUE = table_of(61)
_TURN = table_of(62, 4)  # offsets, anchors of windows, anchors of contexts


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end), wherever they lie."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values."""
    n = len(x) - width + 1
    pad = np.concatenate([x, np.full(-len(x) % width, np.iinfo(U).max, U)]).reshape(-1, width)
    left = np.minimum.accumulate(pad, 1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(values: np.ndarray, ends: np.ndarray, length: int = LENGTH, kgram: int = KGRAM) -> tuple[np.ndarray, ...]:
    """Of symbols of texts laid end to end (ends: where each stops): first and last window of each anchor, anchor and context hashes."""
    none = np.zeros(0, np.int64)
    if len(values) < length:
        return none, none, np.zeros(0, U), np.zeros(0, U)
    sums = _sums(values)
    n = len(values) - kgram + 1
    h = mix((sums[kgram:] - sums[:-kgram]) * powers(len(sums))[1][:n] + U(kgram))
    bits = U(max(20, len(values).bit_length()))
    low = (U(1) << bits) - U(1)
    key = (h & ~low) | (low - np.arange(n, dtype=U))  # of equal hashes the last wins
    own = (low - (_sliding_min(key, length - kgram + 1) & low)).astype(np.int64)
    stop = np.repeat(ends, np.diff(ends, prepend=0))[: len(own)]
    window = np.flatnonzero(np.arange(length, length + len(own)) <= stop)
    own = own[window]
    new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1))
    first, last, pos = window[new], window[np.append(new[1:], len(window)) - 1], own[new]
    context = _hashes(sums, first, last + length) + (pos - first).astype(U) * _TURN[0]
    return first, last, h[pos], mix(mix(context) + h[pos] * _TURN[2])


def _symbols(texts: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash values of all bytes or words of all texts in order, and how many each text has."""
    if unit == "byte":
        return _VALUE[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)
    h, first = words(texts)
    return h, np.diff(first)


def _long(text: bytes, length: int, unit: str) -> Iterator[tuple[int, np.ndarray]]:
    """The symbols of a text of any length, in pieces that overlap by length - 1, and where each begins."""
    if unit == "byte":
        for s in range(0, len(text) - length + 1, PIECE):
            yield s, _symbols([text[s : s + PIECE + length - 1]], unit)[0]
        return
    held, shift = np.zeros(0, U), 0
    for bit in _bits(text):
        held = np.concatenate([held, _symbols([bit], unit)[0]])
        if len(held) >= length:
            yield shift, held
            shift, held = shift + len(held) - length + 1, held[len(held) - length + 1 :]


def _members(docs: DataFrame, text: str, length: int, kgram: int, unit: str = "byte") -> DataFrame:
    """row, lo, hi (first and last owned window, by symbols of the text), k (anchor hash), ctx (hash of anchor and context)."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[int], values: np.ndarray, sizes: np.ndarray, shift: int = 0) -> pa.RecordBatch:
            ends = np.cumsum(sizes)
            lo, hi, k, ctx = anchors(values, ends, length, kgram)
            which = np.searchsorted(ends, lo, "right")
            base = (ends - sizes)[which] - shift
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(rows, np.int64)[which]), pa.array(lo - base), pa.array(hi - base), pa.array(k.view(np.int64)), pa.array(ctx.view(np.int64))], ["row", "lo", "hi", "k", "ctx"])

        for part in parts:
            rows, texts, size = [], [], 0
            for row, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if t is None or len(t) < length:
                    continue
                if len(t) > PIECE:
                    for s, values in _long(t, length, unit):
                        yield found([row], values, np.array([len(values)]), s)
                    continue
                rows.append(row)
                texts.append(t)
                size += len(t)
                if size >= PIECE:
                    yield found(rows, *_symbols(texts, unit))
                    rows, texts, size = [], [], 0
            if rows:
                yield found(rows, *_symbols(texts, unit))
            trim()

    return docs.select("row", F.col(text).cast("binary").alias("t")).mapInArrow(scan, "row long, lo long, hi long, k long, ctx long")


def window_hashes(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of all contexts in order, and each context's first (one more than contexts)."""
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts], np.int64)
    many = size - length + 1
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(first[-1]) + np.repeat(np.cumsum(size) - size - first[:-1], many)
    return _hashes(_sums(_VALUE[raw]), at, at + length), first


def _stretches(row: np.ndarray, lo: np.ndarray, n: np.ndarray, first: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, first and last repeated window of every context that occurs once and has any; repeated: by window."""
    at = np.flatnonzero(repeated)
    of = np.searchsorted(first, at, "right") - 1
    at, of = at[n[of] == 1], of[n[of] == 1]
    new = np.flatnonzero(np.diff(of, prepend=-1))
    end = np.append(new[1:], len(of))[: len(new)] - 1
    of = of[new]
    return row[of], lo[of] + at[new] - first[of], lo[of] + at[end] - first[of]


def _in_group(contexts: DataFrame, length: int) -> DataFrame:
    """Groups lie together in a partition, sorted; many are compared in one pass.  A window of an anchor occurs once in a context, so windows are counted over contexts."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        k, n, row, lo, text = zip(*rows)
        k, n, row, lo = np.array(k).view(U), np.array(n), np.array(row), np.array(lo)
        h, first = window_hashes(list(text), length)
        of = np.repeat(np.arange(len(k)), np.diff(first))
        key = mix(h + k[of] * _TURN[1])
        order = np.argsort(key)
        border = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        total = np.add.reduceat(np.minimum(n, 2)[of[order]], border)
        repeated = np.zeros(len(key), bool)
        repeated[order] = np.repeat(total > 1, np.diff(np.append(border, len(key))))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stretches(row, lo, n, first, repeated)], ["row", "lo", "hi"])

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in parts:
            held += zip(*(part.column(c).to_pylist() for c in range(5)))
            start = 0
            while len(held) - start > 2 * STEP:  # cut where a group ends
                stop = start + STEP
                while stop < len(held) and held[stop][0] == held[stop - 1][0]:
                    stop += 1
                if stop == len(held):
                    break
                yield found(held[start:stop])
                start = stop
            held = held[start:]
        if held:
            yield found(held)

    rows = contexts.select("k", "n", "row", "lo", "context").repartition("k").sortWithinPartitions("k")
    return rows.mapInArrow(compare, "row long, lo long, hi long")


def _in_parts(contexts: DataFrame, length: int) -> DataFrame:
    """Large groups: contexts have a part; parts exchange window hashes by range."""

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        h, first = window_hashes(pdf.context.tolist(), length)
        twice = np.repeat(pdf.n.to_numpy() > 1, np.diff(first))
        values, counts = np.unique(np.concatenate([h, h[twice]]), return_counts=True)
        edge = np.searchsorted(values, np.arange(1, RANGES, dtype=U) << U(64 - (RANGES - 1).bit_length()))
        pieces = zip(np.split(values, edge), np.split(counts, edge))
        k, part = pdf.k.iloc[0], pdf.part.iloc[0]
        return pd.DataFrame([(k, part, r, v.tobytes(), (c > 1).tobytes()) for r, (v, c) in enumerate(pieces) if len(v)], columns=["k", "part", "range", "hashes", "many"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(x, U) for x in pdf.hashes]
        own = [np.frombuffer(x, bool) for x in pdf.many]
        values, counts = np.unique(np.concatenate([*each, *(e[m] for e, m in zip(each, own))]), return_counts=True)
        many = values[counts > 1]
        return pd.DataFrame({"k": pdf.k, "part": pdf.part, "hashes": [e[np.isin(e, many)].tobytes() for e in each]})

    def mark(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=["row", "lo", "hi"])
        many = np.concatenate([np.zeros(0, U), *(np.frombuffer(x, U) for x in told.hashes)])
        h, first = window_hashes(pdf.context.tolist(), length)
        return pd.DataFrame(dict(zip(("row", "lo", "hi"), _stretches(pdf.row.to_numpy(), pdf.lo.to_numpy(), pdf.n.to_numpy(), first, np.isin(h, many)))))

    told = contexts.groupBy("k", "part").applyInPandas(tell, "k long, part int, range int, hashes binary, many binary")
    met = told.groupBy("k", "range").applyInPandas(meet, "k long, part int, hashes binary")
    return contexts.groupBy("k", "part").cogroup(met.groupBy("k", "part")).applyInPandas(mark, "row long, lo long, hi long")


def _merged(found: DataFrame) -> DataFrame:
    """row and spans: array<struct<s, e>>, the union of the stretches (row, s, e) in order; stretches that touch are one."""
    kind = "row long, spans array<struct<s:bigint,e:bigint>>"

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(1)
            s, e = lists.flatten().field("s").to_numpy(), lists.flatten().field("e").to_numpy()
            of = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            order = np.lexsort((s, of))
            s, e, of = s[order], e[order], of[order]
            wide = int(e.max(initial=0)) + 1
            reach = np.maximum.accumulate(e + of * wide)  # each row's ends lie beyond those of the rows before
            new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (s + of * wide > np.concatenate([[-1], reach[:-1]])))
            stop = reach[np.append(new[1:], len(s)) - 1] - of[new] * wide if len(s) else e
            spans = pa.StructArray.from_arrays([pa.array(s[new]), pa.array(stop)], ["s", "e"])
            first = np.searchsorted(of[new], np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(first), spans)], ["row", "spans"])

    return found.groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("all")).mapInArrow(merge, kind)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, kgram: int = KGRAM, group: int = GROUP) -> DataFrame:
    """row and spans: array<struct<s, e>> of bytes to remove, merged and in order, for the rows of docs that have any.

    docs needs a column row that numbers its rows and comes out the same each time it is read.
    """
    ship(docs.sparkSession)
    members = stored(_members(docs, text, length, kgram), "anchors")
    # one of each group's places stands for it; firsts of one aggregation come from one row, and need no sort
    one = [F.first(c).alias(c) for c in ("k", "row", "lo", "hi")]
    groups = stored(members.groupBy("ctx").agg(F.count("*").alias("n"), *one), "contexts")
    total = groups.agg(F.sum("n")).first()[0] or 0
    kinds = groups.groupBy("k").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = join_groups(groups, kinds, "k", "kinds", total)
    need = wanted.groupBy("row").agg(F.collect_list(F.struct("k", "ctx", "n", "kinds", "lo", "hi")).alias("need"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, t, need in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                t, s = t.as_py(), need.values
                lo, hi = s.field("lo").to_numpy(), s.field("hi").to_numpy()
                cuts = pa.array([t[a : b + length] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())
                parts_of = (s.field("kinds").to_numpy() + group - 1) // group
                which = np.where(parts_of > 1, s.field("ctx").to_numpy() % np.maximum(parts_of, 1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([s.field("k"), pa.array(which), s.field("n"), pa.array(np.full(len(lo), row, np.int64)), s.field("lo"), cuts], ["k", "part", "n", "row", "lo", "context"])

    texts = docs.select("row", F.col(text).cast("binary").alias("t"))
    # a merge join whatever the sizes: this side of it grows with the documents
    contexts = stored(texts.join(need.hint("merge"), "row").select("row", "t", "need").mapInArrow(cut, "k long, part int, n long, row long, lo long, context binary"), "context-texts")
    found = _in_group(contexts.where("part < 0").drop("part"), length)
    if contexts.where("part >= 0").take(1):
        found = found.union(_in_parts(contexts.where("part >= 0"), length))
    found = stored(found, "stretches")
    release(contexts)
    # contexts that occur more than once, as a whole
    whole = join_groups(members, groups.where("n > 1").select("ctx", "n"), "ctx", "n", total).select("row", "lo", "hi")
    spans = stored(_merged(found.union(whole).select("row", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))), "spans")
    release(members)
    return spans


def shared_passages(docs: DataFrame, text: str = "text", length: int = PASSAGE, kgram: int = GRAM) -> DataFrame:
    """row and spans: array<struct<s, e>> of the words that lie in passages of length words or more which another row holds too.

    Words are runs of letters and digits, A-Z as a-z, so neither signs nor spacing hide a passage.  What repeats
    within one row only is not shared.  Only windows of anchors that occur in different contexts are compared,
    by hash; a window or a context may be held by any share of the rows.
    """
    ship(docs.sparkSession)
    members = stored(_members(docs, text, length, kgram, "word"), "word-anchors")
    one = [F.first(c).alias(c) for c in ("k", "row", "lo", "hi")]
    groups = stored(members.groupBy("ctx").agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b"), *one), "word-contexts")
    total = groups.agg(F.sum("n")).first()[0] or 0
    kinds = groups.groupBy("k").agg(F.count("*").alias("kinds")).where("kinds > 1")
    need = join_groups(groups, kinds, "k", "kinds", total).groupBy("row").agg(F.collect_list(F.struct("k", "ctx", "a", "b", "lo", "hi")).alias("need"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for t, need in zip(part.column(0), part.column(1)):
                s = need.values
                k, ctx, a, b, lo, hi = (s.field(c).to_numpy() for c in ("k", "ctx", "a", "b", "lo", "hi"))
                sums = _sums(np.concatenate([_symbols([x], "word")[0] for x in _bits(t.as_py())]))
                many = hi - lo + 1
                of = np.repeat(np.arange(len(lo)), many)
                at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                h = mix(_hashes(sums, lo[of] + at, lo[of] + at + length) + k.view(U)[of] * _TURN[1])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ctx[of]), pa.array(at.astype(np.int32)), pa.array(a[of]), pa.array(b[of])], ["h", "ctx", "at", "a", "b"])
            trim()

    texts = docs.select("row", F.col(text).cast("binary").alias("t"))
    windows = stored(texts.join(need.hint("merge"), "row").select("t", "need").mapInArrow(cut, "h long, ctx long, at int, a long, b long"), "windows")
    shared = windows.groupBy("h").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("m")).where("a < b").select("h", "m")
    found = join_groups(windows.where("a = b"), stored(shared, "shared"), "h", "m", total).groupBy("ctx").agg(F.min("at").cast("long").alias("f"), F.max("at").cast("long").alias("l"))
    part = found.join(groups.select("ctx", "n"), "ctx")
    whole = groups.where("a < b").select("ctx", F.lit(0).cast("long").alias("f"), (F.col("hi") - F.col("lo")).alias("l"), "n")
    spots = join_groups(members.select("row", "lo", "ctx"), stored(part.select("ctx", "f", "l", "n").union(whole), "spots"), "ctx", "n", total)
    spans = stored(_merged(spots.select("row", (F.col("lo") + F.col("f")).alias("s"), (F.col("lo") + F.col("l") + length).alias("e"))), "passages")
    release(members)
    release(windows)
    return spans


def _bits(text: bytes) -> Iterator[bytes]:
    """A text cut between words."""
    a = 0
    while a < len(text) or not a:
        b = min(len(text), a + PIECE)
        while b < len(text) and is_word(text[b]):
            b += 1
        yield text[a:b]
        if b == len(text):
            return
        a = b


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP, passage: int = PASSAGE) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256, n_shared_words, shared.

    Null texts are empty; shorter texts than length keep all; equal texts of length or more lose all.
    What is left need not be valid UTF-8, as spans are bytes.  n_shared_words counts the words in passages of
    passage words or more that another row holds too (``shared_passages``), shared says whether there are any; both are
    judged by words on the input and remove nothing.
    """
    ship(docs.sparkSession)
    docs = steady(docs.select(key, text))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    named = rows.select("row", F.col("t").alias(text))
    passages = shared_passages(named, text, passage)
    spans = repeated_spans(named, text, length, group=group)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                at, left = 0, []
                for s in spans or ():
                    left.append(t[at : s["s"]])
                    at = s["e"]
                left = b"".join([*left, t[at:]])
                out.append((len(t), len(t) - len(left), len(spans or ()), left, hashlib.sha256(left).hexdigest()))
            n, gone, runs, left, sha = zip(*out) if out else ((),) * 5
            shared = part.column(3).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(left, pa.binary()), pa.array(sha, pa.string()), part.column(3), pa.array(shared > 0)],
                ["key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "n_shared_words", "shared"],
            )

    long = passages.select("row", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"]).alias("words"))
    both = spans.join(long, "row", "full")
    done = rows.join(both.hint("merge"), "row", "left").select("key", "t", "spans", F.coalesce("words", F.lit(0).cast("long")).alias("words"))
    done = done.mapInArrow(keep, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, n_shared_words long, shared boolean")
    return done.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
