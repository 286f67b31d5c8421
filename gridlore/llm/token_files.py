"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank by corpus frequency, so common ones take one byte.  A block holds
the ids of consecutive documents: ranks take 1 to 4 bytes each, little-endian (data), and two bits
each in separate control bytes, four ids to a byte.  Decoding looks a control byte up in a table of
256 rows of lengths and gathers.  A file is a Parquet table of blocks, so any store that Spark can
reach holds it: block columns are part, start (ids of all documents of this part before the block),
doc_ids, lengths, control, data.  The rank table is written beside the blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import release, scratch, ship, stored, table
from .shingles import U, mix, powers, table_of

END = 2
#: Ids of a block (a longer document makes a block of its own).
BLOCK_IDS = 1 << 18
#: Pieces that a worker remembers.
MEMORY = 1_000_000

#: Texts of these characters only are cut into pieces here.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]*")
#: Their UTF-8 bytes: 0 white space, 1 letters, 2 digits, 3 signs; hash values fold capitals.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLD[0x80:0x9F] += 32
_VALUE, _CHECK = table_of(21)[_FOLD], table_of(22)[_FOLD]
#: Longer pieces aren't hashed.
LONGEST = 256


# --- coding -------------------------------------------------------------------------------------

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of non-negative integers below 2**32."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = raw[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


# --- tokenizer ----------------------------------------------------------------------------------


class Apart(ValueError):
    """Pieces that can't be told apart."""


class Encoder:
    """A tokenizer of the tokenizers library with a bounded memory of pieces.

    Only for tokenizers that drop white space, lower-case, cut words into letter runs, digits and
    sign runs, and mark the last token of a piece (tried on a probe, and again on the first text of every
    call); others, and texts with other characters, apostrophes or special-token marks, go to the library
    whole.  Pieces are cut and hashed in numpy; each new one is encoded once, many together.  A second,
    independent hash is held against each piece's own; where one differs, or a piece is very long, the library takes over.
    """

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(max(names.values(), default=0), end) + 1
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.last = np.zeros(size, bool)
        self.last[[i for w, i in names.items() if w.endswith("</w>")]] = True
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(map(re.escape, marks))) if marks else re.compile(r"(?!)")
        self._forget()
        probe = ["Stop, 12 times!? a--b c_d\nÉs x1y. (z)", "ÀÉÿ <b> A.b\tC"]
        try:
            self.by_piece = self._cut(probe) == self._whole(probe)
        except Apart:
            self.by_piece = False
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, pieces: list[str]) -> None:
        """Adds pieces: encoded side by side and told apart by their last tokens."""
        ids = np.frombuffer(self._whole([" ".join(pieces)])[0], self.kind)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            raise Apart
        count = np.diff(ends, prepend=0)
        all_hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(all_hashes, kind="stable")
        self.hashes, self.checks = all_hashes[order], np.concatenate([self.checks, checks])[order]
        self.first = np.concatenate([self.first, len(self.ids) + ends - count])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.ids = np.concatenate([self.ids, ids])

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts."""
        joined = "\n".join([*texts, ""]).encode()
        raw = np.frombuffer(joined, np.uint8)
        kind = _CLASS[raw]
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        edge = (kind != before) | (kind == 2)
        at = np.flatnonzero(edge)
        start = at[kind[at] > 0]
        end = np.append(at[1:], len(raw))[kind[at] > 0]
        if len(start) and (end - start).max() > LONGEST:
            raise Apart
        up, down = powers(len(raw) + 1)

        def hashes(value: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(raw) + 1, U)
            np.cumsum(value[raw] * up[: len(raw)], out=sums[1:])
            return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))

        h, check = hashes(_VALUE), hashes(_CHECK)
        known, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > MEMORY:
            self._forget()
        pos = np.searchsorted(self.hashes, known)
        new = np.ones(len(known), bool)
        inside = pos < len(self.hashes)
        new[inside] = self.hashes[pos[inside]] != known[inside]
        if new.any():
            spans = zip(start[where[new]].tolist(), end[where[new]].tolist())
            self._learn(known[new], check[where[new]], [joined[a:b].decode().lower() for a, b in spans])
            pos = np.searchsorted(self.hashes, known)
        if (self.checks[pos][back] != check).any():
            raise Apart
        first, count = self.first[pos][back], self.count[pos][back]
        ends = np.cumsum(count)
        flat = self.ids[np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        # where each text's pieces, then its ids, begin
        borders = np.cumsum([len(t.encode()) + 1 for t in texts])
        upto = np.concatenate([[0], ends])[np.searchsorted(start, borders)] * flat.itemsize
        out, data, a = [], flat.tobytes(), 0
        for b in upto.tolist():
            out.append(data[a:b])
            a = b
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of self.kind."""
        plain = [self.by_piece and "'" not in t and _PLAIN.fullmatch(t) is not None and not self.marks.search(t) for t in texts]
        try:
            cut = self._cut([t for t, p in zip(texts, plain) if p]) if any(plain) else []
            if cut and self._whole([texts[plain.index(True)]]) != cut[:1]:
                self.by_piece = False
                raise Apart
        except Apart:
            return self._whole(texts)
        some, rest = iter(cut), iter(self._whole([t for t, p in zip(texts, plain) if not p]))
        return [next(some if p else rest) for p in plain]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, end)
    return _encoders[path]


# --- tables -------------------------------------------------------------------------------------


@dataclass
class TokenFiles:
    """Where the blocks and the rank table are."""

    blocks: str
    ranks: str


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """key and ids: little-endian unsigned 16- or 32-bit ids of the whole text and the end id.

    16 bits where the vocabulary allows.  Null texts are empty; extra columns are dropped.
    """
    ship(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, end)
        last = np.array([end], coder.kind).tobytes()
        for part in parts:
            texts, size, a = ["" if t is None else t for t in part.column(1).to_pylist()], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= 1 << 21 or i == len(texts) - 1:
                    ids = [x + last for x in coder(texts[a : i + 1])]
                    wide = pa.array([coder.kind == "<u4"] * len(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0)[a : i + 1], wide, pa.array(ids, pa.binary())], ["key", "wide", "ids"])
                    a, size = i + 1, 0

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, wide boolean, ids binary")


def _values(wide: bool, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2")


def rank_table(tokens: DataFrame) -> np.ndarray:
    """Ids by falling frequency over all documents, ties by id; as long as the vocabulary at most."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for part in parts:
            if not part.num_rows:
                continue
            _, offsets, data = part.column(1).buffers()  # all ids of the batch lie side by side
            ends = np.frombuffer(offsets, np.int32)[part.column(1).offset :][: part.num_rows + 1]
            got = np.bincount(np.frombuffer(data, "<u4" if part.column(0)[0].as_py() else "<u2", (int(ends[-1]) - int(ends[0])) // (4 if part.column(0)[0].as_py() else 2), int(ends[0])))
            if len(got) > len(seen):
                seen = np.pad(seen, (0, len(got) - len(seen)))
            seen[: len(got)] += got
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["id", "n"])

    got = tokens.select("wide", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


def write_files(docs: DataFrame, path: str, out: str, key: str = "doc_id", text: str = "text", end: int = END) -> TokenFiles:
    """Writes all texts as token files under out, in ascending order of key (nulls first)."""
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, path, key, text, end), "tokens")
    ranked = rank_table(tokens)
    rank = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    rank_of = spark.sparkContext.broadcast(rank)  # as long as the vocabulary
    kind = docs.select(key).schema[0].dataType.simpleString()

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, held, size, start = [], [], 0, 0
        number = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            nonlocal keys, held, size, start
            all_ids = rank_of.value[np.concatenate(held)]
            control, data = encode(all_ids)
            lengths = [len(x) for x in held]
            row = [[number], [start], [pa.array(keys)], [lengths], [control], [data]]
            start += len(all_ids)
            keys, held, size = [], [], 0
            types = [pa.int32(), pa.int64(), pa.list_(key_type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[0].to_pylist() if isinstance(r[0], pa.Array) else r[0]], t) for r, t in zip(row, types)], ["part", "start", "doc_ids", "lengths", "control", "data"])

        for part in parts:
            key_type = part.column(0).type
            for k, wide, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                ids = _values(wide, raw.as_buffer())
                if held and size + len(ids) > BLOCK_IDS:
                    yield block()
                keys.append(k)
                held.append(ids)
                size += len(ids)
        if held:
            yield block()

    ordered = tokens.repartitionByRange("key").sortWithinPartitions("key", "ids")
    blocks = ordered.mapInArrow(code, f"part int, start long, doc_ids array<{kind}>, lengths array<long>, control binary, data binary")
    blocks.write.option("compression", "none").parquet(f"{out}/blocks")
    spark.createDataFrame(pa.table({"rank": np.arange(len(ranked), dtype=np.int64), "id": ranked.astype(np.int64)})).coalesce(1).write.parquet(f"{out}/ranks")
    release(tokens)
    return TokenFiles(f"{out}/blocks", f"{out}/ranks")


def read_files(spark: SparkSession, files: TokenFiles, key: str = "doc_id") -> DataFrame:
    """One row per document: key, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32."""
    ship(spark)
    got = spark.read.parquet(files.ranks).toArrow()  # as long as the vocabulary
    ids = np.zeros(got.num_rows, "<u4")
    ids[got.column("rank").to_numpy()] = got.column("id").to_numpy()
    id_of = spark.sparkContext.broadcast(ids)
    blocks = spark.read.parquet(files.blocks)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(batch.num_rows):
                part, start, keys, lengths, control, data = (batch.column(c)[i] for c in range(6))
                n = lengths.values.to_numpy()
                whole = id_of.value[decode(control.as_buffer(), data.as_buffer(), int(n.sum()))]
                ends = np.cumsum(n)
                pieces = [whole[e - m : e].tobytes() for e, m in zip(ends, n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(n), pa.int32()), keys.values, pa.array(start.as_py() + ends - n), pa.array(n), pa.array(pieces, pa.binary()), pa.array([zlib.crc32(p) for p in pieces], pa.int64())],
                    ["part", "key", "local", "n_tokens", "ids", "ids_crc32"],
                )

    rows = blocks.select("part", "start", "doc_ids", "lengths", "control", "data").mapInArrow(run, f"part int, key {kind}, local long, n_tokens long, ids binary, ids_crc32 long")
    sums = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = rows.join(F.broadcast(before), "part")  # one row per written partition
    return out.select(F.col("key").alias(key), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids", "ids_crc32")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    files = write_files(table(spark, sf_dir, "documents"), path, scratch(spark, "token-files"))
    return read_files(spark, files).drop("ids")
