"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies of all shingles of all documents are counted in BUCKETS hashed counters
   (the hashing trick), so the table has a fixed size and a common shingle stands out by its
   share of the documents at any corpus size.  Weight of a shingle: tf * (1 + log10(N / df)).
2. Improved consistent weighted sampling draws BANDS * ROWS samples (shingle, level) from each
   text; two texts share a sample with the probability of their weighted Jaccard similarity.
   ROWS samples make a band key.
3. Texts with the same word sequence are one node.  In every band bucket all nodes are first
   checked against one pivot; only buckets whose nodes are still in different components after
   that are compared member by member, in blocks.  Every link that can join two components is
   checked by exact weighted Jaccard; a hot bucket costs one row for each member, not each pair.
4. Components of the confirmed links are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh, join_groups, release, ship, steady, stored, table, trim
from .components import components
from .shingles import U, batches, mix, shingles, table_of, words

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
BUCKETS = 1 << 18
#: Members of a bucket that are compared within one task at a time.
BLOCK = 256
ID = U((1 << 50) - 1)


def weighted_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, shingle (50 bits), tf of all distinct shingles, sorted by both; and a digest of each text's words (16 bytes)."""
    h, first = words(texts)
    s, at = shingles(h, first, width)
    digest = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1], first[1:])]
    ids, doc, tf = [], [], []
    step = 1 << 14  # the document's number takes the upper 14 bits of the sort key
    for d in range(0, len(texts), step):
        stop = min(len(texts), d + step)
        part = s[at[d] : at[stop]] & ID
        local = np.repeat(np.arange(stop - d, dtype=U), np.diff(at[d : stop + 1]))
        key = np.sort((local << U(50)) | part)
        new = np.flatnonzero(np.diff(key, prepend=key[:1] ^ U(1)))
        ids.append(key[new] & ID)
        doc.append((key[new] >> U(50)).astype(np.int64) + d)
        tf.append(np.diff(new, append=len(key)))
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return join(doc, np.int64), join(ids, U), join(tf, np.int32), digest


_TURN = table_of(31, 256)
_rng = np.random.default_rng(32)
#: Quantile tables of Gamma(2, 1): r by 14 bits, log c by 20 bits; beta takes 16 bits.
_R = _rng.gamma(2, 1, 1 << 14).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2, 1, 1 << 20)).astype(np.float32)


def samples(doc: np.ndarray, ids: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """docs x k consistent samples; documents without shingles get 0."""
    out = np.zeros((docs, k), U)
    if not len(ids):
        return out
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    present = doc[starts]
    log_w = np.log(weight).astype(np.float32)
    index = np.arange(len(ids), dtype=U)
    for j in range(k):
        h = mix(ids * _TURN[j % 256] + U(j))
        r = _R[(h & U(0x3FFF)).astype(np.int64)]
        beta = ((h >> U(14)) & U(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w / r + beta)
        log_a = _LOG_C[(h >> U(44)).astype(np.int64)] - r * (t - beta) - r
        bits = log_a.view(np.int32)
        ordered = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)
        win = np.minimum.reduceat((ordered.astype(U) << U(32)) | index, starts) & U(0xFFFFFFFF)
        at = win.astype(np.int64)
        out[present, j] = mix(ids[at] * U(0x9E3779B97F4A7C15) + t[at].astype(np.int64).astype(U) + U(j))
    return out


def bands(sample: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sample), n_bands), U)
    for b in range(n_bands):
        acc = np.full(len(sample), b + 1, U)
        for r in range(rows):
            acc = mix(acc * U(0xC2B2AE3D27D4EB4F) + sample[:, b * rows + r])
        out[:, b] = acc
    return out


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Whole texts as UTF-8; null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def document_frequencies(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, int]:
    """df by hashed counter, and the number of documents."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for part in parts:
            texts = _texts(part.column(0))
            n += len(texts)
            for a, b in batches(texts):
                doc, ids, _, _ = weighted_sets(texts[a:b], width)
                pair = np.unique((doc.astype(U) << U(18)) | (ids & U(BUCKETS - 1)))
                seen += np.bincount((pair & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        trim()
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    df = np.zeros(BUCKETS, np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log10((n + 1) / (df + 1))).clip(1).astype(np.float32)


def packed(ids: np.ndarray, tf: np.ndarray) -> bytes:
    """A weighted set as sorted 32-bit fingerprints, each tf times; the low 18 bits name the counter."""
    return np.sort(np.repeat((ids & U(0xFFFFFFFF)).astype(np.uint32), tf)).tobytes()


def unpacked(raw: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fp, tf = np.unique(np.frombuffer(raw, np.uint32), return_counts=True)
    return fp, tf * idf[fp & np.uint32(BUCKETS - 1)].astype(np.float64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (fa, wa), (fb, wb) = a, b
    at = np.searchsorted(fa, fb)
    at[at == len(fa)] = 0
    same = fa[at] == fb if len(fa) else np.zeros(len(fb), bool)
    low = np.minimum(wa[at[same]], wb[same]).sum()
    return float(low / (wa.sum() + wb.sum() - low)) if len(fa) and len(fb) else 0.0


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: row, key, class_id (smallest key of the class), class_size, kept.

    One row of each class is kept: its smallest key, nulls last.  Texts without words (null and
    empty ones included) are each a class of their own.  Repeated rows are members of one class.
    row numbers the rows of docs (monotonically_increasing_id of this scan).
    """
    spark = docs.sparkSession
    ship(spark)
    df, n = document_frequencies(docs, text, width)
    idf = spark.sparkContext.broadcast(idf_table(df, n))  # BUCKETS floats

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, rows = _texts(part.column(2)), part.column(0)
            for a, b in batches(texts):
                doc, ids, tf, digest = weighted_sets(texts[a:b], width)
                weight = tf * idf.value[(ids & U(BUCKETS - 1)).astype(np.int64)]
                keys = bands(samples(doc, ids, weight, b - a, BANDS * ROWS), BANDS, ROWS)
                at = np.searchsorted(doc, np.arange(b - a + 1))
                sets = [packed(ids[i:j], tf[i:j]) for i, j in zip(at[:-1], at[1:])]
                flat = pa.array(keys.ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * BANDS + 1, BANDS, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([rows[a:b], part.column(1)[a:b], pa.array(digest, pa.binary()), lists, pa.array(sets, pa.binary())], ["row", "key", "node", "bands", "bag"])
            trim()

    kind = docs.select(key).schema[0].dataType.simpleString()
    scan = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    sketches = stored(scan.mapInArrow(sketch, f"row long, key {kind}, node binary, bands array<long>, bag binary"), "sketches")

    nodes = stored(sketches.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands")), "nodes")
    spots = nodes.select("node", F.explode("bands").alias("bucket"))
    pivots = stored(spots.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1"), "pivots")
    members = stored(join_groups(spots, pivots, "bucket", "m", n * BANDS).select("bucket", "node", "pivot", "m"), "members")
    release(nodes)
    candidates = members.select("node").distinct()
    # one bag for each candidate node, whatever the number of its copies
    one = sketches.where("node is not null").groupBy("node").agg(F.min("row").alias("row")).join(candidates, "node")
    bags = stored(sketches.select("row", "bag").join(one, "row").select("node", "bag"), "bags")
    star = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(_confirm(star, bags, idf, similarity), "star-links")

    comp = stored(components(links.union(candidates.select(F.col("node").alias("a"), F.col("node").alias("b")))), "star-components")
    # buckets in which more than one component is left
    split = members.join(comp, "node").groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("m").alias("m")).where("x != y").select("bucket", "m")
    if split.take(1):
        rest = members.select("bucket", "node").join(split, "bucket").join(comp, "node")
        more = stored(_compare(rest, bags, idf, similarity), "more-links")
        comp = stored(components(links.union(more).union(candidates.select(F.col("node").alias("a"), F.col("node").alias("b")))), "components")
    release(members)
    release(bags)

    slim = stored(sketches.select("row", "key", "node"), "slim")
    release(sketches)
    with_words, alone = slim.where("node is not null"), slim.where("node is null")
    first = F.min(F.struct(F.col("key").isNull().alias("no"), "key", "row"))
    groups = with_words.groupBy("node").agg(first.alias("least"), F.count("*").alias("copies")).join(comp, "node", "left")
    groups = stored(groups.select("node", F.coalesce("component", "node").alias("component"), "least", "copies"), "groups")
    classes = stored(groups.groupBy("component").agg(F.min("least").alias("first"), F.sum("copies").alias("class_size"), F.count("*").alias("nodes")), "classes")
    # a class of many texts, then a text of many copies, may hold any share of the rows
    named = stored(join_groups(groups.select("node", "component", "copies"), classes, "component", "nodes", n).select("node", "copies", "first", "class_size"), "named")
    joined = join_groups(with_words, named, "node", "copies", n).select("row", "key", F.col("first.key").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))
    return joined.union(alone.select("row", "key", F.col("key").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))).withColumnRenamed("key", key)


def _confirm(pairs: DataFrame, bags: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is high enough."""

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            last, left = None, None
            keep = np.zeros(part.num_rows, bool)
            for i in range(part.num_rows):
                a = part.column(2)[i].as_buffer()
                if last is None or not last.equals(a):
                    last, left = a, unpacked(a, idf.value)
                keep[i] = jaccard(left, unpacked(part.column(3)[i].as_buffer(), idf.value)) >= similarity
            yield part.filter(pa.array(keep)).select([0, 1])
            trim()

    both = pairs.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b").join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(check, "a binary, b binary")


def _compare(rest: DataFrame, bags: DataFrame, idf, similarity: float) -> DataFrame:
    """Links between components within a bucket.  rest: bucket, node, m, component.

    A bucket is cut into blocks of about BLOCK members and every two blocks meet in one task, so
    no task holds more than two blocks, however large a bucket is.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = rest.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component").join(bags, "node")

    def compare(pdf):
        import pandas as pd

        left, right = pdf[pdf.own == pdf.i.iloc[0]], pdf[pdf.own == pdf.j.iloc[0]]
        parent = {bytes(c): bytes(c) for c in pdf.component}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets = {bytes(n): unpacked(b, idf.value) for n, b in zip(pdf.node, pdf.bag)}
        total = {k: v[1].sum() for k, v in sets.items()}
        found = []
        for a, ca in zip(left.node, left.component):
            a, ca = bytes(a), bytes(ca)
            for b, cb in zip(right.node, right.component):
                b, cb = bytes(b), bytes(cb)
                if a == b or root(ca) == root(cb) or min(total[a], total[b]) < similarity * max(total[a], total[b]):
                    continue
                if jaccard(sets[a], sets[b]) >= similarity:
                    found.append((a, b))
                    parent[root(ca)] = root(cb)
        return pd.DataFrame(found, columns=["a", "b"])

    return dealt.groupBy("bucket", "i", "j").applyInPandas(compare, "a binary, b binary")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class of near-duplicates; its rows are read twice, so anything but a file scan is stored first."""
    docs = steady(docs)
    row = fresh(docs, "row")
    gone = near_duplicates(docs, key, text).where("not kept").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left_anti").drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")
