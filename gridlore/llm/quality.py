"""Quality classifier: a byte-level convolutional network in numpy.

A document is its UTF-8 bytes.  Overlapping chunks of CHUNK bytes, a new one every STEP, cover
all of it.  Learned filters over WIDTH embedded bytes slide through each chunk; their responses are
max-pooled per chunk, then averaged and max-pooled over the chunks, and one logistic unit makes a
probability of it.  The network is fitted on the driver on a bounded sample of labelled rows
(at most per_class rows of each label, and as many of them as sample_bytes hold); texts are whole in
training and scoring.  A tile of zeros parts each text from the next, so a score depends on its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ship, stored, table, trim

TILE, STRIDE, WIDTH = 64, 4, 8
PER_TILE = TILE // STRIDE
#: A chunk is four tiles; chunks start every three tiles.
CHUNK, STEP = 4, 3
EMBED, FILTERS = 8, 24
#: Bounds of the training sample: rows of each label, bytes of all its (whole) texts.
PER_CLASS, SAMPLE_BYTES = 1500, 64 << 20
THRESHOLD = 0.3
#: Bytes that are filtered at a time.
SLICE = 1 << 17


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    out_bias: float | np.ndarray


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts padded to whole tiles and a tile of zeros after each, and the first tile of each (one more than texts)."""
    tiles = [max(1, -(-(len(t) + WIDTH) // TILE)) + 1 for t in texts]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(tiles, out=first[1:])
    raw = np.zeros(first[-1] * TILE + WIDTH, np.uint8)
    for t, f in zip(texts, first[:-1]):
        raw[f * TILE : f * TILE + len(t)] = np.frombuffer(t, np.uint8)
    return raw, first


def windows(net: Net, raw: np.ndarray) -> np.ndarray:
    """Embedded windows at every STRIDE bytes: rows of WIDTH * EMBED."""
    x = net.embed[raw]
    n = (len(raw) - WIDTH) // STRIDE
    return np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * EMBED * x.itemsize, x.itemsize))


def tile_peaks(net: Net, raw: np.ndarray, most: int = SLICE, where: np.ndarray | None = None) -> np.ndarray:
    """The largest response of each filter in each tile; bounded memory however long a text is.  where takes the windows that gave them."""
    tiles = (len(raw) - WIDTH) // TILE
    out = np.empty((tiles, FILTERS), net.filters.dtype)
    per = most // TILE
    for t in range(0, tiles, per):
        part = raw[t * TILE : min(tiles, t + per) * TILE + WIDTH]
        act = (windows(net, part) @ net.filters).reshape(-1, PER_TILE, FILTERS)
        if where is None:
            out[t : t + per] = act.max(1)
        else:
            where[t : t + per] = best = act.argmax(1)
            out[t : t + per] = np.take_along_axis(act, best[:, None], 1)[:, 0]
    return out


def chunk_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last tile of every chunk, and each text's first chunk; the tiles of zeros belong to none."""
    tiles = np.diff(first) - 1
    many = np.maximum(1, -(-(tiles - CHUNK) // STEP) + 1)
    at = np.zeros(len(first), np.int64)
    np.cumsum(many, out=at[1:])
    doc = np.repeat(np.arange(len(tiles)), many)
    start = first[:-1][doc] + (np.arange(len(doc)) - at[:-1][doc]) * STEP
    return start, np.minimum(start + CHUNK, first[1:][doc] - 1) - 1, at


def pool(net: Net, peaks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk responses (rectified) and each text's first chunk."""
    start, last, at = chunk_starts(first)
    best = peaks[start]
    for k in range(1, CHUNK):
        best = np.maximum(best, peaks[np.minimum(start + k, last)])
    return np.maximum(best + net.bias, 0), at


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    raw, first = lay_out(texts)
    chunk, at = pool(net, tile_peaks(net, raw), first)
    n = np.diff(at)[:, None]
    features = np.hstack([np.add.reduceat(chunk, at[:-1], 0) / n, np.maximum.reduceat(chunk, at[:-1], 0)])
    return 1 / (1 + np.exp(-np.clip(features @ net.out + net.out_bias, -30, 30).astype(float)))


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, steps: int = 600, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on the weighted log loss; gradients flow through the pooled maxima."""
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        0.0,
    )
    names = tuple(vars(net))
    m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    epochs = -(-steps * batch // len(texts))
    steps = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            grads = _gradients(net, [texts[i] for i in pick], labels[pick], weights[pick])
            t += 1
            lr = rate * (1 - 0.9 * t / steps)
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                move = lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32) if k != "out_bias" else float(net.out_bias - move))
    # scores are computed in double precision: how a batch is cut doesn't show in them
    return Net(*(np.asarray(x, np.float64) for x in vars(net).values()))


def _gradients(net: Net, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict:
    raw, first = lay_out(texts)
    where = np.empty(((len(raw) - WIDTH) // TILE, FILTERS), np.int64)
    peaks = tile_peaks(net, raw, where=where)
    start, last, at = chunk_starts(first)
    tile, best = np.broadcast_to(start[:, None], (len(start), FILTERS)).copy(), peaks[start]
    for k in range(1, CHUNK):
        other = np.minimum(start + k, last)
        better = peaks[other] > best
        best = np.where(better, peaks[other], best)
        tile = np.where(better, other[:, None], tile)
    chunk = np.maximum(best + net.bias, 0)
    n = np.diff(at)[:, None]
    mean, top = np.add.reduceat(chunk, at[:-1], 0) / n, np.maximum.reduceat(chunk, at[:-1], 0)
    features = np.hstack([mean, top])
    p = 1 / (1 + np.exp(-np.clip(features @ net.out + net.out_bias, -30, 30)))
    d = ((p - y) * weight / weight.sum()).astype(np.float32)
    doc = np.repeat(np.arange(len(texts)), n[:, 0])
    g = (d[:, None] * net.out[:FILTERS] / n)[doc]
    is_top = chunk == top[doc]
    g = g + (d[:, None] * net.out[FILTERS:])[doc] * is_top / np.maximum(1, np.add.reduceat(is_top, at[:-1], 0, dtype=np.float32))[doc]
    g = np.where(chunk > 0, g, 0).astype(np.float32)
    k = np.broadcast_to(np.arange(FILTERS), g.shape)
    pos = tile * PER_TILE + where[tile, k]
    dfilters, dembed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    for f in range(FILTERS):
        byte = raw[pos[:, f, None] * STRIDE + np.arange(WIDTH)]
        dfilters[:, f] = net.embed[byte].reshape(len(byte), -1).T @ g[:, f]
        spread = (g[:, f, None] * net.filters[:, f]).reshape(-1, WIDTH, EMBED)
        for e in range(EMBED):
            dembed[:, e] += np.bincount(byte.ravel(), spread[:, :, e].ravel(), 256)
    return {"embed": dembed, "filters": dfilters, "bias": g.sum(0), "out": features.T @ d, "out_bias": float(d.sum())}


def _crc(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")))


def held_out(key: Column) -> Column:
    return F.pmod(_crc(key), F.lit(5)) == 0


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The training sample: whole texts, labels, and weights that restore the classes' true shares.

    Only rows that are not held out; the per_class rows of each label with the smallest hash of
    doc_id, and of these, in that order, those whose texts fit into sample_bytes (half for each label).
    Unlabelled rows and null labels are left out; of repeated labels the largest holds, of repeated
    documents the least text.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id", F.lit("quality"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    # per_class rows of a label, also where a doc_id is repeated
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("t").alias("t"))
    rows = stored(rows, "training")
    sizes = rows.select("doc_id", "y", order.alias("h"), F.octet_length("t").alias("size")).collect()
    wanted, used = [], {0: 0, 1: 0}
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if used[int(r["y"])] + r["size"] <= sample_bytes // 2:
            used[int(r["y"])] += r["size"]
            wanted.append(r["doc_id"])
    got = rows.where(F.col("doc_id").isin(wanted)).collect() if len(wanted) < len(sizes) else rows.collect()
    got.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got], float)
    have = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weights = np.array([counts.get(int(k), 1) / have[int(k)] for k in y])
    return [r["t"].encode() for r in got], y, weights


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Net:
    """Without any labelled row the net answers 0.5 or more, so that nothing is rejected."""
    texts, y, weights = sample(docs, labels, per_class, sample_bytes)
    return fit(texts, y, weights) if len(texts) else fit([b""], np.ones(1), np.ones(1), steps=1)


def score(docs: DataFrame, net: Net, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability of label 1 for every whole text, in the column into; null texts count as empty.

    A column that has that name is replaced.  Equal texts score alike, whatever rows are beside them.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            raw = ["" if t is None else t for t in part]
            out, i = [], 0
            while i < len(raw):  # about 2 MB of text at a time
                j, size, some = i, 0, []
                while j < len(raw) and size < 1 << 21:
                    some.append(raw[j].encode())
                    size += len(some[-1])
                    j += 1
                out.append(probabilities(net, some))
                i = j
            trim()
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(into, probability(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
