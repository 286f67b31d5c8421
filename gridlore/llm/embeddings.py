"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

Equal vectors are one node with a weight.  Unit centres are fitted on a bounded sample; every node
has a home, the cell of its nearest centre, and visits each further cell c over which its own
centre leads (in cosine) by at most half of |x - y| * |D|, for |x - y| of a pair at the threshold
and D the difference of the two centres.  The leads of x and y, at home on either side, add up to
(x - y) * D, so one of the two visits the other's cell: no pair is missed, whatever the spread of
the vectors.  A cell's own nodes are cut into blocks; a block
meets a set of guests in one task, which returns per node a count, and links that span what it
found, never all pairs.  Cosines are double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import join_groups, ship, stored, table
from .components import components

THRESHOLD = 0.9
#: Bounds of the fit: rows of the sample, cells, rounds; nodes a cell is meant for; nodes of a block, of a set of guests.
SAMPLE, MOST_CELLS, ROUNDS, CELL, BLOCK, GUESTS = 20_000, 1024, 8, 1000, 2048, 16384


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """k unit centres of unit rows x; an empty cell takes the row that is farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        cos = x @ centres.T
        home = cos.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        far = iter(np.argsort(cos.max(1)))
        for c in np.flatnonzero(np.sqrt((sums**2).sum(1)) < 1e-9):
            sums[c] = x[next(far)]
        centres = unit(sums)
    return centres


def visits(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each row, and a mask of the other cells it visits."""
    cos = x @ centres.T
    home = cos.argmax(1)
    lead = cos[np.arange(len(x)), home][:, None] - cos
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))[home]
    mask = lead <= np.sqrt(max(1 - threshold, 0) / 2) * apart + 1e-6  # for rounding, also of apart where centres are equal
    mask[np.arange(len(x)), home] = False
    return home, mask


def _compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One block of a cell's own nodes (hosts) against a set of guests, or against itself: (a, a, n) weighted link counts by node, (a, b, 0) links that span what was found."""
    pdf = pdf.sort_values(["guest", "node"])
    cell = pdf.cell.iloc[0]
    node, home, weight = pdf.node.to_numpy(), pdf.home.to_numpy(), pdf.weight.to_numpy()
    x = unit(np.stack(pdf.vector.to_numpy()).astype(np.float64))
    hosts = int((~pdf.guest).sum())
    own = hosts == len(pdf)
    right = np.arange(len(pdf)) if own else np.arange(hosts, len(pdf))
    if not len(right):
        return pd.DataFrame([], columns=["a", "b", "n"])
    # a guest from a lower cell that the host visits in turn: that cell counts the link
    goes = [v for v in pdf.visits.iloc[:hosts]]
    count = np.zeros(len(node), np.int64)
    links = []
    for s in range(0, hosts, 512):
        p, q = np.nonzero(x[s : min(s + 512, hosts)] @ x[right].T >= threshold)
        p, q = p + s, right[q]
        if own:
            p, q = p[p < q], q[p < q]
        elsewhere = np.flatnonzero(home[q] < cell)
        if len(elsewhere):
            again = np.array([home[q[k]] in goes[p[k]] for k in elsewhere], bool)
            fresh = np.ones(len(p), bool)
            fresh[elsewhere[again]] = False
            p, q = p[fresh], q[fresh]
        if not len(p):
            continue
        np.add.at(count, p, weight[q])
        np.add.at(count, q, weight[p])
        label = np.arange(len(node))
        while True:  # smallest index reachable
            low = np.minimum(label[p], label[q])
            new = label.copy()
            np.minimum.at(new, p, low)
            np.minimum.at(new, q, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(node)))
        links += zip(node[moved].tolist(), node[label[moved]].tolist())
    some = np.flatnonzero(count)
    rows = [(n, n, c) for n, c in zip(node[some].tolist(), count[some].tolist())] + [(a, b, 0) for a, b in links]
    return pd.DataFrame(rows, columns=["a", "b", "n"])


def _deal(dealt: DataFrame) -> DataFrame:
    """Tasks (dim, cell, i, g): block i of a cell's own nodes meets guest set g.

    Guest sets are the own blocks i, i + 1, ... and then the chunks of visitors.  Blocks and chunks
    hold about BLOCK and GUESTS nodes, so a cell of any size is cut into bounded tasks.
    """
    spots = dealt.withColumn("cell", F.explode(F.concat(F.array("home"), "visits"))).withColumn("own", F.col("cell") == F.col("home"))
    sizes = spots.groupBy("dim", "cell").agg(F.ceil(F.sum(F.col("own").cast("int")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.sum((~F.col("own")).cast("int")) / GUESTS).cast("int").alias("chunks"))
    spots = spots.join(F.broadcast(sizes.where("blocks > 0")), ["dim", "cell"])  # at most MOST_CELLS rows for a length
    at = F.pmod(F.xxhash64("node"), F.when(F.col("own"), F.col("blocks")).otherwise(F.greatest("chunks", F.lit(1)))).cast("int")
    every = lambda low, high, f: F.when(high >= low, F.transform(F.sequence(low, high), f)).otherwise(F.array().cast("array<struct<i:int,g:int,guest:boolean>>"))
    task = lambda i, g, guest: F.struct(i.alias("i"), g.alias("g"), F.lit(guest).alias("guest"))
    host = every(at, F.col("blocks") + F.col("chunks") - 1, lambda g: task(at, g, False))
    below = every(F.lit(0), at - 1, lambda i: task(i, at, True))
    visit = every(F.lit(0), F.col("blocks") - 1, lambda i: task(i, F.col("blocks") + at, True))
    spots = spots.withColumn("t", F.explode(F.when(F.col("own"), F.concat(host, below)).otherwise(visit)))
    return spots.select("dim", "cell", "t.i", "t.g", "t.guest", "node", "home", "weight", F.when(F.col("t.guest"), F.array().cast("array<int>")).otherwise(F.col("visits")).alias("visits"), "vector")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: key, n_links, component_id (smallest key reachable), kept.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing, nor
    do vectors of different lengths.  Repeated rows are linked like any equal vectors.  The rows of
    one key stand for that key; a row with a null key counts as linked but has no name to give.  A pair at
    the threshold exactly is linked.  Columns beside the two named are not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("key"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    nodes = stored(rows.where("fine").groupBy("v").agg(F.min("key").alias("least"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = nodes.count()
    longest = nodes.agg(F.max(F.size("v"))).first()[0] or 1
    share = min(1.0, SAMPLE * 1.2 / max(n, 1))
    some = nodes.select("v").sample(share, 11).limit(SAMPLE).toPandas().v if n else []
    pad = lambda vs: np.stack([np.pad(np.asarray(x, float), (0, longest - len(x))) for x in vs])
    x = unit(pad(some)) if len(some) else np.eye(1, longest)
    centres = spherical_kmeans(x, int(min(MOST_CELLS, max(1, n // CELL), len(x))))
    model = spark.sparkContext.broadcast(centres)  # MOST_CELLS rows at most

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = model.value
        for part in parts:
            for a in range(0, part.num_rows, 2048):
                some = part.slice(a, 2048)
                raw = some.column(2).to_pylist()
                x = unit(np.stack([np.pad(np.asarray(v), (0, centres.shape[1] - len(v))) for v in raw]))
                home, mask = visits(x, centres, threshold)
                to = [np.flatnonzero(m) for m in mask]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([len(v) for v in raw], pa.int32()), some.column(2), pa.array(home, pa.int32()), pa.array(to, pa.list_(pa.int32()))],
                    ["node", "weight", "dim", "vector", "home", "visits"],
                )

    kind = nodes.schema["v"].dataType.simpleString()
    dealt = nodes.select("node", "weight", "v").mapInArrow(assign, f"node long, weight long, dim int, vector {kind}, home int, visits array<int>")
    dealt = stored(dealt, "cells")
    spots = _deal(dealt)
    found = stored(spots.groupBy("dim", "cell", "i", "g").applyInPandas(lambda pdf: _compare(pdf, threshold), "a long, b long, n long"), "found")

    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(found.where("n = 0").select("a", "b"))
    named = stored(nodes.join(comp, nodes.node == comp.node, "left").join(links, nodes.node == links.a, "left").select("v", "least", "weight", F.coalesce("component", nodes.node).alias("component"), F.coalesce("n", F.lit(0)).alias("n")), "named")
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "least")
    # a component of many vectors, then a vector of many rows, may hold any share of them
    named = join_groups(named.select("v", "weight", "component", "n"), least, "component", "nodes", n)
    named = stored(named.select("v", "weight", "component_id", (F.col("n") + F.col("weight") - 1).alias("n_links")), "classes")
    linked = join_groups(rows.where("fine"), named, "v", "weight", n).select("key", "n_links", "component_id")
    alone = rows.where("not fine").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.union(alone).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
