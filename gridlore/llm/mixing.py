"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

Weights are integers a_s over a period P = sum(a_s).  Block k of source s may run from
``floor(k P / a_s)`` on and must run before ``ceil((k + 1) P / a_s)``.  In each slot the released
block with the earliest deadline runs (ties: the earlier source), so at no time is a source one
whole block away from its share.  Windows repeat after P slots, so one period is scheduled, as a
fold over P slots, and block k takes slot ``(k div a_s) P + slot(k mod a_s)``: the work does
not grow with the input, and every row finds its place by one lookup.

Every row is kept.  A source that has run out leaves its slots to the others, which go on in the
same relative shares.

A schedule of very many sources would be too large for one fold: beyond MOST_SOURCES, sources share
lanes by hash.  A lane has the sum of their weights and takes their blocks in the order of
(blocks before) / weight, so each source keeps its share of the lane; the lanes are what Pfair schedules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import join_groups, numbered, stored, table

BLOCK_ROWS, RESOLUTION, MOST_SOURCES = 16, 1000, 1024


def integer_weights(weights: dict, resolution: int = RESOLUTION) -> dict:
    """Shares in 1/resolution, at least 1 each."""
    total = sum(weights.values())
    return {s: max(1, math.floor(resolution * w / total + 0.5)) for s, w in weights.items()}


def counts(docs: DataFrame, source: str) -> dict | None:
    """Rows by source; None beyond MOST_SOURCES."""
    got = docs.groupBy(F.col(source).cast("string").alias("s")).count().limit(MOST_SOURCES + 1).collect()
    return {r[0]: r[1] for r in got} if len(got) <= MOST_SOURCES else None


def _mix_lanes(docs: DataFrame, weights: dict | None, block_rows: int, source: str, key: str, seed: int, extra: list[str]) -> DataFrame:
    """mix() where sources are more than one schedule takes."""
    spark = docs.sparkSession
    src = F.col(source).cast("string")
    named = docs.groupBy(src.alias("s")).agg(F.count("*").alias("n"))
    if weights:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "g string, w double")
        named = named.join(given, F.col("s").eqNullSafe(F.col("g")), "left").select("s", "n", F.coalesce("w", F.lit(float(min(weights.values())))).alias("w"))
    else:
        named = named.withColumn("w", F.sqrt("n"))
    named = stored(named.select("s", "n", "w", F.pmod(F.xxhash64("s"), F.lit(MOST_SOURCES)).cast("string").alias("lane"), F.xxhash64(F.lit(0), "s").alias("h")), "sources")
    lanes = {r[0]: r[1] for r in named.groupBy("lane").agg(F.sum("w")).collect()}  # MOST_SOURCES at most
    slim = docs.select(F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)]).alias("row"), src.alias("s"), F.xxhash64(F.lit(0), src).alias("h"), _shuffle(F.col(key), seed).alias("r"))
    placed = numbered(slim, "s", ["r", "row"], "i", "lanes")
    total = named.agg(F.sum("n")).first()[0]
    turned = join_groups(placed, named.drop("s"), "h", "n", total).select("row", "s", "lane", (F.floor(F.col("i") / block_rows) / F.col("w")).alias("turn"), "i")
    mixed = mix(turned.select("row", "s", "lane", F.struct("turn", "s", "i").alias("order")), lanes, block_rows, "lane", "row", seed, ["s"], "order")
    return mixed.select(F.col("row.key").alias(key), *[F.col(f"row.x{i}").alias(c) for i, c in enumerate(extra)], F.col("s").alias(source), "block", "slot", "release", "deadline", "position")


def _shuffle(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))


def _period(spark: SparkSession, a: list[int]) -> DataFrame:
    """One row per slot of a period: src (index), j (which of its blocks), o (slot), prefix (blocks of each source before it)."""
    p, n = sum(a), len(a)
    shares = F.array(*[F.lit(x) for x in a])
    at = lambda arr, i: F.element_at(arr, (i + 1).cast("int"))

    def step(acc: Column, t: Column) -> Column:
        due = F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.when(
                (at(acc["done"], i) < at(shares, i)) & (F.floor(at(acc["done"], i) * p / at(shares, i)) <= t),
                F.struct(F.ceil((at(acc["done"], i) + 1) * p / at(shares, i)).alias("deadline"), i.alias("i")),
            ),
        )
        pick = F.array_min(due)["i"]
        return F.struct(
            F.transform(acc["done"], lambda x, i: x + (i == pick).cast("int")).alias("done"),
            F.concat(acc["slots"], F.array(F.struct(pick.alias("src"), at(acc["done"], pick).alias("j"), t.alias("o"), acc["done"].alias("prefix")))).alias("slots"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), n).alias("done"),
        F.expr("cast(array() as array<struct<src:int,j:int,o:int,prefix:array<int>>>)").alias("slots"),
    )
    plan = spark.range(1).select(F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), start, step, lambda acc: acc["slots"]).alias("slots"))
    return plan.select(F.inline("slots"))


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, source: str = "source", key: str = "doc_id", seed: int = 42, extra: list[str] | None = None, order: str | None = None) -> DataFrame:
    """key, source, block, slot, release, deadline, position (and the columns in extra).

    position is the row's place in the mixture, gapless from 0.  weights: source -> target
    weight (null source: key None); sources not named take part with the smallest weight named.
    None: the square roots of the sources' row counts.  Within a source rows are shuffled by
    md5 of key and seed, or go by the column order where it is given; rows with equal keys stay in arbitrary
    order among themselves.  release and deadline count slots.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    n = counts(docs, source)
    if n is None:
        return _mix_lanes(docs, weights, block_rows, source, key, seed, extra or [])
    if weights is None:
        weights = {s: math.sqrt(x) for s, x in n.items()}
    elif weights:
        weights = {s: weights.get(s, min(weights.values())) for s in n}
    names = sorted(n, key=lambda s: (s is not None, s or ""))
    a = integer_weights({s: weights[s] for s in names}) if names else {}
    per = [a[s] for s in names] or [1]
    rows_by, p = [n[s] for s in names] or [0], sum(per)

    src = F.col(source).cast("string")
    index = F.array_position(F.array(*[F.coalesce(F.lit(s), F.lit("\0null")).cast("string") for s in names or [""]]), F.coalesce(src, F.lit("\0null"))).cast("int") - 1
    slim = docs.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(extra or [])], index.alias("src"), (F.col(order) if order else _shuffle(F.col(key), seed)).alias("__r"))
    rows = numbered(slim, "src", ["__r", "__key"], "i", "mixing")
    share = F.element_at(F.array(*[F.lit(x) for x in per]), F.col("src") + 1)
    rows = rows.withColumn("block", F.floor(F.col("i") / block_rows)).withColumn("a", share).withColumn("j", F.pmod("block", F.col("a")).cast("int")).withColumn("round", F.floor(F.col("block") / F.col("a")))
    placed = rows.join(F.broadcast(_period(spark, per)), ["src", "j"])  # one row per slot of a period: a setting's size
    whole = F.array(*[F.struct(F.lit(x).cast("long").alias("n"), F.lit(y).cast("long").alias("a")) for x, y in zip(rows_by, per, strict=True)])
    before = F.aggregate(
        F.zip_with("prefix", whole, lambda c, s: F.least(s["n"], (F.col("round") * s["a"] + c) * block_rows)),
        F.lit(0).cast("long"),
        lambda x, y: x + y,
    )
    return placed.select(
        F.col("__key").alias(key),
        *[F.col(f"__x{i}").alias(c) for i, c in enumerate(extra or [])],
        F.element_at(F.array(*[F.lit(s).cast("string") for s in names or [""]]), F.col("src") + 1).alias(source),
        "block",
        (F.col("round") * p + F.col("o")).alias("slot"),
        (F.col("round") * p + F.floor(F.col("j") * p / F.col("a"))).alias("release"),
        (F.col("round") * p + F.ceil((F.col("j") + 1) * p / F.col("a"))).alias("deadline"),
        (before + F.pmod("i", F.lit(block_rows))).alias("position"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE src AS (
  SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source
), shares AS (
  SELECT source, n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS src,
         CAST(greatest(1, floor({RESOLUTION} * w / (SELECT sum(w) FROM src) + 0.5)) AS BIGINT) AS a FROM src
), cfg AS (
  SELECT list(a ORDER BY src) AS a, list(n ORDER BY src) AS n, CAST(sum(a) AS BIGINT) AS p, CAST(count(*) AS BIGINT) AS s FROM shares
), run(t, done, pick, j, prefix) AS (
  SELECT CAST(0 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)) FROM cfg
  UNION ALL
  SELECT t + 1, list_transform(range(s), lambda i: done[i + 1] + CASE WHEN i = best.i THEN 1 ELSE 0 END), best.i, done[best.i + 1], done
  FROM (SELECT r.t, r.done, c.s, list_min(list_filter(list_transform(range(c.s), lambda i:
          CASE WHEN r.done[i + 1] < c.a[i + 1] AND (r.done[i + 1] * c.p) // c.a[i + 1] <= r.t
               THEN {{'d': ((r.done[i + 1] + 1) * c.p + c.a[i + 1] - 1) // c.a[i + 1], 'i': i}} END), lambda x: x IS NOT NULL)) AS best
        FROM run r, cfg c WHERE r.t < c.p)
), period AS (
  SELECT pick AS src, j, t - 1 AS o, prefix FROM run WHERE t > 0
), nums AS (
  SELECT d.doc_id, d.source, s.src, s.a,
         row_number() OVER (PARTITION BY s.src ORDER BY md5(concat(coalesce(CAST(d.doc_id AS VARCHAR), ''), ':42')), d.doc_id) - 1 AS i
  FROM documents d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT m.doc_id, m.source, m.i // {BLOCK_ROWS} AS block,
       (m.i // {BLOCK_ROWS} // m.a) * c.p + q.o AS slot,
       ((m.i // {BLOCK_ROWS}) * c.p) // m.a AS release,
       ((m.i // {BLOCK_ROWS} + 1) * c.p + m.a - 1) // m.a AS deadline,
       CAST(list_sum(list_transform(range(c.s), lambda z: least(c.n[z + 1], ((m.i // {BLOCK_ROWS} // m.a) * c.a[z + 1] + q.prefix[z + 1]) * {BLOCK_ROWS}))) AS BIGINT) + m.i % {BLOCK_ROWS} AS position
FROM nums m JOIN period q ON q.src = m.src AND q.j = (m.i // {BLOCK_ROWS}) % m.a, cfg c
"""
