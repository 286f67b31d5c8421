"""Decision queries: weights, scores, ranking, visibility."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..catalogue import query, table
from ..operators import decision as D
from ..operators.focal import rescale
from .grid import CELLS_SQL, cells_from_lineitem

MATRIX = [(0, 0, 1.0), (0, 1, 3.0), (0, 2, 5.0), (1, 0, 1 / 3), (1, 1, 1.0), (1, 2, 2.0), (2, 0, 0.2), (2, 1, 0.5), (2, 2, 1.0)]
MATRIX_SQL = "(VALUES " + ", ".join(f"({i}, {j}, {a!r}::DOUBLE)" for i, j, a in MATRIX) + ") m(i, j, a)"


@query("ahp_weights", f"WITH m AS (SELECT * FROM {MATRIX_SQL}), g AS (SELECT i, exp(avg(ln(a))) AS g FROM m GROUP BY i), w AS (SELECT i, g / (SELECT sum(g) FROM g) AS w FROM g), l AS (SELECT avg(aw / w) AS lam FROM (SELECT m.i, sum(m.a * wj.w) AS aw FROM m JOIN w wj ON m.j = wj.i GROUP BY m.i) r JOIN w ON w.i = r.i) SELECT i AS criterion, round(w, 6) AS weight, round(lam, 6) AS lambda_max, round((lam - 3) / 2, 6) AS ci, round((lam - 3) / 2 / 0.58, 6) AS cr, (lam - 3) / 2 / 0.58 <= 0.1 AS consistent FROM w, l")
def ahp_weights(spark, sf):
    out = D.pairwise_weights(spark.createDataFrame(MATRIX, "i int, j int, a double"))
    return out.select("criterion", *[F.round(c, 6).alias(c) for c in ("weight", "lambda_max", "ci", "cr")], "consistent")


@query("minmax_norm", "SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS v FROM supplier")
def minmax_norm(spark, sf):
    return rescale(table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v")), "v").withColumn("v", F.round("v", 6))


PART_MM = "(SELECT p_partkey, p_size, (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE AS a, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS b FROM part)"


@query("wlc_score", f"SELECT p_partkey, round(CASE WHEN p_size > 45 THEN 0 ELSE 0.6 * (1 - a) + 0.4 * b END, 6) AS v FROM {PART_MM}")
def wlc_score(spark, sf):
    out = D.weighted_sum(table(spark, sf, "part"), {"p_size": 3.0, "p_retailprice": 2.0, "p_partkey": 0.0}, ("p_size",), F.col("p_size") > 45)
    return out.select("p_partkey", F.round("wlc", 6).alias("v"))


@query("topsis_score", "WITH n AS (SELECT sqrt(sum(p_size * p_size)) AS ns, sqrt(sum(p_retailprice * p_retailprice)) AS np, max(p_size) AS xs, min(p_size) AS is_, max(p_retailprice) AS xp, min(p_retailprice) AS ip FROM part) SELECT p_partkey, round(sqrt(power(0.6 * (p_size - is_) / ns, 2) + power(0.4 * (p_retailprice - ip) / np, 2)) / (sqrt(power(0.6 * (p_size - xs) / ns, 2) + power(0.4 * (p_retailprice - xp) / np, 2)) + sqrt(power(0.6 * (p_size - is_) / ns, 2) + power(0.4 * (p_retailprice - ip) / np, 2))), 6) AS v FROM part, n")
def topsis_score(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return D.topsis(p, {"p_size": 0.6, "p_retailprice": 0.4}).select("p_partkey", F.round("topsis", 6).alias("v"))


RANKED = "(SELECT n_regionkey AS region, s_suppkey, s_acctbal AS suit, s_suppkey % 17 + 1.0 AS area_km2, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS rank, (s_suppkey % 5) / 10.0 AS p1 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query("borda_cross_rank", f"WITH c AS (SELECT *, ln(1 + area_km2) AS a, CASE WHEN p1 > 0 THEN (count(*) OVER (PARTITION BY region) - rank) * p1 ELSE count(*) OVER (PARTITION BY region) - rank END AS b FROM {RANKED}), s AS (SELECT *, 0.6 * (suit - min(suit) OVER ()) / (max(suit) OVER () - min(suit) OVER ()) + 0.25 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 0.15 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS v FROM c) SELECT region, CAST(rank AS INT) AS rank, round(v, 6) AS composite, CAST(row_number() OVER (ORDER BY v DESC, region, rank) AS INT) AS cross_rank FROM s ORDER BY v DESC, region, rank LIMIT 20")
def borda_cross_rank(spark, sf):
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    c = s.select(F.col("n_regionkey").alias("region"), F.col("s_acctbal").alias("suit"), (F.col("s_suppkey") % 17 + 1.0).alias("area_km2"), rank.alias("rank"), (F.col("s_suppkey") % 5 / 10.0).alias("p1"))
    return D.cross_rank(c).select("region", "rank", F.round("composite", 6).alias("composite"), "cross_rank")


def _draw_sql(*parts):
    """A number in (0, 1) from the first 52 bits of the md5 of seed 7 and the parts."""
    return f"((('0x' || substr(md5(concat_ws(':', '7', {', '.join(parts)})), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


@query("mc_rank1_prob", f"WITH d AS (SELECT s_suppkey AS id, r, s_acctbal + 800.0 * (sqrt(-2 * ln({_draw_sql('r', 's_suppkey', chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {_draw_sql('r', 's_suppkey', chr(39) + 'b' + chr(39))})) AS v FROM supplier, range(1, 501) t(r)), w AS (SELECT r, arg_max(id, v) AS id FROM d GROUP BY r) SELECT s_suppkey AS id, (SELECT count(*) FROM w WHERE w.id = s_suppkey) / 500.0::DOUBLE AS p1 FROM supplier")
def mc_rank1_prob(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("mean"), F.lit(800.0).alias("std"))
    return D.rank1_probability(s, 500)


@query("mc_rank1_weights", f"WITH s AS (SELECT s_suppkey AS id, (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) AS a, (s_suppkey % 31 - min(s_suppkey % 31) OVER ()) / (max(s_suppkey % 31) OVER () - min(s_suppkey % 31) OVER ())::DOUBLE AS b FROM supplier), u AS (SELECT r, {_draw_sql('r', chr(39) + 'a' + chr(39))} AS x, {_draw_sql('r', chr(39) + 'b' + chr(39))} AS y FROM range(1, 501) t(r)), w AS (SELECT r, arg_max(id, (x / (x + y) * a + y / (x + y) * b, id)) AS id FROM s, u GROUP BY r) SELECT s.id, (SELECT count(*) FROM w WHERE w.id = s.id) / 500.0::DOUBLE AS p1 FROM s")
def mc_rank1_weights(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("a"), (F.col("s_suppkey") % 31).cast("double").alias("b"))
    return D.rank1_probability(s, 500, criteria=("a", "b"))


@query("rank_regions", f"""
WITH RECURSIVE good AS MATERIALIZED (SELECT row, col, z FROM ({CELLS_SQL}) WHERE z > 1e-4),
g AS MATERIALIZED (SELECT *, CAST(row AS BIGINT) * 4294967296 + col AS id FROM good WHERE z >= (SELECT quantile_cont(z, 0.7) FROM good)),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
reach(id, c) AS (SELECT id, id FROM g UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id WHERE reach.c < e.b),
comp AS (SELECT id, min(c) AS clump FROM reach GROUP BY id),
zones AS (SELECT clump, count(*) AS n, avg(z) AS mean, stddev_pop(z) AS std FROM g JOIN comp USING (id) GROUP BY clump HAVING count(*) >= 3)
SELECT clump, n, round(mean, 6) AS mean, round(std, 6) AS std, n * 1.0::DOUBLE AS area_km2, CAST(row_number() OVER (ORDER BY mean DESC, clump) AS INT) AS rank FROM zones""")
def rank_regions(spark, sf):
    return D.rank_regions(cells_from_lineitem(spark, sf), 0.7, 3.0, 1.0).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("orbiter_contact", "SELECT t, round(degrees(asin(sin(radians(85)) * sin(u))), 6) AS lat FROM (SELECT range AS t, 2 * pi() * range / (2 * pi() * sqrt(power(1737.4 + 100, 3) / 4902.8)) AS u FROM range(0, 7200, 60))")
def orbiter_contact(spark, sf):
    steps = spark.range(0, 7200, 60).withColumnRenamed("id", "t")
    track = D.ground_track(steps, 100, 85, 1737.4, 4902.8, 2360591.5)
    return D.contact(track, -89.0, 0.0, 1737.4, 100, 5).select("t", F.round("lat", 6).alias("lat"))
