"""Detection, registration, event search, store and pipeline queries."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..catalogue import query, table
from ..functions.bodies import BODIES, CRATER_BODIES
from ..operators import detect, ephemeris
from ..operators.connectivity import shared_folder
from . import ek_store, landing
from .grid import CELLS_SQL, cells_from_lineitem


#: The chronology, written out once more for the SQL: craters of 1 km or more per square km by the middle of an interval, and of one Ga.
_DENSITY = "(5.44e-14 * (exp(6.93 * (lo + hi) / 2) - 1) + 8.38e-4 * (lo + hi) / 2)"
_ONE_GA = 5.44e-14 * (math.exp(6.93) - 1) + 8.38e-4


@query("crater_detect_dem")
def crater_detect_dem(spark, sf):
    g = cells_from_lineitem(spark, sf).select("row", "col", "z")
    return detect.dem_candidates(g, detect.radii(6, 16, 1.0, 40, 50, 4), threshold=0.15)


@query("crater_detect_image")
def crater_detect_image(spark, sf):
    g = cells_from_lineitem(spark, sf).select("row", "col", "z")
    return detect.image_candidates(g, detect.radii(6, 16, 1.0, 40, 50, 4), 90.0, threshold=0.15)


@query("crater_draw")
def crater_draw(spark, sf):
    """Both detectors, suppression, refinement and rings on one grid."""
    g = cells_from_lineitem(spark, sf).select("row", "col", "z")
    out = detect.draw(g, detect.radii(6, 16, 1.0, 40, 50, 4), 0.15, image=g, rings=True, dd_map=g.select("row", "col", (F.col("z") / 100).alias("dd")))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "radius", "confidence", "dD_simple")], "method", "n_methods", "basin_id", "ring_index")


@query("coregister_tiles")
def coregister_tiles(spark, sf):
    """A grid against itself moved by two rows and three columns."""
    g = cells_from_lineitem(spark, sf).select("row", "col", F.col("z").alias("a"))
    moved = g.select(F.pmod(F.col("row") + 2, F.lit(40)).alias("row"), F.pmod(F.col("col") + 3, F.lit(50)).alias("col"), F.col("a").alias("b"))
    out = detect.shift_between(g.join(moved, ["row", "col"]).withColumn("tile", F.lit(0)), window=False)
    return out.select("tile", F.round("drow", 3).alias("drow"), F.round("dcol", 3).alias("dcol"))


@query("event_windows", "WITH s AS (SELECT o_custkey % 20 AS key, epoch(o_orderdate) AS t, avg(o_totalprice) - 250000 AS v FROM orders GROUP BY 1, 2), w AS (SELECT *, lag(v) OVER p AS pv, lag(t) OVER p AS pt FROM s WINDOW p AS (PARTITION BY key ORDER BY t)), c AS (SELECT *, pt + (t - pt) * pv / (pv - v) AS x, sum(CASE WHEN (v >= 0 AND pv < 0) OR pv IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM w) SELECT key, round(l, 1) AS l, round(r, 1) AS r FROM (SELECT key, k, min(CASE WHEN v >= 0 AND pv < 0 THEN x WHEN v >= 0 THEN t END) AS l, max(CASE WHEN v < 0 AND pv >= 0 THEN x ELSE t END) AS r FROM c WHERE v >= 0 OR (v < 0 AND pv >= 0) GROUP BY key, k) WHERE l IS NOT NULL")
def event_windows(spark, sf):
    o = table(spark, sf, "orders")
    s = o.groupBy((F.col("o_custkey") % 20).alias("key"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("t")).agg(F.avg("o_totalprice").alias("value"))
    return ephemeris.event_windows(s, 250000.0).select("key", F.round("l", 1).alias("l"), F.round("r", 1).alias("r"))


@query("ek_store_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 3")
def ek_store_update(spark, sf):
    seg = ek_store.load_rows(ek_store.begin_segment(spark, "n_nationkey int, n_name string, n_regionkey int"), table(spark, sf, "nation"))
    seg = ek_store.update(ek_store.delete(seg, F.col("n_regionkey") == 3), F.col("n_regionkey") == 1, n_name=F.concat(F.upper("n_name"), F.lit("!")))
    return seg.select("n_nationkey", "n_name")


@query("grid_sample_points", f"SELECT c_custkey, z FROM (SELECT c_custkey, CAST(floor((c_custkey % 400) / 10.0) AS INT) AS r, CAST(floor((c_custkey % 600) / 12.0) AS INT) AS c FROM customer) p LEFT JOIN ({CELLS_SQL}) g ON p.r = g.row AND p.c = g.col")
def grid_sample_points(spark, sf):
    from .grid import Region, sample_at

    p = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 600 / 12.0).alias("x"), (40.0 - F.col("c_custkey") % 400 / 10.0).alias("y"))
    return sample_at(p, cells_from_lineitem(spark, sf).select("row", "col", "z"), Region(40, 50, 40.0, 0.0)).select("c_custkey", "z")


@query("landing_pipeline")
def landing_pipeline(spark, sf):
    shared = shared_folder(spark)
    sun = spark.range(12).select(F.col("id").alias("step"), (F.col("id") * 30.0).alias("azimuth"), (F.lit(20.0) + F.col("id") % 3 * 10).alias("elevation"))
    plan = landing.stages(landing.Mission(10.0, max_slope=60.0), [0.0, 90.0, 180.0, 270.0], None, sun)
    dem = cells_from_lineitem(spark, sf).select("row", "col", "z")
    return landing.run(spark, dem, plan, f"{shared}/landing-{uuid.uuid4().hex}")["ranking"]


@query("viewshed", f"WITH g AS MATERIALIZED ({CELLS_SQL}), eye AS (SELECT z + 2.0 AS e FROM g WHERE row = 10 AND col = 12), line AS (SELECT g.row, g.col, e + (g.z - e) * k / n AS lift, CAST(round(10 + (g.row - 10) * (k / n::DOUBLE)) AS INT) AS r2, CAST(round(12 + (g.col - 12) * (k / n::DOUBLE)) AS INT) AS c2 FROM (SELECT *, greatest(abs(row - 10), abs(col - 12)) AS n FROM g) g, eye, range(1, 50) t(k) WHERE k < n) SELECT row, col, CASE WHEN EXISTS (SELECT 1 FROM line l JOIN g h ON h.row = l.r2 AND h.col = l.c2 WHERE l.row = g.row AND l.col = g.col AND h.z > l.lift) THEN 0 ELSE 1 END AS visible FROM g")
def viewshed(spark, sf):
    from ..operators.focal import viewshed as see

    return see(cells_from_lineitem(spark, sf), 10, 12, 2.0)


@query("crater_age", f"WITH RECURSIVE h AS (SELECT p_partkey, p_retailprice * 1e-5 AS n, 0.0::DOUBLE AS lo, 4.6::DOUBLE AS hi, 0 AS k FROM part UNION ALL SELECT p_partkey, n, CASE WHEN {_DENSITY} > n THEN lo ELSE (lo + hi) / 2 END, CASE WHEN {_DENSITY} > n THEN (lo + hi) / 2 ELSE hi END, k + 1 FROM h WHERE k < 50) SELECT p_partkey, round((lo + hi) / 2, 6) AS age, round(n / {_ONE_GA!r}, 6) AS linear FROM h WHERE k = 50")
def crater_age(spark, sf):
    """Ages of crater densities, by the chronology and by the linear ratio."""
    from ..functions.bodies import age_from_density, age_from_ratio

    n = F.col("p_retailprice") * 1e-5
    return table(spark, sf, "part").select("p_partkey", F.round(age_from_density(n), 6).alias("age"), F.round(age_from_ratio(n), 6).alias("linear"))


_BODY_ROWS = ", ".join(f"('{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for n, _, a, b, c, *_rest in BODIES)


@query("target_info", f"SELECT name, round((a + b + c) / 3, 4) AS mean_radius, round((a - c) / a, 6) AS flattening FROM (VALUES {_BODY_ROWS}) t(name, a, b, c)")
def target_info(spark, sf):
    from ..functions.bodies import bodies

    return bodies(spark).select("name", F.round("mean_radius", 4).alias("mean_radius"), F.round("flattening", 6).alias("flattening"))


@query("atmosphere_apply", "SELECT l_orderkey, l_linenumber, l_partkey, round(0.02 + 0.9 * 0.3 * 0.2 * m / (1 - 0.3 * 0.25 * 0.1) + 0.7 * 0.3 * (l_tax - 0.2 * m), 9) AS p FROM (SELECT *, cos(radians(l_quantity)) AS m FROM lineitem)")
def atmosphere_apply(spark, sf):
    from ..operators.cells import apply_atmosphere

    lit = F.lit
    p = apply_atmosphere(lit(0.02), lit(0.9), lit(0.7), lit(0.1), lit(0.3), lit(0.2), lit(0.25), F.col("l_tax"), F.cos(F.radians("l_quantity")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(p, 9).alias("p"))


_CRATER_ROWS = ", ".join(f"('{r[0]}', {', '.join(f'{x!r}::DOUBLE' for x in r[1:])})" for r in CRATER_BODIES)


@query("crater_target", f"SELECT p_partkey, name, round(CASE WHEN dsc > 0 THEN dsc * 1000 WHEN g > 0 THEN 18000.0 * 1.622 / g ELSE 18000.0 END, 3) AS transition FROM (SELECT *, row_number() OVER (ORDER BY name) - 1 AS k FROM (VALUES {_CRATER_ROWS}) t(name, g, radius, bulk, surface, kind, dd, dsc)) b JOIN part ON p_partkey % {len(CRATER_BODIES)} = k")
def crater_target(spark, sf):
    """Each part falls on a body of the table; the diameter at which craters turn complex there."""
    from ..functions.bodies import crater_bodies
    from ..operators.craters import transition_diameter

    names = sorted(r[0] for r in CRATER_BODIES)
    numbered = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")) - 1
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % len(names)).alias("k"))
    b = crater_bodies(spark).withColumn("k", numbered)  # a table of fixed values
    return p.join(F.broadcast(b), "k").select("p_partkey", "name", F.round(transition_diameter(F.col("g"), F.col("dsc_km")), 3).alias("transition"))


@query("dem_mosaic", "WITH t AS (SELECT CAST(l_linenumber AS INT) AS tile, CAST(l_suppkey % 40 AS INT) AS row, CAST(l_partkey % 50 AS INT) AS col, max(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 1000.0 + 0.01 ELSE l_quantity * 10.0 END) AS z FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT *, CASE WHEN abs(max(z) OVER (PARTITION BY tile)) < 50 THEN z * 1000 ELSE z END AS m FROM t) SELECT row, col, round(arg_min(m, tile), 6) AS z FROM s GROUP BY row, col")
def dem_mosaic(spark, sf):
    """Tiles in kilometres and in metres become one map in metres; of overlapping tiles the first counts."""
    from ..sources.dem import mosaic

    q = F.col("l_quantity")
    t = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("tile"), F.expr("cast(l_suppkey % 40 as int)").alias("row"), F.expr("cast(l_partkey % 50 as int)").alias("col"))
    t = t.agg(F.max(F.when(F.col("l_linenumber") % 2 == 0, q / 1000.0 + 0.01).otherwise(q * 10.0)).alias("z"))
    return mosaic(t).withColumn("z", F.round("z", 6))
