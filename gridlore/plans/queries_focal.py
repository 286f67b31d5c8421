"""Focal, terrain and ray queries on the grid made from lineitem."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import focal as O
from .grid import CELLS_SQL, cells_from_lineitem

GRID = f"({CELLS_SQL})"


def _focal_sql(size, z="z", src=GRID):
    h = size // 2
    return f"(SELECT row, col, z, sum(n) OVER v AS n, sum(s) OVER v AS s, sum(q) OVER v AS q, min(lo) OVER v AS lo, max(hi) OVER v AS hi FROM (SELECT row, col, {z} AS z, count({z}) OVER w AS n, sum({z}) OVER w AS s, sum({z} * {z}) OVER w AS q, min({z}) OVER w AS lo, max({z}) OVER w AS hi FROM {src} WINDOW w AS (PARTITION BY row ORDER BY col RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING)) WINDOW v AS (PARTITION BY col ORDER BY row RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING))"


@query("focal_mean_2d", f"SELECT row, col, round(s / n, 6) AS mean FROM {_focal_sql(3)}")
def focal_mean_2d(spark, sf):
    return O.focal(cells_from_lineitem(spark, sf), 3).select("row", "col", F.round(O.mean(), 6).alias("mean"))


@query("focal_mean_join", f"SELECT a.row, a.col, round(sum(b.z) / count(b.z), 6) AS mean FROM {GRID} a JOIN {GRID} b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.row, a.col")
def focal_mean_join(spark, sf):
    """5 x 5; the SQL sums all 25 cells directly."""
    return O.focal(cells_from_lineitem(spark, sf), 5).select("row", "col", F.round(O.mean(), 6).alias("mean"))


@query("focal_stats", f"SELECT row, col, round(sqrt(greatest(0.0, q / n - (s / n) * (s / n))), 6) AS std, round(s, 6) AS sum, hi - lo AS range FROM {_focal_sql(5)}")
def focal_stats(spark, sf):
    return O.focal(cells_from_lineitem(spark, sf), 5).select("row", "col", F.round(O.stddev(), 6).alias("std"), F.round("f_sum", 6).alias("sum"), O.value_range().alias("range"))


@query("focal_mean_1d", f"SELECT row, col, round(avg(z) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS mean FROM {GRID}")
def focal_mean_1d(spark, sf):
    return O.running_mean(cells_from_lineitem(spark, sf), "row", "col", 3).select("row", "col", F.round("mean", 6).alias("mean"))


@query("roughness_rms", f"WITH d AS (SELECT row, col, z, s / n AS m, z - s / n AS dev, sqrt(greatest(0.0, q / n - (s / n) * (s / n))) AS sd FROM {_focal_sql(5)}), g AS (SELECT row, col, power(dev, 2) AS z FROM d) SELECT d.row, d.col, round(sqrt(f.s / f.n), 6) AS rms, round(CASE WHEN d.m > 0.001 THEN d.sd / d.m ELSE 0 END, 6) AS cv FROM d JOIN {_focal_sql(5, 'z', 'g')} f ON d.row = f.row AND d.col = f.col")
def roughness_rms(spark, sf):
    return O.roughness(cells_from_lineitem(spark, sf), 5).select("row", "col", F.round("rms", 6).alias("rms"), F.round("cv", 6).alias("cv"))


def _rough_sql(size, src=GRID):
    """row, col, rms, cv, moran."""
    dev = f"(SELECT row, col, z - s / n AS z, s / n AS m, sqrt(greatest(0.0, q / n - (s / n) * (s / n))) AS sd FROM {_focal_sql(size, 'z', src)})"
    lag = f"(SELECT row, col, z * (s / n) AS z FROM {_focal_sql(3, 'z', dev)})"
    squares = f"(SELECT row, col, z * z AS z FROM {dev})"
    return f"(SELECT d.row, d.col, sqrt(e.s / e.n) AS rms, CASE WHEN d.m > 0.001 THEN d.sd / d.m ELSE 0 END AS cv, CASE WHEN e.s > 1e-4 THEN c.s / e.s ELSE 0 END AS moran FROM {dev} d JOIN {_focal_sql(size, 'z', lag)} c ON d.row = c.row AND d.col = c.col JOIN {_focal_sql(size, 'z', squares)} e ON d.row = e.row AND d.col = e.col)"


@query("roughness_moran", f"WITH g AS MATERIALIZED {GRID} SELECT row, col, round(moran, 6) AS moran, CAST(rms > 1.0 AS INT) AS mask FROM {_rough_sql(5, 'g')}")
def roughness_moran(spark, sf):
    return O.roughness(cells_from_lineitem(spark, sf), 5, threshold=1.0).select("row", "col", F.round("moran", 6).alias("moran"), "mask")


def _beside_sql(src):
    return f"(SELECT row, col, z, coalesce(lag(z) OVER r, z) AS w, coalesce(lead(z) OVER r, z) AS e, coalesce(lag(z) OVER c, z) AS n, coalesce(lead(z) OVER c, z) AS s FROM {src} WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row))"


def _slope_sql(src, size):
    return f"(SELECT row, col, degrees(atan(sqrt(power((e - w) / {2.0 * size}, 2) + power((n - s) / {2.0 * size}, 2)))) AS slope FROM {_beside_sql(src)})"


NB = _beside_sql(GRID)


@query("slope_central", f"SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope, round(CASE WHEN atan2(gx, gy) < 0 THEN degrees(atan2(gx, gy)) + 360 ELSE degrees(atan2(gx, gy)) END, 6) AS aspect FROM (SELECT row, col, (e - w) / 20.0 AS gx, (n - s) / 20.0 AS gy FROM {NB})")
def slope_central(spark, sf):
    return O.slope(cells_from_lineitem(spark, sf).select("row", "col", "z"), 10.0, 10.0).select("row", "col", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


@query("slope_horn", f"SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM (SELECT row, col, ((lag(e) OVER c + 2 * e + lead(e) OVER c) - (lag(w) OVER c + 2 * w + lead(w) OVER c)) / 80.0 AS gx, ((lag(w) OVER c + 2 * lag(z) OVER c + lag(e) OVER c) - (lead(w) OVER c + 2 * lead(z) OVER c + lead(e) OVER c)) / 80.0 AS gy FROM (SELECT row, col, z, lag(z) OVER r AS w, lead(z) OVER r AS e FROM {GRID} WINDOW r AS (PARTITION BY row ORDER BY col)) WINDOW c AS (PARTITION BY col ORDER BY row))")
def slope_horn(spark, sf):
    return O.horn(cells_from_lineitem(spark, sf), 10.0).select("row", "col", F.round("slope", 6).alias("slope"))


@query("slope_scales", f"WITH g AS MATERIALIZED {GRID}, a AS (SELECT row, col, slope > 10.0 AS m FROM {_slope_sql('g', 10)}), b AS (SELECT row, col, slope > 3.0 AS m FROM {_slope_sql('(SELECT row // 5 AS row, col // 5 AS col, avg(z) AS z FROM g GROUP BY 1, 2)', 50)}) SELECT g.row, g.col, CAST(NOT (a.m OR b.m) AS INT) AS safe FROM g JOIN a ON a.row = g.row AND a.col = g.col JOIN b ON b.row = g.row // 5 AND b.col = g.col // 5")
def slope_scales(spark, sf):
    return O.scale_slopes(cells_from_lineitem(spark, sf), 10.0, {10.0: 10.0, 50.0: 3.0})


def _scaled_sql(*columns):
    return ", ".join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END AS {c}" for c in columns)


@query("terrain_hazard", f"WITH g AS MATERIALIZED {GRID}, m AS (SELECT g.row, g.col, s.slope, r.rms AS rough, f.hi - f.lo AS relief, abs(k.z - k.s / k.n) / power(45.0, 2) AS curv, g.w AS crater FROM g JOIN {_slope_sql('g', 10)} s ON s.row = g.row AND s.col = g.col JOIN {_rough_sql(5, 'g')} r ON r.row = g.row AND r.col = g.col JOIN {_focal_sql(11, 'z', 'g')} f ON f.row = g.row AND f.col = g.col JOIN {_focal_sql(9, 'z', 'g')} k ON k.row = g.row AND k.col = g.col), t AS (SELECT row, col, slope > 15.0 OR rough > 1.0 AS bad, {_scaled_sql('slope', 'rough', 'relief', 'curv', 'crater')} FROM m) SELECT row, col, round(0.40 * slope + 0.25 * rough + 0.15 * relief + 0.10 * curv + 0.10 * crater, 6) AS hazard, CAST(bad AS INT) AS mask FROM t")
def terrain_hazard(spark, sf):
    out = O.hazard(cells_from_lineitem(spark, sf).select("row", "col", "z", "w"), 10.0, "w")
    return out.select("row", "col", F.round("hazard", 6).alias("hazard"), "mask")


@query("terrain_ellipse", f"WITH g AS MATERIALIZED {GRID}, s AS MATERIALIZED {_slope_sql('g', 10)}, m AS (SELECT a.row, a.col, a.s / a.n AS slope, b.s / b.n AS r8, c.s / c.n AS r20, r.cv, r.moran FROM {_focal_sql(5, 'slope', 's')} a JOIN {_focal_sql(5, 'CAST(slope < 8 AS DOUBLE)', 's')} b ON b.row = a.row AND b.col = a.col JOIN {_focal_sql(5, 'CAST(slope < 20 AS DOUBLE)', 's')} c ON c.row = a.row AND c.col = a.col JOIN {_rough_sql(5, 'g')} r ON r.row = a.row AND r.col = a.col), t AS (SELECT row, col, r8, r20, moran, {_scaled_sql('slope', 'cv')} FROM m), q AS (SELECT row, col, 0.3632 * r8 + 0.3632 * r20 + 0.0767 * (1 - cv) + 0.1578 * greatest(moran, 0.0) + 0.0391 * (1 - slope) AS q FROM t) SELECT row, col, round(q, 6) AS q, CAST(q >= min(q) OVER () + 0.8 * (max(q) OVER () - min(q) OVER ()) AS INT) AS candidate FROM q")
def terrain_ellipse(spark, sf):
    return O.ellipse_quality(cells_from_lineitem(spark, sf), 10.0, 5).select("row", "col", F.round("q", 6).alias("q"), "candidate")


REACH = 75  # whole steps after which a ray has left a grid of 40 x 50


@query("shadow_mask", f"WITH g AS MATERIALIZED {GRID} SELECT g.row, g.col, CASE WHEN EXISTS (SELECT 1 FROM g h, range(1, {REACH + 1}) t(k) WHERE h.row = CAST(round(g.row - k * {math.cos(math.radians(40))}) AS INT) AND h.col = CAST(round(g.col + k * {math.sin(math.radians(40))}) AS INT) AND h.z > g.z + k * {math.tan(math.radians(15))}) THEN 0 ELSE 1 END AS lit FROM g")
def shadow_mask(spark, sf):
    return O.shadow(cells_from_lineitem(spark, sf), 40.0, 15.0)


HOLES = f"(SELECT row, col, CASE WHEN (row * 50 + col) % 97 <> 0 THEN z END AS z FROM {GRID})"
_DC, _DR, _TAN = math.sin(math.radians(40)), -math.cos(math.radians(40)), math.tan(math.radians(15))


@query("sun_mask", f"WITH g AS MATERIALIZED {HOLES}, s AS (SELECT row, col, z, k * 0.5 AS d, row + k * 0.5 * ({_DR!r}::DOUBLE) AS rc, col + k * 0.5 * ({_DC!r}::DOUBLE) AS cc FROM g, range(1, 361) t(k) WHERE z IS NOT NULL), i AS (SELECT *, CAST(floor(rc) AS INT) AS r0, CAST(floor(cc) AS INT) AS c0, rc - floor(rc) AS fr, cc - floor(cc) AS fc FROM s), h AS (SELECT i.*, (1 - fr) * (1 - fc) * v.z + (1 - fr) * fc * x.z + fr * (1 - fc) * y.z + fr * fc * w.z AS h FROM i LEFT JOIN g v ON v.row = r0 AND v.col = c0 LEFT JOIN g x ON x.row = r0 AND x.col = least(c0 + 1, 49) LEFT JOIN g y ON y.row = least(r0 + 1, 39) AND y.col = c0 LEFT JOIN g w ON w.row = least(r0 + 1, 39) AND w.col = least(c0 + 1, 49)), e AS (SELECT row, col, min(CASE WHEN h IS NULL THEN d END) AS stop, min(CASE WHEN h > z + d * sqrt(power({_DR!r}::DOUBLE, 2) + power({_DC!r}::DOUBLE, 2)) * {_TAN!r}::DOUBLE THEN d END) AS hit FROM h GROUP BY row, col) SELECT g.row, g.col, CASE WHEN z IS NULL THEN 255 WHEN hit < coalesce(stop, 1e9) THEN 0 ELSE 1 END AS mask FROM g LEFT JOIN e ON e.row = g.row AND e.col = g.col")
def sun_mask(spark, sf):
    g = cells_from_lineitem(spark, sf).withColumn("z", F.expr("CASE WHEN (row * 50 + col) % 97 <> 0 THEN z END"))
    return O.sun_mask(g, 40.0, 15.0)


AZ = [0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0]


def _horizon_sql(radius=None):
    """row, col, az, height of g."""
    drop = f" - (k * 10.0) * (k * 10.0) / (2 * {radius})" if radius else ""
    best = f"SELECT y.row, y.col, y.az, max(degrees(atan2(h.z - y.z{drop}, k * 10.0))) AS m FROM (SELECT g.row, g.col, g.z, a.az, k, CAST(round(g.row - k * sin(radians(az))) AS INT) AS r2, CAST(round(g.col + k * cos(radians(az))) AS INT) AS c2 FROM g, (SELECT unnest({AZ}) AS az) a, range(1, {REACH + 1}) t(k)) y JOIN g h ON h.row = y.r2 AND h.col = y.c2 GROUP BY 1, 2, 3"
    return f"(SELECT g.row, g.col, a.az, CASE WHEN m IS NULL THEN 0.0 ELSE greatest(0.0, m) END AS height FROM g CROSS JOIN (SELECT unnest({AZ}) AS az) a LEFT JOIN ({best}) b ON b.row = g.row AND b.col = g.col AND b.az = a.az)"


@query("horizon_max", f"WITH g AS MATERIALIZED {GRID} SELECT row, col, CAST(az AS DOUBLE) AS azimuth, round(height, 6) AS height FROM {_horizon_sql(1737400.0)}")
def horizon_max(spark, sf):
    return O.horizon(cells_from_lineitem(spark, sf), AZ, 10.0, None, 1737400.0).withColumn("height", F.round("height", 6))


def _edge_sql(azimuth):
    """The horizon between two azimuths, of h (row, col, az, height) and a step with that azimuth (counter-clockwise from east)."""
    k, w = f"CAST(floor(({azimuth}) / 45.0) AS INT)", f"(({azimuth}) / 45.0 - floor(({azimuth}) / 45.0))"
    return f"JOIN h lo ON lo.row = g.row AND lo.col = g.col AND lo.az = 45 * ({k} % 8) JOIN h hi ON hi.row = g.row AND hi.col = g.col AND hi.az = 45 * (({k} + 1) % 8)", f"(lo.height * (1 - {w}) + hi.height * {w})"


_SUN_JOIN, _SUN_EDGE = _edge_sql("s.az")


@query("illumination_fraction", f"WITH g AS MATERIALIZED {GRID}, h AS MATERIALIZED {_horizon_sql()}, s AS (SELECT k * 15.0 AS az, 10 * sin(radians(k * 15.0)) AS el FROM range(24) t(k) WHERE 10 * sin(radians(k * 15.0)) > 0), l AS (SELECT g.row, g.col, CAST(el > {_SUN_EDGE} AS DOUBLE) AS lit, CAST(el < 5 AS DOUBLE) AS low FROM g CROSS JOIN s {_SUN_JOIN}) SELECT row, col, round(avg(lit), 6) AS fraction, round(sqrt(greatest(0.0, avg(lit) - avg(lit) * avg(lit))), 6) AS variability, CAST(max(lit) = 0 AS INT) AS psr, sum(lit * low) AS grazing FROM l GROUP BY row, col")
def illumination_fraction(spark, sf):
    g = cells_from_lineitem(spark, sf)
    sun = spark.range(24).select(F.col("id").alias("step"), (F.col("id") * 15.0).alias("azimuth"), (10 * F.sin(F.radians(F.col("id") * 15.0))).alias("elevation"))
    return O.illumination(g, O.horizon_arrays(g, AZ, 10.0), sun).select("row", "col", F.round("fraction", 6).alias("fraction"), F.round("variability", 6).alias("variability"), "psr", "grazing")


_EARTH_JOIN, _EARTH_EDGE = _edge_sql("s.ccw")
_LAT, _LON = -85.0, 10.0
_EARTH = f"(SELECT k, degrees(asin(sin(radians({_LAT})) * sin(lb) + cos(radians({_LAT})) * cos(lb) * cos(hh))) AS el, degrees(atan2(sin(hh) * cos(lb), cos(radians({_LAT})) * sin(lb) - sin(radians({_LAT})) * cos(lb) * cos(hh))) AS az FROM (SELECT k, radians(6.5 * sin(radians(k * 13.0))) AS lb, radians(7.9 * cos(radians(k * 13.0)) - {_LON}) AS hh FROM range(48) t(k)))"


@query("earth_visibility", f"WITH g AS MATERIALIZED {GRID}, h AS MATERIALIZED {_horizon_sql()}, s AS (SELECT k, el, ((90.0 - az) % 360.0 + 360.0) % 360.0 AS ccw FROM {_EARTH} WHERE el >= -10.0), l AS (SELECT g.row, g.col, CAST(el > {_EARTH_EDGE} + 0.5 AS DOUBLE) AS up FROM g CROSS JOIN s {_EARTH_JOIN}) SELECT row, col, round(avg(up), 6) AS fraction, CAST(avg(up) >= 0.5 AS INT) AS mask FROM l GROUP BY row, col")
def earth_visibility(spark, sf):
    from ..operators.rays import elevation_azimuth

    g = cells_from_lineitem(spark, sf)
    k = F.col("id") * 13.0
    elevation, azimuth = elevation_azimuth(_LAT, _LON, 6.5 * F.sin(F.radians(k)), 7.9 * F.cos(F.radians(k)))
    track = spark.range(48).select(F.col("id").alias("step"), azimuth.alias("azimuth"), elevation.alias("elevation"))
    return O.visibility(O.horizon_arrays(g, AZ, 10.0), track, 0.5).select("row", "col", F.round("fraction", 6).alias("fraction"), "mask")
