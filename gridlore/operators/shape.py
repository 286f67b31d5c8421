"""Shape model of an elevation map: rays meet the ellipsoid first, then the map's radius."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as V
from ..plans.grid import Region


def local_radius(lat: Column, lon: Column, a: float, b: float, c: float) -> Column:
    """Radius of the ellipsoid below a planetocentric latitude and longitude (degrees)."""
    u, v = F.radians(lat), F.radians(lon)
    x, y, z = F.cos(u) * F.cos(v) / a, F.cos(u) * F.sin(v) / b, F.sin(u) / c
    return 1 / F.sqrt(x * x + y * y + z * z)


def on_sphere(lat: Column, lon: Column, radius: Column) -> Column:
    """Rectangular point of degrees and a radius."""
    return V.lat_to_rec(radius, F.radians(lon), F.radians(lat))


def surface(rays: DataFrame, dem: DataFrame, region: Region, axes: tuple[float, float, float], key: str = "id", origin: str = "p", look: str = "d", radius: str = "radius", step: float | None = None) -> DataFrame:
    """key, lat, lon, radius and normal where each ray (origin, look) meets the map; nulls for rays that miss.

    The ellipsoid's hit is moved along its own radius, so latitude and longitude stay and one look-up of the map settles
    the point; without data it stays on the ellipsoid.  The normal comes from the four points one step (degrees; the
    cell's size unless given) away, on the ellipsoid where the map has no data.  A ray and its five look-ups
    meet the map in one equality join on cells, and partial aggregates bring them back; keys must differ.
    """
    d = step or region.ns_res
    hit = V.once(V.ellipsoid_hit(F.col(origin), F.col(look), *axes), V.rec_to_lat)
    at = rays.select(key, hit.alias("__h")).select(key, F.degrees("__h.lat").alias("lat"), F.degrees("__h.lon").alias("__lon"))
    at = at.select(key, "lat", F.pmod("__lon", F.lit(360.0)).alias("lon"))
    around = [(0.0, 0.0), (d, 0.0), (-d, 0.0), (0.0, d), (0.0, -d)]
    spots = F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("lat").isNotNull(), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("lat") + u))).alias("lat"), F.pmod(F.col("lon") + v, F.lit(360.0)).alias("lon")) for k, (u, v) in enumerate(around)])
    looks = at.select(key, F.explode(spots).alias("s")).select(key, "s.*")
    row, col = region.cell_of(F.col("lon"), F.col("lat"))
    found = looks.withColumn("row", F.least(row, F.lit(region.rows - 1))).withColumn("col", col).join(dem.select("row", "col", F.col(radius).alias("__r")), ["row", "col"], "left")
    r = F.when(F.col("__r") > 0, F.col("__r")).otherwise(local_radius(F.col("lat"), F.col("lon"), *axes))
    point = F.struct("lat", "lon", r.alias("radius"))
    wide = found.groupBy(key).agg(*[F.max(F.when(F.col("k") == k, point)).alias(f"__{k}") for k in range(5)])
    xyz = lambda k: on_sphere(F.col(f"__{k}.lat"), F.col(f"__{k}.lon"), F.col(f"__{k}.radius"))
    ends = V.once(F.struct(V.sub(xyz(3), xyz(4)).alias("east"), V.sub(xyz(1), xyz(2)).alias("north")), lambda e: V.cross(e["east"], e["north"]))
    outward = V.once(F.struct(V.once(ends, V.unit).alias("n"), xyz(0).alias("p")), lambda x: V.scale(F.when(V.dot(x["n"], x["p"]) < 0, -1.0).otherwise(1.0), x["n"]))
    hits = F.col("__0.lat").isNotNull()
    return wide.select(key, *[F.when(hits, F.col(f"__0.{n}")).alias(n) for n in ("lat", "lon", "radius")], F.when(hits, outward).alias("normal"))


def sub_point(v: Column) -> Column:
    """struct<lat, lon> (degrees, east 0 to 360) of the point below a body-fixed position."""
    return V.once(V.rec_to_lat(v), lambda p: F.struct(F.degrees(p["lat"]).alias("lat"), F.pmod(F.degrees(p["lon"]), F.lit(360.0)).alias("lon")))


def plane_hit(p: Column, d: Column, normal: Column, constant: Column | float = 0.0) -> Column:
    """Where the ray p + t d, t >= 0, meets the plane normal . x = constant; null where it doesn't."""
    along = V.dot(normal, d)
    t = F.when(F.abs(along) > 1e-12, (constant - V.dot(normal, p)) / along)
    return F.when(t >= 0, V.add(p, V.scale(t, d)))


def ground_size(distance: Column, emission: Column, ifov: float) -> Column:
    """struct<across, along>: a pixel's footprint at a distance; along the look it stretches by 1 / cos(emission)."""
    across = 2 * distance * math.tan(ifov / 2)
    return F.struct(across.alias("across"), F.when(F.cos(emission) > 0, across / F.cos(emission)).alias("along"))
