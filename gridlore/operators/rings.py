"""Ring-plane images: a camera's bilinear geometry, images resampled to radius and longitude, map positions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.grid import Region

#: Newton steps that invert the geometry.
STEPS = 4


@dataclass(frozen=True)
class Geometry:
    """radius and longitude (degrees) as k0 + k1 s + k2 l + k3 s l of sample s and line l, for an image of lines x samples."""

    radius: tuple[float, float, float, float]
    lon: tuple[float, float, float, float]
    lines: int
    samples: int


def fit_geometry(position: np.ndarray, rotation: np.ndarray, scale: tuple[float, float], lines: int, samples: int, grid: int = 9) -> Geometry:
    """Least squares over grid x grid looks of a camera (position and rotation in the ring frame) that meet the plane z = 0 ahead.

    scale is the tangent of a pixel along samples and lines.  The looks are a fixed, small number, so they stay here.
    """
    s, l = (x.ravel() for x in np.meshgrid(np.linspace(0, samples - 1, grid), np.linspace(0, lines - 1, grid)))
    look = np.stack([(s - (samples - 1) / 2) * scale[0], -(l - (lines - 1) / 2) * scale[1], np.ones_like(s)])
    look = np.asarray(rotation, float).reshape(3, 3) @ (look / np.linalg.norm(look, axis=0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = -position[2] / look[2]
    ahead = (np.abs(look[2]) >= 1e-12) & (t >= 0)
    if ahead.sum() < 4:
        raise ValueError("fewer than four looks meet the ring plane")
    x, y = (position[k] + t[ahead] * look[k, ahead] for k in (0, 1))
    terms = np.stack([np.ones_like(s), s, l, s * l], 1)[ahead]
    fits = [np.linalg.lstsq(terms, v, rcond=None)[0] for v in (np.hypot(x, y), np.degrees(np.arctan2(y, x)))]
    return Geometry(*[tuple(float(k) for k in f) for f in fits], lines, samples)


def pixel_at(radius: Column, lon: Column, g: Geometry) -> Column:
    """struct<s, l> where the geometry has a radius and longitude; null outside the image."""
    a, b = g.radius, g.lon
    det = a[1] * b[2] - a[2] * b[1]
    if abs(det) < 1e-30:
        raise ValueError("the geometry can't be inverted")
    dr, dl = radius - a[0], lon - b[0]
    first = F.struct(((b[2] * dr - a[2] * dl) / det).alias("s"), ((a[1] * dl - b[1] * dr) / det).alias("l"))

    def newton(x: Column, _: Column) -> Column:
        s, l = x["s"], x["l"]
        miss_r = a[1] * s + a[2] * l + a[3] * s * l - dr
        miss_l = b[1] * s + b[2] * l + b[3] * s * l - dl
        rs, rl, ls, ll = a[1] + a[3] * l, a[2] + a[3] * s, b[1] + b[3] * l, b[2] + b[3] * s
        d = rs * ll - rl * ls
        d = F.when(F.abs(d) < 1e-30, 1e-30).otherwise(d)
        return F.struct((s - (ll * miss_r - rl * miss_l) / d).alias("s"), (l - (rs * miss_l - ls * miss_r) / d).alias("l"))

    x = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, newton)
    inside = x["s"].between(-0.5, g.samples - 0.5) & x["l"].between(-0.5, g.lines - 0.5)
    return F.when(inside, x)


def resample(at: DataFrame, image: DataFrame, lines: int, samples: int, z: str = "z") -> DataFrame:
    """row, col, z of cells (row, col, x: struct<s, l> or null): the weighted mean of the four pixels around that hold data, null where none does.

    Edges repeat.  One equality join on pixels (image: row = line, col = sample), partial sums back.
    """
    fs, fl = F.col("x.s") - F.floor("x.s"), F.col("x.l") - F.floor("x.l")
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v).cast("int")))
    four = [F.struct(clip(F.col("x.l") + dl, lines).alias("l"), clip(F.col("x.s") + ds, samples).alias("s"), ((fs if ds else 1 - fs) * (fl if dl else 1 - fl)).alias("w")) for dl in (0, 1) for ds in (0, 1)]
    asked = at.select("row", "col", F.explode_outer(F.when(F.col("x").isNotNull(), F.array(*four))).alias("q")).select("row", "col", "q.*")
    pixels = image.where(F.col(z).isNotNull()).select(F.col("row").alias("l"), F.col("col").alias("s"), F.col(z).alias("__z"))
    got = asked.join(pixels, ["l", "s"], "left").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("__z")).alias("__v"), F.sum(F.when(F.col("__z").isNotNull(), F.col("w"))).alias("__w"))
    return got.select("row", "col", F.when(F.col("__w") > 0, F.col("__v") / F.col("__w")).alias(z))


def to_ring_map(spark: SparkSession, image: DataFrame, g: Geometry, region: Region, z: str = "z") -> DataFrame:
    """row, col, z of a map whose east is longitude and north is radius, from an image (row = line, col = sample).

    Every map cell finds its pixel by the inverted geometry; cells outside the image or without data are null.
    """
    cells = spark.range(region.rows * region.cols).select(F.floor(F.col("id") / region.cols).cast("int").alias("row"), (F.col("id") % region.cols).cast("int").alias("col"))
    at = cells.select("row", "col", pixel_at(region.northing(F.col("row")), region.east(F.col("col")), g).alias("x"))
    return resample(at, image, g.lines, g.samples, z)


def project(cells: DataFrame, region: Region, centre_radius: float, centre_lon: float = 0.0, clockwise: bool = False, inverse: bool = False, z: str = "z") -> DataFrame:
    """row, col, z, and the ring-plane position (u, v) of each cell: x, y forward, radius and longitude (degrees) inverse.

    Values stay in their cells; a cell whose position is undefined (a radius of 0 or less) becomes null.
    North is the radius and east the longitude forward; inverse they are read as x and y.
    """
    from ..functions.vectors import ring_cylindrical, ring_cylindrical_inverse

    north, east = region.northing(F.col("row")), region.east(F.col("col"))
    if inverse:
        p = ring_cylindrical_inverse(north, east, centre_radius, centre_lon, clockwise)
        u, v = p["radius"], p["lon"]
    else:
        p = ring_cylindrical(north, F.radians(east), centre_radius, float(np.radians(centre_lon)), clockwise)
        u, v = p["x"], p["y"]
    return cells.select("row", "col", F.when(u.isNotNull(), F.col(z)).alias(z), u.alias("u"), v.alias("v"))
