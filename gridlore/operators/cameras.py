"""Frame cameras over an ellipsoid: looks of pixels, planes of geometry, summaries, images brought to a map."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..plans.grid import Region
from .rings import resample
from .shape import local_radius, on_sphere, sub_point

#: Steps that take the distortion back out.
STEPS = 5


@dataclass(frozen=True)
class Camera:
    """Body-fixed position, rotation from camera to body (nine numbers by rows; the camera looks along +z), focal length and pixel pitch in one unit, size, and the optical axis' sample and line (the middle unless given).

    k1: a pixel at x from the axis sees along x (1 + k1 x^2).
    """

    position: tuple[float, float, float]
    rotation: tuple[float, ...]
    focal: float
    pitch: float
    lines: int
    samples: int
    k1: float = 0.0
    axis: tuple[float, float] | None = None

    @property
    def centre(self) -> tuple[float, float]:
        return self.axis or ((self.samples - 1) / 2, (self.lines - 1) / 2)

    @property
    def ifov(self) -> float:
        return self.pitch / self.focal


def look(sample: Column, line: Column, cam: Camera) -> Column:
    """Unit vector, body-fixed, of a pixel's look."""
    s0, l0 = cam.centre
    x, y = (sample - s0) * cam.pitch, (line - l0) * cam.pitch
    k = 1 + cam.k1 * (x * x + y * y)
    return V.once(V.vec(x * k, y * k, cam.focal), lambda v: V.once(V.matrix_times(V.vec(*cam.rotation), v), V.unit))


def pixel_of(point: Column, cam: Camera) -> Column:
    """struct<s, l> where the camera has a body-fixed point; null behind it or outside the image."""
    s0, l0 = cam.centre

    def seen(v: Column) -> Column:
        x, y, z = (F.element_at(v, k) for k in (1, 2, 3))
        flat = F.struct((cam.focal * x / z).alias("x"), (cam.focal * y / z).alias("y"))

        def undistorted(u: Column) -> Column:
            def closer(d: Column, _: Column) -> Column:
                k = 1 + cam.k1 * (d["x"] * d["x"] + d["y"] * d["y"])
                return F.struct((u["x"] / k).alias("x"), (u["y"] / k).alias("y"))

            d = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), u, closer) if cam.k1 else u
            return V.once(d, lambda d: F.struct((s0 + d["x"] / cam.pitch).alias("s"), (l0 + d["y"] / cam.pitch).alias("l")))

        return F.when(z > 0, V.once(flat, undistorted))

    # the rotation back is the transpose
    back = [cam.rotation[3 * j + i] for i in range(3) for j in range(3)]
    found = V.once(V.matrix_times(V.vec(*back), V.sub(point, V.vec(*cam.position))), seen)
    return V.once(found, lambda x: F.when(x["s"].between(-0.5, cam.samples - 0.5) & x["l"].between(-0.5, cam.lines - 0.5), x))


def _geometry(points: DataFrame, eye: Column, sun: Column, axes: tuple[float, float, float], ifov: float) -> DataFrame:
    """row, col, lat, lon, radius, incidence, emission, phase (degrees) and resolution of points (row, col, point); nulls for null points."""
    rows = points.select("row", "col", "point", sub_point(F.col("point")).alias("g"), V.sub(eye, F.col("point")).alias("to_eye"), V.ellipsoid_normal(F.col("point"), *axes).alias("n"))
    rows = rows.select("*", V.surface_angles(F.col("n"), sun, F.col("to_eye")).alias("a"))
    planes = [F.col("g.lat").alias("lat"), F.col("g.lon").alias("lon"), V.norm(F.col("point")).alias("radius"), *[F.degrees(f"a.{n}").alias(n) for n in ("incidence", "emission", "phase")], (V.norm(F.col("to_eye")) * ifov).alias("resolution")]
    return rows.select("row", "col", *[F.when(F.col("point").isNotNull(), c).alias(n) for c, n in zip(planes, ("lat", "lon", "radius", "incidence", "emission", "phase", "resolution"))])


def map_planes(cells: DataFrame, region: Region, sun: tuple[float, float, float], eye: tuple[float, float, float], axes: tuple[float, float, float], ifov: float = 1.0) -> DataFrame:
    """Planes of geometry of map cells whose north and east are latitude and longitude: one sun direction, one position of the eye."""
    lat, lon = region.northing(F.col("row")), region.east(F.col("col"))
    points = cells.select("row", "col", on_sphere(lat, lon, local_radius(lat, lon, *axes)).alias("point"))
    return _geometry(points, V.vec(*eye), V.vec(*sun), axes, ifov)


def camera_planes(spark: SparkSession, cam: Camera, sun: tuple[float, float, float], axes: tuple[float, float, float]) -> DataFrame:
    """Planes of geometry of a camera's pixels (row = line, col = sample); null where a look misses."""
    pixels = spark.range(cam.lines * cam.samples).select(F.floor(F.col("id") / cam.samples).cast("int").alias("row"), (F.col("id") % cam.samples).cast("int").alias("col"))
    d = pixels.select("row", "col", look(F.col("col").cast("double"), F.col("row").cast("double"), cam).alias("d"))
    points = d.select("row", "col", V.ellipsoid_hit(V.vec(*cam.position), F.col("d"), *axes).alias("point"))
    return _geometry(points, V.vec(*cam.position), V.vec(*sun), axes, cam.ifov)


def camera_summary(planes: DataFrame) -> DataFrame:
    """One row: how many pixels meet the body, ranges of position and of angles, mean resolution."""
    ranges = [f(n).alias(f"{word}_{n}") for n in ("lat", "lon", "incidence", "emission", "phase") for f, word in ((F.min, "least"), (F.max, "most"))]
    return planes.agg(F.count("*").alias("pixels"), F.count("lat").alias("on_body"), *ranges, F.avg("resolution").alias("mean_resolution"))


def to_map(spark: SparkSession, image: DataFrame, cam: Camera, region: Region, axes: tuple[float, float, float], z: str = "z") -> DataFrame:
    """row, col, z of a latitude and longitude map from a camera's image: every map cell finds its pixel and takes the weighted mean of the four around it.

    Cells that the body hides, outside the image or without data are null.
    """
    cells = spark.range(region.rows * region.cols).select(F.floor(F.col("id") / region.cols).cast("int").alias("row"), (F.col("id") % region.cols).cast("int").alias("col"))
    lat, lon = region.northing(F.col("row")), region.east(F.col("col"))
    points = cells.select("row", "col", on_sphere(lat, lon, local_radius(lat, lon, *axes)).alias("point"))
    faces = V.dot(V.ellipsoid_normal(F.col("point"), *axes), V.sub(V.vec(*cam.position), F.col("point"))) > 0
    return resample(points.select("row", "col", F.when(faces, pixel_of(F.col("point"), cam)).alias("x")), image, cam.lines, cam.samples, z)


def looking_at(position: tuple[float, float, float], target: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[float, ...]:
    """Rotation of a camera at a position that looks at a target, lines running south; not from above a pole."""
    z = [t - p for t, p in zip(target, position)]
    n = math.sqrt(sum(v * v for v in z))
    z = [v / n for v in z]
    h = math.hypot(z[0], z[1])
    x = [z[1] / h, -z[0] / h, 0.0]
    y = [z[1] * x[2] - z[2] * x[1], z[2] * x[0] - z[0] * x[2], z[0] * x[1] - z[1] * x[0]]
    return tuple(v for k in range(3) for v in (x[k], y[k], z[k]))
