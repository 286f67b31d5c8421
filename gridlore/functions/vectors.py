"""Vectors, matrices, quaternions and coordinates as column expressions on array<double>.

Vectors are arrays of three, matrices arrays of nine by rows, quaternions (w, x, y, z).  Angles are radians.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def vec(*x: Column | float) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in x])


def _at(a: Column, i: int) -> Column:
    return F.element_at(a, i + 1)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it: expressions stay small where they build on each other."""
    return F.element_at(F.transform(F.array(x), f), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(k: Column | float, a: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def combine(k: Column | float, a: Column, m: Column | float, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * k + y * m)


def cross(a: Column, b: Column) -> Column:
    return vec(*[_at(a, (i + 1) % 3) * _at(b, (i + 2) % 3) - _at(a, (i + 2) % 3) * _at(b, (i + 1) % 3) for i in range(3)])


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """Unit vector; the zero vector stays."""
    return once(F.struct(a.alias("v"), norm(a).alias("n")), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0)))


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def separation(a: Column, b: Column) -> Column:
    """Angle between two vectors, exact near 0 and pi; 0 if either is zero, null if either is null."""

    def between(s: Column) -> Column:
        u, v = s["u"], s["v"]
        same = 2 * F.asin(F.least(F.lit(1.0), norm(sub(u, v)) / 2))
        other = math.pi - 2 * F.asin(F.least(F.lit(1.0), norm(add(u, v)) / 2))
        angle = F.when((norm(u) == 0) | (norm(v) == 0), 0.0).when(dot(u, v) > 0, same).when(dot(u, v) < 0, other).otherwise(math.pi / 2)
        return F.when(u.isNotNull() & v.isNotNull(), angle)

    return once(F.struct(unit(a).alias("u"), unit(b).alias("v")), between)


def project(a: Column, b: Column) -> Column:
    """The part of a along b."""
    d = dot(b, b)
    return F.transform(b, lambda x: F.when(d > 0, x * dot(a, b) / d).otherwise(0.0))


def perpendicular(a: Column, b: Column) -> Column:
    return sub(a, project(a, b))


def rotate_about(v: Column, axis: Column, angle: Column) -> Column:
    """v turned about an axis by the right hand."""
    u = unit(axis)
    return add(add(scale(F.cos(angle), v), scale(F.sin(angle), cross(u, v))), scale((1 - F.cos(angle)) * dot(u, v), u))


def matrix_times(m: Column, v: Column) -> Column:
    return vec(*[sum((_at(m, 3 * i + j) * _at(v, j) for j in range(1, 3)), _at(m, 3 * i) * _at(v, 0)) for i in range(3)])


def transpose(m: Column) -> Column:
    return vec(*[_at(m, 3 * j + i) for i in range(3) for j in range(3)])


def multiply(a: Column, b: Column) -> Column:
    return vec(*[_at(a, 3 * i) * _at(b, j) + _at(a, 3 * i + 1) * _at(b, 3 + j) + _at(a, 3 * i + 2) * _at(b, 6 + j) for i in range(3) for j in range(3)])


def determinant(m: Column) -> Column:
    return dot(F.slice(m, 1, 3), cross(F.slice(m, 4, 3), F.slice(m, 7, 3)))


def trace(m: Column) -> Column:
    return _at(m, 0) + _at(m, 4) + _at(m, 8)


def frame_rotation(angle: Column, axis: int) -> Column:
    """Matrix that turns the frame about axis 1, 2 or 3."""
    c, s = F.cos(angle), F.sin(angle)
    rows = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    a, b = axis % 3, (axis + 1) % 3
    rows[a][a], rows[b][b], rows[a][b], rows[b][a] = c, c, s, -s
    return vec(*[x for r in rows for x in r])


def quaternion_to_matrix(q: Column) -> Column:
    w, x, y, z = (_at(q, i) for i in range(4))
    return vec(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def quaternion_product(p: Column, q: Column) -> Column:
    a, b, c, d = (_at(p, i) for i in range(4))
    w, x, y, z = (_at(q, i) for i in range(4))
    return vec(a * w - b * x - c * y - d * z, a * x + b * w + c * z - d * y, a * y - b * z + c * w + d * x, a * z + b * y - c * x + d * w)


# --- coordinates --------------------------------------------------------------------------------


def lat_to_rec(radius: Column, lon: Column, lat: Column) -> Column:
    return vec(radius * F.cos(lon) * F.cos(lat), radius * F.sin(lon) * F.cos(lat), radius * F.sin(lat))


def rec_to_lat(v: Column) -> Column:
    """struct<radius, lon, lat>."""
    x, y, z = (_at(v, i) for i in range(3))
    return F.struct(norm(v).alias("radius"), F.atan2(y, x).alias("lon"), F.atan2(z, F.sqrt(x * x + y * y)).alias("lat"))


def cyl_to_rec(r: Column, lon: Column, z: Column) -> Column:
    return vec(r * F.cos(lon), r * F.sin(lon), z)


def rec_to_cyl(v: Column) -> Column:
    x, y, z = (_at(v, i) for i in range(3))
    lon = F.atan2(y, x)
    return F.struct(F.sqrt(x * x + y * y).alias("r"), F.when(lon < 0, lon + 2 * math.pi).otherwise(lon).alias("lon"), z.alias("z"))


def sph_to_rec(r: Column, colat: Column, lon: Column) -> Column:
    return vec(r * F.sin(colat) * F.cos(lon), r * F.sin(colat) * F.sin(lon), r * F.cos(colat))


def rec_to_sph(v: Column) -> Column:
    x, y, z = (_at(v, i) for i in range(3))
    return F.struct(norm(v).alias("r"), F.atan2(F.sqrt(x * x + y * y), z).alias("colat"), F.atan2(y, x).alias("lon"))


def rad_to_rec(r: Column, ra: Column, dec: Column) -> Column:
    return lat_to_rec(r, ra, dec)


def geo_to_rec(lon: Column, lat: Column, alt: Column, re: float, f: float) -> Column:
    """Geodetic to rectangular on a spheroid of equatorial radius re and flattening f."""
    e2 = f * (2 - f)
    n = re / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return vec((n + alt) * F.cos(lat) * F.cos(lon), (n + alt) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + alt) * F.sin(lat))


def rec_to_geo(v: Column, re: float, f: float, steps: int = 8) -> Column:
    """struct<lon, lat, alt>: fixed-point steps on the latitude."""
    x, y, z = (_at(v, i) for i in range(3))
    p, e2 = F.sqrt(x * x + y * y), f * (2 - f)

    def better(lat: Column, _: Column) -> Column:
        n = re / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
        return F.atan2(z + e2 * n * F.sin(lat), p)

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.atan2(z, p * (1 - e2)), better)
    n = re / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    alt = p * F.cos(lat) + z * F.sin(lat) - n * (1 - e2 * F.sin(lat) * F.sin(lat))
    return F.struct(F.atan2(y, x).alias("lon"), lat.alias("lat"), alt.alias("alt"))


def az_el_to_rec(r: Column, az: Column, el: Column) -> Column:
    return lat_to_rec(r, az, el)


def ellipsoid_hit(p: Column, d: Column, a: float, b: float, c: float) -> Column:
    """Nearest point ahead where the ray p + t d meets the ellipsoid, or null."""
    k = vec(1 / a, 1 / b, 1 / c)
    scaled = lambda x: F.zip_with(x, k, lambda u, v: u * v)

    def terms(r: Column) -> Column:
        sphere = F.struct(scaled(r["p"]).alias("p"), scaled(r["d"]).alias("d"))
        return once(sphere, lambda s: F.struct(dot(s["d"], s["d"]).alias("a"), (2 * dot(s["p"], s["d"])).alias("b"), (dot(s["p"], s["p"]) - 1).alias("c")))

    def roots(q: Column) -> Column:
        disc = q["b"] * q["b"] - 4 * q["a"] * q["c"]
        return once(F.when(disc >= 0, F.sqrt(disc)), lambda w: F.struct(((-q["b"] - w) / (2 * q["a"])).alias("near"), ((-q["b"] + w) / (2 * q["a"])).alias("far")))

    first = lambda t: F.when(t["near"] > 1e-10, t["near"]).when(t["far"] > 1e-10, t["far"])
    along = lambda r: once(once(once(terms(r), roots), first), lambda t: F.when(t.isNotNull(), add(r["p"], scale(t, r["d"]))))
    return once(F.struct(p.alias("p"), d.alias("d")), along)


def ellipsoid_normal(p: Column, a: float, b: float, c: float) -> Column:
    return unit(F.zip_with(p, vec(1 / a**2, 1 / b**2, 1 / c**2), lambda x, y: x * y))


def surface_angles(normal: Column, to_sun: Column, to_eye: Column) -> Column:
    """struct<incidence, emission, phase>."""
    return F.struct(separation(normal, to_sun).alias("incidence"), separation(normal, to_eye).alias("emission"), separation(to_sun, to_eye).alias("phase"))


# --- map projections of a sphere -------------------------------------------------------------------


def equal_area(lon: Column, lat: Column, radius: float, lon0: float, lat0: float) -> Column:
    """struct<x, y>: azimuthal equal-area about (lon0, lat0)."""
    cosc = math.sin(lat0) * F.sin(lat) + math.cos(lat0) * F.cos(lat) * F.cos(lon - lon0)
    k = F.sqrt(2 / (1 + cosc))
    return F.struct((radius * k * F.cos(lat) * F.sin(lon - lon0)).alias("x"), (radius * k * (math.cos(lat0) * F.sin(lat) - math.sin(lat0) * F.cos(lat) * F.cos(lon - lon0))).alias("y"))


def equal_area_inverse(x: Column, y: Column, radius: float, lon0: float, lat0: float) -> Column:
    rho = F.sqrt(x * x + y * y)
    c = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * radius)))
    lat = F.when(rho > 0, F.asin(F.cos(c) * math.sin(lat0) + y * F.sin(c) * math.cos(lat0) / rho)).otherwise(lat0)
    lon = lon0 + F.atan2(x * F.sin(c), rho * math.cos(lat0) * F.cos(c) - y * math.sin(lat0) * F.sin(c))
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def libration_equal_area(lon: Column, lat: Column, radius: float, libration: float) -> Column:
    """struct<x, y>: the disk seen from the body's near side, widened so that its rim lies the libration beyond the limb.

    The distance from the middle is radius * sin(E / p) for an angle E from the sub-observer point, with p = 1 + libration / (pi / 2).
    """
    p = 1 + libration / (math.pi / 2)
    y, z = F.cos(lat) * F.sin(lon), F.sin(lat)
    across = F.sqrt(y * y + z * z)
    k = F.when(across > 0, radius * F.sin(F.atan2(across, F.cos(lat) * F.cos(lon)) / p) / across).otherwise(0.0)
    return F.struct((k * y).alias("x"), (k * z).alias("y"))


def libration_equal_area_inverse(x: Column, y: Column, radius: float, libration: float) -> Column:
    """struct<lon, lat>; null beyond the rim."""
    p = 1 + libration / (math.pi / 2)
    rho = F.sqrt(x * x + y * y)
    e = p * F.asin(rho / radius)
    k = F.when(rho > 0, F.sin(e) / rho).otherwise(0.0)
    return F.when(rho <= radius, F.struct(F.atan2(k * x, F.cos(e)).alias("lon"), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), k * y))).alias("lat")))


def ring_cylindrical(radius: Column, lon: Column, ring_radius: float, lon0: float, clockwise: bool = False) -> Column:
    """struct<x, y> of a ring plane: x along longitude at ring_radius, y the radius short of it; null for a radius of 0 or less."""
    turn = -1.0 if clockwise else 1.0
    return F.struct(F.when(radius > 0, turn * ring_radius * (lon - lon0)).alias("x"), F.when(radius > 0, ring_radius - radius).alias("y"))


def ring_cylindrical_inverse(x: Column, y: Column, ring_radius: float, lon0_deg: float, clockwise: bool = False) -> Column:
    """struct<radius, lon> (lon in degrees) of a position in a ring plane; null where the radius is 0 or less."""
    turn = -1.0 if clockwise else 1.0
    ahead = y < ring_radius
    return F.struct(F.when(ahead, ring_radius - y).alias("radius"), F.when(ahead, lon0_deg + turn * F.degrees(x / ring_radius)).alias("lon"))


# --- planes, lines, matrices ---------------------------------------------------------------------


def plane(normal: Column, constant: Column | float) -> Column:
    """struct<normal, constant> with a unit normal and a constant of 0 or more: the points x with normal . x = constant."""
    k = constant if isinstance(constant, Column) else F.lit(float(constant))
    given = F.struct(normal.alias("v"), k.alias("k"), norm(normal).alias("n"))
    return once(given, lambda g: F.struct(scale(F.when(g["k"] < 0, -1.0).otherwise(1.0) / g["n"], g["v"]).alias("normal"), F.abs(g["k"] / g["n"]).alias("constant")))


def plane_through(normal: Column, point: Column) -> Column:
    return once(normal, lambda n: plane(n, dot(n, point)))


def plane_spanned(point: Column, u: Column, v: Column) -> Column:
    """The plane through a point along two directions."""
    return plane_through(cross(u, v), point)


def on_plane(p: Column, pl: Column) -> Column:
    """The point of a plane nearest to p."""
    return combine(1.0, p, pl["constant"] - dot(p, pl["normal"]), pl["normal"])


def near_line(point: Column, direction: Column, p: Column) -> Column:
    """struct<nearest, distance> of p and the line through a point."""
    return once(add(point, project(sub(p, point), direction)), lambda foot: F.struct(foot.alias("nearest"), distance(foot, p).alias("distance")))


def inverse(m: Column) -> Column:
    """Inverse of a matrix by cofactors; null if it is singular."""

    def by_cofactors(m: Column) -> Column:
        r = [F.slice(m, k, 3) for k in (1, 4, 7)]
        cofactors = F.concat(cross(r[1], r[2]), cross(r[2], r[0]), cross(r[0], r[1]))
        return once(F.struct(cofactors.alias("c"), determinant(m).alias("d")), lambda x: F.when(x["d"] != 0, scale(1 / x["d"], transpose(x["c"]))))

    return once(m, by_cofactors)


def frame_of(a: Column, b: Column) -> Column:
    """Matrix whose rows are a, the part of b across a, and their product: a right-handed frame."""
    axes = F.struct(unit(a).alias("x"), unit(cross(a, b)).alias("z"))
    return once(axes, lambda f: F.concat(f["x"], cross(f["z"], f["x"]), f["z"]))


def _axis(m: Column) -> Column:
    off = vec(_at(m, 7) - _at(m, 5), _at(m, 2) - _at(m, 6), _at(m, 3) - _at(m, 1))

    def by(off: Column) -> Column:
        # half a turn: the columns of (m + 1) / 2 are multiples of the axis, the longest is taken
        spread = [vec(*[(_at(m, 3 * i + j) + float(i == j)) / 2 for i in range(3)]) for j in range(3)]
        longest = F.when((_at(m, 0) >= _at(m, 4)) & (_at(m, 0) >= _at(m, 8)), spread[0]).when(_at(m, 4) >= _at(m, 8), spread[1]).otherwise(spread[2])
        plain = F.when(norm(off) > 1e-12, off).when(trace(m) > 1, vec(0.0, 0.0, 1.0)).otherwise(longest)
        return F.struct(once(plain, unit).alias("axis"), F.atan2(norm(off), trace(m) - 1).alias("angle"))

    return once(off, by)


def matrix_to_axis(m: Column) -> Column:
    """struct<axis, angle> (0 to pi) of a rotation; the z axis for no rotation."""
    return once(m, _axis)


def axis_to_matrix(axis: Column, angle: Column) -> Column:
    """Matrix that turns vectors about an axis by the right hand."""
    columns = lambda u: F.concat(*[rotate_about(vec(*[float(i == j) for i in range(3)]), u, angle) for j in range(3)])
    return once(once(axis, columns), transpose)


def matrix_to_quaternion(m: Column) -> Column:
    return once(matrix_to_axis(m), lambda r: F.concat(F.array(F.cos(r["angle"] / 2)), scale(F.sin(r["angle"] / 2), r["axis"])))


# --- Jacobians: nine numbers by rows ------------------------------------------------------------


def jacobian_lat(radius: Column, lon: Column, lat: Column) -> Column:
    """Of rectangular by (radius, lon, lat)."""
    cn, sn, ct, st = F.cos(lon), F.sin(lon), F.cos(lat), F.sin(lat)
    return vec(cn * ct, -radius * sn * ct, -radius * cn * st, sn * ct, radius * cn * ct, -radius * sn * st, st, 0.0, radius * ct)


def jacobian_cyl(r: Column, lon: Column, z: Column) -> Column:
    """Of rectangular by (r, lon, z)."""
    return vec(F.cos(lon), -r * F.sin(lon), 0.0, F.sin(lon), r * F.cos(lon), 0.0, 0.0, 0.0, 1.0)


def jacobian_sph(r: Column, colat: Column, lon: Column) -> Column:
    """Of rectangular by (r, colat, lon)."""
    cn, sn, ct, st = F.cos(lon), F.sin(lon), F.cos(colat), F.sin(colat)
    return vec(st * cn, r * ct * cn, -r * st * sn, st * sn, r * ct * sn, r * st * cn, ct, -r * st, 0.0)


def jacobian_geo(lon: Column, lat: Column, alt: Column, re: float, f: float) -> Column:
    """Of rectangular by geodetic (lon, lat, alt): both radii of curvature of the spheroid."""
    e2 = f * (2 - f)
    w = F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    across, along = re / w + alt, re * (1 - e2) / (w * w * w) + alt
    cn, sn, ct, st = F.cos(lon), F.sin(lon), F.cos(lat), F.sin(lat)
    return vec(-across * ct * sn, -along * st * cn, ct * cn, across * ct * cn, -along * st * sn, ct * sn, 0.0, along * ct, st)


def jacobian_from_rec(of_rec: Column) -> Column:
    """Of the coordinates by rectangular: the inverse of a Jacobian above; null on the axis, where there is none."""
    return inverse(of_rec)
