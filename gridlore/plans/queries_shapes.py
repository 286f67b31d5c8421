"""Shape-model, ring-plane, plane and Jacobian queries, windows of thick atmospheres and entries of found rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query, table
from ..functions import vectors as V
from ..operators import cameras, rings, shape, spectra as S
from .ek import ek_elements, ek_rows, ek_sql
from .grid import CELLS_SQL, Region, cells_from_lineitem

GLOBE = Region(40, 50, 90.0, 0.0, 4.5, 7.2)
AXES = (26.0, 25.0, 24.0)

_SURFACE_SQL = f"""
WITH g AS MATERIALIZED (SELECT row, col, 25 + z / 50 AS r FROM ({CELLS_SQL})),
ray AS (SELECT p_partkey, 100 * cos(radians(la)) * cos(radians(lo)) AS px, 100 * cos(radians(la)) * sin(radians(lo)) AS py, 100 * sin(radians(la)) AS pz FROM (SELECT p_partkey, CAST(p_partkey * 7 % 360 AS DOUBLE) + 0.5 AS lo, CAST(p_partkey * 3 % 160 AS DOUBLE) - 79.7 AS la FROM part)),
q AS (SELECT *, 1 - px AS dx, 2 - py AS dy, -3 - pz AS dz FROM ray),
t AS (SELECT *, dx * dx / 676 + dy * dy / 625 + dz * dz / 576 AS qa, 2 * (px * dx / 676 + py * dy / 625 + pz * dz / 576) AS qb, px * px / 676 + py * py / 625 + pz * pz / 576 - 1 AS qc FROM q),
h AS (SELECT p_partkey, px + k * dx AS x, py + k * dy AS y, pz + k * dz AS z FROM (SELECT *, (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS k FROM t)),
ll AS (SELECT p_partkey, degrees(asin(z / sqrt(x * x + y * y + z * z))) AS lat, (degrees(atan2(y, x)) + 360) % 360 AS lon FROM h),
s AS (SELECT p_partkey, k, greatest(-90, least(90, lat + u)) AS lat, (lon + v + 360) % 360 AS lon FROM ll, (VALUES (0, 0, 0), (1, 4.5, 0), (2, -4.5, 0), (3, 0, 4.5), (4, 0, -4.5)) o(k, u, v)),
c AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS cx, cos(radians(lat)) * sin(radians(lon)) AS cy, sin(radians(lat)) AS cz FROM s),
w AS (SELECT c.*, coalesce(g.r, 1 / sqrt(cx * cx / 676 + cy * cy / 625 + cz * cz / 576)) AS r FROM c LEFT JOIN g ON g.row = least(39, CAST(floor((90 - lat) / 4.5) AS INT)) AND g.col = CAST(floor(lon / 7.2) AS INT)),
p AS (SELECT p_partkey, {", ".join(f"max(CASE WHEN k = {k} THEN {v} END) AS {n}{k}" for k in range(5) for n, v in (("x", "r * cx"), ("y", "r * cy"), ("z", "r * cz"), ("lat", "lat"), ("lon", "lon"), ("r", "r")))} FROM w GROUP BY p_partkey),
d AS (SELECT *, x3 - x4 AS ex, y3 - y4 AS ey, z3 - z4 AS ez, x1 - x2 AS nx, y1 - y2 AS ny, z1 - z2 AS nz FROM p),
n AS (SELECT *, ey * nz - ez * ny AS a, ez * nx - ex * nz AS b, ex * ny - ey * nx AS c FROM d)
SELECT p_partkey, round(lat0, 6) AS lat, round(lon0, 6) AS lon, round(r0, 6) AS radius, round(sign(a * x0 + b * y0 + c * z0) * (a * x0 + b * y0 + c * z0) / sqrt(a * a + b * b + c * c) / r0, 6) AS upright, round(sign(a * x0 + b * y0 + c * z0) * c / sqrt(a * a + b * b + c * c), 6) AS nz FROM n
"""


@query("shape_surface", _SURFACE_SQL)
def shape_surface(spark, sf):
    """Looks from 100 km at a rough globe: where they meet it, and its slope there."""
    lo, la = (F.col("p_partkey") * 7 % 360).cast("double") + 0.5, (F.col("p_partkey") * 3 % 160).cast("double") - 79.7
    p = table(spark, sf, "part").select("p_partkey", shape.on_sphere(la, lo, F.lit(100.0)).alias("p"))
    rays = p.select("p_partkey", "p", V.sub(V.vec(1.0, 2.0, -3.0), F.col("p")).alias("d"))
    dem = cells_from_lineitem(spark, sf).select("row", "col", (25 + F.col("z") / 50).alias("radius"))
    out = shape.surface(rays, dem, GLOBE, AXES, key="p_partkey")
    up = V.dot(F.col("normal"), shape.on_sphere(F.col("lat"), F.col("lon"), F.lit(1.0)))
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("lat", "lon", "radius")], F.round(up, 6).alias("upright"), F.round(F.element_at("normal", 3), 6).alias("nz"))


GEOMETRY = rings.Geometry((100.0, 2.0, 0.5, 0.01), (10.0, 0.1, -0.8, 0.002), 40, 50)
RING_MAP = Region(60, 40, 211.3, -22.1, 2.0, 0.9)


def _ring_sql() -> str:
    (a0, a1, a2, a3), (b0, b1, b2, b3) = GEOMETRY.radius, GEOMETRY.lon
    det = a1 * b2 - a2 * b1
    x = f"SELECT row, col, rr, ll, ({b2} * (rr - {a0}) - {a2} * (ll - {b0})) / {det!r} AS s, ({a1} * (ll - {b0}) - {b1} * (rr - {a0})) / {det!r} AS l FROM (SELECT r.range::INT AS row, c.range::INT AS col, 211.3 - (r.range + 0.5) * 2.0 AS rr, -22.1 + (c.range + 0.5) * 0.9 AS ll FROM range(60) r, range(40) c)"
    for _ in range(rings.STEPS):
        x = f"SELECT row, col, rr, ll, s - (q22 * f - q12 * h) / (q11 * q22 - q12 * q21) AS s, l - (q11 * h - q21 * f) / (q11 * q22 - q12 * q21) AS l FROM (SELECT *, {a0} + {a1} * s + {a2} * l + {a3} * s * l - rr AS f, {b0} + {b1} * s + {b2} * l + {b3} * s * l - ll AS h, {a1} + {a3} * l AS q11, {a2} + {a3} * s AS q12, {b1} + {b3} * l AS q21, {b2} + {b3} * s AS q22 FROM ({x}))"
    four = f"SELECT row, col, least(39, greatest(0, floor(l) + dl))::INT AS pl, least(49, greatest(0, floor(s) + ds))::INT AS ps, abs(1 - ds - (s - floor(s))) * abs(1 - dl - (l - floor(l))) AS w FROM x, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dl, ds) WHERE s BETWEEN -0.5 AND 49.5 AND l BETWEEN -0.5 AND 39.5"
    return f"WITH x AS MATERIALIZED ({x}), v AS (SELECT q.row, q.col, sum(q.w * z) / nullif(sum(q.w), 0) AS z FROM ({four}) q JOIN ({CELLS_SQL}) g ON g.row = pl AND g.col = ps GROUP BY 1, 2) SELECT x.row, x.col, round(v.z, 6) AS z FROM x LEFT JOIN v ON v.row = x.row AND v.col = x.col"


@query("rings_from_camera", _ring_sql())
def rings_from_camera(spark, sf):
    """A camera's image of a ring, resampled to longitude and radius."""
    image = cells_from_lineitem(spark, sf).select("row", "col", "z")
    return rings.to_ring_map(spark, image, GEOMETRY, RING_MAP).select("row", "col", F.round("z", 6).alias("z"))


@query("rings_project", f"SELECT row, col, CASE WHEN radius > 0 THEN z END AS z, CASE WHEN radius > 0 THEN round(-20 * (radians(lon) - radians(12.0)), 6) END AS u, CASE WHEN radius > 0 THEN CAST(20 - radius AS DOUBLE) END AS v FROM (SELECT *, 30 - (row + 0.5) AS radius, 5 + (col + 0.5) AS lon FROM ({CELLS_SQL}))")
def rings_project(spark, sf):
    out = rings.project(cells_from_lineitem(spark, sf), Region(40, 50, 30.0, 5.0), 20.0, 12.0, clockwise=True)
    return out.select("row", "col", "z", F.round("u", 6).alias("u"), "v")


MAP = Region(40, 50, 38.1, 8.3, 1.5, 1.5)
SUN, EYE = (0.8, 0.5, 0.2), (90.0, 55.0, 20.0)
CAMERA = cameras.Camera(EYE, cameras.looking_at(EYE), 60.0, 0.4, 40, 50, k1=2e-4)
#: x, y, z of the map's cells on the ellipsoid, and its normal times the squared axes' product left out.
_POINTS = f"SELECT row, col, z AS value, lat, lon, r, r * cx AS x, r * cy AS y, r * cz AS z, r * cx / 676 AS nx, r * cy / 625 AS ny, r * cz / 576 AS nz FROM (SELECT *, 1 / sqrt(cx * cx / 676 + cy * cy / 625 + cz * cz / 576) AS r FROM (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS cx, cos(radians(lat)) * sin(radians(lon)) AS cy, sin(radians(lat)) AS cz FROM (SELECT *, 38.1::DOUBLE - (row + 0.5::DOUBLE) * 1.5 AS lat, 8.3::DOUBLE + (col + 0.5::DOUBLE) * 1.5 AS lon FROM (CELLS))))"


@query("camera_planes_map", f"SELECT row, col, round(lat, 6) AS lat, round(lon, 6) AS lon, round(r, 6) AS radius, round(degrees(acos((nx * 0.8 + ny * 0.5 + nz * 0.2) / n / sqrt(0.93))), 6) AS incidence, round(degrees(acos((nx * ex + ny * ey + nz * ez) / n / e)), 6) AS emission, round(degrees(acos((ex * 0.8 + ey * 0.5 + ez * 0.2) / e / sqrt(0.93))), 6) AS phase, round(e * 0.001, 6) AS resolution FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n, sqrt(ex * ex + ey * ey + ez * ez) AS e FROM (SELECT *, 90 - x AS ex, 55 - y AS ey, 20 - z AS ez FROM ({_POINTS.replace('CELLS', CELLS_SQL)})))")
def camera_planes_map(spark, sf):
    """Latitude, longitude, radius, angles and resolution of a map's cells under one sun and one eye."""
    out = cameras.map_planes(cells_from_lineitem(spark, sf).select("row", "col"), MAP, SUN, EYE, AXES, 0.001)
    return out.select("row", "col", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def _camera_sql() -> str:
    r = CAMERA.rotation
    u = [f"({r[k]!r} * (x - 90) + {r[3 + k]!r} * (y - 55) + {r[6 + k]!r} * (z - 20))" for k in range(3)]
    grid = _POINTS.replace("CELLS", "SELECT r.range::INT AS row, c.range::INT AS col, 0.0 AS z FROM range(40) r, range(50) c")
    x = f"SELECT row, col, ux, uy, ux AS dx, uy AS dy FROM (SELECT row, col, 60.0 * {u[0]} / {u[2]} AS ux, 60.0 * {u[1]} / {u[2]} AS uy FROM ({grid}) WHERE {u[2]} > 0 AND nx * (90 - x) + ny * (55 - y) + nz * (20 - z) > 0)"
    for _ in range(cameras.STEPS):
        x = f"SELECT row, col, ux, uy, ux / (1 + 2e-4 * (dx * dx + dy * dy)) AS dx, uy / (1 + 2e-4 * (dx * dx + dy * dy)) AS dy FROM ({x})"
    x = f"SELECT row, col, 24.5 + dx / 0.4 AS s, 19.5 + dy / 0.4 AS l FROM ({x})"
    four = f"SELECT row, col, least(39, greatest(0, floor(l) + dl))::INT AS pl, least(49, greatest(0, floor(s) + ds))::INT AS ps, abs(1 - ds - (s - floor(s))) * abs(1 - dl - (l - floor(l))) AS w FROM ({x}), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dl, ds) WHERE s BETWEEN -0.5 AND 49.5 AND l BETWEEN -0.5 AND 39.5"
    return f"WITH v AS (SELECT q.row, q.col, sum(q.w * z) / nullif(sum(q.w), 0) AS z FROM ({four}) q JOIN ({CELLS_SQL}) g ON g.row = pl AND g.col = ps GROUP BY 1, 2) SELECT r.range::INT AS row, c.range::INT AS col, round(v.z, 6) AS z FROM range(40) r CROSS JOIN range(50) c LEFT JOIN v ON v.row = r.range AND v.col = c.range"


@query("camera_to_map", _camera_sql())
def camera_to_map(spark, sf):
    """A distorted frame image brought to latitude and longitude."""
    image = cells_from_lineitem(spark, sf).select("row", "col", "z")
    return cameras.to_map(spark, image, CAMERA, MAP, AXES).select("row", "col", F.round("z", 6).alias("z"))


@query("projection_libration", "SELECT c_custkey, round(1737.4 * sin(e / (1 + radians(8) / (pi() / 2))) * sin(lon) * cos(lat) / sin(e), 6) AS x, round(1737.4 * sin(e / (1 + radians(8) / (pi() / 2))) * sin(lat) / sin(e), 6) AS y, round(degrees(lon), 6) AS lon, round(degrees(lat), 6) AS lat FROM (SELECT *, acos(cos(lat) * cos(lon)) AS e FROM (SELECT c_custkey, radians(c_custkey % 190 - 95.3) AS lon, radians(c_custkey % 140 - 70.2) AS lat FROM customer))")
def projection_libration(spark, sf):
    """Positions on the widened near side, and back."""
    c = table(spark, sf, "customer").select("c_custkey", F.radians(F.col("c_custkey") % 190 - 95.3).alias("lon"), F.radians(F.col("c_custkey") % 140 - 70.2).alias("lat"))
    p = c.select("c_custkey", V.libration_equal_area(F.col("lon"), F.col("lat"), 1737.4, 8 * 3.141592653589793 / 180).alias("p"))
    back = p.select("c_custkey", "p", V.libration_equal_area_inverse(F.col("p.x"), F.col("p.y"), 1737.4, 8 * 3.141592653589793 / 180).alias("g"))
    return back.select("c_custkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.round(F.degrees("g.lon"), 6).alias("lon"), F.round(F.degrees("g.lat"), 6).alias("lat"))


_VEC = "(SELECT p_partkey, p_size + 0.0::DOUBLE AS x, p_retailprice / 100 AS y, CAST(p_partkey % 17 AS DOUBLE) - 8.0 AS z FROM part)"


def _vec(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.vec(F.col("p_size") + 0.0, F.col("p_retailprice") / 100, (F.col("p_partkey") % 17).cast("double") - 8.0).alias("v"))


@query("vector_planes", f"SELECT p_partkey, round(abs(x + 2 * y + 2 * z - 6) / 3, 6) AS off, round(x - (x + 2 * y + 2 * z - 6) / 9, 6) AS foot, round(sqrt(x * x + y * y), 6) AS from_axis, CASE WHEN x + 2 * y + 2 * z > 6 THEN round(x * 6 / (x + 2 * y + 2 * z), 6) END AS hit FROM {_VEC}")
def vector_planes(spark, sf):
    """Distance and foot on the plane x + 2 y + 2 z = 6, distance from the z axis, and the plane's hit on the way to the origin."""
    v = F.col("v")
    pl = V.plane(V.vec(1.0, 2.0, 2.0), 6.0)
    out = _vec(spark, sf).select("p_partkey", "v", V.on_plane(v, pl).alias("foot"), V.near_line(V.vec(0.0, 0.0, 5.0), V.vec(0.0, 0.0, 2.0), v)["distance"].alias("line"))
    above = V.dot(v, V.vec(1.0, 2.0, 2.0)) > 6
    hit = shape.plane_hit(v, V.scale(-1.0, v), V.vec(1.0, 2.0, 2.0), 6.0)
    return out.select("p_partkey", F.round(V.distance(v, F.col("foot")), 6).alias("off"), F.round(F.element_at("foot", 1), 6).alias("foot"), F.round("line", 6).alias("from_axis"), F.when(above, F.round(F.element_at(hit, 1), 6)).alias("hit"))


@query("coordinates_jacobian", f"SELECT p_partkey, round(x / r, 6) AS radius_x, round(-y / (h * h), 6) AS lon_x, round(x / (h * h), 6) AS lon_y, round(-x * z / (r * r * h), 6) AS lat_x, round(h / (r * r), 6) AS lat_z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r, sqrt(x * x + y * y) AS h FROM {_VEC})")
def coordinates_jacobian(spark, sf):
    """Derivatives of radius, longitude and latitude by rectangular coordinates."""
    at = _vec(spark, sf).select("p_partkey", V.rec_to_lat(F.col("v")).alias("c"))
    j = at.select("p_partkey", V.jacobian_lat(F.col("c.radius"), F.col("c.lon"), F.col("c.lat")).alias("j")).select("p_partkey", V.jacobian_from_rec(F.col("j")).alias("j"))
    return j.select("p_partkey", *[F.round(F.element_at("j", k), 6).alias(n) for k, n in ((1, "radius_x"), (4, "lon_x"), (5, "lon_y"), (7, "lat_x"), (9, "lat_z"))])


@query("atmosphere_windows", "SELECT p_partkey, round(CASE WHEN r <> 0 THEN b1 * (SELECT median(p_retailprice / p_size) FROM part) / r END, 6) AS b1_cor, CAST(NULL AS DOUBLE) AS b2_cor, CAST(NULL AS DOUBLE) AS b3_cor FROM (SELECT p_partkey, p_retailprice AS b1, p_retailprice / p_size AS r FROM part)")
def atmosphere_windows(spark, sf):
    """Of three bands one lies in a window whose reference is there, one in none, and one in a window without its reference."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("b1"), F.col("p_size").cast("double").alias("b2"), F.col("p_partkey").cast("double").alias("b3"))
    out = S.thick_windows(p, {"b1": 1.02, "b2": 1.27, "b3": 1.74}, [(1.01, 1.28), (1.74, 2.3)], 0.03)
    return out.select("p_partkey", *[F.round(f"{b}_cor", 6).alias(f"{b}_cor") for b in ("b1", "b2", "b3")])


@query("ek_fetch_entries", "SELECT CAST(n AS BIGINT) AS row, CAST(k AS INT) AS element, embedding[k + 1] AS value FROM (SELECT *, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS n FROM embeddings), range(64) t(k)")
def ek_fetch_entries(spark, sf):
    """Every entry of an array column, by row of the answer and by element."""
    found = ek_sql(spark, "SELECT LABEL, VEC_ID, EMBEDDING FROM E ORDER BY LABEL DESC, VEC_ID", {"E": table(spark, sf, "embeddings")})
    return ek_elements(ek_rows(found), "EMBEDDING")
