"""Cell algebra, aggregation, connectivity and crater queries over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..catalogue import query, table
from ..operators import cells as C, connectivity, craters
from .grid import CELLS_SQL, align, cells_from_lineitem

PAIR = "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b FROM lineitem"


def _pairs(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))


def _change(method, sql):
    def run(spark, sf):
        return C.detect_change(_pairs(spark, sf), method=method).select("l_orderkey", "l_linenumber", "l_partkey", F.round("change", 6).alias("change"))

    query(f"change_{method}", f"SELECT l_orderkey, l_linenumber, l_partkey, round({sql}, 6) AS change FROM ({PAIR})")(run)


_change("difference", "b - a")
_change("ratio", "CASE WHEN a <> 0 THEN b / a END")
_change("ndiff", "CASE WHEN a + b <> 0 THEN (b - a) / (b + a) END")
_change("log_ratio", "CASE WHEN a > 0 AND b > 0 THEN ln(b) - ln(a) END")


@query("change_mask", f"SELECT mask, count(*) AS n FROM (SELECT CASE WHEN b - a IS NULL THEN NULL WHEN abs(b - a) >= 1000 AND coalesce(abs(b - a) / abs(nullif(a, 0)) >= 0.05, false) THEN 1 ELSE 0 END AS mask FROM ({PAIR})) GROUP BY mask")
def change_mask(spark, sf):
    return C.detect_change(_pairs(spark, sf), threshold=1000.0, relative=0.05).groupBy("mask").agg(F.count("*").alias("n"))


@query("change_demean", f"SELECT round(sum(abs(c - m)) / count(*), 6) AS spread, count(*) AS n FROM (SELECT b - a AS c, avg(b - a) OVER () AS m FROM ({PAIR}))")
def change_demean(spark, sf):
    return C.detect_change(_pairs(spark, sf), demean=True).agg(F.round(F.sum(F.abs("change")) / F.count("*"), 6).alias("spread"), F.count("*").alias("n"))


@query("change_join", "SELECT a.row, a.col, round(b.v - a.v, 6) AS change FROM (SELECT CAST(l_suppkey AS INT) AS row, l_linenumber AS col, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) a JOIN (SELECT CAST(l_suppkey AS INT) AS row, l_linenumber AS col, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.row = b.row AND a.col = b.col")
def change_join(spark, sf):
    li = table(spark, sf, "lineitem")
    of = lambda flag, name: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").cast("int").alias("row"), F.col("l_linenumber").alias("col")).agg(F.max("l_quantity").alias(name))
    return align(of("N", "a"), of("R", "b")).select("row", "col", F.round(C.change(F.col("a"), F.col("b")), 6).alias("change"))


@query("specpix_counts", "SELECT CASE WHEN dn IS NULL THEN 1 WHEN dn = 0 THEN 1 WHEN dn = 1 THEN 2 WHEN dn = 2 THEN 3 WHEN dn = 65534 THEN 4 WHEN dn = 65535 THEN 5 ELSE 0 END AS class, count(*) AS n FROM (SELECT CASE WHEN l_quantity = 50 THEN 65535 WHEN l_quantity = 49 THEN 65534 WHEN l_quantity = 48 THEN NULL ELSE l_quantity - 1 END AS dn FROM lineitem) GROUP BY 1")
def specpix_counts(spark, sf):
    dn = F.when(F.col("l_quantity") == 50, 65535).when(F.col("l_quantity") == 49, 65534).when(F.col("l_quantity") == 48, None).otherwise(F.col("l_quantity") - 1)
    return table(spark, sf, "lineitem").select(C.special_pixel(dn).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


ANGLES = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 1.7 AS i, l_discount * 800 AS e, l_tax * 1000 AS g, l_extendedprice AS v FROM lineitem"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _angles(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS, (F.col("l_quantity") * 1.7).alias("i"), (F.col("l_discount") * 800).alias("e"), (F.col("l_tax") * 1000).alias("g"), F.col("l_extendedprice").alias("v"))


@query("photom_trim", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN i BETWEEN 0 AND 60 AND e BETWEEN 0 AND 70 AND g <= 50 THEN v END AS v FROM ({ANGLES})")
def photom_trim(spark, sf):
    return _angles(spark, sf).select(*KEYS, C.photometric_trim(F.col("v"), F.col("i"), F.col("e"), F.col("g"), (0.0, 60.0), (0.0, 70.0), 50.0).alias("v"))


M0, M = "cos(radians(i))", "cos(radians(e))"


def _model(name, f, sql):
    query(f"photom_{name}", f"SELECT l_orderkey, l_linenumber, l_partkey, round({sql}, 6) AS f FROM ({ANGLES})")(lambda spark, sf: _angles(spark, sf).select(*KEYS, F.round(f(F.col("i"), F.col("e"), F.col("g")), 6).alias("f")))


_lit = lambda x: f"CASE WHEN i >= 90 OR e >= 90 OR {M0} <= 0 OR {M} <= 0 THEN 0.0 ELSE {x} END"
_model("lambert", lambda i, e, g: C.lambert(i), f"greatest({M0}, 0.0)")
_model("lommel", lambda i, e, g: C.lommel_seeliger(i, e), _lit(f"2 * {M0} / ({M0} + {M})"))
_model("lunar_lambert", lambda i, e, g: C.lunar_lambert(i, e, 0.6), _lit(f"{M0} * (0.4 + 1.2 / ({M0} + {M}))"))
_model("minnaert", lambda i, e, g: C.minnaert(i, e, 0.7), _lit(f"{M0} * power({M0} * {M}, -0.3)"))
_X = "(1 - 0.019 * {g} + 0.000242 * {g} * {g} - 0.00000146 * {g} * {g} * {g})"
_R = "(2 * {x} * {a} / ({a} + {b}) + (1 - {x}) * {a})"
_model(
    "mcewen",
    lambda i, e, g: C.lunar_lambert_mcewen(i, e, g, -0.019, 0.000242, -0.00000146),
    _lit(f"{_R.format(x=_X.format(g=30.0), a=math.cos(math.radians(30)), b=1.0)} / {_R.format(x=_X.format(g='g'), a=M0, b=M)}"),
)
_G = "sqrt(1 - 0.3)"
_H = lambda x: f"((1 + 2 * {x}) / (1 + 2 * {x} * {_G}))"
_PH = "((1 - 0.4) * (1 - 0.04) / power(1 + 0.04 + 0.4 * cos(radians(g)), 1.5) + 0.4 * (1 - 0.04) / power(greatest(1 + 0.04 - 0.4 * cos(radians(g)), 1e-10), 1.5))"
_model(
    "hapke_smooth",
    lambda i, e, g: C.hapke(i, e, g, 0.3, 0.05, 1.0, 0.2, 0.4),
    f"CASE WHEN {M0} <= 0 THEN 0.0 ELSE 0.3 / 4 * {M0} / ({M0} + {M}) * ((1 + 1.0 / (1 + tan(radians(g) / 2) / 0.05)) * {_PH} - 1 + {_H(M0)} * {_H(M)}) END",
)


def _rough_hapke_sql(angles, theta, w, h, b0, b, c):
    """Bidirectional reflectance of a rough surface, from the published relations (1984), for angles i, e, g."""
    t = math.tan(math.radians(theta))
    chi = 1 / math.sqrt(1 + math.pi * t * t)
    e1, e2 = (lambda x: f"exp(least(-power(1 / ({t} * tan(greatest({x}, 1e-12))), 2) / pi(), 23.0))"), (lambda x: f"exp(least(-2 / (pi() * {t} * tan(greatest({x}, 1e-12))), 23.0))")
    half = "power(sin(psi / 2), 2)"
    base = f"SELECT *, {e1('i')} AS e1i, {e2('i')} AS e2i, {e1('e')} AS e1e, {e2('e')} AS e2e, CASE WHEN sin(i) * sin(e) = 0 THEN 0.0 ELSE acos(greatest(-1.0, least(1.0, (cos(g) - cos(i) * cos(e)) / (sin(i) * sin(e))))) END AS psi FROM (SELECT *, radians(i0) AS i, radians(e0) AS e, radians(g0) AS g FROM {angles})"
    eta = lambda x, f1, f2: f"{chi} * (cos({x}) + sin({x}) * {t} * {f1} / (2 - {f2}))"
    high, low = "2 - {0} - (psi / pi()) * {1}", "({0} * {1} {2} {3} * {4})"
    mu = lambda x, y: f"{chi} * (cos({x}) + sin({x}) * {t} * {low.format('cos(psi)', f'e1{y}', '+', half, f'e1{x}')} / ({high.format(f'e2{y}', f'e2{x}')}))"  # noqa: E731  the shallower of the two
    nu = lambda x, y: f"{chi} * (cos({x}) + sin({x}) * {t} * {low.format('1', f'e1{x}', '-', half, f'e1{y}')} / ({high.format(f'e2{x}', f'e2{y}')}))"  # noqa: E731  the steeper
    step = f"SELECT *, {eta('i', 'e1i', 'e2i')} AS ni, {eta('e', 'e1e', 'e2e')} AS ne, CASE WHEN i <= e THEN {mu('i', 'e')} ELSE {nu('i', 'e')} END AS m0, CASE WHEN i <= e THEN {nu('e', 'i')} ELSE {mu('e', 'i')} END AS m, CASE WHEN psi >= pi() THEN 0.0 ELSE exp(-2 * tan(psi / 2)) END AS f FROM ({base})"
    hh = lambda x: f"(1 + 2 * {x}) / (1 + 2 * {x} * {math.sqrt(1 - w)})"
    phase = f"(1 + {b} * cos(g) + {c} * (1.5 * cos(g) * cos(g) - 0.5))"
    return f"SELECT *, {w} / 4 * m0 / (m0 + m) * ((1 + {b0} / (1 + tan(g / 2) / {h})) * {phase} - 1 + ({hh('m0')}) * ({hh('m')})) * (m / ne) * (cos(i) / ni) * {chi} / (1 - f + f * {chi} * CASE WHEN i <= e THEN cos(i) / ni ELSE cos(e) / ne END) AS r FROM ({step})"


_ANGLES0 = f"(SELECT *, CAST(i AS DOUBLE) AS i0, CAST(e AS DOUBLE) AS e0, CAST(g AS DOUBLE) AS g0 FROM ({ANGLES}))".replace("SELECT *, CAST(i", "SELECT * EXCLUDE (i, e, g), CAST(i")


@query("photom_hapke_rough", f"SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN cos(i) <= 0 THEN 0.0 ELSE r END, 6) AS f FROM ({_rough_hapke_sql(_ANGLES0, 20.0, 0.3, 0.05, 1.0, 0.3, 0.1)})")
def photom_hapke_rough(spark, sf):
    """Held against a numpy version in the tests."""
    return C.hapke_rough(_angles(spark, sf), "i", "e", "g", "f", 0.3, 0.05, 1.0, 20.0, bh=0.3, ch=0.1).select(*KEYS, F.round("f", 6).alias("f"))


@query("albedo_correct", f"SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN greatest({M0}, 0.0) <> 0 THEN v * cos(radians(30)) / greatest({M0}, 0.0) END, 4) AS v FROM ({ANGLES})")
def albedo_correct(spark, sf):
    return _angles(spark, sf).select(*KEYS, F.round(C.photometric_correct(F.col("v"), math.cos(math.radians(30)), C.lambert(F.col("i"))), 4).alias("v"))


GRID = f"({CELLS_SQL})"


@query("dem_prepare_mean", f"SELECT row, col, CASE WHEN z >= 20 AND z <= 30 THEN round(z, 6) END AS z FROM (SELECT row, col, coalesce(y, avg(y) OVER ()) AS z FROM (SELECT row, col, CASE WHEN row % 7 <> 0 THEN z END AS y FROM {GRID}))")
def dem_prepare_mean(spark, sf):
    holes = cells_from_lineitem(spark, sf).select("row", "col", F.when(F.col("row") % 7 != 0, F.col("z")).alias("z"))
    return C.prepare_dem(holes, fill="mean", low=20.0, high=30.0).select("row", "col", F.round("z", 6).alias("z"))


@query("dem_ellipsoid", f"SELECT row, col, round(z - 3396190.0 * 3376200.0 / sqrt(power(3376200.0 * cos(radians(row * 2.0)), 2) + power(3396190.0 * sin(radians(row * 2.0)), 2)), 3) AS z FROM {GRID}")
def dem_ellipsoid(spark, sf):
    g = cells_from_lineitem(spark, sf).withColumn("lat", F.col("row") * 2.0)
    return C.prepare_dem(g, a=3396190.0, c=3376200.0, heights=True).select("row", "col", F.round("z", 3).alias("z"))


@query("desmear", f"SELECT row, col, round(z - 0.5 / 2.0 * avg(z) OVER () * row / 40, 6) AS z FROM {GRID}")
def desmear(spark, sf):
    return C.desmear(cells_from_lineitem(spark, sf), 0.5, 2.0, 40).select("row", "col", F.round("z", 6).alias("z"))


@query("destripe_sub", f"SELECT row, col, round(z - avg(z) OVER (PARTITION BY col) + avg(z) OVER (), 6) AS z FROM {GRID}")
def destripe_sub(spark, sf):
    return C.destripe(cells_from_lineitem(spark, sf)).select("row", "col", F.round("z", 6).alias("z"))


@query("destripe_div", f"SELECT row, col, round(z * avg(z) OVER () / avg(z) OVER (PARTITION BY col), 6) AS z FROM {GRID}")
def destripe_div(spark, sf):
    return C.destripe(cells_from_lineitem(spark, sf), method="div").select("row", "col", F.round("z", 6).alias("z"))


@query("destripe_events", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id % 16) + avg(value) OVER (), 6) AS value FROM events")
def destripe_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", (F.col("user_id") % 16).alias("stripe"), "value")
    return C.destripe(ev, by="stripe", z="value").select("event_id", F.round("value", 6).alias("value"))


@query("cubenorm_mean", f"SELECT row, col, round(z / avg(z) OVER (PARTITION BY col), 6) AS z FROM {GRID}")
def cubenorm_mean(spark, sf):
    return C.cube_normalise(cells_from_lineitem(spark, sf)).select("row", "col", F.round("z", 6).alias("z"))


@query("cubenorm_median", f"SELECT row, col, round(z / median(z) OVER (PARTITION BY col), 6) AS z FROM {GRID}")
def cubenorm_median(spark, sf):
    return C.cube_normalise(cells_from_lineitem(spark, sf), statistic="median").select("row", "col", F.round("z", 6).alias("z"))


LONG = f"(SELECT row, col, 1 AS band, z AS value FROM {GRID} UNION ALL SELECT row, col, 2, w FROM {GRID})"


def _long(spark, sf):
    g = cells_from_lineitem(spark, sf)
    return g.select("row", "col", F.explode(F.array(F.struct(F.lit(1).alias("band"), F.col("z").alias("value")), F.struct(F.lit(2).alias("band"), F.col("w").alias("value")))).alias("b")).select("row", "col", "b.band", "b.value")


@query("bandnorm_own", f"SELECT row, col, band, round(value / avg(value) OVER (PARTITION BY band), 6) AS value FROM {LONG}")
def bandnorm_own(spark, sf):
    return C.band_normalise(_long(spark, sf)).withColumn("value", F.round("value", 6))


@query("bandnorm_reference", f"SELECT row, col, band, round(value / (SELECT avg(value) FROM {LONG} WHERE band = 2), 6) AS value FROM {LONG}")
def bandnorm_reference(spark, sf):
    return C.band_normalise(_long(spark, sf), reference=2).withColumn("value", F.round("value", 6))


@query("radial_profile", f"SELECT row, round(avg(z), 6) AS mean, count(z) AS n FROM {GRID} GROUP BY row")
def radial_profile(spark, sf):
    return C.profile(cells_from_lineitem(spark, sf), "row").withColumn("mean", F.round("mean", 6))


@query("azimuth_profile", f"SELECT col, round(avg(z), 6) AS mean, count(z) AS n FROM {GRID} GROUP BY col")
def azimuth_profile(spark, sf):
    return C.profile(cells_from_lineitem(spark, sf), "col").withColumn("mean", F.round("mean", 6))


@query("mosaic_first_wins", "SELECT row, col, arg_min(z, tile) AS z FROM (SELECT CAST(l_suppkey % 40 AS INT) AS row, CAST(l_partkey % 50 AS INT) AS col, l_linenumber AS tile, max(l_quantity) AS z FROM lineitem GROUP BY 1, 2, 3) GROUP BY row, col")
def mosaic_first_wins(spark, sf):
    tiles = table(spark, sf, "lineitem").groupBy(F.expr("cast(l_suppkey % 40 as int)").alias("row"), F.expr("cast(l_partkey % 50 as int)").alias("col"), F.col("l_linenumber").alias("tile")).agg(F.max("l_quantity").alias("z"))
    return C.first_wins(tiles)


@query("zonal_stats", "SELECT c_nationkey, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY c_nationkey")
def zonal_stats(spark, sf):
    return C.zonal(table(spark, sf, "customer"), "c_nationkey", "c_acctbal").withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("zone_counts", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment HAVING count(*) >= 10")
def zone_counts(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.count("*").alias("n")).where("n >= 10")


@query("percentile_threshold", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.9) FROM customer)")
def percentile_threshold(spark, sf):
    c = table(spark, sf, "customer")
    return c.crossJoin(F.broadcast(c.agg(F.percentile("c_acctbal", F.lit(0.9)).alias("p")))).where("c_acctbal >= p").select("c_custkey", "c_acctbal")


@query("series_stack", f"SELECT row, col, round(avg(z), 6) AS average, round(stddev_pop(z), 6) AS stddev, round(sum(z), 6) AS sum, max(z) AS maximum FROM (SELECT CAST(l_suppkey % 40 AS INT) AS row, CAST(l_partkey % 50 AS INT) AS col, l_linenumber AS step, max(l_quantity) AS z FROM lineitem GROUP BY 1, 2, 3) GROUP BY row, col")
def series_stack(spark, sf):
    steps = table(spark, sf, "lineitem").groupBy(F.expr("cast(l_suppkey % 40 as int)").alias("row"), F.expr("cast(l_partkey % 50 as int)").alias("col"), F.col("l_linenumber").alias("step")).agg(F.max("l_quantity").alias("z"))
    out = C.series(steps)
    return out.select("row", "col", *[F.round(c, 6).alias(c) for c in ("average", "stddev", "sum")], "maximum")


@query("resample_block_mean", f"SELECT CAST(row // 5 AS INT) AS row, CAST(col // 5 AS INT) AS col, round(avg(z), 6) AS z FROM {GRID} GROUP BY 1, 2")
def resample_block_mean(spark, sf):
    return C.coarsen(cells_from_lineitem(spark, sf), 5).withColumn("z", F.round("z", 6))


@query("mask_union", f"SELECT row, col, CASE WHEN z > 26 OR w > 2.6 THEN 1 ELSE 0 END AS mask FROM {GRID}")
def mask_union(spark, sf):
    return cells_from_lineitem(spark, sf).select("row", "col", C.mask_union((F.col("z") > 26).cast("int"), (F.col("w") > 2.6).cast("int")).alias("mask"))


@query("top_n_suppliers", "SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)::INT AS rank FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def top_n_suppliers(spark, sf):
    return C.top_n(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), 20, F.desc("s_acctbal"), F.asc("s_suppkey"))


# --- connectivity ---------------------------------------------------------------------------------

MASK = f"(SELECT row, col, CASE WHEN z > 25.5 THEN 1 ELSE 0 END AS z FROM {GRID})"


def _mask(spark, sf):
    return cells_from_lineitem(spark, sf).select("row", "col", F.when(F.col("z") > 25.5, 1).otherwise(0).alias("z"))


@query("clump_runs", f"SELECT row, min(col) AS first, max(col) AS last, z FROM (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY col) AS k FROM (SELECT *, CASE WHEN lag(z) OVER w IS DISTINCT FROM z OR lag(col) OVER w IS DISTINCT FROM col - 1 THEN 1 ELSE 0 END AS new FROM {MASK} WINDOW w AS (PARTITION BY row ORDER BY col))) GROUP BY row, k, z")
def clump_runs(spark, sf):
    return connectivity.runs(_mask(spark, sf))


@query("clump_2d", f"""
WITH RECURSIVE g AS MATERIALIZED (SELECT row, col, z, CAST(row AS BIGINT) * 4294967296 + col AS id FROM {MASK}),
runs AS MATERIALIZED (SELECT row, min(col) AS f, max(col) AS l, z, CAST(row AS BIGINT) * 4294967296 + min(col) AS id FROM (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY col) AS k FROM (SELECT *, CASE WHEN lag(z) OVER w IS DISTINCT FROM z THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY row ORDER BY col))) GROUP BY row, k, z),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.z = b.z AND abs(a.row - b.row) = 1 AND a.f <= b.l AND b.f <= a.l),
reach(id, c) AS (SELECT id, id FROM runs UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id WHERE reach.c < e.b),
comp AS (SELECT id, min(c) AS clump FROM reach GROUP BY id)
SELECT g.row, g.col, g.z, comp.clump FROM g JOIN runs r ON g.row = r.row AND g.col BETWEEN r.f AND r.l JOIN comp ON comp.id = r.id""")
def clump_2d(spark, sf):
    return connectivity.clump(_mask(spark, sf))


@query("clump_min_area", f"""
WITH RECURSIVE g AS MATERIALIZED (SELECT row, col, CAST(row AS BIGINT) * 4294967296 + col AS id FROM {MASK} WHERE z = 1),
runs AS MATERIALIZED (SELECT row, min(col) AS f, max(col) AS l, CAST(row AS BIGINT) * 4294967296 + min(col) AS id FROM (SELECT *, col - row_number() OVER (PARTITION BY row ORDER BY col) AS k FROM g) GROUP BY row, k),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON abs(a.row - b.row) = 1 AND a.f <= b.l + 1 AND b.f <= a.l + 1),
reach(id, c) AS (SELECT id, id FROM runs UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id WHERE reach.c < e.b),
comp AS (SELECT id, min(c) AS clump FROM reach GROUP BY id)
SELECT clump, CAST(sum(l - f + 1) AS BIGINT) AS n FROM runs JOIN comp USING (id) GROUP BY clump HAVING sum(l - f + 1) >= 5""")
def clump_min_area(spark, sf):
    c = connectivity.clump(_mask(spark, sf), diagonal=True).where("z = 1")
    return c.groupBy("clump").agg(F.count("*").alias("n")).where("n >= 5")


# --- craters ----------------------------------------------------------------------------------------

PART = "SELECT p_partkey, p_size * 10.0 AS L, 2000 + p_retailprice AS rp, 2700.0 AS rt, 15000.0 AS v, radians(30 + p_size) AS th, 1.622 AS g FROM part"
W = "(0.5 * rp * (pi() / 6) * power(L, 3) * v * v)"


def _parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("L"), (2000 + F.col("p_retailprice")).alias("rp"), F.lit(2700.0).alias("rt"), F.lit(15000.0).alias("v"), F.radians(30 + F.col("p_size")).alias("th"), F.lit(1.622).alias("g"))


_gault = "CASE WHEN 0.25 * power(rp, 1.0 / 6) * power(rt, -0.5) * power(w, 0.29) * power(sin(th), 1.0 / 3) > 100 THEN 0.27 * power(rp, 1.0 / 6) * power(rt, -0.5) * power(w, 0.28) * power(sin(th), 1.0 / 3) ELSE 0.25 * power(rp, 1.0 / 6) * power(rt, -0.5) * power(w, 0.29) * power(sin(th), 1.0 / 3) END"
_pi = "1.8 * power(rp, 0.11) * power(rt, -1.0 / 3) * power(g, -0.22) * power(L, 0.13) * power(w, 0.22)"
_yield = "0.0133 * power(w, 1 / 3.4) + 1.51 * sqrt(rp / rt) * L"


@query("crater_forward", f"SELECT p_partkey, round(w / 4.184e12, 3) AS kt, round({_gault}, 3) AS gault, round({_yield}, 3) AS yield, round({_pi}, 3) AS pi FROM (SELECT *, {W} AS w FROM ({PART}))")
def crater_forward(spark, sf):
    p = _parts(spark, sf).withColumn("w", craters.kinetic_energy(F.col("rp"), F.col("L"), F.col("v")))
    c = F.col
    return p.select("p_partkey", F.round(craters.tnt_kt(c("w")), 3).alias("kt"), F.round(craters.gault_diameter(c("w"), c("rp"), c("rt"), c("th"), F.lit(False)), 3).alias("gault"), F.round(craters.yield_diameter(c("w"), c("rp"), c("rt"), c("L")), 3).alias("yield"), F.round(craters.pi_diameter(c("w"), c("rp"), c("rt"), c("L"), c("g")), 3).alias("pi"))


@query("crater_inverse", "SELECT p_partkey, round(CAST(L AS DOUBLE), 3) AS by_pi, round(CAST(L AS DOUBLE), 3) AS by_yield FROM (" + PART + ")")
def crater_inverse(spark, sf):
    """The inverses give back the sizes that the forward relations started from."""
    c = F.col
    p = _parts(spark, sf).withColumn("w", craters.kinetic_energy(c("rp"), c("L"), c("v")))
    # the inverse folds the energy into its exponents (0.11 + 0.22, 0.13 + 0.66)
    return p.select("p_partkey", F.round(craters.pi_size(craters.pi_diameter(c("w"), c("rp"), c("rt"), c("L"), c("g")), c("v"), c("rp"), c("rt"), c("g")), 3).alias("by_pi"), F.round(craters.yield_size(craters.yield_diameter(c("w"), c("rp"), c("rt"), c("L")), c("v"), c("rp"), c("rt")), 3).alias("by_yield"))


@query("crater_depth", "SELECT p_partkey, round(df, 3) AS df, round(df * CASE WHEN df < 18000 THEN 0.2 ELSE greatest(0.02, least(0.2, 0.05 + 0.15 * sqrt(18000 / df))) END, 3) AS depth FROM (SELECT p_partkey, CASE WHEN 1.25 * d < 18000 THEN 1.25 * d ELSE 1.17 * power(d, 1.13) / power(18000, 0.13) END AS df FROM (SELECT p_partkey, p_retailprice * 12 AS d FROM part))")
def crater_depth(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", craters.final_diameter(F.col("p_retailprice") * 12, F.lit(1.622)).alias("df"))
    return p.select("p_partkey", F.round("df", 3).alias("df"), F.round(craters.depth(F.col("df"), F.lit(1.622), F.lit(0.2)), 3).alias("depth"))


@query("csfd_cumulative", "SELECT bin, n_in_bin, CAST(sum(n_in_bin) OVER (ORDER BY bin DESC) AS BIGINT) AS n_cum FROM (SELECT CAST(floor(log10(p_retailprice) * 10) AS BIGINT) AS bin, count(*) AS n_in_bin FROM part GROUP BY 1)")
def csfd_cumulative(spark, sf):
    return craters.size_frequency(table(spark, sf, "part"), "p_retailprice")


@query("powerlaw_fit", "SELECT round(regr_slope(log10(n), b / 50.0), 6) AS slope, round(regr_intercept(log10(n), b / 50.0), 6) AS intercept FROM (SELECT bin AS b, sum(n_in_bin) OVER (ORDER BY bin DESC) AS n FROM (SELECT floor(log10(p_retailprice) * 50) AS bin, count(*) AS n_in_bin FROM part GROUP BY 1))")
def powerlaw_fit(spark, sf):
    fit = craters.power_law(craters.size_frequency(table(spark, sf, "part"), "p_retailprice", 50), 50)
    return fit.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("ricochet_chain", "SELECT p_partkey, CAST(b AS INT) AS bounce, round(p_size * 3.0 * power(0.6, b), 6) AS size, round(900 * power(0.5, b), 6) AS speed FROM part, range(5) t(b) WHERE b = 0 OR (p_size % 10 + 0.5 < 5 AND p_size * 3.0 * power(0.6, b) >= 1 AND 900 * power(0.5, b) >= 100)")
def ricochet_chain(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 3.0).alias("diameter"), F.lit(900.0).alias("velocity"), (F.col("p_size") % 10 + 0.5).alias("angle"))
    return craters.ricochets(p).select("p_partkey", "bounce", F.round("size", 6).alias("size"), F.round("speed", 6).alias("speed"))


CANDIDATES = "(SELECT s_suppkey AS id, CAST(s_suppkey % 37 * 10 AS DOUBLE) AS cx, CAST(s_suppkey % 23 * 10 AS DOUBLE) AS cy, CAST(10 + s_suppkey % 7 * 4 AS DOUBLE) AS radius, abs(s_acctbal) AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN 'dem' ELSE 'image' END AS method FROM supplier)"
_CLAMP = "greatest(-1.0, least(1.0, ({0} * {0} + {1} * {1} - {2} * {2}) / (2 * {0} * {1})))"
_LENS = f"(r1 * r1 * acos({_CLAMP.format('d', 'r1', 'r2')}) + r2 * r2 * acos({_CLAMP.format('d', 'r2', 'r1')}) - 0.5 * sqrt(greatest(0.0, (-d + r1 + r2) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2))))"
_COMMON = f"CASE WHEN d >= r1 + r2 THEN 0.0 WHEN d <= abs(r1 - r2) THEN pi() * least(r1, r2) * least(r1, r2) ELSE {_LENS} END"
#: Pairs of different candidates whose disks overlap: a, b, their confidences and methods, iou.
OVERLAPS = f"(SELECT *, i / (pi() * (r1 * r1 + r2 * r2) - i) AS iou FROM (SELECT *, {_COMMON} AS i FROM (SELECT a.id AS a, b.id AS b, a.confidence AS ca, b.confidence AS cb, a.method AS ma, b.method AS mb, CAST(a.radius AS DOUBLE) AS r1, CAST(b.radius AS DOUBLE) AS r2, sqrt(CAST((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS DOUBLE)) AS d FROM {CANDIDATES} a JOIN {CANDIDATES} b ON a.id <> b.id)) WHERE d < r1 + r2)"


def _candidates(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 37 * 10.0).alias("cx"), (F.col("s_suppkey") % 23 * 10.0).alias("cy"), (10.0 + F.col("s_suppkey") % 7 * 4).alias("radius"), F.abs(F.col("s_acctbal")).alias("confidence"), F.when(F.col("s_suppkey") % 2 == 0, "dem").otherwise("image").alias("method"))


@query("crater_nms", f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY confidence DESC, id) AS k FROM {CANDIDATES}),
e AS MATERIALIZED (SELECT x.k AS a, y.k AS b, x.id AS over_id, y.id AS under_id, x.method AS m1, y.method AS m2 FROM {OVERLAPS} o JOIN c x ON x.id = o.a JOIN c y ON y.id = o.b WHERE o.iou >= 0.3 AND x.k < y.k),
above AS MATERIALIZED (SELECT b, list(a) AS over FROM e GROUP BY b),
greedy(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT g.k + 1, CASE WHEN len(list_intersect(g.kept, coalesce(above.over, []))) > 0 THEN g.kept ELSE list_append(g.kept, g.k + 1) END FROM greedy g LEFT JOIN above ON above.b = g.k + 1 WHERE g.k < (SELECT count(*) FROM c)),
kept AS MATERIALIZED (SELECT unnest(kept) AS k FROM greedy WHERE k = (SELECT count(*) FROM c)),
merged AS (SELECT over_id, count(*) AS n FROM (SELECT arg_min(e.over_id, e.over_id) AS over_id, arg_min(e.m1, e.over_id) AS m1, arg_min(e.m2, e.over_id) AS m2 FROM e JOIN kept ON kept.k = e.a GROUP BY e.b) WHERE m1 <> m2 GROUP BY over_id)
SELECT c.id, c.cx, c.cy, c.radius, c.confidence, CASE WHEN merged.n IS NULL THEN c.method ELSE 'merged' END AS method, 1 + coalesce(merged.n, 0) AS n_methods FROM c JOIN kept USING (k) LEFT JOIN merged ON merged.over_id = c.id""")
def crater_nms(spark, sf):
    return craters.suppress(_candidates(spark, sf))


@query("crater_multi_ring")
def crater_multi_ring(spark, sf):
    return craters.multi_rings(_candidates(spark, sf))


@query("crater_overlap_pairs", f"SELECT a AS a_id, b AS b_id, round(iou, 6) AS iou FROM {OVERLAPS} WHERE a < b AND iou > 0")
def crater_overlap_pairs(spark, sf):
    c = _candidates(spark, sf).select("id", "cx", "cy", "radius")
    pairs = craters.overlapping_blocks(c, c, 80.0).withColumn("iou", F.round("iou", 6))  # once for all rows of two blocks
    return craters.block_rows(pairs).where("a_id < b_id").select("a_id", "b_id", "iou")
