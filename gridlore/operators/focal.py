"""Focal and stencil operators on cells (row, col, z).

Rectangular windows are separable: sums, counts and extremes run along rows, then along columns, so a
cell takes part in two windows of n cells instead of n * n.  Windows truncate at the edges and skip
nulls.  Both passes partition by a line of the raster, so they spread over as many tasks as the
raster has lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rays import any_visible, horizon, horizon_arrays, illumination, largest_horizon, shadow, steps_across, sun_mask, viewshed, visibility  # noqa: F401

#: Fixed weights of the terrain hazard and landing ellipse scores.
HAZARD_WEIGHTS = {"slope": 0.40, "rough": 0.25, "relief": 0.15, "curv": 0.10, "crater": 0.10}
ELLIPSE_WEIGHTS = {"r8": 0.3632, "r20": 0.3632, "cv": 0.0767, "moran": 0.1578, "slope": 0.0391}


def _line(by: str, along: str, half: int) -> object:
    return Window.partitionBy(by).orderBy(along).rangeBetween(-half, half)


def focal(cells: DataFrame, size: int, z: str = "z", prefix: str = "f_") -> DataFrame:
    """cells with n, sum, sumsq, min and max over the size x size window (odd size)."""
    h = size // 2
    w, v = _line("row", "col", h), _line("col", "row", h)
    first = {"n": F.count(z), "sum": F.sum(z), "sumsq": F.sum(F.col(z) * F.col(z)), "min": F.min(z), "max": F.max(z)}
    over = {"n": F.sum, "sum": F.sum, "sumsq": F.sum, "min": F.min, "max": F.max}
    out = cells.select("*", *[f.over(w).alias(f"__{k}") for k, f in first.items()])
    return out.select(*[F.col(f"`{c}`") for c in cells.columns], *[over[k](f"__{k}").over(v).alias(prefix + k) for k in first])


def mean(prefix: str = "f_") -> Column:
    return F.when(F.col(f"{prefix}n") > 0, F.col(f"{prefix}sum") / F.col(f"{prefix}n"))


def stddev(prefix: str = "f_") -> Column:
    n, s, q = (F.col(prefix + x) for x in ("n", "sum", "sumsq"))
    return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n))))


def value_range(prefix: str = "f_") -> Column:
    return F.col(f"{prefix}max") - F.col(f"{prefix}min")


def running_mean(rows: DataFrame, key: str, along: str, half: int, z: str = "z") -> DataFrame:
    """Truncated running mean along an ordered axis within each key."""
    return rows.withColumn("mean", F.avg(z).over(Window.partitionBy(key).orderBy(along).rowsBetween(-half, half)))


def roughness(cells: DataFrame, size: int, threshold: float | None = None, z: str = "z") -> DataFrame:
    """row, col, rms, cv, moran (and mask): RMS of deviations from the focal mean, std over mean, neighbour autocorrelation."""
    f = focal(cells.select("row", "col", z), size, z)
    dev = f.select("row", "col", z, mean().alias("m"), stddev().alias("sd"), (F.col(z) - mean()).alias("dev")).withColumn("dev2", F.col("dev") ** 2)
    lag = focal(dev, 3, "dev", "l_").withColumn("lag3", mean("l_")).drop("l_n", "l_sum", "l_sumsq", "l_min", "l_max")
    cross = focal(lag.withColumn("cross", F.col("dev") * F.col("lag3")), size, "cross", "c_")
    both = focal(cross, size, "dev2", "d_")
    rms = F.sqrt(mean("d_"))
    out = both.select(
        "row",
        "col",
        rms.alias("rms"),
        F.when(F.col("m") > 0.001, F.col("sd") / F.col("m")).otherwise(0.0).alias("cv"),
        F.when(F.col("d_sum") > 1e-4, F.col("c_sum") / F.col("d_sum")).otherwise(0.0).alias("moran"),
    )
    return out if threshold is None else out.withColumn("mask", (F.col("rms") > threshold).cast("int"))


def neighbours(cells: DataFrame, z: str = "z") -> DataFrame:
    """cells with north, south, west, east; at an edge the cell itself."""
    r, c = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    at = lambda f, w, axis, step: F.when(f(axis).over(w) == F.col(axis) + step, f(z).over(w))
    out = cells.select("*", at(F.lag, r, "col", -1).alias("west"), at(F.lead, r, "col", 1).alias("east"))
    out = out.select("*", at(F.lag, c, "row", -1).alias("north"), at(F.lead, c, "row", 1).alias("south"))
    return out.select(*[F.col(f"`{x}`") for x in cells.columns], *[F.coalesce(x, z).alias(x) for x in ("north", "south", "west", "east")])


def slope(cells: DataFrame, dx: Column | float, dy: Column | float, z: str = "z") -> DataFrame:
    """row, col, slope and aspect (degrees) by central differences over twice the cell size, edges included."""
    n = neighbours(cells, z)
    gx, gy = (F.col("east") - F.col("west")) / (2 * dx), (F.col("north") - F.col("south")) / (2 * dy)
    aspect = F.degrees(F.atan2(gx, gy))
    return n.select(*[c for c in cells.columns if c != z], F.col(z), F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope"), F.when(aspect < 0, aspect + 360).otherwise(aspect).alias("aspect"))


def horn(cells: DataFrame, size: float, z: str = "z") -> DataFrame:
    """row, col, slope, aspect by Horn's 3 x 3 weights; null where a neighbour is missing."""
    r = Window.partitionBy("row").orderBy("col")
    three = cells.select("row", "col", F.lag(z).over(r).alias("w"), F.col(z).alias("c"), F.lead(z).over(r).alias("e"))
    c = Window.partitionBy("col").orderBy("row")
    up = {k: F.lag(k).over(c) for k in "wce"}
    down = {k: F.lead(k).over(c) for k in "wce"}
    gx = ((up["e"] + 2 * F.col("e") + down["e"]) - (up["w"] + 2 * F.col("w") + down["w"])) / (8 * size)
    gy = ((up["w"] + 2 * up["c"] + up["e"]) - (down["w"] + 2 * down["c"] + down["e"])) / (8 * size)
    g = three.select("row", "col", gx.alias("gx"), gy.alias("gy"))
    return g.select("row", "col", F.degrees(F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))).alias("slope"), F.pmod(F.degrees(F.atan2("gx", "gy")), F.lit(360.0)).alias("aspect"))


def scale_slopes(cells: DataFrame, native: float, scales: dict[float, float], z: str = "z") -> DataFrame:
    """row, col, safe: no scale (metres -> largest slope in degrees) is exceeded; a scale averages blocks of cells."""
    out = cells.select("row", "col")
    for k, (scale, limit) in enumerate(scales.items()):
        b = max(1, round(max(scale, native) / native))
        blocks = cells.groupBy(F.floor(F.col("row") / b).cast("int").alias("row"), F.floor(F.col("col") / b).cast("int").alias("col")).agg(F.avg(z).alias(z))
        steep = slope(blocks, native * b, native * b, z).select(F.col("row").alias("__r"), F.col("col").alias("__c"), (F.col("slope") > limit).alias(f"__m{k}"))
        out = out.withColumn("__r", F.floor(F.col("row") / b).cast("int")).withColumn("__c", F.floor(F.col("col") / b).cast("int")).join(steep, ["__r", "__c"], "left").drop("__r", "__c")
    masks = [F.coalesce(f"__m{k}", F.lit(False)) for k in range(len(scales))]
    unsafe = masks[0]
    for m in masks[1:]:
        unsafe = unsafe | m
    return out.select("row", "col", (~unsafe).cast("int").alias("safe"))


def rescale(cells: DataFrame, *columns: str) -> DataFrame:
    """Columns min-max scaled to 0..1 over all cells; a constant column becomes 0."""
    stats = cells.agg(*[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns])
    out = cells.crossJoin(F.broadcast(stats))
    for c in columns:
        span = F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.when(span > 0, (F.col(c) - F.col(f"__lo_{c}")) / span).otherwise(0.0)))
    return out.drop(*[f"__{k}_{c}" for k in ("lo", "hi") for c in columns])


def hazard(cells: DataFrame, size: float, crater: str | None = None, max_slope: float = 15.0, max_rough: float = 1.0, z: str = "z") -> DataFrame:
    """row, col, hazard, mask: weighted min-max scaled slope, roughness, relief (11 x 11) and curvature (9 x 9), and crater density if given."""
    extra = [crater] if crater else []
    base = slope(cells.select("row", "col", z, *extra), size, size, z)
    rough = roughness(cells, 5, z=z).select("row", "col", F.col("rms").alias("rough"))
    relief = focal(cells.select("row", "col", z), 11, z).select("row", "col", value_range().alias("relief"))
    bend = focal(cells.select("row", "col", z), 9, z).select("row", "col", (F.abs(F.col(z) - mean()) / (4.5 * size) ** 2).alias("curv"))
    m = base.join(rough, ["row", "col"]).join(relief, ["row", "col"]).join(bend, ["row", "col"])
    m = m.withColumn("mask", ((F.col("slope") > max_slope) | (F.col("rough") > max_rough)).cast("int"))
    names = ["slope", "rough", "relief", "curv"] + (["crater"] if crater else [])
    if crater:
        m = m.withColumn("crater", F.col(crater))
    total = sum(HAZARD_WEIGHTS[n] for n in names)
    scaled = rescale(m, *names)
    score = F.lit(0.0)
    for n in names:
        score = score + F.col(n) * (HAZARD_WEIGHTS[n] / total)
    return scaled.select("row", "col", score.alias("hazard"), "mask")


def ellipse_quality(cells: DataFrame, size: float, window: int, z: str = "z") -> DataFrame:
    """row, col, q and candidate: shares of cells below 8 and 20 degrees, variation, autocorrelation and mean slope in the window."""
    s = slope(cells.select("row", "col", z), size, size, z)
    r = roughness(cells, window, z=z)
    s = s.withColumn("r8", (F.col("slope") < 8).cast("double")).withColumn("r20", (F.col("slope") < 20).cast("double"))
    for c in ("slope", "r8", "r20"):
        s = focal(s, window, c, f"{c}_").withColumn(c, mean(f"{c}_")).drop(*[f"{c}_{k}" for k in ("n", "sum", "sumsq", "min", "max")])
    m = s.join(r, ["row", "col"])
    scaled = rescale(m, "slope", "cv")
    w = ELLIPSE_WEIGHTS
    q = w["r8"] * F.col("r8") + w["r20"] * F.col("r20") + w["cv"] * (1 - F.col("cv")) + w["moran"] * F.greatest(F.col("moran"), F.lit(0.0)) + w["slope"] * (1 - F.col("slope"))
    out = scaled.select("row", "col", q.alias("q"))
    lo_hi = out.agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    return out.crossJoin(F.broadcast(lo_hi)).select("row", "col", "q", (F.col("q") >= F.col("lo") + 0.8 * (F.col("hi") - F.col("lo"))).cast("int").alias("candidate"))
