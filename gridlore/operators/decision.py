"""Multi-criteria decisions: pairwise weights, linear and ideal-point scores, ranking with uncertainty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .connectivity import clump
from .focal import rescale

#: Fixed random consistency indices by matrix size.
RANDOM_INDEX = [0.0, 0.0, 0.0, 0.58, 0.90, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49]


def pairwise_weights(matrix: DataFrame) -> DataFrame:
    """criterion, weight, lambda_max, ci, cr, consistent of a pairwise matrix (i, j, a): geometric-mean weights; CR <= 0.10 is consistent."""
    g = matrix.groupBy("i").agg(F.exp(F.avg(F.log("a"))).alias("g"))
    w = g.crossJoin(g.agg(F.sum("g").alias("t"), F.count("*").alias("n"))).select("i", (F.col("g") / F.col("t")).alias("weight"), "n")
    row = matrix.join(w.select(F.col("i").alias("j"), F.col("weight").alias("wj")), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("wj")).alias("aw"))
    lam = w.join(row, "i").agg(F.avg(F.col("aw") / F.col("weight")).alias("lambda_max"))
    out = w.crossJoin(lam)
    ci = F.when(F.col("n") > 1, (F.col("lambda_max") - F.col("n")) / (F.col("n") - 1)).otherwise(0.0)
    ri = F.element_at(F.array(*[F.lit(x) for x in RANDOM_INDEX]), F.least(F.col("n"), F.lit(10)).cast("int") + 1)
    out = out.withColumn("ci", ci).withColumn("cr", F.when(ri > 0, F.col("ci") / ri).otherwise(0.0))
    return out.select(F.col("i").alias("criterion"), "weight", "lambda_max", "ci", "cr", (F.col("cr") <= 0.10).alias("consistent"))


def not_reciprocal(matrix: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Pairs whose a_ij * a_ji is off 1 by more than tolerance."""
    other = matrix.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("a").alias("b"))
    return matrix.join(other, ["i", "j"]).where((F.col("i") < F.col("j")) & (F.abs(F.col("a") * F.col("b") - 1) > tolerance)).select("i", "j", "a", "b")


def weighted_sum(rows: DataFrame, weights: dict[str, float], invert: tuple[str, ...] = (), excluded: Column | None = None, into: str = "wlc") -> DataFrame:
    """rows with the weighted linear combination of min-max scaled criteria; some inverted; excluded rows get 0.

    Criteria with weight <= 0 are skipped and the rest re-normalised; a constant criterion counts 0.
    """
    used = {c: w for c, w in weights.items() if w > 0}
    total = sum(used.values())
    temp = rows.select("*", *[F.col(c).cast("double").alias(f"__{c}") for c in used])
    scaled = rescale(temp, *[f"__{c}" for c in used])
    score = F.lit(0.0)
    for c, w in used.items():
        x = F.col(f"__{c}")
        score = score + (1 - x if c in invert else x) * (w / total)
    if excluded is not None:
        score = F.when(excluded, 0.0).otherwise(score)
    return scaled.withColumn(into, score).drop(*[f"__{c}" for c in used])


def topsis(rows: DataFrame, weights: dict[str, float], into: str = "topsis") -> DataFrame:
    """rows with closeness to the ideal: vector-normalised weighted gains, distances to best and worst."""
    total = sum(weights.values())
    norms = rows.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"__n_{c}") for c in weights], *[F.max(c).alias(f"__x_{c}") for c in weights], *[F.min(c).alias(f"__i_{c}") for c in weights])
    out = rows.crossJoin(F.broadcast(norms))
    up = down = F.lit(0.0)
    for c, w in weights.items():
        k = w / total
        part = lambda x, c=c, k=k: F.when(F.col(f"__n_{c}") > 0, x * k / F.col(f"__n_{c}")).otherwise(0.0)
        up = up + F.pow(part(F.col(c)) - part(F.col(f"__x_{c}")), F.lit(2))
        down = down + F.pow(part(F.col(c)) - part(F.col(f"__i_{c}")), F.lit(2))
    value = F.when(F.sqrt(up) + F.sqrt(down) > 0, F.sqrt(down) / (F.sqrt(up) + F.sqrt(down))).otherwise(0.0)
    return out.withColumn(into, value).drop(*norms.columns)


def score(rows: DataFrame, weights: dict[str, float], invert: tuple[str, ...] = (), excluded: Column | None = None) -> DataFrame:
    """rows with score: the mean of weighted sum and TOPSIS."""
    out = topsis(weighted_sum(rows, weights, invert, excluded), {c: w for c, w in weights.items() if w > 0})
    return out.withColumn("score", (F.col("wlc") + F.col("topsis")) / 2)


def rank_regions(cells: DataFrame, q: float, min_km2: float, cell_km2: float, z: str = "z") -> DataFrame:
    """clump, n, mean, std, area_km2, rank of the suitable regions: cells above 1e-4 and the q-th quantile, clumped, large enough, by falling mean."""
    good = cells.where(F.col(z) > 1e-4)
    cut = good.agg(F.percentile(z, F.lit(q)).alias("cut"))
    marked = good.crossJoin(F.broadcast(cut)).where(F.col(z) >= F.col("cut")).select("row", "col", F.lit(1).alias("one"), z)
    c = clump(marked.select("row", "col", "one"), z="one").join(marked.select("row", "col", z), ["row", "col"])
    least = max(1, int(min_km2 / cell_km2))
    zones = c.groupBy("clump").agg(F.count("*").alias("n"), F.avg(z).alias("mean"), F.stddev_pop(z).alias("std")).where(F.col("n") >= least)
    return zones.withColumn("area_km2", F.col("n") * cell_km2).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "clump")))  # one row per region


def rank1_probability(candidates: DataFrame, runs: int, seed: int = 7, criteria: tuple[str, ...] = (), key: str = "id", mean: str = "mean", std: str = "std") -> DataFrame:
    """key and p1: the share of runs that each candidate wins.

    Criteria given: weights drawn uniformly and normalised, over min-max scaled criteria; else a
    Gaussian about the mean.  Draws are hashes of (seed, run, item), so a rerun task draws the same; md5, so that
    any SQL engine can draw them too.
    """
    u = lambda *parts: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    runs_of = F.explode(F.sequence(F.lit(1), F.lit(runs)))
    if criteria:
        scaled = rescale(candidates, *criteria).withColumn("run", runs_of)
        raw = [u(F.col("run"), F.lit(c)) for c in criteria]
        total = raw[0]
        for r in raw[1:]:
            total = total + r
        value = F.lit(0.0)
        for r, c in zip(raw, criteria):
            value = value + r / total * F.col(c)
        drawn = scaled.withColumn("__v", value)
    else:
        normal = F.sqrt(-2 * F.log(u(F.col("run"), F.col(key), F.lit("a")))) * F.cos(2 * math.pi * u(F.col("run"), F.col(key), F.lit("b")))
        drawn = candidates.withColumn("run", runs_of).withColumn("__v", F.col(mean) + F.col(std) * normal)
    wins = drawn.groupBy("run").agg(F.max_by(key, F.struct("__v", F.col(key))).alias(key)).groupBy(key).agg((F.count("*") / runs).alias("p1"))
    return candidates.select(key).join(wins, key, "left").select(key, F.coalesce("p1", F.lit(0.0)).alias("p1"))


def cross_rank(candidates: DataFrame, weights: tuple[float, float, float] = (0.6, 0.25, 0.15), area: str = "log", top: int = 20) -> DataFrame:
    """Ranks candidates of many regions together.

    candidates: region, rank (in its region), suit, area_km2, p1.  Components suitability, area
    (log1p, sqrt or linear) and Borda points (n - rank, times p1 where p1 > 0) are min-max scaled
    (a constant one counts 0.5) and weighted.
    """
    n = candidates.groupBy("region").agg(F.count("*").alias("__n"))
    size = {"log": F.log1p("area_km2"), "sqrt": F.sqrt("area_km2"), "linear": F.col("area_km2")}[area]
    points = F.col("__n") - F.col("rank")
    parts = candidates.join(F.broadcast(n), "region").withColumn("__a", size).withColumn("__b", F.when(F.col("p1") > 0, points * F.col("p1")).otherwise(points.cast("double"))).withColumn("__s", F.col("suit"))
    lims = parts.agg(*[f(c).alias(f"{c}_{k}") for c in ("__s", "__a", "__b") for k, f in (("lo", F.min), ("hi", F.max))])
    out = parts.crossJoin(F.broadcast(lims))
    norm = lambda c: F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), (F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))).otherwise(0.5)
    total = sum(weights)
    value = norm("__s") * (weights[0] / total) + norm("__a") * (weights[1] / total) + norm("__b") * (weights[2] / total)
    best = out.withColumn("composite", value).orderBy(F.desc("composite"), "region", "rank").limit(top)
    return best.select("region", "rank", "suit", "area_km2", "composite").withColumn("cross_rank", F.row_number().over(Window.orderBy(F.desc("composite"), "region", "rank")))  # top rows only


def ground_track(steps: DataFrame, altitude_km: float, inclination_deg: float, radius_km: float, mu: float, spin_s: float, t: str = "t") -> DataFrame:
    """steps with lat and lon (degrees) under a circular orbit, by Kepler's period."""
    period = 2 * math.pi * math.sqrt((radius_km + altitude_km) ** 3 / mu)
    u = 2 * math.pi * F.col(t) / period
    inc = math.radians(inclination_deg)
    lat = F.asin(math.sin(inc) * F.sin(u))
    lon = F.atan2(math.cos(inc) * F.sin(u), F.cos(u)) - 2 * math.pi * F.col(t) / spin_s
    return steps.withColumn("lat", F.degrees(lat)).withColumn("lon", F.pmod(F.degrees(lon) + 180, F.lit(360.0)) - 180)


def contact(track: DataFrame, lat: float, lon: float, radius_km: float, altitude_km: float, min_elevation: float) -> DataFrame:
    """track with elevation (degrees) and visible for a site on a sphere."""
    p, q = F.radians("lat"), math.radians(lat)
    cosg = math.sin(q) * F.sin(p) + math.cos(q) * F.cos(p) * F.cos(F.radians(F.col("lon") - lon))
    g = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosg)))
    elevation = F.degrees(F.atan2(F.cos(g) - radius_km / (radius_km + altitude_km), F.sin(g)))
    return track.withColumn("elevation", elevation).withColumn("visible", (elevation >= min_elevation).cast("int"))
