"""Crater scaling, size-frequency counts, candidates."""

from __future__ import annotations

import math
from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .connectivity import kept as stored

#: J per kt of TNT; lunar transition diameter (m) and gravity.
TNT_J_PER_KT, MOON_DSC, MOON_G = 4.184e12, 18000.0, 1.622
#: Fixed values of the three Gault regimes: constant, energy exponent, sine exponent, largest diameter (m).
GAULT = [(0.015, 0.37, 2 / 3, 10.0), (0.25, 0.29, 1 / 3, 100.0), (0.27, 0.28, 1 / 3, math.inf)]


def mass(rho_p: Column, size: Column) -> Column:
    return rho_p * (math.pi / 6) * size**3


def kinetic_energy(rho_p: Column, size: Column, v: Column) -> Column:
    return 0.5 * mass(rho_p, size) * v * v


def tnt_kt(energy: Column) -> Column:
    return energy / TNT_J_PER_KT


def gault_diameter(energy: Column, rho_p: Column, rho_t: Column, theta: Column, competent: Column) -> Column:
    """Transient diameter; competent targets start in the small-crater regime. theta in radians."""
    s = F.when(F.sin(theta) > 0, F.sin(theta)).otherwise(1e-6)
    small, middle, large = [c * F.pow(rho_p, F.lit(1 / 6)) * F.pow(rho_t, F.lit(-0.5)) * F.pow(energy, F.lit(q)) * F.pow(s, F.lit(p)) for c, q, p, _ in GAULT]
    loose = F.when(middle > GAULT[1][3], large).otherwise(middle)
    return F.when(competent & (small <= GAULT[0][3]), small).otherwise(loose)


def yield_diameter(energy: Column, rho_p: Column, rho_t: Column, size: Column) -> Column:
    return 0.0133 * F.pow(energy, F.lit(1 / 3.4)) + 1.51 * F.sqrt(rho_p / rho_t) * size


def pi_diameter(energy: Column, rho_p: Column, rho_t: Column, size: Column, g: Column) -> Column:
    return 1.8 * F.pow(rho_p, F.lit(0.11)) * F.pow(rho_t, F.lit(-1 / 3)) * F.pow(g, F.lit(-0.22)) * F.pow(size, F.lit(0.13)) * F.pow(energy, F.lit(0.22))


def gault_size(diameter: Column, v: Column, rho_p: Column, rho_t: Column, theta: Column, competent: Column) -> Column:
    """Projectile size of a transient diameter, by the regime the diameter lies in."""
    s = F.when(F.sin(theta) > 0, F.sin(theta)).otherwise(1e-6)

    def invert(c: float, q: float, p: float) -> Column:
        k = c * (math.pi / 12) ** q * F.pow(rho_p, F.lit(1 / 6 + q)) * F.pow(rho_t, F.lit(-0.5)) * F.pow(v, F.lit(2 * q)) * F.pow(s, F.lit(p))
        return F.pow(diameter / k, F.lit(1 / (3 * q)))

    small, middle, large = [invert(c, q, p) for c, q, p, _ in GAULT]
    return F.when(competent & (diameter < GAULT[0][3]), small).when(diameter < GAULT[1][3], middle).otherwise(large)


def pi_size(diameter: Column, v: Column, rho_p: Column, rho_t: Column, g: Column) -> Column:
    k = 1.8 * (math.pi / 12) ** 0.22 * F.pow(rho_p, F.lit(0.33)) * F.pow(rho_t, F.lit(-1 / 3)) * F.pow(g, F.lit(-0.22)) * F.pow(v, F.lit(0.44))
    return F.pow(diameter / k, F.lit(1 / 0.79))


def yield_size(diameter: Column, v: Column, rho_p: Column, rho_t: Column, steps: int = 60) -> Column:
    """Inverse of yield_diameter.  It rises in the size, so the interval is halved in a fold; no closed form exists."""
    a = 0.0133 * F.pow(math.pi / 12 * rho_p * v * v, F.lit(1 / 3.4))
    b = 1.51 * F.sqrt(rho_p / rho_t)
    start = F.struct(F.lit(0.0).alias("lo"), (diameter / b + 1).alias("hi"))

    def halve(x: Column, _: Column) -> Column:
        mid = (x["lo"] + x["hi"]) / 2
        over = a * F.pow(mid, F.lit(3 / 3.4)) + b * mid > diameter
        return F.struct(F.when(over, x["lo"]).otherwise(mid).alias("lo"), F.when(over, mid).otherwise(x["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda x: (x["lo"] + x["hi"]) / 2)


def transition_diameter(g: Column, measured_km: Column | None = None) -> Column:
    """Simple-to-complex: the measured value, else lunar scaled by 1/g."""
    scaled = F.when(g > 0, MOON_DSC * MOON_G / g).otherwise(MOON_DSC)
    return scaled if measured_km is None else F.when(measured_km > 0, measured_km * 1000).otherwise(scaled)


def final_diameter(transient: Column, g: Column, measured_km: Column | None = None) -> Column:
    dsc = transition_diameter(g, measured_km)
    return F.when(1.25 * transient < dsc, 1.25 * transient).otherwise(1.17 * F.pow(transient, F.lit(1.13)) / F.pow(dsc, F.lit(0.13)))


def depth(diameter: Column, g: Column, dd_simple: Column, measured_km: Column | None = None) -> Column:
    simple = F.when(dd_simple > 0, dd_simple).otherwise(0.196)
    dsc = transition_diameter(g, measured_km)
    ratio = F.greatest(F.lit(0.02), F.least(simple, 0.05 + (simple - 0.05) * F.sqrt(dsc / diameter)))
    return diameter * F.when(diameter < dsc, simple).otherwise(ratio)


def effective_density(surface_height: Column, rho_surface: Column, rho_below: Column, transient: Column) -> Column:
    """Mean density of the excavated depth, a third of the transient diameter."""
    d = transient / 3
    h = F.least(surface_height, d)
    return (h * rho_surface + (d - h) * rho_below) / d


def polygon_area(ring: Column) -> Column:
    """Shoelace area of array<struct<x, y>>."""
    n = F.size(ring)
    nxt = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, x: a + x)
    return F.abs(twice) / 2


def equivalent_diameter(area: Column) -> Column:
    return 2 * F.sqrt(area / math.pi)


def ricochets(impactors: DataFrame, most: int = 4) -> DataFrame:
    """Bounces of impactors below 5 degrees: speed halves, size shrinks by 0.6, each hop covers four diameters.

    impactors: velocity (m/s), angle (degrees), diameter (m); rows with null or non-positive
    attributes are left out.  The chain stops below 1 m or 100 m/s.
    """
    fine = impactors.where((F.col("velocity") > 0) & (F.col("diameter") > 0) & (F.col("angle") > 0))
    bounce = F.explode(F.when(F.col("angle") < 5, F.sequence(F.lit(0), F.lit(most))).otherwise(F.array(F.lit(0))))
    out = fine.withColumn("bounce", bounce)
    size, speed = F.col("diameter") * F.pow(F.lit(0.6), F.col("bounce")), F.col("velocity") * F.pow(F.lit(0.5), F.col("bounce"))
    hops = 4 * F.col("diameter") * (1 - F.pow(F.lit(0.6), F.col("bounce"))) / 0.4
    return out.withColumn("size", size).withColumn("speed", speed).withColumn("travelled", hops).where((F.col("bounce") == 0) | ((F.col("size") >= 1) & (F.col("speed") >= 100)))


def minor_axis(diameter: Column, angle_deg: Column) -> Column:
    s = F.pow(F.sin(F.radians(angle_deg)), F.lit(1 / 3))
    return diameter * F.greatest(F.lit(0.2), F.least(F.lit(1.0), s))


def size_frequency(diameters: DataFrame, d: str = "d", per_decade: int = 10) -> DataFrame:
    """bin, n_in_bin and n_cum (craters of the bin's size or more) over log-spaced bins."""
    bins = diameters.where(F.col(d) > 0).groupBy(F.floor(F.log10(d) * per_decade).cast("long").alias("bin")).agg(F.count("*").alias("n_in_bin"))
    # one row per bin, however many craters there are
    return bins.withColumn("n_cum", F.sum("n_in_bin").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)))


def power_law(bins: DataFrame, per_decade: int = 10) -> DataFrame:
    """Least-squares line through log10 N(>=D) over log10 D of the bins."""
    x, y = F.col("bin") / per_decade, F.log10("n_cum")
    return bins.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def disk_overlap(d: Column, r1: Column, r2: Column) -> Column:
    """Intersection over union of two disks at distance d."""
    lens1 = r1 * r1 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (d * d + r1 * r1 - r2 * r2) / (2 * d * r1))))
    lens2 = r2 * r2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (d * d + r2 * r2 - r1 * r1) / (2 * d * r2))))
    kite = 0.5 * F.sqrt(F.greatest(F.lit(0.0), (-d + r1 + r2) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2)))
    small = F.least(r1, r2)
    inter = F.when(d >= r1 + r2, 0.0).when(d <= F.abs(r1 - r2), math.pi * small * small).otherwise(lens1 + lens2 - kite)
    return inter / (math.pi * (r1 * r1 + r2 * r2) - inter)


#: Equal disks travel as blocks of so many rows at most.
BLOCK = 256


def _disk() -> Column:
    """Whether a row is a disk that can overlap anything: a centre, and a radius above nothing."""
    finite = reduce(lambda x, y: x & y, [F.abs(F.col(c)) < math.inf for c in ("cx", "cy", "radius")])
    return F.coalesce(finite & (F.col("radius") > 0), F.lit(False))


def _meeting(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """Pairs (a_, b_ columns) with the distance d of their centres; none at reach or nearer is missing.

    Both sides are binned by reach; a looks into the nine bins around its own, so the join is an
    equality on bins, not a product.
    """
    bin_of = lambda c: F.floor(F.col(c) / reach)
    around = F.sequence(F.lit(-1), F.lit(1))
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], bin_of("cx").alias("__x"), bin_of("cy").alias("__y"))
    left = left.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).withColumn("__x", F.col("__x") + F.col("__dx")).withColumn("__y", F.col("__y") + F.col("__dy"))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], bin_of("cx").alias("__x"), bin_of("cy").alias("__y"))
    d = F.sqrt((F.col("a_cx") - F.col("b_cx")) ** 2 + (F.col("a_cy") - F.col("b_cy")) ** 2)
    # as a generated column d is worked out once; else each of the many places that name it would hold its expression, too much code to compile
    return left.join(right, ["__x", "__y"]).withColumn("d", F.explode(F.array(d))).drop("__x", "__y", "__dx", "__dy")


def _blocks(disks: DataFrame) -> DataFrame:
    """cx, cy, radius, rows: the other columns of up to BLOCK rows with that very disk."""
    at = ["cx", "cy", "radius"]
    rest = [c for c in disks.columns if c not in at]
    number = F.row_number().over(Window.partitionBy(*at).orderBy(*rest)) if rest else F.lit(0)
    numbered = disks.where(_disk()).withColumn("__block", F.floor((number - 1) / BLOCK))
    return numbered.groupBy(*at, "__block").agg(F.collect_list(F.struct(*rest)).alias("rows")).drop("__block")


def overlapping_blocks(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """Pairs (a_, b_: cx, cy, radius, rows) of blocks of equal disks whose IoU is positive, with iou.  reach: at least twice the largest radius."""
    touching = _meeting(_blocks(a), _blocks(b), reach).where(F.col("d") < F.col("a_radius") + F.col("b_radius"))  # a cheap test before a dear one
    return touching.withColumn("iou", disk_overlap(F.col("d"), F.col("a_radius"), F.col("b_radius"))).where("iou > 0").drop("d")


def block_rows(pairs: DataFrame) -> DataFrame:
    """All pairs of rows of the pairs of blocks."""
    each = pairs.withColumn("a_rows", F.explode("a_rows")).withColumn("b_rows", F.explode("b_rows"))
    fields = [F.col(f"{side}_rows.{f.name}").alias(f"{side}_{f.name}") for side in "ab" for f in each.schema[f"{side}_rows"].dataType.fields]
    return each.select(*[c for c in each.columns if c not in ("a_rows", "b_rows")], *fields)


def overlapping(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """Pairs (a_, b_ columns) of disks whose IoU is positive.  reach: at least twice the largest radius.

    Equal disks overlap alike, so overlaps are worked out between blocks of them and then told to all their rows.
    """
    return block_rows(overlapping_blocks(a, b, reach)).select(*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in b.columns], "iou")


def suppress(candidates: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Non-maximum suppression: by falling confidence (ties by id, null last), a candidate goes if a kept one overlaps it by threshold or more.

    candidates: id, cx, cy, radius, confidence, method.  Adds n_methods; a kept candidate whose
    suppressed ones came by another method becomes ``merged``.  Of equal disks only the strongest
    can stay, and what beats it beats them all, so the strongest alone are held against each other.
    One is decided once all stronger overlapping ones are, so each round settles all local maxima
    at once; the loop works on the overlap edges only.
    """
    weak = F.coalesce(F.when(F.isnan("confidence"), -math.inf).otherwise(-F.col("confidence").cast("double")), F.lit(math.inf))
    # a disk that by rounding doesn't overlap its equals by threshold stands for itself
    alone = F.when(~(disk_overlap(F.lit(0.0), F.col("radius"), F.col("radius")) >= threshold), F.col("id"))
    each = candidates.where(_disk()).select("cx", "cy", "radius", "id", "method", weak.alias("weak"), alone.alias("alone"))
    best = stored(each.groupBy("cx", "cy", "radius", "alone").agg(F.min(F.struct("weak", "id", "method")).alias("best")).select("cx", "cy", "radius", "best.*"))
    reach = 2 * (best.agg(F.max("radius")).first()[0] or 1.0)
    better = (F.col("iou") >= threshold) & (F.struct("a_weak", "a_id") < F.struct("b_weak", "b_id"))
    ranked = best.drop("method")
    edges = stored(overlapping(ranked, ranked, reach).where(better).select(F.col("a_id").alias("over"), F.col("b_id").alias("under")))
    gone, live = [], edges
    while True:  # each round beats one at least
        tops = live.select(F.col("over").alias("id")).distinct().join(live.select(F.col("under").alias("id")).distinct(), "id", "left_anti")
        beaten = stored(live.join(tops.withColumnRenamed("id", "over"), "over").select("under").distinct())
        if beaten.isEmpty():
            break
        gone.append(beaten)
        live = stored(live.join(beaten, "under", "left_anti").join(beaten.withColumnRenamed("under", "over"), "over", "left_anti"))
    lost = reduce(DataFrame.union, gone, edges.select("under").limit(0))
    top = stored(best.join(lost.select(F.col("under").alias("id")), "id", "left_anti"))
    kept = candidates.join(top.select("id"), "id", "left_semi").unionByName(candidates.where(~_disk()))
    # kept ones overlap little, so a candidate meets few of them
    over = overlapping(top, each.drop("alone"), reach).where(better).select(F.col("a_id").alias("over"), F.col("b_id").alias("under"), F.col("a_method").alias("m1"), F.col("b_method").alias("m2"))
    first = over.groupBy("under").agg(F.min_by(F.struct("over", "m1", "m2"), "over").alias("e")).select("e.*")
    extra = first.where("m1 != m2").groupBy(F.col("over").alias("id")).agg(F.count("*").alias("__n"))
    out = kept.join(extra, "id", "left")
    return out.withColumn("n_methods", 1 + F.coalesce("__n", F.lit(0))).withColumn("method", F.when(F.col("__n").isNotNull(), "merged").otherwise(F.col("method"))).drop("__n")


def multi_rings(candidates: DataFrame, tolerance: float = 0.3, ratio: float = 1.3) -> DataFrame:
    """basin_id and ring_index: concentric candidates whose radii differ by ratio at least, two rings or more.

    Centres lie within tolerance of the smaller radius.  Ids give the order of seeds; only candidates
    that can share a basin meet, and each neighbourhood of such is settled on its own.  Equal disks
    can share basins with the same disks, so links are formed between different disks.
    """
    from .connectivity import label

    at = ["cx", "cy", "radius"]
    each = candidates.where(_disk()).select("id", *at)
    disks = stored(each.groupBy(*at).agg(F.min("id").alias("disk")))
    reach = tolerance * (disks.agg(F.max("radius")).first()[0] or 1.0) or 1.0
    small, large = F.least("a_radius", "b_radius"), F.greatest("a_radius", "b_radius")
    # the least bit wider than the rule, which settle() then applies
    close = (F.col("a_disk") <= F.col("b_disk")) & (large / small >= ratio) & (F.col("d") <= tolerance * small * (1 + 1e-9))
    links = stored(_meeting(disks, disks, reach * (1 + 1e-6)).where(close).select(F.col("a_disk").alias("a"), F.col("b_disk").alias("b")))
    groups = label(links).withColumnRenamed("node", "disk")
    members = each.join(disks.join(groups, "disk"), at)
    linked = links.join(groups.withColumnRenamed("disk", "a"), "a").select("a", "b", F.col("component").alias("group"))

    def settle(pdf: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        place = {m.disk: (m.cx, m.cy, m.radius) for m in pdf.drop_duplicates("disk").itertuples()}
        near: dict = {x: set() for x in place}
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            (x, y, r), (u, v, s) = place[a], place[b]
            if math.hypot(u - x, v - y) <= tolerance * min(r, s):
                near[a].add(b)
                near[b].add(a)
        free = {x: deque(g) for x, g in pdf.groupby("disk", sort=False)["id"]}
        taken, out = set(), []
        for seed, disk in zip(pdf["id"], pdf["disk"], strict=True):
            if seed in taken:
                continue
            free[disk].popleft()  # the seed: of equal disks the least id goes first, as seed or as ring
            ring, fits = [(place[disk][2], seed)], near[disk]
            while fits := [x for x in fits if free[x]]:
                other = min(fits, key=lambda x: free[x][0])
                r = place[other][2]
                ring.append((r, free[other].popleft()))
                fits = [x for x in fits if max(r, place[x][2]) / min(r, place[x][2]) >= ratio]
            if len(ring) > 1:
                taken |= {m for _, m in ring}
                out += [(m, seed, k) for k, (_, m) in enumerate(sorted(ring, key=lambda m: m[0]), 1)]
        return pd.DataFrame(out, columns=["id", "basin_id", "ring_index"])

    found = members.groupBy("component").cogroup(linked.groupBy("group")).applyInPandas(settle, "id long, basin_id long, ring_index int")
    return candidates.join(found, "id", "left")


def pair_score(features: list[Column], weights: list[float] | None = None, bias: float = 0.0) -> Column:
    """Logistic score of candidate features; equal weights if none are given."""
    w = weights or [1 / len(features)] * len(features)
    total = F.lit(bias)
    for x, k in zip(features, w, strict=True):
        total = total + x * k
    return 1 / (1 + F.exp(-total))
