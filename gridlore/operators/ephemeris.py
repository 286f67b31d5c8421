"""Time-tagged states: polynomial segments, orientation between samples, sun position, event windows."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors as V


def chebyshev(coefficients: Column, x: Column) -> Column:
    """Chebyshev series at x in [-1, 1] by Clenshaw's recurrence."""
    zero = F.struct(F.lit(0.0).alias("b1"), F.lit(0.0).alias("b2"))
    step = lambda s, c: F.struct((2 * x * s["b1"] - s["b2"] + c).alias("b1"), s["b1"].alias("b2"))
    return F.aggregate(F.reverse(coefficients), zero, step, lambda s: s["b1"] - x * s["b2"])


def states(times: DataFrame, segments: DataFrame, width: float, t: str = "t", object_: str = "object") -> DataFrame:
    """times with position (array of three) from the segment that covers each.

    segments: object, l, r, cx, cy, cz.  Spans go to bins of width, so the match is an equality join;
    of overlapping segments the latest start wins.
    """
    bins = segments.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("l") / width), F.floor(F.col("r") / width))))
    hit = times.withColumn("__bin", F.floor(F.col(t) / width)).join(bins, [object_, "__bin"]).where(F.col(t).between(F.col("l"), F.col("r")))
    best = hit.groupBy(object_, t).agg(F.max_by(F.struct("l", "r", "cx", "cy", "cz"), "l").alias("s"))
    x = (2 * F.col(t) - F.col("s.l") - F.col("s.r")) / (F.col("s.r") - F.col("s.l"))
    return best.select(object_, t, F.array(*[chebyshev(F.col(f"s.{c}"), x) for c in ("cx", "cy", "cz")]).alias("position"))


def slerp(p: Column, q: Column, part: Column) -> Column:
    """Shortest turn from quaternion p to q."""
    d = V.dot(p, q)
    q = F.transform(q, lambda x: F.when(d < 0, -x).otherwise(x))
    a = F.acos(F.least(F.lit(1.0), F.abs(d)))
    s = F.sin(a)
    return F.when(s < 1e-9, p).otherwise(V.combine(F.sin((1 - part) * a) / s, p, F.sin(part * a) / s, q))


def pointing(times: DataFrame, samples: DataFrame, largest_gap: float, t: str = "t", key: str = "frame") -> DataFrame:
    """times with quaternion q between the samples beside each; null across gaps above largest_gap.

    One sorted pass over both sides by frame.
    """
    a = times.select(key, F.col(t).alias("t"), F.lit(None).cast("array<double>").alias("q"), F.lit(1).alias("mine"))
    b = samples.select(key, F.col(t).alias("t"), "q", F.lit(0).alias("mine"))
    s = F.when(F.col("mine") == 0, F.struct("t", "q"))
    back = Window.partitionBy(key).orderBy("t", "mine").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(key).orderBy("t", F.desc("mine")).rowsBetween(0, Window.unboundedFollowing)
    both = a.union(b).withColumn("lo", F.last(s, True).over(back)).withColumn("hi", F.first(s, True).over(on)).where("mine = 1")
    gap = F.col("hi.t") - F.col("lo.t")
    turn = F.when(gap == 0, F.col("lo.q")).when(gap <= largest_gap, slerp(F.col("lo.q"), F.col("hi.q"), (F.col("t") - F.col("lo.t")) / gap))
    return both.select(key, F.col("t").alias(t), turn.alias("q"))


def sun_direction(et: Column) -> Column:
    """Unit vector to the sun from the Earth in the equator of J2000, to about 0.01 degrees: mean elements and the equation of centre."""
    d = et / 86400
    g, q = F.radians(357.529 + 0.98560028 * d), 280.459 + 0.98564736 * d
    lon = F.radians(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    e = math.radians(23.4393)
    return V.vec(F.cos(lon), math.cos(e) * F.sin(lon), math.sin(e) * F.sin(lon))


def sun_elevation(lat_deg: float, lon_deg: float, sub_lat: Column, sub_lon: Column) -> Column:
    """struct<elevation, azimuth> (degrees) of the sun at a site, from the sub-solar point."""
    p, q, h = math.radians(lat_deg), F.radians(sub_lat), F.radians(sub_lon - lon_deg)
    el = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), math.sin(p) * F.sin(q) + math.cos(p) * F.cos(q) * F.cos(h))))
    az = F.atan2(F.sin(h) * F.cos(q), math.cos(p) * F.sin(q) - math.sin(p) * F.cos(q) * F.cos(h))
    return F.struct(F.degrees(el).alias("elevation"), F.pmod(F.degrees(az), F.lit(360.0)).alias("azimuth"))


def event_windows(steps: DataFrame, reference: float, relation: str = ">", key: str = "key", t: str = "t", value: str = "value") -> DataFrame:
    """key, l, r: when a stepped quantity is above (below) reference; crossings lie on the chord between steps.

    relation '>' or '<'.  The first and last step bound what can be known.
    """
    v = F.col(value) - reference if relation == ">" else reference - F.col(value)
    w = Window.partitionBy(key).orderBy(t)
    s = steps.select(key, t, v.alias("v")).withColumn("pv", F.lag("v").over(w)).withColumn("pt", F.lag(t).over(w))
    rise = (F.col("v") >= 0) & (F.col("pv") < 0)
    fall = (F.col("v") < 0) & (F.col("pv") >= 0)
    cross = F.col("pt") + (F.col(t) - F.col("pt")) * F.col("pv") / (F.col("pv") - F.col("v"))
    s = s.withColumn("x", F.when(rise | fall, cross)).withColumn("k", F.sum((rise | F.col("pv").isNull()).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = s.where((F.col("v") >= 0) | fall)
    return inside.groupBy(key, "k").agg(F.min(F.when(rise, F.col("x")).when(F.col("v") >= 0, F.col(t))).alias("l"), F.max(F.when(fall, F.col("x")).otherwise(F.col(t))).alias("r")).where("l is not null").select(key, "l", "r")


def refine(brackets: DataFrame, f: Callable, tolerance: float, l: str = "l", r: str = "r") -> DataFrame:
    """brackets with root: bisection of a vectorised f(t) (numpy arrays) whose sign differs at l and r."""

    @F.pandas_udf("double")
    def root(a: pd.Series, b: pd.Series) -> pd.Series:
        import numpy as np

        lo, hi = a.to_numpy(float).copy(), b.to_numpy(float).copy()
        left = np.sign(f(lo))
        while len(lo) and (hi - lo).max() > tolerance:
            mid = (lo + hi) / 2
            same = np.sign(f(mid)) == left
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
        return pd.Series((lo + hi) / 2)

    return brackets.withColumn("root", root(l, r))


def pool_values(pool: DataFrame, name: str) -> DataFrame:
    """The values of a variable of a kernel pool (name, type, values), one per row, numbered from 0."""
    return pool.where(F.upper("name") == name.upper()).select(F.posexplode("values").alias("at", "value"))


def pool_names(pool: DataFrame, template_: str) -> DataFrame:
    from ..plans.ek import template

    return pool.where(F.col("name").rlike(template(template_))).select("name", "type", F.size("values").alias("n"))


def parse_kernel(text: str) -> list[tuple[str, str, list[str]]]:
    """(name, type, values) of the data blocks of a text kernel; += appends."""
    import re

    blocks = re.findall(r"\\begindata(.*?)(?:\\begintext|$)", text, flags=re.S)
    out: dict[str, tuple[str, list[str]]] = {}
    for name, op, body in re.findall(r"([\w/]+)\s*(\+?=)\s*(\((?:[^()']|'(?:[^']|'')*')*\)|'(?:[^']|'')*'|\S+)", "\n".join(blocks)):
        texts = re.findall(r"'((?:[^']|'')*)'", body)
        values = [t.replace("''", "'") for t in texts] if texts else re.sub("[(),]", " ", body).upper().replace("D", "E").split()
        kind = "character" if texts else "numeric"
        out[name] = (kind, out[name][1] + values) if op == "+=" and name in out else (kind, values)
    return [(n, k, v) for n, (k, v) in out.items()]
