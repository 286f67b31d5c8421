"""Crater detectors on grids, and registration of two images."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .connectivity import kept


def radii(d_min: float, d_max: float, cell_m: float, rows: int, cols: int, scales: int = 8) -> list[float]:
    """Log-spaced radii in cells, at least 2 and at most what the grid holds."""
    low = max(2.0, d_min / 2 / cell_m)
    high = min(max(d_max / 2 / cell_m, low + 1), min(rows, cols) / 2 - 2)
    return [math.exp(math.log(low) + (math.log(high) - math.log(low)) * k / max(1, scales - 1)) for k in range(scales)]


def centres(cells: DataFrame, rs: list[float]) -> DataFrame:
    """row, col, r: cells on each radius' stride of a third of it."""
    sizes = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("r"), F.lit(max(1, int(r / 3))).alias("stride")) for r in rs]))
    out = cells.select("row", "col", sizes.alias("s"))
    return out.where((F.col("row") % F.col("s.stride") == 0) & (F.col("col") % F.col("s.stride") == 0)).select("row", "col", "s.r")


def ring_samples(cells: DataFrame, at: DataFrame, points: list[tuple[str, float, float]], z: str = "z") -> DataFrame:
    """row, col, r, kind, k, value: bilinear values at centre + r * (dr, dc); null where one of the four cells is missing.

    points: kind, dr, dc in radii.  Each point looks up its four cells by one equality join.
    """
    arr = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (kind, dr, dc) in enumerate(points)])
    s = at.withColumn("p", F.explode(arr)).select("row", "col", "r", "p.kind", "p.k", (F.col("row") + F.col("r") * F.col("p.dr")).alias("y"), (F.col("col") + F.col("r") * F.col("p.dc")).alias("x"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    s = s.withColumn("c", corner)
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    w = F.when(F.col("c.i") == 1, fy).otherwise(1 - fy) * F.when(F.col("c.j") == 1, fx).otherwise(1 - fx)
    s = s.withColumn("w", w).withColumn("__r", (F.floor("y") + F.col("c.i")).cast("int")).withColumn("__c", (F.floor("x") + F.col("c.j")).cast("int"))
    near = cells.where(F.col(z).isNotNull()).select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(z).alias("__z"))
    got = s.join(near, ["__r", "__c"]).groupBy("row", "col", "r", "kind", "k").agg(F.sum(F.col("w") * F.col("__z")).alias("value"), F.count("*").alias("n"))
    return got.where("n = 4").drop("n")


def dem_candidates(cells: DataFrame, rs: list[float], azimuths: int = 16, threshold: float = 0.3, z: str = "z") -> DataFrame:
    """row, col, r, confidence: tanh of the rim's height over the floor in units of the rim's deviation."""
    ring = [(kind, f * math.sin(2 * math.pi * k / azimuths), f * math.cos(2 * math.pi * k / azimuths)) for kind, f in (("rim", 1.0), ("inner", 0.5)) for k in range(azimuths)]
    v = ring_samples(cells, centres(cells, rs), ring, z)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("value"))
    g = v.groupBy("row", "col", "r").agg(F.count(of("rim")).alias("nr"), F.count(of("inner")).alias("ni"), F.avg(of("rim")).alias("rim"), F.avg(of("inner")).alias("inner"), F.stddev_pop(of("rim")).alias("sd"))
    g = g.where((F.col("nr") >= azimuths // 2) & (F.col("ni") >= azimuths // 4) & (F.col("rim") > F.col("inner")))
    return g.select("row", "col", "r", F.tanh((F.col("rim") - F.col("inner")) / (F.col("sd") + 0.5) / 3).alias("confidence")).where(F.col("confidence") >= threshold)


def image_candidates(cells: DataFrame, rs: list[float], sun_azimuth: float, threshold: float = 0.3, arc: int = 9, z: str = "z") -> DataFrame:
    """row, col, r, confidence: a bright arc to the sun, a dark one opposite, an even floor.

    sun_azimuth: degrees clockwise from north.
    """
    sun = math.radians(90 - sun_azimuth)
    spread = [(k - (arc - 1) / 2) * (math.pi / 3) / (arc - 1) for k in range(arc)]
    ring = [("bright", -math.sin(sun + d), math.cos(sun + d)) for d in spread] + [("dark", math.sin(sun + d), -math.cos(sun + d)) for d in spread]
    ring += [("inner", 0.4 * math.sin(k * math.pi / 2), 0.4 * math.cos(k * math.pi / 2)) for k in range(4)]
    v = ring_samples(cells, centres(cells, rs), ring, z)
    of = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("value"))
    g = v.groupBy("row", "col", "r").agg(F.avg(of("bright")).alias("b"), F.avg(of("dark")).alias("d"), F.avg(of("inner")).alias("i"), F.stddev_pop(of("bright", "dark")).alias("sd"), F.count("*").alias("n"))
    g = g.where((F.col("n") == 2 * arc + 4) & (F.col("sd") > 0))
    s1, s2 = (F.col("b") - F.col("d")) / F.col("sd"), ((F.col("b") + F.col("d")) / 2 - F.col("i")) / F.col("sd")
    return g.where(s1 > 0).select("row", "col", "r", F.tanh((s1 + 0.5 * F.greatest(F.lit(0.0), s2)) / 3).alias("confidence")).where(F.col("confidence") >= threshold)


def pair_detections(dem: DataFrame, image: DataFrame, least: float = 0.3) -> DataFrame:
    """dem_id, image_id, iou: each DEM candidate by falling confidence takes the best free image candidate with IoU above least.

    Overlapping candidates form neighbourhoods that don't touch; each is settled by itself.
    """
    from .connectivity import label
    from .craters import overlapping

    reach = 2 * max(dem.agg(F.max("radius")).first()[0] or 1.0, image.agg(F.max("radius")).first()[0] or 1.0)
    both = overlapping(dem, image, reach).where(F.col("iou") > least).select("a_id", "b_id", "a_confidence", "iou")
    # image ids as negative numbers, so that both kinds are nodes of one graph
    groups = label(both.select(F.col("a_id").alias("a"), (-F.col("b_id") - 1).alias("b"))).withColumnRenamed("node", "a_id")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, g in pdf.sort_values(["a_confidence", "a_id"], ascending=[False, True]).groupby("a_id", sort=False):
            free = g[~g.b_id.isin(used)].sort_values(["iou", "b_id"], ascending=[False, True])
            if len(free):
                best = free.iloc[0]
                used.add(best.b_id)
                out.append((int(best.a_id), int(best.b_id), float(best.iou)))
        return pd.DataFrame(out, columns=["dem_id", "image_id", "iou"])

    return both.join(groups, "a_id").groupBy("component").applyInPandas(settle, "dem_id long, image_id long, iou double")


#: Fixed search of a refinement: positions on each axis, span of the centre and of the radius in radii.
REFINE_STEPS, CENTRE_SPAN, RADIUS_SPAN = 7, 1 / 3, 0.15


def refine(cells: DataFrame, candidates: DataFrame, azimuths: int = 16, z: str = "z", methods: tuple[str, ...] = ("dem", "merged")) -> DataFrame:
    """candidates (id, cx, cy, radius in cells, method, ...) moved to the best rim near them.

    A grid of centres and radii around each candidate is scored by the rim's height over the floor in units of the rim's deviation
    plus a half; the best score wins, the place where it stands on a tie.  Other methods, radii below two cells, and candidates without
    a rim stay.  Each candidate meets the tiles around it, whatever the size of the grid.
    """
    from .rays import BATCH_BYTES, extent, tiles

    cells.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    box = extent(cells)
    side = max(8, min(64, max(box[1] - box[0], box[3] - box[2]) + 1))
    span = F.col("radius") * (1 + RADIUS_SPAN + CENTRE_SPAN) + 2
    tiles_of = lambda c: F.sequence(F.floor((F.col(c) - span) / side).cast("int"), F.floor((F.col(c) + span) / side).cast("int"))
    wanted = candidates.where(F.col("method").isin(*methods) & (F.col("radius") >= 2)).select("id", F.col("cx").alias("x0"), F.col("cy").alias("y0"), F.col("radius").alias("r0"), F.explode(tiles_of("cy")).alias("ty"), tiles_of("cx").alias("txs"))
    near = wanted.withColumn("tx", F.explode("txs")).drop("txs").join(tiles(cells, side, z).select("ty", "tx", "z"), ["ty", "tx"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        first_y, first_x = pdf.ty.min(), pdf.tx.min()
        grid = np.full(((pdf.ty.max() - first_y + 1) * side + 1, (pdf.tx.max() - first_x + 1) * side + 1), np.nan)
        for ty, tx, raw in zip(pdf.ty, pdf.tx, pdf.z):
            y, x = (ty - first_y) * side, (tx - first_x) * side
            grid[y : y + side, x : x + side] = np.frombuffer(raw, float).reshape(side + 1, side + 1)[:side, :side]
        x0, y0, r0 = (float(pdf[c].iloc[0]) for c in ("x0", "y0", "r0"))
        step = np.linspace(-1, 1, REFINE_STEPS)
        r, y, x = (g.ravel() for g in np.meshgrid(r0 * (1 + RADIUS_SPAN * step), y0 + r0 * CENTRE_SPAN * step, x0 + r0 * CENTRE_SPAN * step, indexing="ij"))
        r, y, x = np.append(r0, r), np.append(y0, y), np.append(x0, x)  # where it stands comes first
        around = 2 * np.pi * np.arange(azimuths) / azimuths

        def ring(share: float):
            py = y[:, None] + share * r[:, None] * np.sin(around) - first_y * side
            px = x[:, None] + share * r[:, None] * np.cos(around) - first_x * side
            iy, ix = np.floor(py).astype(int), np.floor(px).astype(int)
            inside = (iy >= 0) & (ix >= 0) & (iy < grid.shape[0] - 1) & (ix < grid.shape[1] - 1)
            iy, ix, fy, fx = np.where(inside, iy, 0), np.where(inside, ix, 0), py - iy, px - ix
            v = (1 - fy) * ((1 - fx) * grid[iy, ix] + fx * grid[iy, ix + 1]) + fy * ((1 - fx) * grid[iy + 1, ix] + fx * grid[iy + 1, ix + 1])
            return np.where(inside, v, np.nan)

        rim, floor = ring(1.0), ring(0.5)
        n_rim, n_floor = (~np.isnan(rim)).sum(1), (~np.isnan(floor)).sum(1)
        total = lambda v: np.nansum(v, 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = total(rim) / n_rim
            height = mean - total(floor) / n_floor
            score = height / (np.sqrt(np.maximum(total(rim * rim) / n_rim - mean * mean, 0)) + 0.5)
        score[(n_rim < azimuths // 2) | (n_floor < azimuths // 4) | (r < 2) | ~(height > 0)] = -np.inf
        k = int(np.argmax(score))
        return pd.DataFrame([(int(pdf.id.iloc[0]), x[k], y[k], r[k])], columns=["id", "__x", "__y", "__r"])

    moved = near.groupBy("id").applyInPandas(search, "id long, __x double, __y double, __r double")
    new = {"cx": "__x", "cy": "__y", "radius": "__r"}
    return candidates.join(moved, "id", "left").select(*[F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in candidates.columns])


def draw(cells: DataFrame, rs: list[float], threshold: float = 0.3, image: DataFrame | None = None, sun_azimuth: float = 90.0, iou: float = 0.3, refined: bool = True, rings: bool = False, dd_map: DataFrame | None = None, dd_simple: float | None = None, body: str = "moon") -> DataFrame:
    """id, cx, cy, radius (cells), confidence, method, n_methods, dD_simple, basin_id, ring_index: the chain of the detectors.

    Candidates of the DEM (and of an image on the same grid) are suppressed by overlap, refined on the DEM, grouped into
    concentric rings if asked for, and given a depth ratio: of dd_map (row, col, dd) at the centre if in (0, 0.5], else dd_simple,
    else the body's.
    """
    from ..functions.bodies import CRATER_BODIES
    from .craters import multi_rings, suppress

    if dd_simple is not None and not 0 < dd_simple <= 0.5:
        raise ValueError("a depth ratio lies in (0, 0.5]")
    default = next((r[6] for r in CRATER_BODIES if r[0] == body.lower()), None)
    if default is None:
        raise ValueError(f"no body {body!r}")
    found = dem_candidates(cells, rs, threshold=threshold).withColumn("method", F.lit("dem"))
    if image is not None:
        found = found.unionByName(image_candidates(image, rs, sun_azimuth, threshold).withColumn("method", F.lit("image")))
    key = F.xxhash64("method", "row", "col", "r").bitwiseAND((1 << 62) - 1)
    found = found.select(key.alias("id"), F.col("col").cast("double").alias("cx"), F.col("row").cast("double").alias("cy"), F.col("r").alias("radius"), "confidence", "method")
    out = suppress(kept(found), iou)
    if refined:
        out = refine(cells, out)
    out = multi_rings(kept(out)) if rings else out.withColumn("basin_id", F.lit(None).cast("long")).withColumn("ring_index", F.lit(None).cast("int"))
    ratio = F.lit(dd_simple if dd_simple is not None else default)
    if dd_map is not None:
        at = dd_map.select(F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("dd").alias("__dd"))
        out = out.join(at, (F.floor(F.col("cy") + 0.5) == F.col("__row")) & (F.floor(F.col("cx") + 0.5) == F.col("__col")), "left")
        ratio = F.when((F.col("__dd") > 0) & (F.col("__dd") <= 0.5), F.col("__dd")).otherwise(ratio)
    return out.select("id", "cx", "cy", "radius", "confidence", "method", "n_methods", ratio.alias("dD_simple"), "basin_id", "ring_index")


def shift_between(pair: DataFrame, by: str = "tile", a: str = "a", b: str = "b", window: bool = True) -> DataFrame:
    """by, drow, dcol, peak: the shift of b against a in each tile, by phase correlation with a parabola through the peak.

    A tile is one task's grid; nulls count as the tile's mean.
    """

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        r, c = pdf.row - pdf.row.min(), pdf.col - pdf.col.min()
        shape = (r.max() + 1, c.max() + 1)
        grids = []
        for name in (a, b):
            g = np.full(shape, np.nan)
            g[r, c] = pdf[name].astype(float)
            g = np.where(np.isnan(g), np.nanmean(g), g) - np.nanmean(g)
            grids.append(g * np.outer(np.hanning(shape[0] + 2)[1:-1], np.hanning(shape[1] + 2)[1:-1]) if window else g)
        f = np.fft.fft2(grids[0]).conj() * np.fft.fft2(grids[1])
        p = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real
        y, x = np.unravel_index(p.argmax(), shape)
        near = lambda i, j: p[i % shape[0], j % shape[1]]

        def peak(m, z, q):
            d = m - 2 * z + q
            return 0.0 if abs(d) < 1e-12 else 0.5 * (m - q) / d

        dy, dx = y + peak(near(y - 1, x), near(y, x), near(y + 1, x)), x + peak(near(y, x - 1), near(y, x), near(y, x + 1))
        wrap = lambda v, n: v - n if v > n / 2 else v
        return pd.DataFrame({by: [pdf[by].iloc[0]], "drow": [wrap(dy, shape[0])], "dcol": [wrap(dx, shape[1])], "peak": [p.max()]})

    return pair.groupBy(by).applyInPandas(correlate, f"{by} {pair.schema[by].dataType.simpleString()}, drow double, dcol double, peak double")


def photoclinometry(tiles: DataFrame, sun: tuple[float, float, float], by: str = "tile", albedo: float = 1.0, smooth: float = 0.1, rounds: int = 200, z: str = "z", seed: str | None = None) -> DataFrame:
    """by, row, col, height: shape from shading of each tile under a Lambert surface.

    Gradients relax against the brightness equation (numerical derivatives, step 1e-3), are summed
    along row and column paths, averaged, and moved to the mean of the seed heights.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["row", "col"])
        shape = (pdf.row.nunique(), pdf.col.nunique())
        img = pdf[z].to_numpy(float).reshape(shape)
        s = np.array(sun) / np.linalg.norm(sun)
        shade = lambda p, q: np.maximum(0, (-p * s[0] - q * s[1] + s[2]) / np.sqrt(1 + p * p + q * q))
        p, q, d = np.zeros(shape), np.zeros(shape), 1e-3
        around = lambda g: (np.pad(g, 1, "edge")[1:-1, :-2] + np.pad(g, 1, "edge")[1:-1, 2:] + np.pad(g, 1, "edge")[:-2, 1:-1] + np.pad(g, 1, "edge")[2:, 1:-1]) / 4
        for _ in range(rounds):
            pm, qm = around(p), around(q)
            fp, fq = (shade(pm + d, qm) - shade(pm - d, qm)) / (2 * d), (shade(pm, qm + d) - shade(pm, qm - d)) / (2 * d)
            off = np.where(np.isnan(img), 0, shade(pm, qm) - img / albedo) / (fp * fp + fq * fq + smooth**2)
            p, q = pm - fp * off, qm - fq * off
        first = np.cumsum(p, 1) + np.cumsum(q, 0)[:, :1]
        second = np.cumsum(q, 0) + np.cumsum(p, 1)[:1]
        h = (first + second) / 2
        h += (np.nanmean(pdf[seed]) if seed else 0.0) - h.mean()
        return pd.DataFrame({by: pdf[by].to_numpy(), "row": pdf.row.to_numpy(), "col": pdf.col.to_numpy(), "height": h.ravel()})

    return tiles.groupBy(by).applyInPandas(solve, f"{by} {tiles.schema[by].dataType.simpleString()}, row int, col int, height double")
