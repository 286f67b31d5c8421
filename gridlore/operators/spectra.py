"""Spectra: a spectrum is array<double> by band; wavelengths are a list shared by all rows.

Wavelengths ascend within a section; the weights of an interpolation depend on the wavelengths alone
and are worked out on the driver, so a row only multiplies two of its elements.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, functions as F

#: Index name, body, mode, centre(s), left or numerator, right or denominator (micrometres).
INDICES = [
    ("olivine", "any", "BD", 1.05, 0.75, 1.55),
    ("pyroxene", "any", "BD", 2.0, 1.5, 2.5),
    ("tio2", "any", "RATIO", None, 0.415, 0.750),
    ("feo", "any", "RATIO", None, 0.950, 0.750),
    ("mafic", "any", "IBD", (1.05, 2.0), 0.75, 2.5),
    ("ibd1000", "moon", "IBD", (0.82, 1.19), 0.749, 1.309),
    ("ibd2000", "moon", "IBD", (1.66, 2.50), 1.579, 2.499),
    ("r1580_1250", "moon", "RATIO", None, 1.58, 1.25),
    ("bd2800", "moon", "BD", 2.8, 2.5, 3.1),
    ("r749_433", "mercury", "RATIO", None, 0.749, 0.433),
    ("r996_749", "mercury", "RATIO", None, 0.996, 0.749),
    ("spec_slope", "mercury", "SLOPE", None, 0.433, 0.996),
    ("r500_200", "titan", "RATIO", None, 5.0, 2.0),
    ("r280_200", "titan", "RATIO", None, 2.8, 2.0),
    ("r159_127", "titan", "RATIO", None, 1.59, 1.27),
    ("r1740_1300", "venus", "RATIO", None, 1.74, 1.30),
    ("r1180_1100", "venus", "RATIO", None, 1.18, 1.10),
    ("bd2300", "venus", "BD", 2.3, 2.0, 2.55),
]
#: Entries of a spectral library that are broadcast.
BROADCAST_ENTRIES = 10_000
#: Centres of an integrated band depth over a range.
IBD_POINTS = 10


def sections(wavelengths: list[float]) -> list[list[int]]:
    """Band numbers split where the wavelengths turn."""
    out: list[list[int]] = []
    up = None
    for b, w in enumerate(wavelengths):
        if out and (up is None or (w > wavelengths[b - 1]) == up) and w != wavelengths[b - 1]:
            up = w > wavelengths[b - 1]
            out[-1].append(b)
        else:
            out.append([b])
            up = None
    return out


def nearest_band(wavelengths: list[float], w: float) -> int:
    """Number of the nearest band; the first of equals."""
    return min(range(len(wavelengths)), key=lambda b: (abs(wavelengths[b] - w), b))


def at(bands: Column, wavelengths: list[float], w: float) -> Column:
    """Linear interpolation; clamps at the ends."""
    if w <= wavelengths[0]:
        return F.element_at(bands, 1)
    if w >= wavelengths[-1]:
        return F.element_at(bands, len(wavelengths))
    k = bisect_left(wavelengths, w)
    if wavelengths[k] == w:
        return F.element_at(bands, k + 1)
    part = (w - wavelengths[k - 1]) / (wavelengths[k] - wavelengths[k - 1])
    return F.element_at(bands, k) * (1 - part) + F.element_at(bands, k + 1) * part


def ratio(bands: Column, wavelengths: list[float], a: float, b: float) -> Column:
    low = at(bands, wavelengths, b)
    return F.when(low != 0, at(bands, wavelengths, a) / low)


def band_depth(bands: Column, wavelengths: list[float], centre: float, left: float, right: float) -> Column:
    """1 - R(centre) / continuum; null where the continuum isn't positive."""
    part = (centre - left) / (right - left)
    cont = at(bands, wavelengths, left) * (1 - part) + at(bands, wavelengths, right) * part
    return F.when(cont > 0, 1 - at(bands, wavelengths, centre) / cont)


def multi_band_depth(bands: Column, wavelengths: list[float], centres: list[float], left: float, right: float, weights: list[float] | None = None) -> Column:
    """Weighted mean of the depths that are defined."""
    depths = [band_depth(bands, wavelengths, c, left, right) for c in centres]
    w = weights or [1.0] * len(centres)
    top = bottom = F.lit(0.0)
    for d, k in zip(depths, w, strict=True):
        top, bottom = top + F.coalesce(d * k, F.lit(0.0)), bottom + F.when(d.isNotNull(), k).otherwise(0.0)
    return F.when(bottom > 0, top / bottom)


def mineral_index(bands: Column, wavelengths: list[float], name: str) -> Column:
    _, _, mode, centre, left, right = next(i for i in INDICES if i[0] == name)
    if mode == "BD":
        return band_depth(bands, wavelengths, centre, left, right)
    if mode == "RATIO":
        return ratio(bands, wavelengths, left, right)
    if mode == "SLOPE":
        low = at(bands, wavelengths, left)
        return F.when(low != 0, (at(bands, wavelengths, right) / low - 1) / (right - left))
    a, b = centre
    centres = list(centre) if name == "mafic" else [a + (b - a) * k / (IBD_POINTS - 1) for k in range(IBD_POINTS)]
    return multi_band_depth(bands, wavelengths, centres, left, right)


def indices_for(body: str) -> list[str]:
    return [i[0] for i in INDICES if i[1] in ("any", body)]


def continuum_removed(bands: Column, wavelengths: list[float], left: float, right: float) -> Column:
    """Divided by the chord inside [left, right], copied outside."""
    a, b = at(bands, wavelengths, left), at(bands, wavelengths, right)
    ws = F.array(*[F.lit(float(w)) for w in wavelengths])
    chord = lambda w: a + (b - a) * (w - left) / (right - left)
    return F.zip_with(bands, ws, lambda x, w: F.when(w.between(left, right), F.when(chord(w) != 0, x / chord(w))).otherwise(x))


def running_mean(bands: Column, half: int) -> Column:
    """Truncated running mean along the bands, nulls skipped."""
    sums = lambda a: F.aggregate(a, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda t, x: F.struct((t["s"] + F.coalesce(x, F.lit(0.0))).alias("s"), (t["n"] + x.isNotNull().cast("int")).alias("n")), lambda t: F.when(t["n"] > 0, t["s"] / t["n"]))
    return F.transform(bands, lambda _, i: sums(F.slice(bands, F.greatest(i - half + 1, F.lit(1)), F.least(i + half, F.size(bands) - 1) - F.greatest(i - half, F.lit(0)) + 1)))


def highpass(bands: Column, half: int) -> Column:
    return F.zip_with(bands, running_mean(bands, half), lambda x, m: x - m)


def divide_filter(bands: Column, half: int) -> Column:
    return F.zip_with(bands, running_mean(bands, half), lambda x, m: F.when(m != 0, x / m))


def spectral_angle(a: Column, b: Column, on_zero: str = "null") -> Column:
    """Angle between two spectra over the bands that both have.  on_zero: 'null' or 'half_pi' for a zero norm; fewer than two bands give null."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))))
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0).alias("n"))
    add = lambda t, p: F.when(p.isNull(), t).otherwise(F.struct((t["xy"] + p["x"] * p["y"]).alias("xy"), (t["xx"] + p["x"] * p["x"]).alias("xx"), (t["yy"] + p["y"] * p["y"]).alias("yy"), (t["n"] + 1).alias("n")))
    cos = lambda t: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t["xy"] / F.sqrt(t["xx"] * t["yy"])))
    flat = F.lit(None).cast("double") if on_zero == "null" else F.lit(math.pi / 2)
    return F.aggregate(pairs, zero, add, lambda t: F.when((t["n"] < 2) if on_zero == "null" else F.lit(False), None).when(t["xx"] * t["yy"] <= 0, flat).otherwise(F.acos(cos(t))))


def sam_classify(angle: Column, threshold: float) -> Column:
    return F.when(angle.isNotNull(), (angle <= threshold).cast("int")).otherwise(0)


def match_library(spectra: DataFrame, library: DataFrame, top: int, max_angle: float, key: str = "id", bands: str = "bands") -> DataFrame:
    """The top library entries of each spectrum by angle (ties by name).  library: name, ref (array).

    Every spectrum meets every entry, as the operator asks; the library is broadcast up to BROADCAST_ENTRIES entries, a larger one is
    left to the planner.
    """
    few = library.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    both = spectra.crossJoin(F.broadcast(library) if few else library).withColumn("angle", spectral_angle(F.col(bands), F.col("ref")))
    best = both.where(F.col("angle") <= max_angle).groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("angle", "name"))), 1, top).alias("m"))
    return best.select(key, F.posexplode("m").alias("rank", "m")).select(key, (F.col("rank") + 1).alias("rank"), "m.name", "m.angle")


def planck_radiance(wavelength_um: float, t: Column) -> Column:
    """W / (m2 sr um)."""
    c1, c2 = 1.191042972e8, 14387.768775
    return c1 / wavelength_um**5 / (F.exp(c2 / (wavelength_um * t)) - 1)


def brightness_temperature(bands: Column, wavelengths: list[float], low: float, high: float) -> Column:
    """Mean over the bands in [low, high] of the inverse Planck function; bands without positive radiance are left out."""
    c1, c2 = 1.191042972e8, 14387.768775
    ks = [k for k, w in enumerate(wavelengths) if low <= w <= high]
    temps = [F.when(F.element_at(bands, k + 1) > 0, c2 / wavelengths[k] / F.log(1 + c1 / wavelengths[k] ** 5 / F.element_at(bands, k + 1))) for k in ks]
    arr = F.filter(F.array(*temps), lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / F.size(arr))


def reflectance(bands: Column, wavelengths: list[float], irradiance: list[float], temperature: Column, emissivity: float = 1.0) -> Column:
    """pi (L - e B(T)) / E by band; negatives become 0."""
    return F.array(*[F.greatest(F.lit(0.0), math.pi * (F.element_at(bands, k + 1) - emissivity * planck_radiance(w, temperature)) / e) for k, (w, e) in enumerate(zip(wavelengths, irradiance, strict=True))])


def smooth3(bands: Column) -> Column:
    """Three-band moving mean; the first output averages the second and third band, the last the last two."""
    n = F.size(bands)
    return F.transform(
        bands,
        lambda x, i: F.when(i == 0, (F.element_at(bands, 2) + F.element_at(bands, 3)) / 2).when(i == n - 1, (F.element_at(bands, i) + x) / 2).otherwise((F.try_element_at(bands, i) + x + F.try_element_at(bands, i + 2)) / 3),
    )


def thin_atmosphere(value: Column, depth: Column, tau_bins: list[tuple[float, float]]) -> Column:
    """value / exp(-tau): tau by piecewise-linear look-up of a band depth in (depth, tau) bins, clamped."""
    bins = sorted(tau_bins)
    tau = F.when(depth <= bins[0][0], bins[0][1])
    for (x0, y0), (x1, y1) in zip(bins, bins[1:]):
        tau = tau.when(depth <= x1, y0 + (depth - x0) / (x1 - x0) * (y1 - y0))
    return value * F.exp(tau.otherwise(bins[-1][1]))


def thick_atmosphere(cells: DataFrame, window: str, reference: str, into: str) -> DataFrame:
    """window * median(window / reference) / (window / reference)."""
    r = F.when(F.col(reference) != 0, F.col(window) / F.col(reference))
    med = cells.agg(F.percentile(r, F.lit(0.5)).alias("__med"))
    return cells.crossJoin(F.broadcast(med)).withColumn(into, F.when(r != 0, F.col(window) * F.col("__med") / r)).drop("__med")


def match_window(wavelength: float, windows: list[tuple[float, float]], tolerance: float) -> tuple[float, float] | None:
    """Of windows (centre, reference wavelength) the nearest centre, the first of equals; None beyond the tolerance."""
    best = min(windows, key=lambda w: abs(w[0] - wavelength), default=None)
    return best if best and abs(best[0] - wavelength) <= tolerance else None


def thick_windows(cells: DataFrame, wavelengths: dict[str, float], windows: list[tuple[float, float]], tolerance: float, suffix: str = "_cor") -> DataFrame:
    """cells with each band column (name -> wavelength) corrected as by thick_atmosphere against the band nearest to its window's reference.

    A band that is no window, or whose reference no band has within the tolerance, becomes null.  All medians are one aggregate.
    """
    names = list(wavelengths)
    ratios = {}
    for b in names:
        w = match_window(wavelengths[b], windows, tolerance)
        near = w and match_window(w[1], [(wavelengths[x], i) for i, x in enumerate(names)], tolerance)
        if near:
            ref = names[near[1]]
            ratios[b] = F.when(F.col(ref) != 0, F.col(b) / F.col(ref))
    out = cells
    if ratios:
        out = cells.crossJoin(F.broadcast(cells.agg(*[F.percentile(r, F.lit(0.5)).alias(f"__med_{b}") for b, r in ratios.items()])))  # one row
    cols = [F.when(ratios[b] != 0, F.col(b) * F.col(f"__med_{b}") / ratios[b]) if b in ratios else F.lit(None).cast("double") for b in names]
    return out.select(*cells.columns, *[c.alias(b + suffix) for b, c in zip(names, cols)])


# --- components and clusters --------------------------------------------------------------------


def gram(rows: DataFrame, bands: str, n: int) -> DataFrame:
    """i, j (i <= j), n, sxy, sx, sy over complete rows, ready for a covariance: each partition multiplies its own rows, and partial sums meet."""

    def part(batches):
        import numpy as np
        import pyarrow as pa

        total, sums, count = np.zeros((n, n)), np.zeros(n), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
            total, sums, count = total + x.T @ x, sums + x.sum(0), count + len(x)
        i, j = np.triu_indices(n)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": np.full(len(i), count), "sxy": total[i, j], "sx": sums[i], "sy": sums[j]})

    full = rows.where((F.size(bands) == n) & ~F.exists(bands, lambda x: x.isNull())).select(F.col(bands).cast("array<double>").alias("b"))
    parts = full.mapInArrow(part, "i int, j int, n long, sxy double, sx double, sy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sxy", "sx", "sy")])


def pca(rows: DataFrame, bands: str, n: int, standardise: bool = False):
    """(eigenvalues falling, eigenvectors by row, variance percent, means): covariance over n - 1; each vector's largest component is positive."""
    import numpy as np

    g = gram(rows, bands, n).collect()  # n * (n + 1) / 2 rows
    count = g[0]["n"] if g else 0
    if count < n:
        raise ValueError("fewer complete rows than bands")
    cov, mean = np.zeros((n, n)), np.zeros(n)
    for r in g:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = (r["sxy"] - r["sx"] * r["sy"] / count) / (count - 1)
        mean[r["i"]] = r["sx"] / count
    if standardise:
        sd = np.sqrt(np.diag(cov))
        cov = cov / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1].T
    vectors *= np.sign(vectors[np.arange(n), np.abs(vectors).argmax(1)])[:, None]
    return values, vectors, 100 * values / values.sum(), mean


def pca_scores(rows: DataFrame, bands: str, vectors, mean, k: int, into: str = "scores") -> DataFrame:
    centre = F.array(*[F.lit(float(m)) for m in mean])
    dot = lambda v: F.aggregate(F.zip_with(F.zip_with(bands, centre, lambda x, m: x - m), F.array(*[F.lit(float(c)) for c in v]), lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn(into, F.array(*[dot(v) for v in vectors[:k]]))


def kmeans(rows: DataFrame, bands: str, k: int, iterations: int = 20, seed: int = 1) -> DataFrame:
    """rows with label (from 1), by k-means++ seeds and Lloyd steps of the ML library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = rows.withColumn("__v", array_to_vector(F.col(bands).cast("array<double>")))
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="__v", predictionCol="__p").fit(x)
    return model.transform(x).withColumn("label", F.col("__p") + 1).drop("__v", "__p")
