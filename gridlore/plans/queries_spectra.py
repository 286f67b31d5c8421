"""Spectral queries: embeddings serve as spectra of 64 bands between 0.4 and 2.92 micrometres."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query, table
from ..operators import spectra as S

WAVES = [round(0.4 + 0.04 * k, 2) for k in range(64)]
SPEC = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 1) AS b, label FROM embeddings)"


def _spec(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 1).alias("b"), "label")


def _at(w):
    if w <= WAVES[0]:
        return "b[1]"
    if w >= WAVES[-1]:
        return "b[64]"
    k = next(i for i, x in enumerate(WAVES) if x >= w)
    if WAVES[k] == w:
        return f"b[{k + 1}]"
    part = (w - WAVES[k - 1]) / (WAVES[k] - WAVES[k - 1])
    return f"(b[{k}] * {1 - part!r} + b[{k + 1}] * {part!r})"


def _row(name, f, sql):
    query(name, f"SELECT vec_id, round({sql}, 6) AS v FROM {SPEC}")(lambda spark, sf: _spec(spark, sf).select("vec_id", F.round(f(F.col("b")), 6).alias("v")))


def _depth(c, a, z):
    p = (c - a) / (z - a)
    cont = f"({_at(a)} * {1 - p!r} + {_at(z)} * {p!r})"
    return f"CASE WHEN {cont} > 0 THEN 1 - {_at(c)} / {cont} END"


_row("spectrum_interpolate", lambda b: S.at(b, WAVES, 1.237), _at(1.237))
_row("band_ratio", lambda b: S.ratio(b, WAVES, 0.95, 0.75), f"CASE WHEN {_at(0.75)} <> 0 THEN {_at(0.95)} / {_at(0.75)} END")
_row("band_depth", lambda b: S.band_depth(b, WAVES, 1.05, 0.75, 1.55), _depth(1.05, 0.75, 1.55))
_two = [_depth(c, 0.75, 2.5) for c in (1.05, 2.0)]
_row("band_depth_multi", lambda b: S.mineral_index(b, WAVES, "mafic"), f"(coalesce({_two[0]}, 0) + coalesce({_two[1]}, 0)) / nullif((CASE WHEN {_two[0]} IS NULL THEN 0 ELSE 1 END) + (CASE WHEN {_two[1]} IS NULL THEN 0 ELSE 1 END), 0)")
_row("index_slope", lambda b: S.mineral_index(b, WAVES, "spec_slope"), f"CASE WHEN {_at(0.433)} <> 0 THEN ({_at(0.996)} / {_at(0.433)} - 1) / {0.996 - 0.433!r} END")
_row("index_tio2", lambda b: S.mineral_index(b, WAVES, "tio2"), f"CASE WHEN {_at(0.75)} <> 0 THEN {_at(0.415)} / {_at(0.75)} END")


def _index_sql(name):
    _, _, mode, centre, left, right = next(i for i in S.INDICES if i[0] == name)
    if mode == "BD":
        return _depth(centre, left, right)
    if mode == "RATIO":
        return f"CASE WHEN {_at(right)} <> 0 THEN {_at(left)} / {_at(right)} END"
    centres = centre if name == "mafic" else [centre[0] + (centre[1] - centre[0]) * k / 9 for k in range(10)]
    return f"list_avg([{', '.join(_depth(c, left, right) for c in centres)}])"


@query("mineral_indices_moon", f"SELECT vec_id, {', '.join(f'round({_index_sql(n)}, 6) AS {n}' for n in S.indices_for('moon'))} FROM {SPEC}")
def mineral_indices_moon(spark, sf):
    return _spec(spark, sf).select("vec_id", *[F.round(S.mineral_index(F.col("b"), WAVES, n), 6).alias(n) for n in S.indices_for("moon")])


_mean = "(SELECT list_avg(b[greatest(k - 3, 1):least(k + 3, 64)]))"


@query("spectrum_highpass", f"SELECT vec_id, k AS band, round(b[k] - list_avg(b[greatest(k - 3, 1):least(k + 3, 64)]), 6) AS v FROM {SPEC}, range(1, 65) t(k)")
def spectrum_highpass(spark, sf):
    out = _spec(spark, sf).select("vec_id", F.posexplode(S.highpass(F.col("b"), 3)).alias("band", "v"))
    return out.select("vec_id", (F.col("band") + 1).cast("long").alias("band"), F.round("v", 6).alias("v"))


@query("spectrum_divfilter", f"SELECT vec_id, k AS band, round(CASE WHEN list_avg(b[greatest(k - 3, 1):least(k + 3, 64)]) <> 0 THEN b[k] / list_avg(b[greatest(k - 3, 1):least(k + 3, 64)]) END, 5) AS v FROM {SPEC}, range(1, 65) t(k)")
def spectrum_divfilter(spark, sf):
    out = _spec(spark, sf).select("vec_id", F.posexplode(S.divide_filter(F.col("b"), 3)).alias("band", "v"))
    return out.select("vec_id", (F.col("band") + 1).cast("long").alias("band"), F.round("v", 5).alias("v"))


@query("spectrum_continuum", f"SELECT vec_id, k AS band, round(CASE WHEN 0.4 + 0.04 * (k - 1) BETWEEN 0.75 - 1e-9 AND 1.55 + 1e-9 THEN b[k] / ({_at(0.75)} + ({_at(1.55)} - {_at(0.75)}) * (round(0.4 + 0.04 * (k - 1), 2) - 0.75) / 0.8) ELSE b[k] END, 5) AS v FROM {SPEC}, range(1, 65) t(k)")
def spectrum_continuum(spark, sf):
    out = _spec(spark, sf).select("vec_id", F.posexplode(S.continuum_removed(F.col("b"), WAVES, 0.75, 1.55)).alias("band", "v"))
    return out.select("vec_id", (F.col("band") + 1).cast("long").alias("band"), F.round("v", 5).alias("v"))


REF = "(SELECT vec_id AS name, embedding AS ref FROM embeddings WHERE vec_id < 20)"
ANGLE = "acos(greatest(-1, least(1, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(r.ref AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(r.ref AS DOUBLE[]), CAST(r.ref AS DOUBLE[]))))))"


@query("sam_angle", f"SELECT e.vec_id, round({ANGLE}, 6) AS angle FROM embeddings e, {REF} r WHERE r.name = 0 AND e.vec_id > 0")
def sam_angle(spark, sf):
    e = table(spark, sf, "embeddings")
    ref = e.where("vec_id = 0").select(F.col("embedding").alias("ref"))
    return e.where("vec_id > 0").crossJoin(F.broadcast(ref)).select("vec_id", F.round(S.spectral_angle(F.col("embedding"), F.col("ref"), "half_pi"), 6).alias("angle"))


@query("sam_class", f"SELECT e.vec_id, CAST(CASE WHEN {ANGLE} <= 1.5 THEN 1 ELSE 0 END AS INT) AS class FROM embeddings e, {REF} r WHERE r.name = 0 AND e.vec_id > 0")
def sam_class(spark, sf):
    e = table(spark, sf, "embeddings")
    ref = e.where("vec_id = 0").select(F.col("embedding").alias("ref"))
    return e.where("vec_id > 0").crossJoin(F.broadcast(ref)).select("vec_id", S.sam_classify(S.spectral_angle(F.col("embedding"), F.col("ref")), 1.5).alias("class"))


@query("sam_topn", f"SELECT vec_id, rank, name, round(angle, 6) AS angle FROM (SELECT e.vec_id, r.name, {ANGLE} AS angle, CAST(row_number() OVER (PARTITION BY e.vec_id ORDER BY {ANGLE}, r.name) AS INT) AS rank FROM embeddings e, {REF} r WHERE e.vec_id >= 20 AND {ANGLE} <= 1.6) WHERE rank <= 3")
def sam_topn(spark, sf):
    e = table(spark, sf, "embeddings")
    lib = e.where("vec_id < 20").select(F.col("vec_id").alias("name"), F.col("embedding").alias("ref"))
    return S.match_library(e.where("vec_id >= 20").select("vec_id", "embedding"), lib, 3, 1.6, "vec_id", "embedding").withColumn("angle", F.round("angle", 6))


@query("pca_gram", "SELECT i, j, count(*) AS n, round(sum(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE)), 6) AS sxy FROM embeddings, (SELECT CAST(range AS INT) AS i FROM range(64)) a, (SELECT CAST(range AS INT) AS j FROM range(64)) b WHERE i <= j GROUP BY i, j")
def pca_gram(spark, sf):
    return S.gram(table(spark, sf, "embeddings").select(F.col("embedding").alias("b")), "b", 64).select("i", "j", "n", F.round("sxy", 6).alias("sxy"))


@query("pca_variance")
def pca_variance(spark, sf):
    values, _, percent, _ = S.pca(table(spark, sf, "embeddings").select(F.col("embedding").alias("b")), "b", 64)
    return spark.createDataFrame([(k + 1, float(v), float(p)) for k, (v, p) in enumerate(zip(values, percent))], "pc int, eigenvalue double, variance_pct double")


@query("kmeans_sizes")
def kmeans_sizes(spark, sf):
    return S.kmeans(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 5).groupBy("label").agg(F.count("*").alias("n"))


@query("iirs_smooth", f"SELECT vec_id, k AS band, round(CASE WHEN k = 1 THEN (b[2] + b[3]) / 2 WHEN k = 64 THEN (b[63] + b[64]) / 2 ELSE (b[k - 1] + b[k] + b[k + 1]) / 3 END, 6) AS v FROM {SPEC}, range(1, 65) t(k)")
def iirs_smooth(spark, sf):
    out = _spec(spark, sf).select("vec_id", F.posexplode(S.smooth3(F.col("b"))).alias("band", "v"))
    return out.select("vec_id", (F.col("band") + 1).cast("long").alias("band"), F.round("v", 6).alias("v"))


def _temperature_sql(low, high):
    """Mean inverse Planck temperature over the bands of that range with positive radiance."""
    c1, c2 = 1.191042972e8, 14387.768775
    some = ", ".join(f"CASE WHEN b[{k + 1}] > 0 THEN {c2 / w!r}::DOUBLE / ln(1 + {c1 / w**5!r}::DOUBLE / b[{k + 1}]) END" for k, w in enumerate(WAVES) if low <= w <= high)
    return f"list_avg([{some}])"


@query("thermal_temperature", f"SELECT vec_id, round({_temperature_sql(2.5, 2.9)}, 4) AS t FROM {SPEC}")
def thermal_temperature(spark, sf):
    return _spec(spark, sf).select("vec_id", F.round(S.brightness_temperature(F.col("b"), WAVES, 2.5, 2.9), 4).alias("t"))


@query("atmosphere_thick", "SELECT p_partkey, round(CASE WHEN r <> 0 THEN w * (SELECT median(p_retailprice / p_size) FROM part) / r END, 6) AS v FROM (SELECT p_partkey, p_retailprice AS w, p_retailprice / p_size AS r FROM part)")
def atmosphere_thick(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("size"))
    return S.thick_atmosphere(p, "p_retailprice", "size", "v").select("p_partkey", F.round("v", 6).alias("v"))
