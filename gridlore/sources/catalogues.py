"""Catalogue tables, JSON reports, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Fixed positions of the crater catalogue's columns.
CRATER_COLUMNS = {0: ("crater_name", "string"), 1: ("diameter_km", "double"), 2: ("lat", "double"), 4: ("east_lon", "double"), 6: ("radius_m", "double"), 12: ("depth_km", "double"), 16: ("rim_height_km", "double"), 50: ("age", "string"), 51: ("age_class", "int")}

SIDECAR = "schema_version string, data_type string, sensor string, radiometric_quantity string, n_bands int, wavelengths array<double>, fwhm array<double>, validity array<boolean>, body string, mission string, processing_history array<struct<command:string,timestamp:string,inputs:array<string>,outputs:array<string>>>"


def read_catalogue(spark: SparkSession, path: str, columns: dict[int, tuple[str, str]] = CRATER_COLUMNS, header: bool = True) -> DataFrame:
    """Columns of a CSV by position; comment lines (#) are skipped, bad numbers become null."""
    width = max(columns) + 1
    raw = spark.read.option("comment", "#").option("header", header).schema(T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(width)])).option("enforceSchema", True).csv(path)
    return raw.select(*[F.trim(F.col(f"_{k}")).try_cast(kind).alias(name) for k, (name, kind) in columns.items()])


def layer(x: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return x * scale + offset


def inside_box(lon: Column, lat: Column, west: float, east: float, south: float, north: float) -> Column:
    """A point in a box; west > east wraps the date line."""
    across = (lon >= west) | (lon <= east) if west > east else lon.between(west, east)
    return lat.between(south, north) & across


def boxes_meet(boxes: DataFrame, west: float, east: float, south: float, north: float) -> DataFrame:
    """Rows (west, east, south, north) that meet a box; either may wrap: a wrapped span is split in two."""
    spans = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    own = F.when(F.col("west") <= F.col("east"), F.array(F.struct(F.col("west").alias("w"), F.col("east").alias("e")))).otherwise(
        F.array(F.struct(F.col("west").alias("w"), F.lit(180.0).alias("e")), F.struct(F.lit(-180.0).alias("w"), F.col("east").alias("e")))
    )
    hit = lambda s: (s["w"] <= spans[0][1]) & (s["e"] >= spans[0][0]) if len(spans) == 1 else ((s["w"] <= spans[0][1]) & (s["e"] >= spans[0][0])) | ((s["w"] <= spans[1][1]) & (s["e"] >= spans[1][0]))
    return boxes.where(F.exists(own, hit) & (F.col("south") <= north) & (F.col("north") >= south))


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(SIDECAR).json(path)


def write_report(candidates: DataFrame, path: str) -> None:
    """One JSON object for each region with its candidates by rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", *[c for c in candidates.columns if c not in ("rank", "region")])))
    candidates.groupBy("region").agg(F.count("*").alias("n_candidates"), rows.alias("candidates")).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).select("region", F.inline("candidates"))
