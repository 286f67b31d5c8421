"""Spectral libraries: plain-text spectra to one table, and the table to two-column files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: No-data values of published libraries lie within FLAG_REACH of FLAG (fixed value of their format).
FLAG, FLAG_REACH = -1.23e34, 1e30


def _lines(text: Column, skip: int) -> Column:
    """The lines that hold something, without the first skip ones."""
    return F.filter(F.slice(F.split(text, "\r?\n"), skip + 1, 1 << 30), lambda x: F.trim(x) != "")


def read_axis(spark: SparkSession, path: str, skip: int = 1) -> list[float]:
    """The wavelengths of a file with one value a line: the axis of an instrument, some thousands at most."""
    values = spark.read.text(path, wholetext=True).select(F.transform(_lines(F.col("value"), skip), lambda x: F.trim(x).try_cast("double")).alias("v"))
    return list(values.first()["v"])


def read_single(spark: SparkSession, path: str | list[str], axis: list[float], skip: int = 1) -> DataFrame:
    """path, wavelengths, values of files with one value a line on a common axis; flagged and unreadable values are null."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.transform(_lines(F.col("value"), skip), lambda x: F.trim(x).try_cast("double")).alias("values"))
    clean = F.transform("values", lambda v: F.when(F.abs(v - FLAG) >= FLAG_REACH, v))
    return raw.select("path", F.array(*[F.lit(float(w)) for w in axis]).alias("wavelengths"), clean.alias("values"))


def read_pairs(spark: SparkSession, path: str | list[str], skip: int = 2) -> DataFrame:
    """path, wavelengths, values of files with wavelength and value (and more) in columns; lines that hold less are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), _lines(F.col("value"), skip).alias("lines"))
    pairs = F.transform("lines", lambda x: F.struct(F.get(F.split(F.trim(x), r"[\s,]+"), 0).try_cast("double").alias("w"), F.get(F.split(F.trim(x), r"[\s,]+"), 1).try_cast("double").alias("v")))
    good = raw.select("path", F.filter(pairs, lambda p: p["w"].isNotNull() & p["v"].isNotNull()).alias("p"))
    return good.select("path", F.col("p.w").alias("wavelengths"), F.col("p.v").alias("values"))


def build(spectra: DataFrame, names: DataFrame) -> DataFrame:
    """name, class, source, wavelengths, values of spectra whose path ends in a registered file (columns file, name, class, source); points without a value are left out."""
    file = F.element_at(F.split("path", "/"), -1)
    points = F.filter(F.arrays_zip("wavelengths", "values"), lambda p: p["values"].isNotNull() & ~F.isnan(p["values"]))
    out = spectra.withColumn("file", file).join(names, "file").withColumn("p", points)
    return out.select("name", "class", "source", F.col("p.wavelengths").alias("wavelengths"), F.col("p.values").alias("values"))


def resample(library: DataFrame, wavelengths: list[float]) -> DataFrame:
    """name, class, bands: each spectrum at a sensor's wavelengths, linear between its points (in rising order), null beyond its ends."""

    def value(w: float) -> Column:
        below = F.filter(F.arrays_zip("wavelengths", "values"), lambda p: p["wavelengths"] <= w)
        above = F.filter(F.arrays_zip("wavelengths", "values"), lambda p: p["wavelengths"] >= w)
        a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
        span = b["wavelengths"] - a["wavelengths"]
        return F.when(span == 0, a["values"]).otherwise(a["values"] + (b["values"] - a["values"]) * (w - a["wavelengths"]) / span)

    return library.select("name", "class", F.array(*[value(float(w)) for w in wavelengths]).alias("bands"))


def as_csv(library: DataFrame) -> DataFrame:
    """name, value: the text of each spectrum's file, a comment line, a header, and a line for each point."""
    head = F.concat(F.lit("# name="), "name", F.lit("  source="), "source", F.lit("  class="), "class")
    rows = F.transform(F.arrays_zip("wavelengths", "values"), lambda p: F.format_string("%.6f,%.8f", p["wavelengths"], p["values"]))
    return library.select("name", F.concat_ws("\n", F.array(head, F.lit("wavelength_um,reflectance")), rows).alias("value"))


def write(library: DataFrame, path: str) -> None:
    """One folder for each name, with one file in it, from the tasks."""
    as_csv(library).write.mode("overwrite").partitionBy("name").text(path)
