"""The raster model: one row per cell (row, col, z), a region beside it, null for no data (never NaN)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..catalogue import table


@dataclass(frozen=True)
class Region:
    """Rows, columns, upper-left corner and cell sizes of a computational region."""

    rows: int
    cols: int
    north: float
    west: float
    ns_res: float = 1.0
    ew_res: float = 1.0

    def east(self, col: Column) -> Column:
        return self.west + (col + 0.5) * self.ew_res

    def northing(self, row: Column) -> Column:
        return self.north - (row + 0.5) * self.ns_res

    def cell_of(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) of the cell that a point falls in."""
        return F.floor((self.north - y) / self.ns_res).cast("int"), F.floor((x - self.west) / self.ew_res).cast("int")


def no_nan(c: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def align(*maps: DataFrame) -> DataFrame:
    """Inner cell join of maps that share row and col; other columns must differ."""
    out = maps[0]
    for m in maps[1:]:
        out = out.join(m, ["row", "col"])
    return out


def to_bands(cells: DataFrame, band: str = "band", value: str = "value") -> DataFrame:
    """(row, col, band, value) -> (row, col, bands): array in band order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(band), F.col(value))))
    return cells.groupBy("row", "col").agg(F.transform(packed, lambda x: x[value]).alias("bands"))


def to_long(cells: DataFrame, bands: str = "bands") -> DataFrame:
    """(row, col, bands) -> (row, col, band, value), bands numbered from 1."""
    return cells.select("row", "col", F.posexplode(bands).alias("band", "value")).withColumn("band", F.col("band") + 1)


def sample_at(points: DataFrame, cells: DataFrame, region: Region, x: str = "x", y: str = "y") -> DataFrame:
    """points with the columns of the cell that each falls in; points outside keep nulls."""
    row, col = region.cell_of(F.col(x), F.col(y))
    return points.withColumn("row", row).withColumn("col", col).join(cells, ["row", "col"], "left")


#: A grid from lineitem: 40 x 50 cells, one value each.
CELLS_SQL = "SELECT CAST(l_suppkey % 40 AS INT) AS row, CAST(l_partkey % 50 AS INT) AS col, sum(l_quantity) / count(*) AS z, sum(l_linenumber) / count(*) AS w FROM lineitem GROUP BY 1, 2"


def cells_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.expr("cast(l_suppkey % 40 as int)").alias("row"), F.expr("cast(l_partkey % 50 as int)").alias("col")).agg(
        (F.sum("l_quantity") / F.count("*")).alias("z"), (F.sum("l_linenumber") / F.count("*")).alias("w")
    )
