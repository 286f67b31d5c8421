"""Elevation tiles to one map."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Heights whose largest is below this are taken for kilometres.
KM_BELOW = 50.0


def in_metres(tiles: DataFrame, tile: str = "tile", z: str = "z") -> DataFrame:
    """tiles with z in metres: a tile whose largest height is below KM_BELOW (in size) holds kilometres.

    The largest of each tile is a partial aggregate that joins back, so no tile moves as a whole.
    """
    top = tiles.groupBy(tile).agg(F.max(z).alias("__top"))
    return tiles.join(top, tile).withColumn(z, F.when(F.abs("__top") < KM_BELOW, F.col(z) * 1000).otherwise(F.col(z))).drop("__top")


def mosaic(tiles: DataFrame, tile: str = "tile", z: str = "z", scale: bool = True, fill: int = 0) -> DataFrame:
    """row, col, z of tiles (tile, row, col, z) on one grid: where tiles overlap, the first with data counts.

    scale: tiles in kilometres are turned into metres.  fill: cells without data take the mean of the fill x fill window
    (odd size) around them, where that holds any.
    """
    rows = in_metres(tiles, tile, z) if scale else tiles
    out = rows.groupBy("row", "col").agg(F.min_by(z, F.when(F.col(z).isNotNull(), F.col(tile))).alias(z))
    if fill:
        from ..operators.focal import focal, mean

        out = focal(out, fill, z).select("row", "col", F.coalesce(F.col(z), mean()).alias(z))
    return out
