"""Times the headline queries and prints one JSON line: median of three runs after a warm-up (one run where that took over two seconds), results counted in full."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from gridlore.operators import focal, rays  # noqa: E402
from gridlore.queries import QUERIES  # noqa: E402

HEADLINE = [
    "ek_equi_join", "ek_or_dedup", "ek_non_equi_join", "change_difference", "change_join", "photom_lunar_lambert", "photom_hapke_rough", "destripe_sub", "cubenorm_median", "zonal_stats", "percentile_threshold",
    "series_stack", "focal_stats", "roughness_rms", "slope_central", "terrain_hazard", "shadow_mask", "horizon_max", "illumination_fraction", "clump_2d", "crater_forward", "csfd_cumulative", "interval_merge", "interval_intersect",
    "interval_contains_join", "asof_last_le", "band_depth", "sam_topn", "pca_gram", "wlc_score", "topsis_score", "borda_cross_rank", "mc_rank1_prob", "set_union", "str_parse_lists", "coordinates_geodetic",
]
RUNS = 3
#: Queries on a grid that grows with the data: a square of as many cells as there are line items.
GRID = {
    "grid_horizon_8": lambda cells, side: rays.horizon_arrays(cells, [45.0 * k for k in range(8)], 10.0, None, 1737400.0),
    "grid_shadow": lambda cells, side: rays.shadow(cells, 40.0, 15.0, 10.0),
    "grid_sun_mask": lambda cells, side: rays.sun_mask(cells, 40.0, 60.0, 10.0, 10.0),
    "grid_viewshed": lambda cells, side: rays.viewshed(cells, side // 3, side // 2, 20.0),
    "grid_illumination_24": lambda cells, side: rays.illumination(cells, rays.horizon_arrays(cells, [90.0 * k for k in range(4)], 10.0, 100), SUN(cells.sparkSession)),
    "grid_focal": lambda cells, side: focal.focal(cells, 11),
}


def SUN(spark):
    return spark.range(24).select(F.col("id").alias("step"), (F.col("id") * 15.0).alias("azimuth"), (F.lit(20.0) + F.col("id") % 5).alias("elevation"))


def square(spark: SparkSession, side: int):
    """A rough surface of side x side cells."""
    r, c = F.floor(F.col("id") / side).cast("int"), (F.col("id") % side).cast("int")
    z = 300 * F.sin(r / 97.0) * F.cos(c / 71.0) + 40 * F.sin((r + c) / 13.0) + F.pmod(r * 7919 + c * 104729, F.lit(101)) / 10.0
    return spark.range(side * side).select(r.alias("row"), c.alias("col"), z.alias("z"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = os.environ.get("BENCH_SHARED", "/tmp/bench-shared")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    side = max(50, int(spark.read.parquet(f"{sf}/lineitem.parquet").count() ** 0.5))
    square(spark, side).write.mode("overwrite").parquet(f"{shared}/bench-grid")
    cells = spark.read.parquet(f"{shared}/bench-grid")

    def run(name: str) -> float:
        began = time.perf_counter()
        df = GRID[name](cells, side) if name in GRID else QUERIES[name](spark, sf)
        # every column of every row is computed, none is pruned by a count
        df.agg(F.sum(F.shiftright(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), 32))).collect()
        return time.perf_counter() - began

    took = {}
    for name in [*HEADLINE, *GRID]:
        runs = RUNS if run(name) < 2 else 1
        took[name] = round(statistics.median(run(name) for _ in range(runs)), 4)
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1], "cpus": int(cpus), "grid_cells": side * side, "spark": spark.version, "shuffle_partitions": int(cpus)}))


if __name__ == "__main__":
    main()
