"""The landing-site pipeline: terrain, illumination, scoring, ranking; finished stages are kept and skipped on resume."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import decision, focal


@dataclass
class Mission:
    """Cell size (m), slope limit (degrees), least lit fraction, criteria weights, region area limits (km2)."""

    cell_m: float
    max_slope: float = 15.0
    least_light: float = 0.3
    weights: dict[str, float] = field(default_factory=lambda: {"slope": 0.4, "rms": 0.3, "light": 0.3})
    quantile: float = 0.7
    min_km2: float = 0.0
    top: int = 20


def stages(mission: Mission, azimuths: list[float], reach: int | None, sun: DataFrame) -> list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]:
    """(name, function of the results so far); ``dem`` (row, col, z) is there from the start."""
    m = mission
    km2 = m.cell_m * m.cell_m / 1e6

    def score(got: dict[str, DataFrame]) -> DataFrame:
        cells = got["terrain"].join(got["illumination"].select("row", "col", F.col("fraction").alias("light")), ["row", "col"])
        bad = (F.col("slope") > m.max_slope) | (F.col("light") < m.least_light)
        return decision.weighted_sum(cells, m.weights, ("slope", "rms"), bad, "score").select("row", "col", "score")

    return [
        ("terrain", lambda g: focal.slope(g["dem"], m.cell_m, m.cell_m).select("row", "col", "slope").join(focal.roughness(g["dem"], 5).select("row", "col", "rms"), ["row", "col"])),
        ("horizon", lambda g: focal.horizon_arrays(g["dem"], azimuths, m.cell_m, reach)),
        ("illumination", lambda g: focal.illumination(g["dem"], g["horizon"], sun)),
        ("score", score),
        ("ranking", lambda g: decision.rank_regions(g["score"], m.quantile, m.min_km2, km2, "score").where(F.col("rank") <= m.top)),
    ]


def run(spark: SparkSession, dem: DataFrame, plan: list, folder: str) -> dict[str, DataFrame]:
    """Runs the stages in order into folder; a stage whose table is complete is read, not run again."""
    got = {"dem": dem}
    for name, stage in plan:
        path = f"{folder.rstrip('/')}/{name}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            stage(got).write.mode("overwrite").parquet(path)
        got[name] = spark.read.parquet(path)
    return got
