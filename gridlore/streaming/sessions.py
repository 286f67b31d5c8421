"""An extension: the same event operators on unbounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """key, start, end, n, total of each session; late sets a watermark for streams."""
    src = events.withColumn(ts, F.col(ts).cast("timestamp"))
    src = src.withWatermark(ts, late) if late else src
    out = src.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None, by: str = "event_type", ts: str = "ts") -> DataFrame:
    """start, by, n, total of fixed windows."""
    src = events.withColumn(ts, F.col(ts).cast("timestamp"))
    src = src.withWatermark(ts, late) if late else src
    out = src.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")
